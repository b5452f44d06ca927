"""Structured streams: quality check, exact dedup, live windows, failure log. Every stream resumes from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import dedup
from ..operators.gates import counted, quality_check


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)


def checked(stream: DataFrame, mode: str = "clean") -> DataFrame:
    return quality_check(stream, mode)


def checked_and_counted(stream: DataFrame, name: str, mode: str = "clean") -> DataFrame:
    """checked, with its counters observed under a name, in the same pass: see Counters."""
    return counted(quality_check(stream, mode), name)


def distinct_texts(stream: DataFrame, time: str, text: str = "text", late: str = "1 hour") -> DataFrame:
    """The first of equal texts within the watermark; state is bounded by it."""
    return stream.withColumn("_h", F.md5(text)).withWatermark(time, late).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): tumbling windows of events (ts, event_type, value), as a stream or as a table."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withWatermark("ts", late) if df.isStreaming else df
    out = df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): sessions of users, closed by a gap without events."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withWatermark("ts", late) if df.isStreaming else df
    out = df.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> StreamingQuery:
    """Works off what is there and stops; the next run goes on after it."""
    return stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def with_failure_log(stream: DataFrame, good: str, bad: str, checkpoint: str, failed: str = "status = 'invalid'") -> StreamingQuery:
    """Two sinks from one pass: what passed and what failed. A batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where(f"not ({failed})").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where(failed).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Fixed value: how many kept signatures the scan of a growing collection looks back on.
LATEST = 50_000


def _snapshots(spark: SparkSession, state: str) -> list[int]:
    """The batches of which a snapshot of the state is there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(there)] if fs.exists(there) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))


def near_distinct(stream: DataFrame, good: str, state: str, checkpoint: str, key: str, text: str = "text", near: int = dedup.NEAR, latest: int = LATEST) -> StreamingQuery:
    """Near-duplicate removal over a stream: a row goes if its signature is near one of the `latest` newest that earlier
    batches kept, or one that its own batch keeps in key order.

    The state after a batch is a snapshot of these newest kept signatures, by batch and key; the next batch reads it and
    nothing older, so that a batch costs its own rows and the window, however many batches there were. A batch that
    runs again reads the snapshot before its own and replaces what it wrote; snapshots that no batch can ask for are
    deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        scratch = dedup.Scratch(spark, "near")
        signed = scratch.keep(batch.withColumn("signature", dedup.simhash(F.col(text))), "signed")
        before, kept, old = [n for n in _snapshots(spark, state) if n < number], signed, None
        if before:
            old = spark.read.schema(f"{key} {signed.schema[key].dataType.simpleString()}, signature long, since long").parquet(f"{state}/batch={before[-1]}")
            kept = scratch.keep(kept.join(dedup.near_any(signed.select(key, "signature"), old, key, near), key, "left_anti"), "new")
        heads = kept.where("signature is not null").groupBy("signature").agg(F.min(key).alias(key))
        chosen = scratch.keep(dedup.greedy(heads, dedup.near_edges(heads, key, near), key).where("kept").select(key), "chosen")
        out = kept.where("signature is null").unionByName(kept.join(chosen, key, "left_semi"))
        out.drop("signature").write.mode("overwrite").parquet(f"{good}/batch={number}")
        own = signed.select(key, "signature").join(chosen, key, "left_semi").withColumn("since", F.lit(number).cast("long"))
        window = (own if old is None else own.unionByName(old)).orderBy(F.desc("since"), F.desc(key)).limit(latest)
        window.write.mode("overwrite").parquet(f"{state}/batch={number}")
        for n in before[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/batch={n}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        scratch.clear()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Counters(StreamingQueryListener):
    """The counters of quality checks over the batches of streams, by the name of the observation, from the pass that
    writes the rows. spark.streams.addListener(Counters())."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}
        self._seen: set[tuple] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        batch = (str(event.progress.id), event.progress.batchId)
        if event.progress.observedMetrics and batch not in self._seen:  # a batch that runs again counts once
            self._seen.add(batch)
            for name, row in event.progress.observedMetrics.items():
                own = self.totals.setdefault(name, {})
                for c, n in row.asDict().items():
                    own[c] = own.get(c, 0) + (n or 0)

    def onQueryTerminated(self, event) -> None:
        pass
