"""Writing: JSON lines, audit logs, metric tables, LaTeX tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import running_sums
from ..operators.sampling import unprocessed


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key isn't there yet; Spark's committer makes each append whole or nothing."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        df = unprocessed(df, spark.read.parquet(path), key)
    df.write.mode("append").parquet(path)


class Ledger:
    """A table that several writers append to, each key once. Its folder holds parts and numbered commits; a commit names
    its run and its part. A part counts when its commit is there, and a commit's number goes to whoever first moves a
    finished file to it: a rename that fails where the target is there, as HDFS has it, a hard link on a local disk
    (object stores need conditional writes instead). So an append is whole or nothing, one that lost the race is worked
    out anew over what is there now, and a run that is repeated after its commit does nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def commits(self) -> list[dict]:
        """{run, part} of the commits in order."""
        out: list[dict] = []
        while self._fs.exists(at := self._at(f"commits/{len(out):08d}")):
            stream = self._fs.open(at)
            try:
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            out.append(json.loads(text))
        return out

    def read(self, commits: list[dict] | None = None) -> DataFrame | None:
        """The rows of all committed parts; None where nothing has been committed."""
        parts = [f"{self.path}/parts/{c['part']}" for c in (self.commits() if commits is None else commits)]
        return self.spark.read.parquet(*parts) if parts else None

    def append(self, df: DataFrame, key: str, run: str) -> bool:
        """Appends the rows of a run whose key isn't there yet, of repeated keys one row; False where the run was
        committed before. Null keys are a key of their own."""
        while True:
            commits = self.commits()
            if any(c["run"] == run for c in commits):
                return False
            there, new = self.read(commits), df.dropDuplicates([key])
            if there is not None:
                keys = there.select(F.col(key).alias("_k")).distinct()
                new = new.join(keys, new[key].eqNullSafe(F.col("_k")), "left_anti")
            part = uuid.uuid4().hex
            new.write.parquet(f"{self.path}/parts/{part}")
            if self._commit(len(commits), {"run": run, "part": part}):
                return True
            self._fs.delete(self._at(f"parts/{part}"), True)

    def _commit(self, number: int, commit: dict) -> bool:
        own, target = self._at(f"commits/.{uuid.uuid4().hex}"), self._at(f"commits/{number:08d}")
        stream = self._fs.create(own, False)
        stream.write(json.dumps(commit).encode())
        stream.close()
        try:
            if self._fs.getUri().getScheme() != "file":
                return not self._fs.exists(target) and self._fs.rename(own, target)
            local = lambda path: self._jvm.java.io.File(path.toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(local(target), local(own))
            return True
        except Exception as error:  # the number is taken
            if "FileAlreadyExists" in str(error):
                return False
            raise
        finally:
            self._fs.delete(own, False)

    def vacuum(self) -> int:
        """Deletes the parts that no commit names, of appends that failed; only while nobody appends."""
        named = {c["part"] for c in self.commits()}
        there = [s.getPath() for s in self._fs.listStatus(self._at("parts"))] if self._fs.exists(self._at("parts")) else []
        gone = [p for p in there if p.getName() not in named]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def write_audit(audit: DataFrame, path: str) -> None:
    audit.write.partitionBy("action").json(path)


def write_csv(df: DataFrame, path: str, separator: str = "|") -> None:
    """With a header; null is empty, arrays are joined."""
    flat = [F.array_join(c, separator).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.option("header", True).option("nullValue", "").csv(path)


def union_of_keys(records: DataFrame, key: str, value: str, by: list[str], names: list[str] | None = None) -> DataFrame:
    """A wide table of long metric rows (by ..., key, value): a column for every key that any row has, sorted, null where
    a row of `by` lacks it. Without names one job asks for the keys, of which there are as many as metrics."""
    names = sorted(r[0] for r in records.select(key).distinct().collect()) if names is None else names
    return records.groupBy(*by).pivot(key, names).agg(F.first(value))


def write_metrics(wide: DataFrame, path: str) -> None:
    """A metric table as JSON lines and as CSV, side by side."""
    write_jsonl(wide, f"{path}/json")
    write_csv(wide, f"{path}/csv")


def latex_table(wide: list[dict], label: str, metrics: list[str], digits: int = 4) -> str:
    """A table of a few rows, the best of each column in bold."""
    best = {m: max((r[m] for r in wide if r.get(m) is not None), default=None) for m in metrics}

    def cell(r: dict, m: str) -> str:
        v = r.get(m)
        shown = "--" if v is None else f"{v:.{digits}f}"
        return rf"\textbf{{{shown}}}" if v is not None and v == best[m] else shown

    head = " & ".join([label, *metrics]) + r" \\"
    rows = [" & ".join([str(r[label]), *(cell(r, m) for m in metrics)]) + r" \\" for r in wide]
    return "\n".join([r"\begin{tabular}{l" + "r" * len(metrics) + "}", r"\toprule", head, r"\midrule", *rows, r"\bottomrule", r"\end{tabular}"])


def latex_lines(wide: DataFrame, label: str, metrics: list[str], digits: int = 4) -> DataFrame:
    """(place, line): the same table as rows, by label; a row for each line, so that the table may be of any length. The
    best of a column come from one pass, a null is `--`, of equally good cells each is in bold."""
    best = wide.agg(*(F.max(m).alias(f"_{m}") for m in metrics))
    shown = lambda m: F.format_string(f"%.{digits}f", F.col(m).cast("double"))
    cells = [F.when(F.col(m).isNull(), "--").when(F.col(m) == F.col(f"_{m}"), F.concat(F.lit(r"\textbf{"), shown(m), F.lit("}"))).otherwise(shown(m)) for m in metrics]
    rows = wide.crossJoin(F.broadcast(best))  # one row
    rows = running_sums(rows.select(F.col(label).cast("string").alias("_label"), F.concat(F.concat_ws(" & ", F.col(label).cast("string"), *cells), F.lit(r" \\")).alias("line")), [], ["_label", "line"], place=F.lit(1))
    head = [r"\begin{tabular}{l" + "r" * len(metrics) + "}", r"\toprule", " & ".join([label, *metrics]) + r" \\", r"\midrule"]
    fixed = wide.sparkSession.createDataFrame([(k - len(head) + 1, x) for k, x in enumerate(head)] + [(None, r"\bottomrule"), (None, r"\end{tabular}")], "place int, line string")
    last = wide.agg(F.count("*").alias("_n"))
    foot = F.col("_n") + F.when(F.col("line") == r"\bottomrule", 1).otherwise(2)
    fixed = fixed.crossJoin(F.broadcast(last)).select(F.coalesce("place", foot).cast("long").alias("place"), "line")  # one row
    return rows.select(F.col("place").cast("long").alias("place"), "line").unionByName(fixed)
