"""The data source of document folders: ranges, filters, and a stream that takes each file once."""

import os
import random

from pyspark.sql import functions as F

from corpusmill.sources import corpus_files as cf


def write(path, content, when=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    if when is not None:
        os.utime(path, ns=(when, when))


def test_ranges_hold_each_line_once(spark, tmp_path):
    rng = random.Random(1)
    root, lines = tmp_path / "docs", {}
    for i in range(12):
        own = [bytes(rng.choice(b"abc \xe4") for _ in range(rng.choice([0, 3, 40, 300]))) for _ in range(rng.randrange(30))]
        write(root / f"sub{i % 3}" / f"f{i}.{'TXT' if i % 2 else 'txt'}", b"\n".join(own), 10**18 + i)
        lines[f"f{i}"] = b"\n".join(own)
    write(root / "a.docx", b"x" * 500)
    write(root / "none.txt", b"")
    write(root / "b.zip", b"no")
    write(root / "_temporary" / "c.txt", b"no")
    for size, task in ((7, 30), (64, 200), (1 << 20, 1 << 20)):
        df = cf.corpus_files(spark, str(root), range_bytes=size, task_bytes=task)
        rows = df.orderBy("path", "begin").collect()
        whole = {}
        for r in rows:
            whole[os.path.basename(r.path).split(".")[0]] = whole.get(os.path.basename(r.path).split(".")[0], b"") + bytes(r.content)
        assert whole == lines | {"a": b"x" * 500, "none": b""}
        assert all(bytes(r.content).endswith(b"\n") or r.begin + len(r.content) <= r.size for r in rows) and sum(r.suffix == "docx" for r in rows) == 1
        assert df.rdd.getNumPartitions() >= sum(map(len, lines.values())) // max(task, size)
    assert cf.corpus_files(spark, str(root), kinds="pdf").isEmpty() and cf.corpus_files(spark, f"file://{root}", kinds="zip").count() == 1


def test_filters_reach_the_listing(spark, tmp_path):
    for name in ("a/x.txt", "a/y.docx", "b/z.txt"):
        write(tmp_path / name, name.encode())
    df = cf.corpus_files(spark, str(tmp_path), task_bytes=1)
    assert df.rdd.getNumPartitions() == 3
    only = df.where(F.col("suffix") == "docx")
    assert [bytes(r.content) for r in only.collect()] == [b"a/y.docx"] and only.rdd.getNumPartitions() == 1
    assert sorted(bytes(r.content) for r in df.where(F.col("path").startswith(f"{tmp_path}/a/") & F.col("suffix").isin("txt", "pdf") & (F.col("size") > 2)).collect()) == [b"a/x.txt"]


def test_a_stream_takes_each_file_once(spark, tmp_path):
    root, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        stream = cf.corpus_stream(spark, str(root), range_bytes=8)
        stream.select("path", "begin", F.col("content").cast("string").alias("text")).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    write(root / "a.txt", b"one\ntwo\nthree\n", 10**18)
    write(root / "b.txt", b"four", 10**18 + 1)
    run()
    run()
    write(root / "c.txt", b"five\nsix", 10**18 + 2)
    write(root / "d.txt", b"seven", 10**18 + 2)
    run()
    got = sorted((os.path.basename(r.path), r.begin, r.text) for r in spark.read.parquet(out).collect() if r.text)
    assert "".join(t for n, _, t in got if n == "a.txt") == "one\ntwo\nthree\n" and sorted({n for n, *_ in got}) == ["a.txt", "b.txt", "c.txt", "d.txt"]
    assert len(got) == len(set(got)) and [t for n, _, t in got if n == "c.txt"] == ["five\nsix"]
