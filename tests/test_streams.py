"""Streams with state of their own, counters of one pass, appends of several writers."""

import random
import re
import threading
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusmill.operators import dedup, gates
from corpusmill.sources import sinks
from corpusmill.streaming import monitor, streams

EVENTS = "id long, kind string, value double, ts timestamp_ntz"


def events(spark, rows):
    return spark.createDataFrame(rows, "id long, kind string, value double, at string").select("id", "kind", "value", F.to_timestamp("at").alias("ts"))


def run_update(stream, checkpoint, into):
    def write(batch, number):
        into.extend(r.asDict() | {"batch": number} for r in batch.collect())

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_live_figures_equal_those_of_the_table(spark, tmp_path):
    rng = random.Random(3)
    stamp = lambda s: f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    rows = [(i, rng.choice(["a", "b"]), float(rng.randrange(50)), stamp(i * 30)) for i in range(200)] + [(1, "c", 2.5, stamp(10)), (7, None, 1.0, stamp(5)), (9, "a", None, stamp(5))]
    source, mark, out = str(tmp_path / "in"), str(tmp_path / "mark"), []
    for lo, hi in ((0, 120), (120, 200)):  # the second run goes on where the first one stopped
        events(spark, [r for k, r in enumerate(rows) if lo <= k < hi or (k >= 200 and lo == 0)]).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("id long, kind string, value double, ts timestamp").json(source)
        run_update(monitor.live_latest(stream, "kind", "id", "value", "ts", n=15, target=500, idle_seconds=1800), mark, out)
    want = {r.kind: r for r in monitor.latest_by(events(spark, rows), "kind", "id", "value", "ts", 15, 500).collect()}
    for kind in ("a", "b"):
        got = [r for r in out if r["kind"] == kind and not r["idle"]][-1]
        for name in ("total", "n", "upper_median", "first_half", "second_half", "trend", "rate", "seconds_left"):
            assert got[name] == pytest.approx(want[kind][name]), (kind, name)
    # c fell silent: one row says so when the watermark has passed it, with what it had
    idle = [r for r in out if r["idle"]]
    assert [(r["kind"], r["total"], r["rate"], r["upper_median"]) for r in idle] == [("c", 1, 0.0, 2.5)] and want["c"].rate is None and want["c"].first_half is None
    assert {r["kind"] for r in out} == {"a", "b", "c"}
    # rows behind the watermark are left out
    before = len(out)
    events(spark, [(500, "a", 9.0, "2023-12-31 00:00:00")]).coalesce(1).write.mode("append").json(source)
    run_update(monitor.live_latest(spark.readStream.schema("id long, kind string, value double, ts timestamp").json(source), "kind", "id", "value", "ts", n=15, target=500, idle_seconds=1800), mark, out)
    assert all(r["total"] < 1000 and r["kind"] != "a" for r in out[before:])


def test_latest_by_agrees_with_latest(spark):
    rows = [(i, "k", float(i * 7 % 11), f"2024-01-01 00:00:{i % 60:02d}") for i in range(31)]
    from corpusmill.operators.sampling import latest

    a = latest(events(spark, rows), 20, "id", "value").first()
    b = monitor.latest_by(events(spark, rows), "kind", "id", "value", "ts", 20).first()
    assert (a.n, a.upper_median, a.first_half, a.second_half, a.trend) == (b.n, b.upper_median, b.first_half, b.second_half, b.trend) and b.total == 31 and b.seconds_left is None
    assert monitor.latest_by(events(spark, rows).limit(0), "kind", "id", "value", "ts").isEmpty()


def test_counters_come_with_the_rows(spark, tmp_path):
    texts = ["good text " * 8, "", "x", "" * 30, "good  words here " * 5, "broken � text that is long enough", "1 + 1 = 2 " * 9, None, "環境报告中文内容 " * 9, "·" * 40]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "id long, text string")
    want = {r.status: r.n for r in gates.quality_check(rows).groupBy("status").agg(F.count("*").alias("n")).collect()}
    seen = Observation("qc")
    scans = gates.counted(gates.quality_check(rows), seen)
    scans.write.parquet(str(tmp_path / "out"))
    assert {s: n for s in ("valid", "salvaged", "invalid") if (n := seen.get[s])} == want
    assert seen.get["n"] == len(texts) * 3 == sum(seen.get[name] for name in gates.REASONS)
    rows.repartition(3).write.json(str(tmp_path / "in"))
    counters = streams.Counters()
    spark.streams.addListener(counters)
    try:
        stream = streams.read_stream(spark, str(tmp_path / "in"), "id long, text string", files=1)
        query = streams.run_available(streams.checked_and_counted(stream, "qc"), str(tmp_path / "good"), str(tmp_path / "mark"))
        query.awaitTermination()
        for _ in range(100):
            if counters.totals.get("qc", {}).get("n") == len(texts) * 3:
                break
            time.sleep(0.1)
        assert counters.totals["qc"] == seen.get and len(query.recentProgress) > 1
    finally:
        spark.streams.removeListener(counters)


def test_near_duplicates_of_a_stream_look_back_on_a_window(spark, tmp_path):
    rng = random.Random(5)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(6)]
    source, good, state, mark = (str(tmp_path / x) for x in ("in", "good", "state", "mark"))
    parts = [[(0, base[0]), (1, base[1]), (2, base[1] + " x")], [(3, base[2])], [(4, base[3]), (5, base[0] + " x")], [(6, base[4])], [(7, base[2] + " y"), (8, "short"), (9, "short")]]
    for part in parts:
        spark.createDataFrame(part, "id long, text string").coalesce(1).write.mode("append").json(source)
        streams.near_distinct(streams.read_stream(spark, source, "id long, text string"), good, state, mark, "id", near=6, latest=2).awaitTermination()
        assert spark.read.parquet(state).count() <= 2 * 2 and len(streams._snapshots(spark, state)) <= 2  # no batch finds more
    # 5 is near 0, which has left the window of two; 7 is near 3, which has left it too
    assert sorted(r.id for r in spark.read.parquet(good).collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9]


def test_ledger_holds_each_key_once(spark, tmp_path):
    ledger = sinks.Ledger(spark, str(tmp_path / "t"))
    assert ledger.read() is None and ledger.append(spark.range(5), "id", "first") and not ledger.append(spark.range(9), "id", "first")
    assert sorted(r.id for r in ledger.read().collect()) == list(range(5))
    done = []
    writers = [threading.Thread(target=lambda k=k: done.append(sinks.Ledger(spark, ledger.path).append(spark.range(k, k + 20).unionByName(spark.range(k, k + 3)), "id", f"run {k}"))) for k in (0, 10)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert done == [True, True] and sorted(r.id for r in ledger.read().collect()) == list(range(30)) and len(ledger.commits()) == 3
    spark.range(3).write.parquet(f"{ledger.path}/parts/left-by-a-writer-that-died")
    assert ledger.read().count() == 30 and ledger.vacuum() == 1 and ledger.vacuum() == 0
    # a number goes to one of many
    taken = []
    rivals = [threading.Thread(target=lambda k=k: taken.append(sinks.Ledger(spark, f"{ledger.path}/race")._commit(0, {"run": str(k), "part": "p"}))) for k in range(12)]
    for r in rivals:
        r.start()
    for r in rivals:
        r.join()
    assert sorted(taken) == [False] * 11 + [True] and len(sinks.Ledger(spark, f"{ledger.path}/race").commits()) == 1
    # whoever finds the number taken works its rows out anew
    stale, real = sinks.Ledger(spark, ledger.path), ledger.commits()
    views = iter([real[:-1], real])
    stale.commits = lambda: next(views)
    assert stale.append(spark.range(28, 33), "id", "late") and sorted(r.id for r in ledger.read().collect()) == list(range(33))
    nulls = spark.createDataFrame([(None,), (None,), (1,)], "id long")
    assert ledger.append(nulls, "id", "nulls") and ledger.append(nulls, "id", "nulls again") and ledger.read().where("id is null").count() == 1


def test_lines_of_a_text_are_deduplicated_in_order(spark):
    rng = random.Random(8)
    texts = ["\n".join(rng.choice(["a", " a ", "b", "", "  ", "c\t", "a\r", "é"]) for _ in range(rng.randrange(9))) for _ in range(150)] + [None, "", "\n", "\n\n", "one"]
    got = dedup.dedup_lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    for t, r in zip(texts, got, strict=True):
        seen, kept = set(), []
        for line in re.split("\n", t or ""):
            if line.strip() and line.strip() in seen:
                continue
            seen.add(line.strip())
            kept.append(line)
        assert (r.text, r.line_dedup_removed) == ("\n".join(kept), len(re.split("\n", t or "")) - len(kept)), t
    long = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.lit("line "), (i % 50_000).cast("string"))), "\n").alias("text"))
    began = time.time()
    assert dedup.dedup_lines(long).select("line_dedup_removed").first()[0] == 50_000 and time.time() - began < 20


def test_running_sums_and_what_stands_on_them(spark):
    from corpusmill.operators import ranges, sampling, stats

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, float(rng.randrange(9))])) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(3)
    got = {r.k: r for r in ranges.running_sums(df, ["g"], ["k"], s=F.col("v"), n=F.lit(1)).collect()}
    means = {r.k: r.running_mean for r in sampling.running_mean(df, "g", "k", "v").collect()}
    for g in ("a", "b", None):
        total, n, seen = 0.0, 0, []
        for _, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            total, n, seen = total + (v or 0), n + 1, seen + ([v] if v is not None else [])
            assert (got[k].s, got[k].n) == (total, n) and means[k] == (pytest.approx(sum(seen) / len(seen)) if seen else None)
    assert [r.k for r in sampling.batch(df, 3, 40, "k").orderBy("k").collect()] == list(range(80, 120)) and sampling.batch(df, 9, 40, "k").isEmpty()
    assert ranges.running_sums(df.limit(0), [], ["k"], n=F.lit(1)).isEmpty()
    pairs = spark.createDataFrame([("m", i, float(rng.randrange(40)), float(rng.randrange(40))) for i in range(200)], "metric string, i int, va double, vb double")
    d = [(r.va - r.vb) for r in pairs.collect() if r.va != r.vb]
    size = sorted(abs(x) for x in d)
    rank = lambda x: sum(k + 1 for k, y in enumerate(size) if y == x) / size.count(x)
    assert stats.wilcoxon(pairs, "metric").first().w_plus == pytest.approx(sum(rank(x) for x in d if x > 0))


def test_sketches_merge(spark):
    from corpusmill.operators import metrics

    rng = random.Random(7)
    rows = [(("en", "de")[i % 2], i % 5, "".join(rng.choice("abcdefghijklmnop ") for _ in range(200))) for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, part int, text string")
    for n in (1, 2, 3):
        exact = {r[0]: r[1] for r in metrics.distinct_n(df, "text", n, ["lang"]).collect()}
        parts = metrics.distinct_sketches(df, "text", n, ["lang", "part"])
        merged = {r[0]: r[1] for r in metrics.distinct_of(parts, ["lang"], n).collect()}
        whole = {r[0]: r[1] for r in metrics.distinct_of(metrics.distinct_sketches(df, "text", n, ["lang"]), ["lang"], n).collect()}
        assert set(exact) == set(merged) and all(merged[k] == pytest.approx(v, rel=0.03) and merged[k] == pytest.approx(whole[k], rel=0.03) for k, v in exact.items()), n


def test_phrases_before_characters(spark):
    from corpusmill.functions import text as T

    pairs = {"後": "后", "乾": "干", "髮": "发", "發": "发", "著": "着"}
    phrases = {"乾坤": "乾坤", "著作": "著作", "乾": "干", "乾隆年間": "乾隆年间", "乾隆": "乾隆"}
    texts = ["乾坤之後", "乾燥著作", "看著乾隆年間的著作", "乾隆髮", "plain", "", None, "乾"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.select("i", T.to_simplified_phrases(F.col("t"), phrases, pairs).alias("x")).orderBy("i").collect()]
    assert got == ["乾坤之后", "干燥著作", "看着乾隆年间的著作", "乾隆发", "plain", "", None, "干"]
    assert [r.x for r in df.select(T.to_simplified_phrases(F.col("t"), {}).alias("x"), "i").orderBy("i").collect()] == texts
    long = spark.range(1).select(T.to_simplified_phrases(F.repeat(F.lit("乾隆年間乾"), 200_000), phrases).alias("x")).first().x
    assert long == "乾隆年间干" * 200_000
