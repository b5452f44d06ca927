"""Routing, knowledge, generation, metrics, statistics, samples, sources and streams on small rows."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import calls, dedup, gates, generation, knowledge, metrics, replies, routing, sampling, stats
from corpusmill.sources import files, sinks
from corpusmill.streaming import streams


def test_routing_defaults_and_ties(spark):
    df = spark.createDataFrame([(1, ""), (2, "公司员工环保治理碳排放对比比较差异。2020 2021 2022 10%" * 3), (3, None)], "doc_id int, text string")
    rows = routing.route(df).orderBy("doc_id").collect()
    assert rows[0].experts == ["qa_expert"] and rows[2].experts == ["qa_expert"]  # all scores equal: catalogue order
    assert rows[1].experts[0] == "analysis_expert" and "consistency_verification_expert" in rows[1].experts
    assert all(1 <= len(r.experts) <= 3 for r in routing.route(df, "rule", least=1, most=3).collect())
    assert [len(r.experts) for r in routing.route(df, least=2, most=3).orderBy("doc_id").collect()][0] == 2


def test_knowledge_order_and_cut(spark):
    df = spark.createDataFrame([("a", "ESG指标 GRI 碳排放 员工 能源 合规"), ("b", "nothing"), ("c", None)], "chunk_id string, text string")
    base = spark.createDataFrame([("n1", "d1", "碳排放 text"), ("n2", "d2", "none")], "name string, description string, text string")
    rows = {r.chunk_id: r.knowledge for r in knowledge.retrieve(df, base).collect()}
    assert [k.type for k in rows["a"]] == ["entity", "keyword", "keyword", "keyword", "keyword"] and rows["a"][0].content == "Entity: n1 - d1"
    assert rows["b"] == [] and rows["c"] == []


def test_replies(spark):
    said = ["Question: a?\nAnswer: b", "问题：甲\n答案：乙", "Question: x\nQuestion: y\nAnswer: z", "no labels at all", "first block\n\nsecond block", ""]
    df = spark.createDataFrame(list(enumerate(said)), "i int, r string")
    got = [(r.p.instruction, r.p.response) for r in df.select("i", replies.read(F.col("r"), "qa_expert").alias("p")).orderBy("i").collect()]
    assert got == [("a?", "b"), ("甲", "乙"), ("y", "z"), ("Answer the following question.", "no labels at all"), ("first block", "second block"), ("Answer the following question.", "")]
    many = spark.createDataFrame([("Instruction: do\nAnswer: one long line\nand more",), ("Answer: short",)], "r string")
    assert [tuple(r.p) for r in many.select(generation.parse_multiline(F.col("r")).alias("p")).collect()] == [("do", "one long line\nand more"), ("Analyze the following ESG-related content.", "Answer: short")]


def test_generation_survives_failures(spark):
    def broken(prompt, text):
        raise RuntimeError("down")

    text = "The company reports its emissions. They fell by 15% in 2020. More water was saved than planned. " * 2
    df = spark.createDataFrame([("a", text), ("b", "short")], "chunk_id string, text string")
    good = generation.pairs(df).collect()
    assert len(good) == 1 and good[0].status == "success" and good[0].quality_score > 0.5
    assert generation.pairs(df, broken).collect()[0].status == "exception"
    assert generation.pairs(df, mode="sequential").collect()[0].quality_score > 0.5
    assert {r.method for r in generation.baseline(df, "self_instruct").collect()} == {"self_instruct"}
    grid = [("experts", "K=1", 1, "parallel", 2, True), ("knowledge", "off", 3, "parallel", 2, False)]
    assert {r.condition for r in generation.ablation(df, grid=grid).collect()} == {"K=1", "off"}


def test_lcs_and_scores(spark):
    def table(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
        assert metrics.lcs(a, b) == table(a, b)
    df = spark.createDataFrame([("in 2020 we had 5", "2020 and 7"), (None, None), ("", "x")], "response string, source string")
    assert [r[0] for r in df.select(metrics.factcheck_numbers(F.col("response"), F.col("source"))).collect()] == [0.5, 1.0, 1.0]
    assert all(0 <= r.quality <= 1 for r in metrics.composite(df).collect())
    with pytest.raises(ValueError):
        metrics.composite(df, weights={"fidelity": 0.3})


def test_statistics(spark):
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate([0.0, 0.0, 0.0])] + [("k", i, float(i)) for i in range(1, 9)], "metric string, s int, va double").withColumn("vb", F.lit(0.0))
    rows = {r.metric: r for r in stats.wilcoxon(df, "metric").collect()}
    assert rows["m"].p == 1.0 and rows["k"].w_plus == 36.0 and rows["k"].p < 0.02
    ci = {r.metric: r for r in stats.bootstrap_ci(df, "metric", "va", "s", draws=300).collect()}
    assert ci["m"].low == ci["m"].high == 0.0 and ci["k"].low < 4.5 < ci["k"].high
    w = {r.metric: r for r in stats.welch(df, "metric", "va", "k").collect()}
    assert w["k"].t is None and w["m"].t < 0
    h = stats.histogram(spark.createDataFrame([(5,), (200,), (None,)], "n int"), F.col("n"), stats.CHAR_RANGES).orderBy("bin").collect()
    assert [r.n for r in h] == [1, 1, 0, 0, 0, 0]


def test_samples(spark):
    df = spark.range(1000).withColumn("g", (F.col("id") % 7).cast("int"))
    small, large = ({r.id for r in sampling.sample(df, n, "id").collect()} for n in (50, 200))
    assert small < large and len(large) == 200
    counts = {(r.g, r.split): r.n for r in sampling.split(df, "id", 0.05, "g").groupBy("g", "split").agg(F.count("*").alias("n")).collect()}
    assert all(counts[g, "eval"] == 7 for g in range(7))
    three = {r.split: r.n for r in sampling.split_three(df, "id").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert three == {"val": 50, "test": 50, "train": 900}
    with pytest.raises(ValueError):
        sampling.coverage(df.withColumn("x", F.array("g")), "x", list("abc"), 2, "id", "id")


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.txt").write_bytes("环境报告 2020 年，公司治理。".encode("gbk"))
    (tmp_path / "a/two.txt").write_text("plain text")
    (tmp_path / "a/skip.bin").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "table.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell("a")}{cell(" b ")}</w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    assert [r.doc_id for r in files.listing(spark, str(tmp_path)).collect()] == ["a_one", "a_two", "broken", "table"]
    found = {r.doc_id: r for r in files.parse_files(files.list_files(spark, str(tmp_path))).collect()}
    assert {k: r.text for k, r in found.items()} == {"a_one": "环境报告 2020 年，公司治理。", "a_two": "plain text", "table": "First line\na b", "broken": ""}
    assert found["broken"].error.startswith("BadZipFile") and found["table"].error is None
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["not json"]
    raw = spark.createDataFrame([('{"instruction": "", "question": "q", "output": "o", "metadata": {"experts": ["e"], "quality_score": 0.5}}',)], "v string")
    r = raw.select(files.tolerant(F.col("v")).alias("r")).first().r
    assert (r.instruction, r.response, r.experts, r.quality_score) == ("q", "o", ["e"], 0.5)
    out = str(tmp_path / "out")
    sinks.append_new(spark.range(5), out, "id")
    sinks.append_new(spark.range(8), out, "id")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))
    assert r"\textbf{0.9000}" in sinks.latex_table([{"m": "a", "f1": 0.5}, {"m": "b", "f1": 0.9}], "m", ["f1"])


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.createDataFrame([(i, "good text " * 5 if i % 3 else "") for i in range(30)], "id int, text string")
    rows.where("id < 15").write.json(source)
    run = lambda: streams.run_available(streams.checked(streams.read_stream(spark, source, "id int, text string")), out, mark).awaitTermination()
    run()
    rows.where("id >= 15").write.mode("append").json(source)
    run()
    got = sorted((r.id, r.status) for r in spark.read.parquet(out).collect())
    want = sorted((r.id, r.status) for r in streams.checked(rows).collect())
    assert got == want


def test_columns_and_functions_read_replies_alike(spark):
    rng = random.Random(31)
    parts = ["指令：", "指令:", "Instruction: ", " instruction:", "问题：甲：乙", "Question: ", "答案:", "Answer: x: y", "ANSWER:", "摘要：", "Summary: s", "提取结果：r", "Extraction result: e", "the classification result: c", "分类结果", "Analysis result:", "分析结果: z", "回答：a:b", "\n", "\n\n", "text", "：", ":", "　"]
    said = ["".join(rng.choice(parts) + rng.choice(["", "\n", " w "]) for _ in range(rng.randrange(7))) for _ in range(120)] + [None, ""]
    rows = [(i, e, r) for i, (e, r) in enumerate((e, r) for e in [*replies.READERS, "unknown"] for r in said)]
    df = spark.createDataFrame(rows, "i int, e string, r string")
    got = {r.i: tuple(r.p) for r in df.select("i", replies.read_any(F.col("e"), F.col("r")).alias("p")).collect()}
    assert got == {i: replies.read_text(r, e) for i, e, r in rows}
    replies.register("extra_expert", "reserved", "Extra expert", "Do this.", "summary", default="Sum up.")
    assert replies.read_text("Summary: s", "extra_expert") == ("Sum up.", "s")
    replies.READERS.pop("extra_expert"), replies.WANTED.pop("extra_expert"), routing.V.EXPERTS.pop()
    with pytest.raises(ValueError):
        replies.register("x", "base", "x", "x", "no such form")


def test_marks(spark):
    said = ["指令：总结以下内容\n回答：这是一个足够长的答复内容", "指令：短\n回答：x", "1. 指令: 分析全文内容\n2. 回答: 第一部分内容足够长的一句话", "no marks in this reply", "回答\n前面没有标记的内容也要够长才行", None]
    want = [("总结以下内容", "这是一个足够长的答复内容"), ("Analyze the following ESG-related content", said[1]), ("分析全文内容 2.", "第一部分内容足够长的一句话"), ("Analyze the following ESG-related content", said[3]), ("Analyze the following ESG-related content", "前面没有标记的内容也要够长才行"), ("Analyze the following ESG-related content", "")]
    df = spark.createDataFrame(list(enumerate(said)), "i int, r string")
    assert [tuple(r.p) for r in df.select("i", replies.read_marks(F.col("r")).alias("p")).orderBy("i").collect()] == want


def test_calls_wait_and_try_again():
    now, slept = [1000.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = calls.Limiter(gap=12, a_minute=3, a_day=6, clock=lambda: now[0], sleep=sleep)
    times = []
    for _ in range(6):
        limiter.wait()
        times.append(now[0])
    assert all(b - a >= 12 for a, b in zip(times, times[1:], strict=False)) and all(b - a >= 60 for a, b in zip(times, times[3:], strict=False))
    with pytest.raises(calls.DailyLimit):
        limiter.wait()
    now[0] += calls.DAY
    limiter.wait()
    errors, slept[:] = [RuntimeError("429 too many"), RuntimeError("SSL EOF"), None], []

    def flaky(prompt, text):
        if (e := errors.pop(0)) is not None:
            raise e
        return "fine"

    assert calls.retrying(flaky, sleep=slept.append)("p", "t") == "fine" and slept == [10.0, 10.0]
    errors[:] = [RuntimeError("bad key"), None]
    with pytest.raises(RuntimeError, match="bad key"):
        calls.retrying(flaky, sleep=slept.append)("p", "t")
    errors[:] = [RuntimeError("timeout")] * 3
    with pytest.raises(RuntimeError, match="timeout"):
        calls.retrying(flaky, sleep=slept.append)("p", "t")


def test_batches_resume_and_log_failures(spark, tmp_path):
    text = "The company reports its emissions. They fell by 15% in 2020. More water was saved than planned. " * 2
    df = spark.createDataFrame([(f"c{i}", text if i % 4 else "  ") for i in range(12)], "chunk_id string, text string")
    out, lost = str(tmp_path / "out"), str(tmp_path / "lost")

    def picky(prompt, said):
        if len(prompt) % 2 and "Summarise" in prompt:
            raise RuntimeError("down")
        return generation.extractive(prompt, said)

    counts = {r.status: r.n for r in generation.run_batches(df.limit(6), out, lost, picky, batches=2).collect()}
    assert counts["success"] >= 4 and counts["skipped_empty_chunk"] == 2
    counts = {r.status: r.n for r in generation.run_batches(df, out, lost, batches=3).collect()}
    assert counts == {"success": 9, "skipped_empty_chunk": 3}
    assert sorted(r.chunk_id for r in spark.read.parquet(out).collect()) == sorted(f"c{i}" for i in range(12) if i % 4)


def test_baselines_and_dynamic_instructions(spark):
    df = spark.createDataFrame([("a", "The company reports its emissions. They fell by 15%."), ("b", "")], "chunk_id string, text string")
    for method in ("direct", "self_instruct", "evol", "alpaca", "api_direct"):
        rows = generation.baseline(df, method).collect()
        assert len(rows) == 2 and {r.method for r in rows} == {method}
    prompt = df.select(knowledge.alpaca_prompt(F.lit("问"), F.col("text"), "zh", F.lit("答")).alias("p")).collect()
    assert "### 输入：" in prompt[0].p and "### 输入" not in prompt[1].p and prompt[1].p.endswith("### 回复：\n答")
    asked = df.withColumn("expert", F.lit("qa_expert")).withColumn("prompt", generation.instruction_prompt(F.col("expert"), F.col("text"), F.array(F.lit("ESG")), F.array(F.lit("qa_expert"), F.lit("summary_expert"))))
    assert "summary_expert" in asked.first().prompt
    assert {r.instruction for r in generation.instructions(asked).collect()} == {"Generate a high-quality Q&A pair based on the text."}
    assert {r.instruction for r in generation.instructions(asked, lambda p, t: "Work instruction: look at water").collect()} == {"look at water"}


def test_baselines_take_all_their_calls(spark):
    def says(prompt, text):
        return f" <{prompt.replace(text, 'T')}> "

    df = spark.createDataFrame([("a", "The company reports its emissions."), ("b", "x {y}")], "chunk_id string, text string")
    got = {(r.chunk_id, r.method): r for r in generation.baselines(df, generator=says).collect()}
    assert len(got) == 10
    for key in "ab":
        first = "<Write an instruction for the text.\n\nText:\nT>"
        once = f"<Make this instruction harder: {first}\n\nText:\nT>"
        twice = f"<Make this instruction harder: {once}\n\nText:\nT>"
        assert got[key, "evol"].instruction == twice and got[key, "evol"].evolution_rounds == 2
        assert got[key, "evol"].output == f"<Instruction: {twice}\n\nInput: T\n\nGenerate the response.>"
        asked = "<Write one instruction for the text, and nothing else.\n\nText:\nT>"
        assert got[key, "alpaca"].instruction == asked and f"### Instruction:\n{asked}\n\n### Input:\nT\n" in got[key, "alpaca"].output
        assert got[key, "self_instruct"].seed_instruction in generation.SEEDS
    prompt = df.select(knowledge.alpaca_prompt(F.lit("do {x}"), F.col("text")).alias("p")).collect()
    assert [r.p for r in prompt] == [knowledge.alpaca_text("do {x}", t) for t in ("The company reports its emissions.", "x {y}")]


def test_baseline_records_has_every_record(spark):
    from corpusmill.plans import more

    rows = more.QUERIES["baseline_records"](spark, "/root/testdata/sf0.001").select("chunk_id", "method").collect()
    chunks = {r.chunk_id for r in more.QUERIES["chunk_docs"](spark, "/root/testdata/sf0.001").where("doc_id >= 0").collect()}
    assert sorted((r.chunk_id, r.method) for r in rows) == sorted((c, m) for c in chunks for m in ("direct", "self_instruct", "evol", "alpaca", "api_direct"))


def test_bleu_rubric_and_stems(spark):
    import math

    pairs = [("abcd abce", "abcd abcf"), ("x", "abc"), ("", "abc"), ("zzzzzz", "abcdef")]
    df = spark.createDataFrame([("g", c, r) for c, r in pairs] + [("h", "zz", "ab")], "g string, c string, r string")
    logs = []
    for n in range(1, 5):
        hit = total = 0
        for c, r in pairs:
            a, b = ([x[i : i + n] for i in range(len(x) - n + 1)] for x in (c, r))
            hit += sum(min(a.count(g), b.count(g)) for g in set(a))
            total += max(len(a), 1)
        logs.append(math.log((hit or 0.1) / total))
    c, r = (sum(len(p[k]) for p in pairs) for k in (0, 1))
    want = (1 if c > r else math.exp(1 - r / c)) * math.exp(sum(logs) / 4)
    got = {x.g: x.bleu4 for x in metrics.corpus_bleu4(df, "c", "r", ["g"]).collect()}
    assert abs(got["g"] - want) < 1e-12 and got["h"] == 0.0
    assert [metrics.stem(w) for w in ("relational", "hopping", "caresses", "happy", "controlling", "sky")] == ["relat", "hop", "caress", "happi", "control", "sky"]
    rounds = spark.createDataFrame([("a", 0, 0.5, 0.5, 0.5, 0.5), ("a", 1, 0.9, 0.8, 0.7, 0.6), ("a", 2, 0.9, 0.8, 0.7, 0.6), ("b", 0, 0.1, 0.1, 0.1, 0.1), ("c", 0, None, 1.0, 1.0, 1.0)], "id string, round int, correctness double, completeness double, relevance double, structure double")
    best = metrics.best_round(rounds, "id").collect()
    assert [(x.id, x.round) for x in best] == [("a", 1)] and abs(best[0].overall - 0.8) < 1e-9
    assert metrics.rubric(rounds).where("id = 'c' and overall is null and feedback is null").count() == 1
    assert metrics.model_scores(df).where("bertscore is null and bleurt is null").count() == 5


def test_tests_of_significance(spark):
    from itertools import product

    for n in (1, 4, 8):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in product((0, 1), repeat=n)]
        for w in (0, n, n * (n + 1) // 2):
            low, high = sum(s <= w for s in sums) / len(sums), sum(s >= w for s in sums) / len(sums)
            assert abs(stats.signed_rank_p(w, n) - min(1.0, 2 * min(low, high))) < 1e-12
    df = spark.createDataFrame([("m", i, float(i % 7) + 1, 0.5) for i in range(400)] + [("z", i, 1.0, 1.0) for i in range(20)], "metric string, s int, va double, vb double")
    ci = {r.metric: r for r in stats.bootstrap_ci(df, "metric", "va", "s", draws=500).collect()}
    half = 1.96 * 2.0 / 20
    assert abs(ci["m"].low - (ci["m"].mean - half)) < 0.06 and abs(ci["m"].high - (ci["m"].mean + half)) < 0.06
    again = {r.metric: r for r in stats.bootstrap_ci(df.repartition(7), "metric", "va", "s", draws=500).collect()}
    assert abs(again["m"].low - ci["m"].low) < 1e-9
    p = {r.metric: r.p for r in stats.paired_bootstrap(df, "metric", "s", draws=300).collect()}
    assert 0.3 < p["m"] < 0.7 and p["z"] == 1.0
    t = spark.createDataFrame([(0.5, 100.0), (2.1, 1e6), (2.7, 1e6), (-4.0, 1e6), (2.1, 5.0), (None, None)], "t double, df double")
    assert [r[0] for r in t.select(stats.stars(F.col("t"), F.col("df"))).collect()] == ["", "*", "**", "***", "", None]


def test_percentiles_and_first_of_groups(spark):
    import numpy as np

    rng = random.Random(2)
    values = [rng.choice([rng.randrange(50), rng.random() * 1000]) for _ in range(997)] + [None]
    df = spark.createDataFrame([(i, None if v is None else float(v), i % 5) for i, v in enumerate(values)], "id long, v double, g int")
    r = stats.percentiles(df, "v").first()
    for p in (0, 25, 50, 75, 90, 95, 99, 100):
        assert abs(r[f"p{p}"] - np.percentile(values[:-1], p)) < 1e-9
    assert abs(r["mean"] - np.mean(values[:-1])) < 1e-9
    from hashlib import md5

    place = lambda i: (md5(f"{i}|42".encode()).hexdigest(), i)
    got = {r.id for r in sampling.first_of_groups(df, ["g"], F.col("g") * 30, "id").where("_in").collect()}
    want = {i for g in range(5) for i in sorted((i for i in range(998) if i % 5 == g), key=place)[: g * 30]}
    assert got == want
    best = sampling.good_sample(df, 5, "id", "v", 40.0, 300).collect()
    assert len(best) == 5 and all(r.v >= 40 and r.id < 300 for r in best)
    runs = spark.createDataFrame([("m1", "b", 7.0), ("m2", "a", 70.0), ("m3", "a", 7.0), ("m4", "c", 1.0)], "name string, tier string, params double")
    assert [r.name for r in sampling.plan(runs, ["a", "b"]).orderBy("place").collect()] == ["m3", "m2", "m1"]


def test_keep_fuller_and_signature_masks(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(60)]
    texts = [" ".join(base), " ".join(base + ["more"]), " ".join(base[:-1]), " ".join(base + ["more"]), "short", " ".join(rng.sample(base, 60)), None, ""]
    got = {r.doc_id: r.kept for r in dedup.keep_fuller(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 7: False}
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values):
        for k in (1, 2, 3, 4):
            w = v
            for bit in rng.sample(range(64), k):
                w ^= 1 << bit
            values.append(w)
    signed = [(i, v - (1 << 64) if v >= 1 << 63 else v) for i, v in enumerate(dict.fromkeys(values))]
    for near in (0, 1, 3):
        df = spark.createDataFrame(signed, "doc_id long, signature long")
        got = {(r.a, r.b) for r in dedup.near_edges(df, near=near).collect()}
        assert got == {(i, j) for j, w in signed for i, v in signed if i < j and ((v ^ w) & (2**64 - 1)).bit_count() <= near}


def test_stream_of_near_duplicates(spark, tmp_path):
    rng = random.Random(9)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(4)]
    rows = [(i, base[i % 4] + ("" if i < 4 else " x"), "t") for i in range(12)] + [(20, "short", "t"), (21, "short", "t")]
    source, good, state, mark = (str(tmp_path / x) for x in ("in", "good", "state", "mark"))
    df = spark.createDataFrame(rows, "id long, text string, other string")
    run = lambda: streams.near_distinct(streams.read_stream(spark, source, "id long, text string, other string"), good, state, mark, "id", near=6).awaitTermination()
    df.where("id < 2").write.json(source)
    run()
    df.where("id >= 2").write.mode("append").json(source)
    run()
    got = sorted(r.id for r in spark.read.parquet(good).collect())
    whole = sorted(r.doc_id for r in dedup.near_duplicates(df.withColumnRenamed("id", "doc_id"), near=6).where("kept").collect())
    assert got == whole and {20, 21} <= set(got)


def test_layers_config_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("Layer2_x_治理",), ("第三层_员工",), ("other_环境",), (None,)], "n string")
    rows = df.select(gates.known_layer(F.col("n")), gates.section_of(F.col("n")), gates.layer_within(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("Layer2", "Governance Structure", "Layer2"), ("Layer3", "Social Responsibility", None), ("unknown", "Environmental Management", None), ("unknown", None, None)]
    text = 'data:  # where\n  raw_corpus_path: "a b"\n  chunk_size: 256\n\ncoe:\n  max_experts: 2\n  layered_selection:\n    analysis_layer_threshold: 0.6\n    verification_layer_threshold: 0.7\n    graph_layer_threshold: 0.8\nlist:\n  - 1\n  - x\nflags: [true, null, 2.5]\n'
    config = files.load_config(text)
    assert (config.raw, config.chunk_size, config.experts_most, config.thresholds, config.chunk_overlap) == ("a b", 256, 2, (0.6, 0.7, 0.8), 50)
    assert files.plain_yaml(text)["list"] == [1, "x"] and files.plain_yaml(text)["flags"] == [True, None, 2.5] and files.load_config("") == files.Config()
    with pytest.raises(ValueError):
        files.plain_yaml("just words")
    long = spark.createDataFrame([("a", "f1", 0.5), ("a", "bleu", 0.1), ("b", "rouge", 0.2)], "method string, metric string, value double")
    wide = sinks.union_of_keys(long, "metric", "value", ["method"])
    assert wide.columns == ["method", "bleu", "f1", "rouge"]
    sinks.write_metrics(wide.coalesce(1), str(tmp_path / "m"))
    lines = spark.read.text(str(tmp_path / "m/csv")).orderBy("value").collect()
    assert [r.value for r in lines] == ["a,0.1,0.5,", "b,,,0.2", "method,bleu,f1,rouge"]
    docs = spark.createDataFrame([("d1", "x" * 60), ("d1", " "), ("d2", "y"), ("", "z" * 60)], "doc_id string, text string")
    r = stats.coverage(spark.range(4), docs).first()
    assert (r.chunks, r.unique_docs, r.empty_chunks, r.short_chunks, r.coverage) == (4, 2, 1, 1, 50.0)
    d = stats.dataset_stats(docs.withColumnRenamed("text", "output").withColumn("instruction", F.lit("ab")), tokens=F.length("output"), most=50).first()
    assert (d.n, d.max_output, d.avg_instruction, d.exceeding) == (4, 60, 2.0, 2)


def test_contains_join(spark):
    from corpusmill.operators.contains import contains_join

    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcde é中") for _ in range(n))
    docs = [(i, text(rng.choice([0, 2, 30, 300])), "w") for i in range(120)] + [(3, "abcabc", "w"), (None, "abc", "w"), (500, None, "w")]
    words = [text(rng.randrange(1, 7)) for _ in range(400)] + ["abc", "a", "", None, "zzz", "abc"]
    got = contains_join(spark.createDataFrame(docs, "doc_id long, text string, word string").repartition(3), spark.createDataFrame([(w,) for w in words], "word string"))
    want = sorted(((i, w) for i, t, _ in docs if t for w in {w for w in words if w} if w in t), key=str)
    assert sorted(((r.doc_id, r.word) for r in got.collect()), key=str) == want and len(want) > 500
    assert contains_join(spark.createDataFrame(docs, "doc_id long, text string, word string"), spark.createDataFrame([], "word string")).isEmpty()
    # a million words, most of which stand nowhere
    many = spark.range(1_000_000).select(F.concat(F.lit("k"), F.conv(F.col("id").cast("string"), 10, 36)).alias("word"))
    held = spark.createDataFrame([(i, " ".join(f"K{k}" for k in range(i, i + 30)).lower()) for i in range(300)], "doc_id long, text string")
    counted = {r.doc_id: r.n for r in contains_join(held, many.select(F.lower("word").alias("word"))).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for i in (0, 7, 299):
        own = " ".join(f"k{k}" for k in range(i, i + 30))
        assert counted[i] == len({own[a:b] for a in range(len(own)) if own[a] == "k" for b in range(a + 2, a + 6) if " " not in own[a:b] and (own[a + 1] != "0" or b == a + 2) and int(own[a + 1 : b], 36) < 1_000_000})


def test_contains_join_does_not_move_texts(spark):
    from corpusmill.operators.contains import contains_join

    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(60)]
    docs = [(i, " ".join(f"<{rng.choice(stems)}>" for _ in range(1000)) + "".join(" " + "".join(rng.choices("ijklmnopqrstuvwxyz", k=5)) for _ in range(4000))) for i in range(40)] + [(99, "x" * 9 + stems[0] + "\n" + stems[1])]
    words = [s[a : a + 7] for s in stems for a in (0, 1, 2)] + ["nowhere", stems[0] + "\n"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    df.cache().count()
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (x.apply(i) for x in [spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)] for i in range(x.size()))}
    before = stages()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    got = sorted((r.doc_id, r.word) for r in contains_join(df, spark.createDataFrame([(w,) for w in words], "word string")).collect())
    shuffled = sum(v for k, v in stages().items() if k not in before)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    df.unpersist()
    assert got == sorted((i, w) for i, t in docs for w in set(words) if w in t)
    assert 0 < shuffled < sum(len(t) for _, t in docs) / 4


def test_ablation_shares_what_its_conditions_have_in_common(spark):
    rng = random.Random(4)
    said = ["The company reports its emissions.", "They fell by 15% in 2020.", "Compared with the industry, waste is higher than in 2019.", "We will strive to improve carbon and water management.", "GRI standards apply.", "The table shows 12 figures: a, b, c."]
    rows = [(f"c{i}", " ".join(rng.choice(said) for _ in range(6)), i) for i in range(12)] + [("short", "x", 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, other int")

    def picky(prompt, text):
        if len(prompt) % 7 == 0:
            raise RuntimeError("down")
        return generation.extractive(prompt, text)

    grid = [g for g in generation.GRID if g[1] in ("K=1", "K=5", "none", "sequential", "R=0", "off")]
    got = generation.ablation(df, picky, grid)
    want = None
    for dimension, condition, k, mode, passes, known in grid:
        own = generation.pairs(df, picky, mode={"none": "single"}.get(mode, mode), passes=passes, with_knowledge=known, most=k)
        own = own.withColumn("dimension", F.lit(dimension)).withColumn("condition", F.lit(condition))
        want = own if want is None else want.unionByName(own)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 12 * len(grid)


def test_ablation_asks_nothing_twice(spark, tmp_path):
    log = tmp_path / "asked"

    def logged(prompt, text):
        with log.open("a") as f:
            f.write(repr((prompt, text)) + "\n")
        return "Question: what is said?\nAnswer: no" + "t" * (len(prompt) % 5)

    df = spark.createDataFrame([("a", "Plain words about nothing in particular, and some more of them. " * 3), ("b", "The company reports its carbon emissions under GRI. They fell by 15% in 2020. " * 3)], "chunk_id string, text string").coalesce(1)
    grid = [g for g in generation.GRID if g[1] in ("K=2", "sequential", "R=0", "R=2", "off")]
    assert len(generation.ablation(df, logged, grid).collect()) == 2 * len(grid)
    first = [x for x in log.read_text().splitlines() if "Earlier answer" not in x]
    assert first and len(first) == len(set(first))
