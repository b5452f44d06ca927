"""The pipeline: stages in order, decisions take effect, clean documents stay."""

import random

import corpus_pipeline
from corpusmill.llm import neardup, tokens
from corpusmill.session import SETTLE, Scratch


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_run(spark, tmp_path):
    rng = random.Random(21)
    item = words(rng, 30)
    rows = [(i, words(rng, 80) + (" idiotic moron" if i % 10 == 0 else ""), "en", "s", 0) for i in range(200)]
    rows += [(300, rows[1][1], "en", "s", 0), (301, f"{words(rng, 40)} {item} {words(rng, 9)}", "en", "s", 0), (302, f"{words(rng, 40)} joe@corp.example.com", "en", "s", 0), (303, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/stage-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
    clean = {i for i in range(200) if i % 10} | {301, 302, 303}
    assert kept["toxicity"] == clean | {300}
    assert kept["near_duplicates"] == clean
    assert kept["decontamination"] == kept["personal_data"] == kept["packing"] == clean - {301}
    texts = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/stage-personal_data").collect()}
    assert texts[302].text.endswith("[EMAIL]") and texts[302].n_chars == len(texts[302].text)
    key = lambda r: (r.doc_id, r.piece)
    assert sorted((key(r), r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((key(r), r.length, r.ids_crc32) for r in docs.collect())
    encode = tokens.encoder(tokens.default_vocabulary())
    assert sum(r.length for r in docs.collect()) == sum(len(encode(t.text or "")) + 1 for t in texts.values())


def test_odd_tables(spark, tmp_path):
    """Columns with the operators' own names stay as they are; empty tables and null rows pass every stage."""
    rows = [(1, "idiotic words of one", "s", 0.25, "m", 9, 3, 1), (2, None, "s", 0.5, "m", 9, 3, 1), (None, "more words of another text", None, None, None, None, None, None)]
    schema = "doc_id long, text string, source string, score double, matches string, tokens int, _row int, key int"
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full = spark.createDataFrame(rows, schema)
    for docs in (full, full.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if name == "packing":
                break
            path = f"{tmp_path}/{name}-{docs is full}-{k}-{len(docs.columns)}-{id(docs)}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.dtypes == full.dtypes
            assert all((r.score, r.matches, r.tokens, r._row, r.key) in {(0.25, "m", 9, 3, 1), (0.5, "m", 9, 3, 1), (None, None, None, None, None)} for r in docs.collect())
        assert out.count() == docs.count()


def test_the_driver_gives_back_what_finished_steps_left(spark, tmp_path):
    """Every stage begins with a collection, and long ones have some on the way."""
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert whole() > before
    before, scratch = whole(), Scratch(spark, "test")
    for _ in range(SETTLE):
        scratch.keep(docs)
    assert whole() > before


def test_jobs_of_a_large_family(spark):
    """A family that goes through every round of verification takes few jobs, which the driver keeps account of."""
    rng = random.Random(5)
    base = words(rng, 60).split()
    rows = [(i, " ".join([*base[: i % 60], words(rng, 1), *base[i % 60 + 1 :]])) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.sparkContext.setJobGroup("large-family", "")
    try:
        assert {r.class_id for r in neardup.near_duplicates(spark, docs).collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("large-family"))
    assert 0 < jobs < 150
