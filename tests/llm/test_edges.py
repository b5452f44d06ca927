"""Empty tables, very long texts, repeated rows, nulls and clashing columns where other tests don't have them."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from test_llm import base_spans, words

from corpusmill.llm import chat, neardup, packing, pii, quality, toxicity
from corpusmill.llm.common import Scratch


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(17)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(200_000))


def test_very_long_texts(spark, long_text):
    edited = long_text.replace("a", "b", 500)
    rows = [(1, long_text, "h"), (2, edited, "h"), (3, long_text + " idiotic moron", "h"), (4, words(random.Random(1), 40), "h"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark, docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 4, None: None}
    model = toxicity.Model(toxicity.Words({"w:idiotic": 6.0, "w:moron": 6.0}), drift=0.03, rate=1.0, size=0.01, weights=(-1.0, 2.0, 0.5))
    scored = {r.doc_id: r for r in toxicity.score(spark, docs, model).collect()}
    assert [len(scored[i].passages) for i in (1, 2, 3, 4, None)] == [0, 0, 1, 0, 0]
    spot = scored[3].passages[0]
    assert scored[3].text[spot.start : spot.end] == "idiotic moron" and scored[3].tokens == 200_002
    measured = {r.doc_id: r for r in quality.quality_rules(spark, docs).collect()}
    assert measured[1].n_words == 200_000 and measured[None].n_words == 0
    pieces = packing.pack_documents(spark, docs).where("doc_id = 1").collect()
    assert sorted(r.piece for r in pieces) == list(range(len(pieces))) and all(r.length <= 2048 for r in pieces)
    found = {r.doc_id: r for r in pii.sanitise(spark, docs.union(spark.createDataFrame([(5, long_text + " me@x.org", "h")], docs.schema))).collect()}
    assert found[5].text.endswith("[EMAIL]") and found[1]._base == []


def test_turns(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, loss string"
    rows = [(1, 0, "user", "hi <|im_end|>", "own", "own"), (1, 1, "assistant", "there", "own", "own"), (1, 1, "assistant", "there", "own", "own"), (None, None, None, None, None, None)]
    turns = spark.createDataFrame(rows, schema)
    out = chat.format_turns(turns)
    assert out.columns == ["conv_id", "turn", "role", "text", "formatted", "loss", "attachments"]
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 10 and got[None].n_turns == 1
    assert chat.format_turns(turns.limit(0)).collect() == [] and chat.digests(chat.format_turns(turns.limit(0))).collect() == []
    parts = spark.createDataFrame([(1, "user", '[{"type":"text","text":"see "},{"type":"image","ref":"u","width":28,"height":28},{"type":"text","text":"end"}]'), (2, "user", None)], "conv_id long, role string, content string")
    made = {r.conv_id: r for r in chat.format_turns(parts.withColumn("content", chat.parts_from_json("content")), "content").collect()}
    assert chat.read_back(made[1].formatted) == [("user", "see end")] and made[1].attachments[0].tokens == 1 and chat.read_back(made[2].formatted) == [("user", "")]
    with pytest.raises(ValueError):
        chat.read_back(made[1].formatted[:-3])
    reader, turns_ = chat.Reader(), []
    for c in made[1].formatted * 2:  # pieces of one character
        turns_ += reader.feed(c)
    assert turns_ == [("user", "see end")] * 2


def test_disclosed_shares_equal_brute_force(spark):
    """PMI(e; t) / IC(e) of every term that is masked, by counting in plain Python."""
    rng = random.Random(23)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(1500)]
    texts = []
    for i in range(150):
        w = [rng.choice(vocabulary) if rng.random() < 0.2 else vocabulary[min(int(rng.expovariate(0.08)), 159)] for _ in range(rng.randrange(30, 60))]
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice([f"me{i}@corp.example.com", "you@x.org", "it@y.net", f"10.0.{i}.7"]))
        texts.append(" ".join(w))
    texts += texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.term: r.share for r in pii._risky(docs, Scratch(spark, "test"), pii.GENERALISE).collect()}

    def terms(x):
        return {w for w in re.split(r"[^a-z]+", x.lower()) if len(w) >= 3}

    distinct, near, whole = sorted(set(texts)), collections.defaultdict(dict), collections.defaultdict(dict)
    n, holds = float(max(2, len(distinct))), collections.Counter(t for x in distinct for t in terms(x))
    for x in distinct:
        for kind, a, b in base_spans(x):
            left, right = x[max(0, a - pii.CONTEXT) : a], x[b : b + pii.CONTEXT]
            left = re.sub(r"^[a-z]+", "", left) if a > pii.CONTEXT else left
            right = re.sub(r"[a-z]+$", "", right) if len(right) == pii.CONTEXT else right
            near[kind, x[a:b].lower()].setdefault(x, set()).update(terms(left) | terms(right))
            whole[kind, x[a:b].lower()][x] = terms(x)
    want: dict[str, float] = {}
    share = lambda both, e, t: math.log(both * n / (e * holds[t])) / math.log(n / e)
    for entity, around in near.items():
        for t, both in collections.Counter(t for ts in around.values() for t in ts).items():
            want[t] = max(want.get(t, 0), share(both, len(around), t))
        for t, both in collections.Counter(t for ts in whole[entity].values() for t in ts).items():
            if both > 1:  # no two texts here have the same surroundings
                want[t] = max(want.get(t, 0), share(both - 1, len(around), t))
    want = {t: s for t, s in want.items() if s >= pii.GENERALISE}
    assert len(want) > 10 and set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-9 for t in want)


@pytest.fixture
def written(spark, tmp_path, monkeypatch):
    """Documents in 80 files of one row, and a function that counts the files of every scratch table."""
    rows = [(i, f"{words(random.Random(i), 40)} user{i}@example.org tells of word{i % 7} beside") for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(80, "doc_id").write.parquet(f"{tmp_path}/docs")
    held = {"spark.sql.shuffle.partitions": "80", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "64k", "spark.sql.files.maxPartitionBytes": "64k"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    files, keep = {}, Scratch.keep

    def counted(self, df, name="t"):
        out = keep(self, df, name)
        files[out._scratch_path] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    yield spark.read.parquet(f"{tmp_path}/docs"), files
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_personal_data_of_many_splits_goes_to_few_files(spark, written):
    docs, files = written
    assert docs.rdd.getNumPartitions() > 16
    found = pii.sanitise(spark, docs)
    assert sorted(r.doc_id for r in found.where("_base[0].kind = 'email'").collect()) == list(range(80))
    assert found.rdd.getNumPartitions() <= 16 and files and max(files.values()) <= 16


def test_islands_share_tasks(spark, written):
    docs, files = written
    out = packing.pack_documents(spark, docs, block_size=2).collect()
    assert sorted(r.doc_id for r in out) == list(range(80))
    islands = [n for name, n in files.items() if name.endswith("islands")]
    assert islands and max(islands) <= 16 and max(n for name, n in files.items() if name.endswith("pieces")) <= 16


def test_terms_of_other_texts_need_two_surroundings(spark):
    rows = [f"lorem and more words of Wobblegate mail joe.doe@corp.example.com lorem and more {i}" for i in range(3)]  # one surrounding
    rows += ["Wobblegate and lorem", "lorem words of Quuxby mail +1 555 555 1234 and more", "Quuxby and lorem"]
    rows += ["lorem words here of Zanzit mail ann@corp.example.org and more Zanzit", "mail words to ann@corp.example.org Zanzit lorem"]
    rows += ["Zanzit and lorem", "lorem " * 20_000, None, ""]
    rows += [f"lorem and more words of mail here {i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, t, 1.0, i) for i, t in enumerate(rows + rows[:1])], "doc_id long, text string, share double, same long")
    got = {r.doc_id: r for r in pii.sanitise(spark, docs, **pii.SURE).collect()}
    assert len(got) == len(rows) + 1 and got[len(rows)].text == got[0].text
    for i in range(3):
        assert "[TERM] mail [EMAIL]" in got[i].text
    assert "[TERM] mail [PHONE]" in got[4].text or "Quu* mail [PHONE]" in got[4].text
    assert got[3].text == rows[3] and got[5].text == rows[5]  # seen in one surrounding: other texts keep it
    for i in (6, 7, 8):  # seen in two, and in one text of three without the address: no text keeps it
        assert "Zanzit" not in got[i].text
    assert got[6].text.count("[EMAIL]") == 1 and [s.kind for s in got[6]._spans].count("term") == 2  # the whole text of the owner
    assert got[10].text == got[11].text == "" and all(got[i].text == rows[i] for i in (9, *range(12, len(rows))))
    assert pii.sanitise(spark, docs.limit(0), **pii.SURE).collect() == []


def test_lower_shares_equal_plain_ones(spark):
    """The share with Wilson's bound, by the bound's own definition: p is where (phat - p)^2 = z^2 p (1 - p) / n."""
    rows = [(float(b), float(e), float(t)) for t in (1, 2, 3, 7, 40) for b in range(1, t + 1) for e in (1, 3)]
    df = spark.createDataFrame(rows, "b double, e double, t double")
    x = df.select("b", "e", "t", pii._lower_share(*(F.col(c) for c in "bet"), F.lit(1000.0), 1.645).alias("x")).collect()
    for b, e, t, got in x:
        lo, hi = 0.0, b / t
        for _ in range(200):
            p = (lo + hi) / 2
            lo, hi = (lo, p) if b / t - p < 1.645 * math.sqrt(p * (1 - p) / t) else (p, hi)
        assert abs(got - math.log(lo * 1000 / e) / math.log(1000 / e)) < 1e-9
