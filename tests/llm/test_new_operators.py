"""Token alignment, word-level BPE and collocations against brute force and the tokenizers' own libraries, on rows with
nulls, empty and long texts, ties, repeats and columns of clashing names."""

import collections
import hashlib
import itertools
import random
import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import alignment, collocations, lexicon, tokens, transducer

DOCS = "doc_id long, text string, lang string, block long, names string, n string, key string, words string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["the", "of", "new", "york", "city", "red", "wine", "a", "Über", "naïve", "don't", "it's", "x1", "中文", "😀"]
    phrase = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [f"{phrase(9)}. New York City {phrase(4)}\tred  wine, {phrase(3)}\n\nred wine" for _ in range(150)]
    texts += [None, "", " ", "a", "a a a a a a", "...", "tab\tand ▁ mark", " led by space", "é́ ﬁ Ⅷ ½   \x00 \x85", "<|endoftext|> and <|startoftext|>x", "<s> <unk> </s>", "x" * 3000, "new york " * 2000]
    out = [(i, t, rng.choice(["en", "de", None]), 7, "clash", "clash", "k", "w") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "new york city", "und", 0, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(row):
    return tuple(-9 if x is None else x for x in row)


def aligned_plainly(rows):
    vocabulary, pieces = tokens.default_vocabulary(), alignment.default_pieces()
    library = Tokenizer.from_file(vocabulary)
    library.encode_special_tokens = True
    own, of_a, of_b = alignment.processor(pieces), alignment.bytes_of_a(vocabulary), alignment.bytes_of_b(pieces)
    found, in_docs = [], collections.Counter()
    for doc_id, text in rows:
        a, b = (library.encode(" " + text, add_special_tokens=False).ids, own.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(of_a[i] for i in a) != raw or b"".join(of_b[i] for i in b) != raw:
            a = b = []
        ends_a, ends_b = (list(itertools.accumulate((len(of[i]) for i in ids), initial=0)) for of, ids in ((of_a, a), (of_b, b)))
        place_a, place_b = ({e: k for k, e in enumerate(ends)} for ends in (ends_a, ends_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        text_of = lambda ids: ",".join(map(str, ids))
        groups = [f"{text_of(a[place_a[i] : place_a[j]])}|{text_of(b[place_b[i] : place_b[j]])}" for i, j in itertools.pairwise(cuts)]
        of_byte_a, of_byte_b = ([k for k, i in enumerate(ids) for _ in of[i]] for of, ids in ((of_a, a), (of_b, b)))
        links = [(a[i], b[j]) for i, j in sorted(set(zip(of_byte_a, of_byte_b, strict=True)))]
        in_docs.update(set(links))
        found.append((doc_id, len(a), len(b), groups, links))
    best = collections.defaultdict(int)
    for (a, _), n in in_docs.items():
        best[a] = max(best[a], n)
    return [(i, a, b, len(g), len(x), sum(in_docs[p] == best[p[0]] for p in x), sum(in_docs[p] for p in x), sha(";".join(g)) if g else "") for i, a, b, g, x in found]


@pytest.mark.parametrize("block_bytes", [1, 500, 1 << 22])
def test_alignment(spark, docs, rows, block_bytes):
    got, pairs = alignment.aligned(spark, docs, block_bytes=block_bytes)
    want = aligned_plainly([r[:2] for r in rows])
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert pairs.where("docs > best").isEmpty() and any(w[3] == 0 for w in want) and any(w[3] < w[1] for w in want)


def test_links_of_a_group():
    length = alignment._lengths([b"", b"a", b"ab", b"abc"])
    assert alignment.links_of([2, 3], [1, 3, 1], length, length) == {(2, 1): 1, (2, 3): 1, (3, 3): 1, (3, 1): 1}
    assert alignment.links_of([3, 1, 3], [1, 2, 2, 2], length, length) == {(3, 1): 1, (3, 2): 3, (1, 2): 1}


def test_word_bpe(spark, docs, rows):
    library = Tokenizer.from_file(lexicon.default_vocabulary())
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    for size in (0, 5, lexicon.LEXICON):  # the lexicon decides nothing but the time
        name = lexicon.build(spark, docs, size=size)
        assert sorted(map(tuple, lexicon.digests(docs, name).collect()), key=key) == sorted(want, key=key), size
    one = lexicon.encode(docs.where("doc_id = 0"), name).first()
    assert one.ids == library.encode(rows[0][1], add_special_tokens=False).ids and one.decoded == library.decode(one.ids, skip_special_tokens=False)


def test_words_are_cut_and_merged_as_by_the_library():
    own, library, rng = lexicon.tokenizer(lexicon.default_vocabulary()), Tokenizer.from_file(lexicon.default_vocabulary()), random.Random(2)
    odd = [0x130, 0x178, 0x17F, 0x186, 0x23E, 0x300, 0x301, 0x345, 0x3A3, 0x3C2, 0x1E9E, 0x2028, 0x3000, 0x4E2D, 0xAC00, 0x1100, 0x1161, 0x1F600, 0x212B, 0xFB01, 0x660, 0x2160, 0x200B, 0xFEFF]
    pool = [chr(c) for c in [*range(0x180), *odd]] + ["'s", "'ll", "<|endoftext|>", "<|endoftext", "Word", "  "]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        assert [i for w in own.words(text) for i in own.merge(w)] == library.encode(text, add_special_tokens=False).ids, text
    for text in ("x" * 5000, "the" * 3000, "ab" * 4000, "中" * 900):
        assert [i for w in own.words(text) for i in own.merge(w)] == library.encode(text, add_special_tokens=False).ids


def test_transducer(tmp_path):
    rng = random.Random(4)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 7))): tuple(rng.randrange(9) for _ in range(rng.randrange(1, 4))) for _ in range(400)}
    words |= {stem + b"ing": (k, 99) for k, stem in enumerate([b"talk", b"walk", b"xalk"])}
    for k, own in enumerate([words, {}, {b"": (1,)}]):
        path = tmp_path / f"{k}.bin"
        path.write_bytes(transducer.compiled(sorted(own.items())))
        read = transducer.Transducer(str(path))
        asked = [*words, b"", b"zz", b"talkin", b"abcabcabc"]
        assert read.look_up(asked) == [own.get(w) for w in asked]
    shared = tmp_path / "shared.bin"
    shared.write_bytes(transducer.compiled([(b"talking", (1, 9)), (b"walking", (2, 9)), (b"xalking", (3, 9))]))
    assert len(transducer.Transducer(str(shared))) == 8  # the start, one state after each first letter, one for each shared one


def collocations_plainly(rows, least, best, within):
    words_of, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            words_of[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        kept, own = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}, []
        inside = collections.defaultdict(int)
        for p, a in kept.items():
            for i, j in itertools.combinations(range(len(p) + 1), 2):
                if j - i < len(p):
                    inside[p[i:j]] = max(inside[p[i:j]], a)
        for p, a in kept.items():
            if 100 * inside[p] >= within * a:
                continue
            score, k = min((1000 * a * words_of[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, words_of[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(own)[:best], 1)]
    return sorted(out)


def test_rows_of_megabytes_are_held_a_few_at_a_time(spark, monkeypatch):
    kept, keep = {}, collocations.Scratch.keep
    monkeypatch.setattr(collocations.Scratch, "keep", lambda self, df, name="t", **options: kept.setdefault(name, keep(self, df, name, **options)))
    monkeypatch.setattr(collocations.Scratch, "drop", lambda self, *frames: None)
    word = lambda i: F.concat(F.lit("w"), F.xxhash64(i, "id").cast("string"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50_000)), word), " ")
    collocations.phrases(spark, spark.range(0, 40, 1, 1).select(F.lit("en").alias("lang"), text.alias("text")), least=1000, longest=2, block_bytes=1 << 19)
    files = [pq.ParquetFile(f).metadata for f in Path(kept["words"]._scratch_path).glob("*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 40 and max(g.total_byte_size for g in groups) < 32 << 20


@pytest.mark.parametrize(("least", "best", "within", "block_bytes"), [(100, 2000, 100, 4 << 20), (3, 2000, 100, 300), (2, 15, 60, 1)])
def test_collocations(spark, docs, rows, monkeypatch, least, best, within, block_bytes):
    monkeypatch.setattr(collocations, "SENT_ROWS", 0 if block_bytes == 300 else 1 << 19)  # both ways that ids reach blocks
    got = collocations.collocations(spark, docs, best, within, least, block_bytes=block_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == collocations_plainly([(r[1], r[2]) for r in rows], least, best, within)


def test_scores_are_exact(spark):
    values = [(100, 10**13, 100, 100), (2 * 10**12, 9 * 10**12, 2 * 10**12 + 1, 3 * 10**12), (10**12, 10**13 - 1, 10**12, 10**12), (123456789012, 98765432109876, 987654321098, 223456789013)]
    got = spark.createDataFrame(values, "a long, n long, l long, r long").select(collocations.score(*map(F.col, "anlr")).alias("s"))
    assert [r.s for r in got.collect()] == [1000 * a * n // (x * y) for a, n, x, y in values]


def test_empty_tables(spark, empty):
    rows, pairs = alignment.aligned(spark, empty)
    assert rows.isEmpty() and pairs.isEmpty()
    assert lexicon.digests(empty, lexicon.build(spark, empty)).isEmpty() and lexicon.encode(empty, lexicon.build(spark, empty)).isEmpty()
    assert collocations.collocations(spark, empty).isEmpty()


def test_paths_without_a_scheme_are_of_the_default_file_system(spark, tmp_path):
    from corpusmill.llm import token_files

    assert token_files.mounted(token_files.qualified(spark, str(tmp_path))) == str(tmp_path)
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://shared/")
    conf.set("fs.viewfs.mounttable.shared.link./data", tmp_path.as_uri())
    try:
        assert token_files.qualified(spark, "/data/x") == "viewfs://shared/data/x" and token_files.mounted("viewfs://shared/data/x") is None
        assert token_files.mounted(token_files.qualified(spark, f"file://{tmp_path}")) == str(tmp_path)
    finally:
        conf.set("fs.defaultFS", before)
