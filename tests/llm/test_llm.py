"""The training-data operators against brute force, on rows with nulls, empty texts, ties, repeats and odd columns."""

import collections
import hashlib
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm.common import Scratch
from corpusmill.llm.components import components
from corpusmill.llm import chat, decontamination, html_text, licenses, neardup, packing, pii, quality, shingles, token_files, tokens, toxicity

DOCS = "doc_id long, text string, source string, row int, key string, label int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.choice([3, 8, 40, 150])) for _ in range(60)]
    near = [" ".join(w if i != 7 else "changed" for i, w in enumerate(b.split())) for b in base if len(b.split()) > 100][:6]
    texts = [*base, *near, *base[:5], None, "", " \n", "one two", "one  two", "é 😀 中文"]
    out = [(i, t, f"h{i % 3}", i, "k", None) for i, t in enumerate(texts)]
    return [*out, (3, texts[3], None, 0, None, 1), (None, "no id here", "h0", 0, None, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_packing_is_whole_and_gapless(spark, docs, rows, empty):
    out = packing.pack_documents(spark, docs, size=64, block_size=32).collect()
    encode, want = tokens.encoder(tokens.default_vocabulary()), []
    for i, t, *_ in rows:
        ids = np.array([*encode(t or ""), 0], dtype="<u4")
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64)]
        want += [(i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True))]
    key = lambda r: tuple(-9 if x is None else x for x in r)
    assert sorted((tuple(r[:5]) for r in out), key=key) == sorted(want, key=key)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(r.length for r in out) // 64) * 1.06 + 1
    assert packing.pack_documents(spark, empty).collect() == []


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 90, 400)
    a, b = (packing.best_fit(lengths, 100, rng.permutation(400)) for _ in range(2))
    for _ in range(20):
        a = packing.crossover(a, b, lengths, 100, rng)
        load = np.bincount(a, weights=lengths)
        assert load.max() <= 100 and load.min() > 0 and len(a) == 400
    evolved = packing.evolve(lengths, 100, [], 3, 6, 30)
    down = packing.best_fit(lengths, 100, np.argsort(-lengths))
    assert evolved.max() <= down.max()


def test_vocabularies_agree(rows):
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    t, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    for text in [r[1] or "" for r in rows] + ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x <|endof", "a\n\n  b\t'll don't 1234", "x" * 5000]:
        assert t.encode(text, add_special_tokens=False).ids == list(tokens.encoder(path)(text))
        assert plain.encode(text, add_special_tokens=False).ids == list(tokens.encoder(path, plain=True)(text))
        assert token_files.END_ID not in tokens.encoder(path, plain=True)(text)


def shingle_set(t):
    w = t.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def test_near_duplicates_equal_brute_force(spark, docs, rows, empty):
    got = {}
    kept = {}
    for r in neardup.near_duplicates(spark, docs, small_bucket=2, block=3).collect():
        got.setdefault(r.doc_id, set()).add(r.class_id)
        kept[r.class_id] = kept.get(r.class_id, 0) + r.keep
    sets = [shingle_set(t or "") for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 10**9), 10**9 if i is None else i)
    for k, (i, *_) in enumerate(rows):
        want = least[find(k)]
        assert got[i] == {None if want == 10**9 else want}
    assert set(kept.values()) == {1}
    clean = neardup.deduplicate(spark, docs)
    assert clean.columns == docs.columns and clean.count() == len(least)
    assert neardup.near_duplicates(spark, empty).collect() == []


@pytest.mark.parametrize(("families", "small", "block"), [(3, 2, 4), (2, 32, 192)])
def test_families_larger_than_a_block(spark, families, small, block):
    """Families round a base text and chains away from it: leaders, pairs of small buckets and mixed buckets."""
    rng, texts = random.Random(families), []
    for _ in range(families):
        base = words(rng, 60).split()
        pool = [base]
        for _ in range(480 // families):
            copy = list(rng.choice(pool) if rng.random() < 0.5 else base)
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                copy[rng.randrange(60)] = words(rng, 1)
            pool.append(copy)
            texts.append(" ".join(copy))
    texts += [words(rng, 40) for _ in range(60)]
    rng.shuffle(texts)
    sets, holds, root = [shingle_set(t) for t in texts], {}, list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, own in enumerate(sets):
        for g in own:
            holds.setdefault(g, []).append(i)
        for j, k in collections.Counter(j for g in own for j in holds[g] if j < i).items():
            if k >= 0.8 * (len(own) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark, docs, small_bucket=small, block=block).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1500)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000), (2000, 2001)]
    table_ = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components(Scratch(spark, "test"), table_).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1500)} | {2000: 2000, 2001: 2000}
    assert components(Scratch(spark, "test"), table_.limit(0)).collect() == []


@pytest.mark.parametrize("at_once", [100_000, 40, 0])
def test_components_in_rounds_and_at_once(spark, at_once):
    """Edges dealt over tasks, so that none of them sees a whole component; few edges take no rounds."""
    rng = random.Random(at_once)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    edges = [(f"{u:05d}".encode(), f"{v:05d}".encode()) for u, v in edges]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in edges:
        for u, v in edges:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    rng.shuffle(edges)
    scratch = Scratch(spark, "test")
    out = components(scratch, spark.createDataFrame(edges, "u binary, v binary").repartition(7), **({} if at_once == 100_000 else {"at_once": at_once})).collect()
    assert len(out) == len(least) and {bytes(r.node): bytes(r.root) for r in out} == least
    assert scratch.made <= 2 or at_once < 100_000


def test_near_duplicates_that_repeat_lines_unequally_often(spark):
    rng, texts = random.Random(21), []
    for k in (10, 20, 50, 200):
        for _ in range(8):
            text, line = words(rng, 70), words(rng, 30)
            texts += [f"{text}\n{line}", text + f"\n{line}" * k]
    sets = [shingle_set(t) for t in texts]
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert linked == {(i, i + 1) for i in range(0, len(texts), 2)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark, docs).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    h = shingles.mix(np.arange(400, dtype=np.uint64))
    wa, wb = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    d = np.r_[np.zeros(300), np.ones(300)].astype(int)
    s = neardup.prob_minhash(np.r_[h[:300], h[100:]], d, np.r_[wa, wb], 2, 4096)
    a, b = np.zeros(400), np.zeros(400)
    a[:300], b[100:] = wa, wb
    both = np.flatnonzero((a > 0) & (b > 0))
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in both)
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def fold(text):
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in re.sub(r"\s+", " ", text))


def least_edits(item, text):
    """Edits of the best place of item in text, by the whole table."""
    before = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        now = [i + 1] + [0] * len(text)
        for j, y in enumerate(text):
            now[j + 1] = min(before[j] + (x != y), before[j + 1] + 1, now[j] + 1)
        before = now
    return min(before)


def edited(rng, text, edits):
    s = list(text)
    for _ in range(edits):
        k, kind = rng.randrange(max(1, len(s))), rng.random()
        if kind < 0.4 and s:
            s[k] = rng.choice("abcxyz")
        elif kind < 0.7 and s:
            del s[k]
        else:
            s.insert(k, rng.choice("abcxyz"))
    return "".join(s)


def test_decontamination_equals_edit_distance(spark, empty):
    rng = random.Random(4)
    items = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, " \n"), (93, "dup item text"), (93, "dup item text")]
    texts = [None, "", "a" * 50_000]
    for _ in range(60):
        text = "".join(rng.choice("abcdefgh  \n") for _ in range(rng.randrange(120)))
        item = rng.choice(items[:40])[1]
        at = rng.randrange(len(text) + 1)
        texts.append(text[:at] + edited(rng, item, rng.randrange(len(item) // 10 + 2)).upper() + text[at:])
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, matches string, edits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for t in texts:
        found = {i for i, p in items if (p or "").strip() and least_edits(fold(p.strip()), fold(t or "")) <= len(fold(p.strip())) // 10}
        want.append(found)
    for options in ({}, {"block_chars": 200}, {"block_chars": 100, "pass_chars": 400}):
        out = decontamination.benchmark_matches(spark, docs, bench, **options)
        assert out.columns == ["doc_id", "text", "edits", "matches"]
        got = {r.doc_id: r.matches for r in out.collect()}
        assert [{m.item_id for m in got[i]} for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        for m in got[i][:50]:  # the places hold the item with the edits stated
            item = fold(dict((k, v) for k, v in items)[m.item_id].strip())
            assert least_edits(item, fold(t[m.start : m.end])) <= m.edits <= len(item) // 10
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.matches == [] for r in decontamination.benchmark_matches(spark, docs, none).collect())
    assert decontamination.benchmark_matches(spark, empty, bench).collect() == []


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_parts_of_long_benchmark_items(spark):
    rng = random.Random(8)
    item, other = words(rng, 500), words(rng, 300)
    part = item[500:1300]
    changed = list(part)
    for k in range(0, len(changed), 40):
        changed[k] = "z"
    texts = [f"{words(rng, 20)} {part} {words(rng, 20)}", f"{words(rng, 20)} {''.join(changed)}", item[:150], f"{item} and {item}", words(rng, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    got = {r.doc_id: r.matches for r in decontamination.benchmark_matches(spark, docs, bench).collect()}
    assert [[m.item_id for m in got[i]] for i in range(5)] == [[1], [1], [], [1, 1], []]
    assert got[0][0].start >= texts[0].index(part) and got[0][0].end <= texts[0].index(part) + len(part) and got[0][0].end - got[0][0].start >= 400
    assert [(m.start, m.end, m.edits) for m in got[3]] == [(0, len(item), 0), (len(item) + 5, 2 * len(item) + 5, 0)]


def base_spans(t):
    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0

    def valid(k, m):
        n = sum(c.isdigit() for c in m)
        return k == "email" or (k == "ip" and all(int(x) <= 255 for x in m.split("."))) or (k == "card" and 12 <= n <= 19 and luhn(m)) or (k == "phone" and 9 <= n <= 15)

    return [(k, s, e) for s, _, k, e in sorted((m.start(), r, k, m.end()) for r, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], t or "") if valid(k, m[0]))]


def test_personal_data(spark, empty):
    rng = random.Random(3)
    alphabet = ["1", "2", "4", "5", "0", ".", "@", "a", "-", " ", "+", "(", ")", "\n", "é", "😀", "_", "%"]
    texts = ["".join(rng.choice(alphabet[: rng.choice([6, 11, 18])]) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["".join(rng.choice(["4", " ", "-", "a@b.c", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 555-1234"]) for _ in range(9)) for _ in range(100)]
    texts += ["4" * 30_000, "a" * 50_000, "1." * 9_000, "a@b" + ".c" * 5_000, None, "", "+1" + " " * 9_000 + "2"]
    plain = len(texts)
    texts += [f"text {i} lorem wobblegate mail joe.doe@corp.example.com and more words {i}" for i in range(12)]
    texts += [f"other text {i} and more words lorem mail here" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    got = {r.doc_id: r for r in pii.sanitise(spark, docs).collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i]._base] == base_spans(t), t
    marked = got[plain]
    assert "[EMAIL]" in marked.text and "wobblegate" not in marked.text and "lorem" in marked.text
    assert [s.kind for s in marked._spans] == ["term", "email"]
    assert got[plain + 20].text == texts[plain + 20]
    assert pii.sanitise(spark, empty).collect() == []


def test_terms_beside_rare_personal_data(spark):
    texts = [f"lorem and more words of Wobblegate mail joe.doe@corp.example.com lorem and more {i}" for i in range(3)]
    texts += ["lorem words of Quuxby mail +1 555 555 1234 and more", "Quuxby and lorem"]
    texts += [f"lorem and more words of mail here {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitise(spark, docs).collect()}
    for i in range(3):  # three texts, one owner: the name stands with this address only
        assert [s.kind for s in got[i]._spans] == ["term", "email"] and "[TERM] mail [EMAIL]" in got[i].text
    # one text with the number, another with the name alone: generalised in both
    assert "Quu* mail [PHONE]" in got[3].text and got[4].text == "Quu* and lorem"
    assert all(got[i].text == texts[i] for i in range(5, len(texts)))


def test_quality_rules(spark, empty):
    rng = random.Random(9)
    common = "this very line stands in all documents of the host and is long"
    texts = [f"{words(rng, 30)}\n{common}" for _ in range(30)] + [f"{words(rng, 4)}\n{common}\n{common} 1" for _ in range(30)]
    loop = words(rng, 12)
    texts += [None, "", "a b", " ".join([loop] * 4), f"{words(rng, 40)}\n\nx\nx\n#*|"]
    docs = spark.createDataFrame([(i, t, "h" if i % 9 else None, 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    got = {r.doc_id: r for r in quality.quality_rules(spark, docs, line_limit=20).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = {}
        for j in range(len(w) - 7):
            seen.setdefault(tuple(w[j : j + 8]), []).append(j)
        covered = {j + k for at in seen.values() if len(at) > 1 for j in at for k in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines, r.base_failed) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)), failed)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or "")) and (not failed or not r.kept)
    assert all(got[i].kept for i in range(30) if i % 9) and not any(got[i].kept for i in range(30, 60) if i % 9)
    assert quality.quality_rules(spark, empty).collect() == []


def test_chat_round_trip():
    rng = random.Random(6)
    parts = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", ">", "\n", "a", "<|image:0|>", "<\\|", "assistant", "é😀"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        role = rng.choice(["user", "assistant", "odd\nrole\\", "<|im_end|>"])
        formatted, loss, _ = chat.format_turn(role, text)
        assert chat.read_back(formatted) == [(role, text)]
        assert "".join(chat.unescape(formatted[a:b]) for a, b in loss) == (text if role == "assistant" else "")
    content = [{"type": "text", "text": "see <"}, {"type": "text", "text": "|x"}, {"type": "image", "ref": "u", "width": 56, "height": 29}, None, {"type": "audio", "ref": "v", "seconds": 2.0}, {"type": "document", "ref": "w", "pages": 3}, {"type": "text", "text": "end"}]
    formatted, loss, found = chat.format_turn("assistant", content)
    assert chat.read_back(formatted) == [("assistant", "see <|xend")] and [f["tokens"] for f in found] == [4, 50, 1536]
    assert all(formatted[f["place"] :].startswith(f"<|{f['type']}:{k}|>") for k, f in enumerate(found))
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "assistant", "y"), (3, None, "assistant", ""), (1, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_sha256) == (3, sha("user\n\nassistant\nb\nassistant\nb\n"), sha("bb"))
    assert got[2].turns_sha256 == sha("\nx\n") and got[None].loss_chars == 1 and got[3].loss_sha256 == sha("")


def test_main_text():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id=cookie-notice>We use cookies, ok.</div><nav><a href=/>x</a></nav>
    <div class="content"><h1>Title</h1><p>First   paragraph, with commas, and enough &lt;text&gt; to count as one of an article.<p>Second &nbsp;one &amp;amp; more, again long enough to count, surely.
    <script>var a = "<p>no</p>";</script><form>subscribe<input></form><p>Short.</div><aside>long side text, with, many, commas, and so on, and so on</aside>
    <section id="comments"><p>A reader's comment, long, with commas, and so on, and so on.</p></section><footer>foot</footer></body></html>"""
    assert html_text.extract(page) == ["Title", "First paragraph, with commas, and enough <text> to count as one of an article.", "Second one &amp; more, again long enough to count, surely.", "Short."]
    assert html_text.extract(None) == html_text.extract("") == [] and html_text.extract("plain") == ["plain"]
    assert html_text.extract("<p>a<p>b</b></div>") == ["a", "b"] and html_text.extract("<div>1 < 2 & 3") == ["1 < 2 & 3"]
    assert html_text.extract("<b>" * 3000 + "deep") == ["deep"]


def test_main_text_keeps_what_belongs_to_the_article():
    long = "{} paragraph, long enough, with commas, to be good text, again and again, so that it counts."
    page = f"""<body><article><h1>T</h1><p>{long.format("First")}</p><h2 id="discussion">Discussion</h2><p>{long.format("Second")}</p><h2 id="related-work">Related work</h2>
    <section id="comments-on-method"><p>{long.format("Third")}</p></section><p>An <span class="ad-hoc">ad hoc</span> word, x <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math>.</p>
    <section id="comments"><p>{long.format("Reader")}</p></section><div class="related-posts"><a href=x>Other</a></div><div class="cookie-notice">We use cookies</div><section class="discussion"><div class="comment">again</div></section></article></body>"""
    assert html_text.extract(page) == ["T", long.format("First"), "Discussion", long.format("Second"), "Related work", long.format("Third"), "An ad hoc word, x x=1."]
    middle = f"<body><div><div class=c><p>{long.format('One') * 2}</p></div><h2>Middle</h2><ul><li>one</li><li>two</li></ul><pre>code  x</pre><blockquote>quoted</blockquote><div class=c><p>{long.format('Two') * 2}</p></div></div></body>"
    assert html_text.extract(middle) == [long.format("One") * 2, "Middle", "one", "two", "code x", "quoted", long.format("Two") * 2]
    form = "<body><form>" + "".join(f"<p>{long.format(k)}</p>" for k in "abc") + "<input name=q><button>Go</button></form></body>"
    assert html_text.extract(form) == [long.format(k) for k in "abc"]


def test_main_text_of_made_pages(spark):
    """Pages of known blocks among what isn't part of an article, on Spark, with odd rows and columns."""
    rng = random.Random(14)
    noise = ["<nav><ul><li><a href=/a>aa</a><li><a href=/b>bb</a></ul></nav>", "<aside><p>Side, text, with, commas, long enough to count for something.</p></aside>", "<script>var x='<p>no</p>';</script>", "<div class='ad-box'><p>Buy, this, now, long enough to count as a paragraph of text.</p></div>", "<form><label>mail</label><input></form>", "<!-- note -->", "<div id='newsletter-signup'>Sign up, now, for more</div>"]
    pages, want = [], []
    for i in range(60):
        blocks = [f"{words(rng, rng.randrange(25, 60))}, {words(rng, 9)}." for _ in range(rng.randrange(3, 8))]
        body = [f"<p>{b}</p>" if rng.random() < 0.8 else f"<blockquote>{b}</blockquote>" for b in blocks]
        for _ in range(3):
            body.insert(rng.randrange(1, len(body)), rng.choice(noise))
        box = rng.choice(["<article>{}</article>", "<main><div class=content>{}</div></main>", "<div id=main>{}</div>"])
        pages.append((i, "u", f"<html><head><title>t</title></head><body><header><h1>Site</h1></header>{noise[0]}{box.format(''.join(body))}<footer>&copy; x</footer></body></html>", 7, "t"))
        want.append("\n\n".join(blocks))
    odd = [(100, "u", None, 1, "t"), (101, "u", "", 1, "t"), (102, None, "<p>" + "word, " * 100_000, 1, "t"), (0, *pages[0][1:])]
    table_ = spark.createDataFrame([*pages, *odd], "page_id long, url string, html string, n_chars int, text string")
    out = html_text.main_text(table_)
    rows = [(r.page_id, r.text, r.n_chars) for r in out.collect()]
    got = {i: t for i, t, _ in rows}
    assert [got[i] for i in range(60)] == want and len(rows) == 64 and all(n == len(t) for _, t, n in rows)
    assert got[100] == got[101] == "" and len(got[102]) == 6 * 100_000 - 1
    assert html_text.main_text(table_.limit(0)).collect() == []


def test_token_files_stitch_over_blocks(spark, tmp_path, empty):
    rng = random.Random(8)
    files, want = [], set()
    for f in range(3):
        ids, start, n = [], 0, 0
        for length in [rng.choice([0, 1, 3, 40]) for _ in range(60)]:
            ids += [rng.randrange(8, 99) for _ in range(length)] + [7]
            want.add((f, n, start, length, True))
            start, n = len(ids), n + 1
        ids += [5] * f
        if f:
            want.add((f, n, start, f, False))
        raw = np.array(ids, dtype="<u2").tobytes()
        files += [(f, k, raw[b : b + 22]) for k, b in enumerate(range(0, len(raw), 22))]
        (tmp_path / f"{f}.bin").write_bytes(raw)
    blocks = spark.createDataFrame(files, "file long, block long, payload binary")
    got = {tuple(r) for r in token_files.document_lengths(spark, blocks, end_id=7, segment=4).select("file", "ordinal", "start", "n_tokens", "closed").collect()}
    assert got == want
    flat = token_files.document_lengths(spark, token_files.file_blocks(spark, str(tmp_path), 22), end_id=7, segment=4)
    assert {(int(r.file[-5]), r.ordinal, r.start, r.n_tokens, r.closed) for r in flat.collect()} == want
    docs = spark.createDataFrame([(1, "a b c", 1), (2, None, 1), (3, ""[:0], 1), (None, "x <|endoftext|> " * 5000, 1), (1, "a b c", 2)], "doc_id long, text string, file int")
    encode = tokens.encoder(tokens.default_vocabulary(), plain=True)
    lengths = sorted(len(encode(t)) for t in ("a b c", "", "", "x <|endoftext|> " * 5000, "a b c"))
    written = token_files.write_blocks(docs.coalesce(1), tokens.default_vocabulary(), block_tokens=2)
    assert sorted(r.n_tokens for r in token_files.document_lengths(spark, written.drop("first", "doc_ids")).collect()) == lengths
    folder = str(tmp_path / "flat")
    manifest = token_files.write_files(docs.coalesce(1), folder, tokens.default_vocabulary()).collect()
    assert [(m.ordinal, m.doc_id) for m in manifest] == [(0, 1), (1, 2), (2, 3), (3, None), (4, 1)]
    assert sorted(r.n_tokens for r in token_files.document_lengths(spark, token_files.file_blocks(spark, folder, 64)).collect()) == lengths
    assert token_files.write_files(empty, folder + "-none", tokens.default_vocabulary()).collect() == []
    assert token_files.write_blocks(empty, tokens.default_vocabulary()).collect() == []
    assert token_files.document_lengths(spark, blocks.limit(0)).collect() == []
    with pytest.raises(ValueError):
        token_files.write_files(docs, "s3a://bucket/x", tokens.default_vocabulary())


def test_licences(spark, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this. The above copyright notice and this permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\"."
    rows = [(1, mit), (2, "Licensed under the Apache License, Version 2.0. Text."), (3, "GNU General Public License, version 3.\nor (at your option) any later version."), (4, "GPL 3\nMIT Licence"), (5, None), (6, ""), (7, "nothing"), (8, "Copyright someone")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(1, 8)] == [["MIT"], ["Apache-2.0"], ["GPL-3.0-or-later"], ["GPL-3.0", "MIT"], [], [], []]
    assert got[8].unmatched == ["copyright"] and licenses.scan(empty).collect() == []


def test_licences_as_wrapped_in_the_wild(spark):
    isc = "Copyright (c) 2020, Someone\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions.\n"
    want = {isc: ["ISC"], gpl: ["GPL-3.0-or-later"], gpl.replace(" * ", "// "): ["GPL-3.0-or-later"], bsd: ["BSD-2-Clause"], bsd + "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software.\n": ["BSD-3-Clause"]}
    want |= {"GNU General Public License, version 2, or (at your option) any later version": ["GPL-2.0-or-later"], "MIT license or Apache License 2.0": ["Apache-2.0", "MIT"]}
    tags = {"MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "MPL-2.0": ["MPL-2.0"], "CC-BY-4.0": ["CC-BY"], "(MIT OR Apache-2.0)": ["Apache-2.0", "MIT"], "GPL-2.0+": ["GPL-2.0-or-later"], "LGPL-2.1-only": ["LGPL"], "ISC": ["ISC"]}
    want |= {f"// SPDX-License-Identifier: {k}\nimport mit_tools": v for k, v in tags.items()}
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    want |= {"\n".join(textwrap.wrap(mit, n)): ["MIT"] for n in (60, 72, 80, 100)}
    want |= {"Copyright X. All rights reserved.\n" + bsd: ["BSD-2-Clause"], "This is not in the public domain.": [], "All rights reserved.": ["proprietary"], "x " * 200_000 + "MIT license": ["MIT"]}
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate([*want, None, ""])], "doc_id long, text string, licenses string, _seq string")
    out = licenses.scan(docs)
    got = {r.text: r.licenses for r in out.collect()}
    assert got == want | {None: [], "": []} and "_seq" in out.columns
    sql = duckdb.connect()
    sql.execute("create table documents (doc_id bigint, text varchar)")
    sql.executemany("insert into documents values (?, ?)", [(i, t) for i, t in enumerate([*want, None, ""])])
    rows = {r[0]: r[1:] for r in sql.execute(licenses.SQL["op5_license_scan"]).fetchall()}
    for r in out.collect():
        assert rows[r.doc_id][:3] == (",".join(r.licenses), ",".join(r.sentence_ids), ",".join(r.unmatched))


def test_segments_equal_brute_force():
    rng = random.Random(11)
    for _ in range(200):
        n = rng.randrange(1, 14)
        scores = [rng.choice([-0.5, -0.5, -1.25, 1.0, 2.5]) for _ in range(n)]
        found = toxicity.segments([(i, s) for i, s in enumerate(scores) if s != -0.5], 0.5)

        def split(lo, hi, scores=scores):  # the definition: the best segment, then left and right of it
            best = max(((round(sum(scores[a : b + 1]), 9), a - b, -a, a, b) for a in range(lo, hi) for b in range(a, hi)), default=None)
            if best is None or best[0] <= 0:
                return []
            _, _, _, a, b = best
            return [*split(lo, a), (best[0]), *split(b + 1, hi)]

        assert sorted(round(s, 9) for *_, s in found) == sorted(split(0, n))


def test_rate_and_size_of_best_segments():
    """lambda and K from token scores of random texts give E-values that best segments keep to."""
    rng = np.random.default_rng(5)
    draw = lambda n: rng.choice([3.0, 1.5, -2.0, -0.1], n, p=[0.004, 0.01, 0.02, 0.966])
    best, tokens_, moments, hits, total = [], [], np.zeros(len(toxicity.RATES)), 0, 0
    for _ in range(800):
        s = draw(400)
        own = [(i, v) for i, v in enumerate(s.tolist()) if v != -0.1]
        moments += np.exp(np.outer([v for _, v in own], toxicity.RATES)).sum(axis=0) if own else 0
        hits, total = hits + len(own), total + len(s)
        best.append(max((v for *_, v in toxicity.segments(own, 0.1)), default=0.0))
        tokens_.append(len(s))
    rate = toxicity._rate(moments, total, hits, 0.1)
    assert abs(0.004 * np.exp(3 * rate) + 0.01 * np.exp(1.5 * rate) + 0.02 * np.exp(-2 * rate) + 0.966 * np.exp(-0.1 * rate) - 1) < 0.02
    size = toxicity._size(np.array(best), np.array(tokens_), rate)
    model = toxicity.Model(rate=rate, size=size)
    for level in (0.5, 0.1, 0.02):
        share = np.mean([model.log_expected(b, 400) <= np.log(level) for b in best if b > 0])
        assert share < 2.5 * level


def test_toxicity_held_out(spark, empty):
    rng = random.Random(12)
    bad = ["idiotle", "idioten", "idiotia", "idiotum", "scumly", "scumer"]
    rows, labels = [], []
    for i in range(400):
        w = words(rng, 60).split()
        if i % 4 == 0:
            w[5:5] = rng.sample(bad, 2)
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, (500, None, "x"), (501, "", "x")], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (900, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(spark, docs, known.where(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.score(spark, docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[500].score < 0.5 and got[501].passages == [] and all(0 <= r.score <= 1 for r in got.values())
    spot = max(got[0].passages, key=lambda p: p.score)
    assert all(p.expected <= toxicity.LEVEL for r in got.values() for p in r.passages)
    assert sum(len(got[i].passages) > 0 for i in range(400) if i % 4) <= 0.05 * 300
    assert toxicity.fit(spark, docs, known.limit(0)).words.scores == {} and toxicity.fit(spark, docs.limit(0), known).words.scores == {}
    assert any(w[:4] in ("idio", "scum") for w in got[0].text[spot.start : spot.end].split())
    assert toxicity.score(spark, empty, model).collect() == []
    assert toxicity.score(spark, docs, toxicity.fit(spark, docs, known.where("toxic = 0"))).where("score >= 0.5").count() == 0
