"""Every registered query of this folder over a whole small table: columns, one row for each input row, and the same rows
as its SQL or as a plain version."""

import collections
import hashlib
import zlib

import duckdb
import pandas as pd
import pytest
from test_llm import base_spans, shingle_set

from corpusmill.llm import registry, tokens, toxicity

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pack_documents": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op3_token_counts": ["doc_id", "n_tokens"],
    "op4_near_duplicates": ["doc_id", "class_id"],
    "op5_license_scan": ["doc_id", "licenses"],
    "op6_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op8_benchmark_leaks": ["doc_id", "contaminated", "item_ids"],
    "op9_main_text": ["page_id", "url", "text", "n_chars"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op12_word_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op13_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: query(spark, DIR).toPandas() for name, query in registry.QUERIES.items()}


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{DIR}/documents.parquet")


def test_columns_and_rows(results, documents):
    assert set(results) == set(COLUMNS)
    for name, columns in COLUMNS.items():
        found = results[name]
        assert list(found.columns)[: len(columns)] == columns, name
        if "doc_id" in columns:
            key = found[found.piece == 0] if name.startswith("op1_") else found
            assert sorted(key.doc_id) == sorted(documents.doc_id), name


def test_sql_gives_the_same(results):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    for name, sql in registry.SQL.items():
        want, got = con.execute(sql).df(), results[name]
        cols = sorted(want.columns)
        rows = lambda df: sorted(map(str, df[cols].itertuples(index=False, name=None)))  # noqa: E731, B023
        assert cols == sorted(got.columns) and rows(want) == rows(got), name


def test_packing_and_counts(results, documents):
    text = dict(zip(documents.doc_id, documents.text, strict=True))
    encode, plain = tokens.encoder(tokens.default_vocabulary()), tokens.encoder(tokens.default_vocabulary(), plain=True)
    assert {r.doc_id: r.n_tokens for r in results["op3_token_counts"].itertuples()} == {i: len(plain(t or "")) for i, t in text.items()}
    packed = results["op1_pack_documents"]
    assert packed.length.sum() == sum(len(encode(t or "")) + 1 for t in text.values())
    load = packed.groupby("sequence_id").length.sum()
    assert load.max() <= 2048 and len(load) <= -(-packed.length.sum() // 2048) * 1.02 + 1
    import numpy as np

    for r in packed.itertuples():
        ids = np.array([*encode(text[r.doc_id] or ""), 0], dtype="<u4")[r.start : r.start + r.length]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_classes_and_spans(results, documents):
    rows = list(zip(documents.doc_id, documents.text, strict=True))
    sets, holds, root = [shingle_set(t or "") for _, t in rows], {}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(sets):
        for g in own:
            holds.setdefault(g, []).append(i)
        for j, k in collections.Counter(j for g in own for j in holds[g] if j < i).items():
            if k >= 0.8 * (len(own) + len(sets[j]) - k):
                root[max(find(i), find(j))] = min(find(i), find(j))
    empty = [i for i, s in enumerate(sets) if not s]
    for i in empty[1:]:
        root[max(find(i), find(empty[0]))] = min(find(i), find(empty[0]))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    assert dict(zip(results["op4_near_duplicates"].doc_id, results["op4_near_duplicates"].class_id, strict=True)) == {i: least[find(k)] for k, (i, _) in enumerate(rows)}
    for r in results["op2_personal_data"].itertuples():
        base = base_spans(dict(rows)[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_scores_and_texts(results):
    scores = results["op10_toxicity"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores.itertuples())
    pages = results["op9_main_text"]
    assert all(len(r.text) == r.n_chars for r in pages.itertuples()) and (pages.n_chars > 0).mean() > 0.9
    assert toxicity.FIT_ROWS >= len(scores)
