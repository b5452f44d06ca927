"""Alignment of two tokenizers by a dictionary of groups.

Tokens of A and of B of the same bytes are cut into groups where a token of both ends. Documents are held as blocks, rows
of some thousand documents each: every distinct group of a block has a local number, and a document is its numbers and how
often it has each. The distinct groups of all blocks are interned once; their links, the pairs of an A and a B token that
share a byte, are expanded once for each distinct group and taken times its documents or occurrences. A pair that is
linked in one distinct group only stands in as many documents as that group; for the others, blocks count the documents
that hold any of the pair's groups. What a group's links come to goes back to the blocks by the key of the group.
"""

from __future__ import annotations

import collections
import hashlib
import itertools
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import join_unique
from . import tokens
from .common import Scratch, ship, table

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=1)
def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others,
    in order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def bytes_of_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as file:
        loaded = json.load(file)
    special = {t["id"]: t["content"] for t in loaded.get("added_tokens", [])}
    vocabulary = {i: s for s, i in loaded["model"]["vocab"].items()} | special
    by = byte_of()
    return [vocabulary.get(i, "").encode() if i in special else bytes(map(by.__getitem__, vocabulary.get(i, ""))) for i in range(max(vocabulary) + 1)]


@lru_cache(maxsize=4)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def bytes_of_b(path: str) -> list[bytes]:
    """The bytes of each id of a piece vocabulary: the marker U+2581 is a space, <0xHH> the byte HH."""
    own = processor(path)
    return [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in range(own.get_piece_size())]


def _lengths(of: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in of], dtype=np.int64)


def cut_groups(a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of A tokens and of B tokens up to the end of each group; both run over the same bytes, and no token
    is empty."""
    end_a, end_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
    at = np.searchsorted(end_b, end_a)
    both = end_b[at] == end_a
    return np.flatnonzero(both) + 1, at[both] + 1


def group_keys(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The number of each group among the distinct ones, and the text of these, `a1,a2|b1`."""
    from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
    single = (to_a - from_a == 1) & (to_b - from_b == 1)
    ones, of_one = np.unique((a[from_a[single]] << 32) | b[from_b[single]], return_inverse=True)
    keys = [f"{x >> 32}|{x & 0xFFFFFFFF}" for x in ones.tolist()]
    more = collections.defaultdict(itertools.count(len(keys)).__next__)
    raw_a, raw_b = a.astype("<i4").tobytes(), b.astype("<i4").tobytes()
    several = np.flatnonzero(~single)
    bounds = zip(*((4 * x[several]).tolist() for x in (from_a, to_a, from_b, to_b)), strict=True)
    numbers = np.empty(len(to_a), dtype=np.int64)
    numbers[single] = of_one
    numbers[several] = [more[raw_a[i:j], raw_b[k:m]] for i, j, k, m in bounds]
    text = lambda raw: ",".join(map(str, np.frombuffer(raw, "<i4").tolist()))
    return numbers, keys + [f"{text(x)}|{text(y)}" for x, y in more]


_DOCS = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("held", pa.int64())])
_KEYS = pa.struct([("key", pa.string()), ("docs", pa.int64())])
BLOCKS = "block long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,groups_sha256:string,held:long>>, places binary, times binary, keys array<struct<key:string,docs:long>>"


def group_blocks(docs: DataFrame, vocabulary: str, pieces: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) as blocks: the documents with the number of distinct groups each holds, the local numbers of
    these (places) and how often it has them (times) one after the other, and the distinct groups of the block with the
    number of documents that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        encode, own = tokens.encoder(vocabulary, plain=True), processor(pieces)
        of_a, of_b = bytes_of_a(vocabulary), bytes_of_b(pieces)
        length_a, length_b = _lengths(of_a), _lengths(of_b)

        def both(text: str) -> tuple[np.ndarray, np.ndarray]:
            whole = " " + text
            a, b = encode(whole), own.encode(text)
            raw = whole.encode()
            same = b"".join(map(of_a.__getitem__, a)) == raw and b"".join(map(of_b.__getitem__, b)) == raw
            return (np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) if same else (np.zeros(0, dtype=np.int64),) * 2

        def done(ids: list, found: list) -> pa.RecordBatch:
            n_a, n_b = (np.array([len(x[k]) for x in found]) for k in (0, 1))
            a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            if len(a):
                to_a, to_b = cut_groups(a, b, length_a, length_b)
                numbers, keys = group_keys(a, b, to_a, to_b)
            else:
                to_a, numbers, keys = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
            n_groups = np.diff(np.searchsorted(to_a, np.cumsum(n_a), side="right"), prepend=0)
            ends = np.cumsum(n_groups).tolist()
            digests = [hashlib.sha256(";".join(map(keys.__getitem__, numbers[i:j].tolist())).encode()).hexdigest() if i < j else "" for i, j in zip([0, *ends], ends, strict=False)]
            size = max(len(keys), 1)
            held, times = np.unique(np.repeat(np.arange(len(ids)), n_groups) * size + numbers, return_counts=True)
            columns = [ids, n_a, n_b, n_groups, digests, np.bincount(held // size, minlength=len(ids))]
            rows = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _DOCS, strict=True)], fields=list(_DOCS))
            groups = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(np.bincount(held % size, minlength=len(keys))[: len(keys)], pa.int64())], fields=list(_KEYS))
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            places = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (held % size, times)]
            return pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), listed(rows), *places, listed(groups)], names=["block", "docs", "places", "times", "keys"])

        ids, found, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                found.append(both(text) if text else (np.zeros(0, dtype=np.int64),) * 2)
                size += len(text or "")
                if size >= block_bytes:
                    yield done(ids, found)
                    ids, found, size = [], [], 0
        if ids:
            yield done(ids, found)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


def links_of(a: list[int], b: list[int], length_a: np.ndarray, length_b: np.ndarray) -> collections.Counter:
    """The linked pairs of a group and how often each is linked; fewer than the tokens of both."""
    links, i, j = collections.Counter(), 0, 0
    end_a, end_b = int(length_a[a[0]]), int(length_b[b[0]])
    while True:
        links[a[i], b[j]] += 1
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a:
            i += 1
        if step_b:
            j += 1
        if i == len(a) or j == len(b):
            return links
        end_a += int(length_a[a[i]]) if step_a else 0
        end_b += int(length_b[b[j]]) if step_b else 0


def links(dictionary: DataFrame, vocabulary: str, pieces: str) -> DataFrame:
    """The links of each distinct group, dictionary (gid, key, docs): gid, a, b, times (within the group), docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_a, length_b = _lengths(bytes_of_a(vocabulary)), _lengths(bytes_of_b(pieces))
        for batch in batches:
            out: list[tuple] = []
            for gid, key, docs in zip(*(batch.column(c).to_pylist() for c in ("gid", "key", "docs")), strict=True):
                a, b = (list(map(int, side.split(","))) for side in key.split("|"))
                out += [(gid, x, y, n, docs) for (x, y), n in links_of(a, b, length_a, length_b).items()]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["gid", "a", "b", "times", "docs"])

    return dictionary.select("gid", "key", "docs").mapInArrow(run, "gid long, a long, b long, times long, docs long")


def _counted(one: pa.Table) -> pa.Table:
    """Of a block: the documents that hold each pair in any of its groups."""
    rows = one["docs"].combine_chunks().values
    places = np.frombuffer(one["places"][0].as_py(), "<i4")
    doc = np.repeat(np.arange(len(rows)), rows.field("held").to_numpy())
    own = one["own"].combine_chunks().values
    local, pairs = own.field("local").to_numpy(), own.field("pairs")
    n, flat = pairs.value_lengths().to_numpy(), pairs.flatten().to_numpy()
    size = np.zeros(max(int(places.max(initial=0)), int(local.max(initial=0))) + 1, dtype=np.int64)
    begin = size.copy()
    size[local], begin[local] = n, np.cumsum(n) - n
    each = size[places]
    at = np.repeat(begin[places] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    distinct, number = np.unique(flat, return_inverse=True)
    held = np.unique(np.repeat(doc, each) * len(distinct) + number[at])
    return pa.table({"pair": pa.array(distinct, pa.int64()), "docs": pa.array(np.bincount(held % len(distinct), minlength=len(distinct)), pa.int64())})


FIGURES = ("n_links", "n_best", "count_sum")


def _summed(one: pa.Table) -> pa.Table:
    """Of a block: the figures of each document, those of its groups as often as it has them."""
    rows = one["docs"].combine_chunks().values
    places, times = (np.frombuffer(one[c][0].as_py(), "<i4") for c in ("places", "times"))
    ends = np.cumsum(rows.field("held").to_numpy())
    own = one["own"].combine_chunks().values
    out = {f: rows.field(f) for f in ("doc_id", "n_a", "n_b", "n_groups")}
    for name in FIGURES:
        figure = np.zeros(int(places.max(initial=0)) + 1, dtype=np.int64)
        if len(own):
            figure[own.field("local").to_numpy()] = own.field(name).to_numpy()
        sums = np.concatenate([[0], np.cumsum(figure[places] * times)])
        out[name] = pa.array(np.diff(sums[np.concatenate([[0], ends])]), pa.int64())
    return pa.table(out | {"groups_sha256": rows.field("groups_sha256")})


def aligned(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The alignment of docs (doc_id, text), a row per document, and the linked pairs, (a, b, docs, best): how many
    documents hold a pair linked and the most that a pair of its A id has.

    A document's row: doc_id, n_a, n_b, n_groups, n_links (linked occurrences), n_best (those of a pair with the most
    documents of its A id, ties included), count_sum (documents of the pairs, over links), groups_sha256. A text that is
    null or empty, or that the bytes of either tokenizer's ids don't give back, has no tokens: zeros and an empty
    digest. Each row is a document of its own, whatever its doc_id; other columns are ignored; an empty table gives
    empty results.
    """
    ship(spark)
    vocabulary, pieces = vocabulary or tokens.default_vocabulary(), pieces or default_pieces()
    scratch = Scratch(spark, "alignment")
    blocks = scratch.keep(group_blocks(docs, vocabulary, pieces, block_bytes), "blocks")
    entries = blocks.select("block", F.posexplode("keys").alias("local", "x")).select("block", "local", "x.*")
    dictionary = entries.groupBy("key").agg(F.sum("docs").alias("docs")).withColumn("gid", F.monotonically_increasing_id())
    dictionary = scratch.keep(dictionary, "dictionary")
    members = scratch.keep(join_unique(entries.select("block", "local", "key"), dictionary.select("key", "gid"), ["key"], "block").drop("key"), "members")
    expanded = scratch.keep(links(dictionary, vocabulary, pieces), "links")
    pairs = expanded.groupBy("a", "b").agg(F.count("*").alias("groups"), F.sum("docs").alias("docs")).withColumn("pair", F.monotonically_increasing_id())
    pairs = scratch.keep(pairs, "pairs")
    # pairs of several groups: a document may hold more than one of these
    shared = join_unique(expanded.select("gid", "a", "b"), pairs.where("groups > 1").select("a", "b", "pair"), ["a", "b"], "gid")
    shared = shared.groupBy("gid").agg(F.collect_list("pair").alias("pairs"))
    own = join_unique(members, shared, ["gid"], "block").groupBy("block").agg(F.collect_list(F.struct("local", "pairs")).alias("own"))
    held = blocks.select("block", F.transform("docs", lambda x: F.struct(x["held"].alias("held"))).alias("docs"), "places").join(own, "block")
    counted = held.groupBy("block").applyInArrow(_counted, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("counted"))
    pairs = pairs.join(counted, "pair", "left").select("a", "b", F.coalesce("counted", "docs").alias("docs"))
    pairs = scratch.keep(pairs, "counted")
    best = pairs.groupBy("a").agg(F.max("docs").alias("best"))
    pairs = pairs.join(F.broadcast(best), "a")  # one row for each id of the vocabulary at most
    figures = join_unique(expanded.select("gid", "a", "b", "times"), pairs, ["a", "b"], "gid")
    figures = figures.groupBy("gid").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("docs") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    own = join_unique(members, figures, ["gid"], "block").groupBy("block").agg(F.collect_list(F.struct("local", *FIGURES)).alias("own"))
    whole = blocks.select("block", "docs", "places", "times").join(own, "block", "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<local:int,n_links:long,n_best:long,count_sum:long>>")))
    rows = whole.groupBy("block").applyInArrow(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return rows, pairs


def op11_token_alignment(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    return aligned(spark, table(spark, sf_dir, "documents"), vocabulary, pieces)[0]


QUERIES = {"op11_token_alignment": op11_token_alignment}
SQL: dict[str, str] = {}
