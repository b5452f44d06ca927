"""Line, paragraph and chunk deduplication."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from functools import lru_cache
from itertools import combinations, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..session import Scratch
from .groups import with_groups

NEAR, EXEMPT = 3, 20
#: Edges to undecided nodes that are scanned on the driver at once.
FRONT = 100_000
#: Cells (a power of two) that grams are counted in for their order: 8 MB in each task, however many grams there are.
CELLS = 1 << 20


def dedup_lines(docs: DataFrame, text: str = "text", removed: str = "line_dedup_removed") -> DataFrame:
    """The first of equal lines (outer white space aside) stays, blank lines stay; adds the number of removed lines.

    Lines are sorted with their places, so that equal ones stand side by side: a text costs n log n of its lines."""
    df = T.once(docs.withColumn("_lines", T.lines(T.filled(F.col(text)))), "_bare", F.transform(T.lines(T.filled(F.col(text))), T.strip))
    df = df.withColumn("_sorted", F.sort_array(F.transform("_bare", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    n = F.size("_sorted") - 1
    again = F.zip_with(F.slice("_sorted", F.lit(2), n), F.slice("_sorted", F.lit(1), n), lambda b, a: F.when((a["x"] == b["x"]) & (b["x"] != ""), b["i"]))
    df = df.withColumn("_again", F.sort_array(F.filter(again, lambda i: i.isNotNull())))
    # what lies between the places of repeated lines stays
    ends = F.concat(F.array(F.lit(-1)), F.col("_again"), F.array(F.size("_lines")))
    between = F.zip_with(F.slice(ends, F.lit(1), F.size("_again") + 1), F.slice(ends, F.lit(2), F.size("_again") + 1), lambda a, b: F.slice("_lines", a + 2, b - a - 1))
    df = df.withColumn("_ends", ends).withColumn("_kept", F.when(F.size("_again") == 0, F.col("_lines")).otherwise(F.flatten(between)))
    df = df.withColumn(removed, F.size("_again")).withColumn(text, F.array_join("_kept", "\n"))
    return df.drop("_lines", "_bare", "_kept", "_sorted", "_again", "_ends")


@lru_cache(maxsize=200_000)
def _bits(gram: str) -> int:
    return int.from_bytes(hashlib.md5(gram.encode("utf-8", "surrogatepass")).digest()[8:], "big")


def simhash_of(text: str) -> int:
    """64 bits over the weighted 4-character shingles of the letters and digits, case aside."""
    kept = "".join(c for c in text.lower() if c.isalnum() or c == "_")
    grams = Counter(kept[i : i + 4] for i in range(max(len(kept) - 3, 1)))
    values = np.array([_bits(g) for g in grams], dtype=np.uint64)
    weights = np.fromiter(grams.values(), dtype=np.int64)
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ahead = weights @ bits > weights.sum() / 2
    return int.from_bytes(np.packbits(ahead).tobytes(), "big", signed=True)


def simhash(text: Column) -> Column:
    """The signature as the bit pattern of a long, null for texts of fewer than 20 characters."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or len(t) < EXEMPT else simhash_of(t) for t in texts], dtype="Int64")

    return run(text)


def dedup_paragraphs(docs: DataFrame, text: str = "text", removed: str = "para_dedup_removed", near: int = NEAR) -> DataFrame:
    """Paragraphs near an earlier kept one go; short ones stay; a text of one paragraph is left as it is."""

    @F.pandas_udf("text string, removed int")
    def run(texts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        out = []
        for t, ps in zip(texts, parts, strict=True):
            kept, seen = [], []
            for p in ps if len(ps) > 1 else []:
                if len(p) >= EXEMPT:
                    h = simhash_of(p) & (2**64 - 1)
                    if any((h ^ s).bit_count() <= near for s in seen):
                        continue
                    seen.append(h)
                kept.append(p)
            out.append(("\n\n".join(kept), len(ps) - len(kept)) if len(ps) > 1 else (t, 0))
        return pd.DataFrame(out, columns=["text", "removed"])

    df = docs.withColumn("_x", run(T.filled(F.col(text)), T.paragraphs(F.col(text))))
    return df.withColumn(text, F.col("_x.text")).withColumn(removed, F.col("_x.removed")).drop("_x")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 0) -> DataFrame:
    """(key, kept): the least key of equal texts; texts shorter than `least` are exempt."""
    same = F.when(F.length(T.filled(F.col(text))) >= least, F.md5(T.filled(F.col(text)))).otherwise(F.concat(F.lit("#"), F.col(key).cast("string")))
    own = docs.select(key, same.alias("same"))
    return with_groups(own, ["same"], key, F.min(key).alias("kept")).select(key, "kept")


def _masks(near: int) -> list[int]:
    """Masks of a signature, as signed longs: two signatures at most `near` bits apart agree under one of them. Of
    2 * near blocks of bits at least half are the same in both, so every choice of half of the blocks is a mask, and
    each is wide enough (32 bits) that chance seldom makes signatures agree under it."""
    blocks = max(1, 2 * near)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    out = [sum(c) for c in combinations(parts, max(1, blocks - near))]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def _banded(df: DataFrame, near: int, *columns: str) -> DataFrame:
    """A row for each mask: its number `i` and the signature under it."""
    under = F.array(*(F.col("signature").bitwiseAND(F.lit(m)) for m in _masks(near)))
    return df.select(*columns, "signature", F.posexplode(under).alias("i", "band"))


def near_edges(signed: DataFrame, key: str = "doc_id", near: int = NEAR) -> DataFrame:
    """(a, b, distance), a < b: all pairs of (key, signature) with a Hamming distance of at most `near`.

    Equal signatures meet once, as one value; pairs of equal signatures are stars, least key first, so that copies don't
    make all pairs.
    """
    signed = signed.where("signature is not null").select(key, "signature")
    groups = signed.groupBy("signature").agg(F.min(key).alias("head"))
    star = with_groups(signed, ["signature"], key, F.min(key).alias("head")).where(F.col(key) != F.col("head")).select(F.col("head").alias("a"), F.col(key).alias("b"), F.lit(0).alias("distance"))
    banded = _banded(groups, near, "head")
    left, right = banded.select("i", "band", F.col("head").alias("a"), F.col("signature").alias("s")), banded.select("i", "band", F.col("head").alias("b"), F.col("signature").alias("t"))
    pairs = _met(left, right, ["i", "band"]).where("a < b").select("a", "b", F.bit_count(F.col("s").bitwiseXOR(F.col("t"))).alias("distance")).where(F.col("distance") <= near).distinct()
    return pairs.unionByName(star)


def near_any(new: DataFrame, old: DataFrame, key: str, near: int = NEAR) -> DataFrame:
    """The keys of `new` (key, signature) that are near any signature of `old`."""
    left = _banded(new.where("signature is not null"), near, key)
    right = _banded(old.where("signature is not null").select("signature").distinct(), near).select("i", "band", F.col("signature").alias("t"))
    close = F.bit_count(F.col("signature").bitwiseXOR(F.col("t"))) <= near
    return left.join(right, ["i", "band"]).where(close).select(key).distinct()


def _met(rows: DataFrame, others: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input, by sorting: Spark sends what seems small to all tasks, which
    the driver then holds, and compressed ids and flags seem small at any size that is met in practice."""
    return rows.join(others.hint("merge"), on, how)


def greedy(nodes: DataFrame, edges: DataFrame, key: str = "doc_id", front: int = FRONT) -> DataFrame:
    """(key, kept) of the greedy scan in key order: a node goes iff an earlier kept node is its neighbour.

    Each round keeps the nodes whose earlier neighbours are all gone and drops the neighbours of kept ones. What still
    waits is a chain of dependencies, which is sequential: its first `front` edges in key order are scanned at once, so
    that a long chain takes a round for so many edges and not one for every node. Rounds go on until every node is
    decided; each decides one at least. State is written after every round.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "greedy")
    edges = scratch.keep(edges.select("a", "b").distinct(), "edges")
    state = scratch.keep(nodes.select(F.col(key).alias("id"), F.lit(None).cast("boolean").alias("kept")), "state")
    while True:
        earlier = _met(edges, state.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.bool_or(F.col("kept").isNull()).alias("wait"))
        now = _met(state, earlier, "id", "left").select("id", F.coalesce("kept", F.when(F.col("hit"), F.lit(False)).when(F.col("wait"), F.lit(None).cast("boolean")).otherwise(F.lit(True))).alias("kept"))
        now = scratch.keep(now, "state")
        scratch.drop(state)
        state = now
        waiting = state.where("kept is null").select("id")
        if waiting.isEmpty():
            break
        # edges from nodes that are gone decide nothing; those from nodes that this round kept still do
        still = state.where("kept is null or kept").select(F.col("id").alias("a"))
        open_ = _met(_met(edges, still, "a", "left_semi"), waiting.withColumnRenamed("id", "b"), "b", "left_semi")
        ahead = open_.select("a", "b").orderBy("b", "a").limit(front + 1).toArrow()
        decided = _front(list(zip(ahead["a"].to_pylist(), ahead["b"].to_pylist(), strict=True)), front)
        if decided:
            known = spark.createDataFrame(pa.table({"id": pa.array(decided.keys(), ahead.schema.field("a").type), "_kept": pa.array(decided.values(), pa.bool_())}))
            now = scratch.keep(state.join(known, "id", "left").select("id", F.coalesce("kept", "_kept").alias("kept")), "state")
            scratch.drop(state)
            state = now
            if state.where("kept is null").isEmpty():
                break
    return state.select(F.col("id").alias(key), "kept")


def _front(edges: list[tuple], front: int) -> dict:
    """Decisions over edges (a, b), sorted by b, from kept and undecided to undecided nodes: the first ones in key order. If there are more
    than `front`, the last node may lack edges and waits. Nodes without an earlier neighbour here are kept."""
    last = edges[-1][1] if len(edges) > front else None
    kept: dict = {}
    for b, group in groupby(edges, lambda e: e[1]):
        if b != last:
            kept[b] = not any([kept.setdefault(a, True) for a, _ in group])
    return kept


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", near: int = NEAR) -> DataFrame:
    """(key, kept) of the near-duplicate scan over whole tables in key order; texts under 20 characters are kept.

    Copies of a text are dropped first, which changes nothing, since they are near their first one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    signed = scratch.keep(docs.select(key, simhash(F.col(text)).alias("signature")), "signed")
    heads = signed.where("signature is not null").groupBy("signature").agg(F.min(key).alias(key))
    chosen = greedy(heads, near_edges(heads, key, near), key).where("kept").select(key, F.lit(True).alias("chosen"))
    out = _met(signed, chosen, key, "left")
    return out.select(key, (F.col("signature").isNull() | F.coalesce("chosen", F.lit(False))).alias("kept"))


def jaccard_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, least: float = 0.85) -> DataFrame:
    """(a, b, jaccard), a < b: pairs of distinct texts whose sets of word n-grams are similar.

    Prefix filter: of a set of s grams in global order, rarest first, a similar set must share one of the first
    s - ceil(least * s) + 1; only those are joined, and candidates are verified on the whole sets. Any order will do:
    grams are ordered by the counts of CELLS cells that they hash to, so that no gram outside the first ones is shuffled.
    """
    one = docs.groupBy(F.md5(T.filled(F.col(text))).alias("same")).agg(F.min(key).alias(key), F.first(text).alias("_t"))
    words = F.filter(F.split(T.filled(F.col("_t")), f"[{V.SPACE}]+"), lambda w: w != "")
    base = one.select(key, F.transform(words, lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") >= n)
    # hashes of the n-grams come from whole shifted arrays: a lambda that looks words up would split the text each time
    base = base.withColumn("g", F.col("w"))
    for k in range(1, n):
        m = F.size("w") - k
        base = base.withColumn("g", F.zip_with(F.slice("g", F.lit(1), m), F.slice("w", F.lit(k + 1), m), lambda a, b: F.xxhash64(a, b)))
    base = Scratch(docs.sparkSession, "grams").keep(base.select(key, F.array_distinct("g").alias("g")), "grams")
    cells = base.select(F.explode("g").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).agg(F.count("*").alias("n")).toArrow()
    often = np.zeros(CELLS, dtype=np.int64)
    often[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(often)

    @F.pandas_udf("array<long>")
    def first(grams: pd.Series) -> pd.Series:
        def of(g: np.ndarray) -> np.ndarray:
            return g[np.lexsort((g, sent.value[g & (CELLS - 1)]))[: len(g) - math.ceil(len(g) * least) + 1]]

        return grams.map(of)

    heads = base.select(key, F.size("g").alias("s"), F.explode(first("g")).alias("h"))
    left, right = heads.select("h", F.col(key).alias("a"), F.col("s").alias("sa")), heads.select("h", F.col(key).alias("b"), F.col("s").alias("sb"))
    near = left.join(right, "h").where((F.col("a") < F.col("b")) & (F.least("sa", "sb") >= least * F.greatest("sa", "sb"))).select("a", "b").distinct()
    both = near.join(base.select(F.col(key).alias("a"), F.col("g").alias("ga")), "a").join(base.select(F.col(key).alias("b"), F.col("g").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", (shared / (F.size("ga") + F.size("gb") - shared)).alias("jaccard")).where(F.col("jaccard") > least)


def keep_fuller(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, least: float = 0.85) -> DataFrame:
    """(key, kept): of near copies by Jaccard similarity the longer one stays, of equally long ones the lower key. A
    document goes iff a kept one that comes before it in that order is its near copy; equal texts keep their least key."""
    scratch = Scratch(docs.sparkSession, "fuller")
    own = docs.select(key, F.length(T.filled(F.col(text))).alias("_n"), F.md5(T.filled(F.col(text))).alias("_same"))
    heads = own.groupBy("_same").agg(F.min(key).alias(key), F.first("_n").alias("_n"))
    # in this order as text: longer first, then the key
    place = F.concat(F.lpad((F.lit(10**12) - F.col("_n")).cast("string"), 13, "0"), F.lit("|"), F.lpad(F.col(key).cast("string"), 20, "0"))
    heads = scratch.keep(heads.select(key, place.alias("place")), "heads")
    pairs = jaccard_pairs(docs, key, text, n, least).select("a", "b")
    at = lambda c, p: heads.select(F.col(key).alias(c), F.col("place").alias(p))
    edges = _met(_met(pairs, at("a", "pa"), "a"), at("b", "pb"), "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
    kept = greedy(heads.select("place"), edges, "place").where("kept")
    chosen = _met(heads, kept.select("place"), "place").select(key, F.lit(True).alias("_k"))
    return _met(docs.select(key), chosen, key, "left").select(key, F.coalesce("_k", F.lit(False)).alias("kept"))
