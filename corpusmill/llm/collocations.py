"""Phrase collocations by hierarchical pair naming.

Texts are held as blocks, rows of some thousand documents each, in which every distinct word has a local number. Words
are counted over all blocks, frequent ones get a global id, and a block learns the ids of its own numbers only. In a
round the sequence of (k-1)-gram numbers of a block becomes one of k-gram numbers: two adjacent frequent (k-1)-grams are
a pair, pairs are counted over all blocks by their two ids, and frequent pairs get ids of their own. An id's pair is
its two parents, its first k-1 and its last k-1 words, so that the counts of all parts of a cut come with two joins to
the level below, and phrases within longer ones are found by the same pointers.
"""

from __future__ import annotations

import collections
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.groups import PARTS, join_unique
from .common import Scratch, arrow_batches, ship, table

#: Fixed values of the contract.
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b"\t"
LEAST, LONGEST, WITHIN, BEST, NO_LANG = 100, 5, 100, 2000, "und"
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Rows and bytes of phrases up to which the ids of a level are sent to all tasks; larger ones are joined in parts.
SENT_ROWS, SENT_BYTES = 1 << 18, 1 << 24

_BREAK = b"\xff"  # stands in no UTF-8 text
_TO_BREAKS = bytes.maketrans(BREAKS + SPACES, _BREAK * len(BREAKS) + b" " * len(SPACES))
_WORDS = pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_PAIRS = pa.struct([("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])


def _block(block: int, sequence: np.ndarray, rows: pa.StructArray) -> pa.RecordBatch:
    """The one row of a block: its sequence of local numbers, -1 where a phrase ends, and what the numbers stand for."""
    keep = np.ones(len(sequence), dtype=bool)
    keep[1:] = (sequence[1:] >= 0) | (sequence[:-1] >= 0)
    lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sequence[keep].astype("<i4").tobytes()], pa.binary()), lists], names=["block", "sequence", "names"])


def word_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (lang, text) as blocks of words: (block, sequence, names), the n-th of the names for local number n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)

        def done(by: dict, parts: list) -> pa.RecordBatch:
            sequence = np.concatenate(parts)
            own = [(local, lang, word.decode()) for lang, words in by.items() for word, local in words.items() if local >= 0]
            own.sort()
            counts = np.bincount(sequence[sequence >= 0], minlength=len(own))
            columns = [pa.array([x[1] for x in own], pa.string()), pa.array([x[2] for x in own], pa.string()), pa.array(counts, pa.int64())]
            return _block(next(number), sequence, pa.StructArray.from_arrays(columns, fields=list(_WORDS)))

        by, parts, size, local = {}, [], 0, itertools.count()
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                lang = NO_LANG if lang is None else lang
                if lang not in by:
                    by[lang] = collections.defaultdict(local.__next__, {_BREAK: -1})
                raw = (text or "").encode().lower().translate(_TO_BREAKS).replace(_BREAK, b" \xff ")  # bytes.lower is A-Z
                words = raw.split(b" ")
                parts.append(np.fromiter(map(by[lang].__getitem__, filter(None, words)), dtype=np.int64))
                parts.append(np.array([-1]))
                size += len(raw)
                if size >= block_bytes:
                    yield done(by, parts)
                    by, parts, size, local = {}, [], 0, itertools.count()
        if parts:
            yield done(by, parts)

    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "block long, sequence binary, names array<struct<lang:string,word:string,n:long>>")


def entries(blocks: DataFrame) -> DataFrame:
    """What the local numbers of all blocks stand for: block, local, and the names' columns."""
    return blocks.select("block", F.posexplode("names").alias("local", "x")).select("block", "local", "x.*")


def _up(block: int, sequence: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """The block one level up: adjacent numbers that have ids (others have -1) become pairs."""
    size = len(ids)
    known = np.concatenate([ids, [-1]])[sequence] >= 0  # the last place is that of -1
    both = np.flatnonzero(known[:-1] & known[1:])
    pairs, local, n = np.unique(sequence[both].astype(np.int64) * size + sequence[both + 1], return_inverse=True, return_counts=True)
    above = np.full(max(len(sequence) - 1, 0), -1, dtype=np.int64)
    above[both] = local
    columns = [pa.array(x, pa.int64()) for x in (ids[pairs // max(size, 1)], ids[pairs % max(size, 1)], n)]
    return _block(block, above, pa.StructArray.from_arrays(columns, fields=list(_PAIRS)))


class _Known:
    """The ids of a level by their names: words in a dictionary, pairs as places among the sorted pairs."""

    def __init__(self, level: pa.Table, by: list[str]):
        self.by, self.sorted = by, by == ["left", "right"]
        own = [level[c] for c in (*by, "id")]
        if self.sorted:
            left, right, ids = (c.to_numpy() for c in own)
            self.lefts, self.rights = np.unique(left), np.unique(right)
            codes = self._codes(left, right)
            order = np.argsort(codes)
            self.codes, self.held = np.append(codes[order], -1), np.append(ids[order], -1)
        else:
            self.dictionary = dict(zip(zip(*(c.to_pylist() for c in own[:-1]), strict=True), own[-1].to_pylist(), strict=True))

    def _codes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A pair as one number; -2 where a side isn't in any pair of the level."""
        places = []
        for values, side in ((self.lefts, left), (self.rights, right)):
            at = np.searchsorted(values, side)
            at[at == len(values)] = 0
            places.append(np.where(values[at] == side, at, -1) if len(values) else np.full(len(side), -1))
        return np.where((places[0] >= 0) & (places[1] >= 0), places[0] * len(self.rights) + places[1], -2)

    def ids(self, names: pa.StructArray) -> np.ndarray:
        columns = [names.field(c) for c in self.by]
        if not self.sorted:
            get = self.dictionary.get
            return np.fromiter((get(x, -1) for x in zip(*(c.to_pylist() for c in columns), strict=True)), dtype=np.int64)
        codes = self._codes(*(c.to_numpy() for c in columns))
        at = np.searchsorted(self.codes[:-1], codes)
        return np.where(self.codes[at] == codes, self.held[at], -1)


UP = "block long, sequence binary, names array<struct<left:long,right:long,n:long>>"


def pair_blocks(blocks: DataFrame, level: DataFrame, by: list[str]) -> DataFrame:
    """The blocks one level up, by the ids that level has for names.

    Where ids are few, so are the names that have one: the ids are sent to all tasks and blocks stay where they are.
    Otherwise most names have one, and ids come to blocks by joins, those of a name in parts.
    """
    ids = level.select(*by, "id")
    rows, size = level.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    if rows <= SENT_ROWS and size <= SENT_BYTES:
        sent = blocks.sparkSession.sparkContext.broadcast(ids.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Known(sent.value, by)
            for b in batches:
                for k in range(b.num_rows):
                    ids = known.ids(b["names"].slice(k, 1).flatten())
                    yield _up(b["block"][k].as_py(), np.frombuffer(b["sequence"][k].as_buffer(), "<i4"), ids)

        return blocks.mapInArrow(run, UP)
    # a block meets its ids as rows, which are sorted and may spill, not as arrays of the heap
    named = join_unique(entries(blocks), ids, by, "block").select(F.col("block").alias("of"), "local", "id")

    def up(one: pa.Table, own: pa.Table) -> pa.Table:
        ids = np.full(one["size"][0].as_py(), -1, dtype=np.int64)
        ids[own["local"].to_numpy()] = own["id"].to_numpy()
        return pa.Table.from_batches([_up(one["block"][0].as_py(), np.frombuffer(one["sequence"][0].as_py(), "<i4"), ids)])

    whole = blocks.select("block", "sequence", F.size("names").alias("size"))
    return whole.groupBy("block").cogroup(named.groupBy("of")).applyInArrow(up, UP)


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exact: products are decimals of 38 digits."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", wide(1000 * a) * wide(n), wide(left) * wide(right))


def phrases(spark: SparkSession, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All phrases of 2 to `longest` words that stand `least` times or more in docs (lang, text) of their language:
    lang, phrase, words, a (its count), n (words of the language), l and r (counts of the two sides of its
    lowest-scoring cut; of equal cuts the first), score, and longer (the count of the most frequent candidate that
    holds it, null if none).

    A null lang counts as `und`, a null text as empty; whole texts are read; repeated rows count each; other columns are
    ignored. An empty table, or one without frequent pairs, gives an empty result.
    """
    ship(spark)
    scratch = Scratch(spark, "collocations")
    blocks = scratch.keep(word_blocks(docs, block_bytes), "words", large=True)
    words = scratch.keep(entries(blocks).groupBy("lang", "word").agg(F.sum("n").alias("a")), "counts")
    level = join_unique(words.where(F.col("a") >= least), words.groupBy("lang").agg(F.sum("a").alias("n")), ["lang"], "word")
    level = level.select("lang", "word", F.col("word").alias("phrase"), "a", "n", F.array("a").alias("heads"), F.array("a").alias("tails"), F.monotonically_increasing_id().alias("id"))
    level, levels, by = scratch.keep(level, "level-1"), [], ["lang", "word"]
    scratch.drop(words)
    for size in range(2, longest + 1):
        below, by = blocks, by if size == 2 else ["left", "right"]
        with arrow_batches(spark, block_bytes):
            blocks = scratch.keep(pair_blocks(blocks, level, by), f"blocks-{size}", large=True)
        scratch.drop(below)
        pairs = scratch.keep(entries(blocks).groupBy("left", "right").agg(F.sum("n").alias("a")).where(F.col("a") >= least), f"pairs-{size}")
        first = level.select(F.col("id").alias("left"), "lang", "n", F.col("phrase").alias("_first"), "heads")
        last = level.select(F.col("id").alias("right"), "word", "tails")
        level = join_unique(join_unique(pairs, first, ["left"], "right"), last, ["right"], "left")
        more = lambda c: F.concat(c, F.array("a")).alias(c)
        level = level.select("left", "right", "lang", "word", F.concat_ws(" ", "_first", "word").alias("phrase"), "a", "n", more("heads"), more("tails"), F.lit(size).alias("words"), F.monotonically_increasing_id().alias("id"))
        level = scratch.keep(level, f"level-{size}")
        levels.append(level)
        scratch.drop(pairs)
    scratch.drop(blocks)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    within = [found.select((F.col("words") - 1).alias("words"), F.col(side).alias("id"), "a") for side in ("left", "right")]
    longer = within[0].unionByName(within[1]).groupBy("words", "id").agg(F.max("a").alias("longer"))
    head, tail = lambda k: F.element_at("heads", k), lambda k: F.element_at("tails", F.col("words") - k)
    own_score = lambda k: score(F.col("a"), F.col("n"), head(k), tail(k))
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(own_score(k).alias("score"), k.alias("k")))
    found = found.join(longer, ["words", "id"], "left").withColumn("cut", F.array_min(cuts))
    return found.select("lang", "phrase", "words", "a", head(F.col("cut.k")).alias("l"), tail(F.col("cut.k")).alias("r"), "n", F.col("cut.score").alias("score"), "longer")


def collocations(spark: SparkSession, docs: DataFrame, best: int = BEST, within: int = WITHIN, least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Phrases that a longer candidate holds at `within` percent of their count or more are left out. They rank by score
    and count, largest first, then by the bytes of the phrase. Edge cases as in phrases().
    """
    found = phrases(spark, docs, least, longest, block_bytes).where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # parts of a language first, so that no task sorts all of its phrases
    found = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {"op13_collocations": op13_collocations}
SQL = {
    "op13_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p
), total AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang
), grams AS (
  SELECT lang, k, list_slice(words, i, i + k - 1) AS words
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 6) t(k))
), f AS (
  SELECT lang, k, words, count(*)::BIGINT AS a FROM grams GROUP BY lang, k, words HAVING count(*) >= 100
), cuts AS (
  SELECT f.lang, f.k, f.words, f.a, x.a AS l, y.a AS r, n, (1000 * f.a::HUGEINT * n // (x.a::HUGEINT * y.a))::BIGINT AS score, c
  FROM f JOIN total USING (lang), range(1, 5) t(c), f x, f y
  WHERE c < f.k AND x.lang = f.lang AND x.words = list_slice(f.words, 1, c) AND y.lang = f.lang AND y.words = list_slice(f.words, c + 1, f.k)
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, c) = 1
), inside AS (
  SELECT lang, list_slice(words, i, i + m - 1) AS words, max(a) AS longer
  FROM (SELECT lang, words, a, m, unnest(range(1, k - m + 2)) AS i FROM f, range(2, 5) t(m) WHERE m < k) GROUP BY ALL
), left_over AS (
  SELECT best.* FROM best LEFT JOIN inside USING (lang, words) WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank,
  array_to_string(words, ' ') AS phrase, a, l, r, n, score
FROM left_over QUALIFY rank <= 2000""",
}
