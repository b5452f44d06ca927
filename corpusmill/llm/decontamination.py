"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark item of n characters that occurs in a text with at most k edits shares at least n - q + 1 - kq of its
q-grams with the text on diagonals (text position minus item position) that lie within k of each other. So shared
q-grams are counted in overlapping bands of 2(k + 1) diagonals, bands below that bound are dropped without loss, and
the rest is aligned in a band around its diagonals. An item too short for the bound to be 1 or more gets a smaller q,
n // (k + 1), so that every item has its whole budget of edits. Of a long item any window counts, so that a text which
quotes a part of it is found too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

U = np.uint64
Q, RATE = 8, 0.1
#: Characters of benchmark text whose q-grams are in memory at once, and characters that are sent to the workers at
#: once. More text than the first takes its blocks in turn within a pass; more than the second takes more passes.
BLOCK_CHARS, PASS_CHARS = 1_000_000, 32_000_000
#: Characters of texts that are held folded at once; eight times as many where blocks have to be built for each run.
HELD_CHARS = 1_000_000
#: Items of more characters are looked for by windows of so many, each half a window after the one before.
WINDOW = 400
BREAK = 0x110000  # between texts: no character has this number


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Lower case and one kind of white space, a character for a character."""
    out = np.arange(0x110001, dtype=np.uint32)
    for i in range(0x10000):
        if not 0xD800 <= i < 0xE000:
            low = chr(i).lower()
            out[i] = ord(" ") if chr(i).isspace() else ord(low) if len(low) == 1 else i
    return out


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(folded characters, their places in the text): a run of white space is one space, at its first place."""
    c = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    space = c == 32
    kept = np.flatnonzero(~(space & np.r_[False, space[:-1]])) if len(c) else np.zeros(0, dtype=np.int64)
    return c[kept], kept.astype(np.uint32)


def pattern(text: str | None) -> np.ndarray:
    """The folded characters of an item, without outer white space."""
    return folded((text or "").strip())[0]


def budget(n: int, rate: float) -> int:
    """Edits of an item of n characters."""
    return int(n * rate + 1e-9)


def gram_size(n: int, q: int, rate: float) -> int:
    """The largest size up to q that leaves an item of n characters with its edits a bound of 1 or more."""
    return max(1, min(q, n // (budget(n, rate) + 1)))


def qgrams(c: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(c) - q + 1)
    h = np.zeros(n, dtype=U)
    for j in range(q):
        h *= U(0x9E3779B97F4A7C15)
        h += c[j : j + n]
    return h ^ (h >> U(29))


class Block:
    """The q-grams of some benchmark items, (id, folded characters), all of the same q, and where they are."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, rate: float):
        self.q, self.ids = q, [i for i, _ in items]
        self.text = [t for _, t in items]
        self.length = np.array([len(t) for t in self.text], dtype=np.int64)
        self.edits = np.array([budget(len(t), rate) for t in self.text], dtype=np.int64)
        self.bound = self.length - q + 1 - self.edits * q
        grams = [qgrams(t, q) for t in self.text]
        code = np.concatenate([*grams, np.zeros(0, dtype=U)])
        owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, dtype=np.int64)])
        order = np.argsort(code, kind="stable")
        code, self.owner, self.place = code[order], owner[order], place[order].astype(np.int64)
        new = np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, dtype=bool)
        self.codes = code[new]
        self.begin = np.r_[np.flatnonzero(new), len(code)]
        self.shift = U(64 - max(16, int(np.ceil(np.log2(max(1, len(self.codes)) * 24)))))
        self.seen = np.zeros(1 << int(U(64) - self.shift), dtype=bool)
        self.seen[self._slot(self.codes)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * U(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def bands(self, c: np.ndarray) -> np.ndarray:
        """(item, first diagonal, last diagonal) of the bands of c that meet the bound."""
        h = qgrams(c, self.q)
        at = np.flatnonzero(self.seen[self._slot(h)])
        if not len(at) or not len(self.codes):
            return np.zeros((0, 3), dtype=np.int64)
        k = np.minimum(np.searchsorted(self.codes, h[at]), len(self.codes) - 1)
        true = self.codes[k] == h[at]
        at, k = at[true], k[true]
        many = self.begin[k + 1] - self.begin[k]
        if not many.sum():
            return np.zeros((0, 3), dtype=np.int64)
        at = np.repeat(at, many)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(self.begin[k], many) + inner
        item = self.owner[entry]
        shift = int(self.length.max())  # so that no diagonal is negative
        cell = (at - self.place[entry] + shift) // (self.edits[item] + 1)
        wide = len(c) + 2 * shift + 2
        key, count = np.unique(item * wide + cell, return_counts=True)
        item, cell = key // wide, key % wide
        after = np.r_[np.where(key[1:] == key[:-1] + 1, count[1:], 0), 0] if len(key) else count
        before = np.r_[0, np.where(key[1:] == key[:-1] + 1, count[:-1], 0)] if len(key) else count
        out = []
        for first, total in ((cell, count + after), (cell - 1, count + before)):
            ok = total >= self.bound[item]
            width = self.edits[item][ok] + 1
            low = first[ok] * width - shift
            out.append(np.stack([item[ok], low, low + 2 * width - 1], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def align(self, c: np.ndarray, item: int, low: int, high: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best place of the item in c with start on the diagonals low to high."""
        t, k = self.text[item], int(self.edits[item])
        n, begin, end = len(t), max(0, low - k), min(len(c), high + len(t) + k + 1)
        w = c[begin:end]
        exact = np.flatnonzero(w[: max(0, len(w) - n + 1)] == t[0]) if n else []
        for s in exact:
            if np.array_equal(w[s : s + n], t):
                return 0, begin + int(s), begin + int(s) + n
        # rows: item characters; columns: the diagonals of the band, column j of row i is text place i + j + off
        off, wide, far = low - k - begin, high - low + 2 * k + 1, n + k + 1
        j = np.arange(wide)
        place = off + j
        cost = np.full(wide + 1, far)  # the last column stands for the end of the band
        cost[:-1][(place >= 0) & (place <= len(w))] = 0
        origin = np.append(place, 0)
        left = max(0, -off)
        padded = np.full(left + len(w) + n + wide + 2, BREAK, dtype=np.uint32)
        padded[left : left + len(w)] = w
        for i in range(n):
            begin_at = left + off + i
            # no text character at that place equals any item character, so leaving the text costs an edit a step
            across = cost[:-1] + (padded[begin_at : begin_at + wide] != t[i])
            down = cost[1:] + 1  # an item character without a text character
            pick = down < across
            new = np.where(pick, down, across)
            begun = np.where(pick, origin[1:], origin[:-1])
            # text characters without an item character: the least of what stands to the left plus the distance
            base = new - j
            best = np.minimum.accumulate(base)
            source = np.maximum.accumulate(np.where(base == best, j, 0))
            cost[:-1] = best + j
            origin[:-1] = begun[source]
            if not i % 16 and cost.min() > k:
                return None
        ends = n + place
        cost[:-1][(ends < 0) | (ends > len(w))] = far
        best = int(np.argmin(cost[:-1]))
        if cost[best] > k:
            return None
        return int(cost[best]), begin + max(0, int(origin[best])), begin + int(ends[best])


def _found(texts: list[tuple[np.ndarray, np.ndarray]], block: Block, limit: int = 400_000) -> list[list[tuple[int, int, int, int]]]:
    """(item_id, start, end, edits) of every folded text, each item at its best place in each stretch of text."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    held: list[np.ndarray] = []
    where: list[int] = []
    gap = np.full(1, BREAK, dtype=np.uint32)

    def work() -> None:
        starts = np.cumsum([0, *(len(x) + 1 for x in held)])
        c = np.concatenate([y for x in held for y in (x, gap)])
        best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        ranges: list[list[int]] = []
        for item, low, high in block.bands(c).tolist():
            if ranges and ranges[-1][0] == item and low <= ranges[-1][2] + 1:
                ranges[-1][2] = high
            else:
                ranges.append([item, low, high])
        for item, low, high in ranges:
            n, k = int(block.length[item]), int(block.edits[item])
            e = max(0, int(np.searchsorted(starts, max(0, low - k), side="right")) - 1)
            while e < len(held) and starts[e] <= high + k:  # the band may reach over breaks
                begin, end = int(starts[e]), int(starts[e]) + len(held[e])
                if min(end, high + n + k) - max(begin, low - k) >= n - k:
                    if got := block.align(held[e], item, low - begin, high - begin):
                        best.setdefault((e, item), []).append(got)
                e += 1
        for (e, item), found in best.items():
            last, place = -1, texts[where[e]][1]
            for edits, start, end in sorted(found, key=lambda x: (x[1], x[0])):
                if start >= last:
                    out[where[e]].append((block.ids[item], int(place[start]), int(place[end - 1]) + 1, edits))
                    last = end
        held.clear()
        where.clear()

    size = 0
    for i, (c, _) in enumerate(texts):
        held.append(c)
        where.append(i)
        size += len(c)
        if size > limit:
            work()
            size = 0
    if held:
        work()
    return out


def windows(p: np.ndarray, size: int) -> list[np.ndarray]:
    """An item, or its windows: the last one ends where the item does."""
    if len(p) <= size:
        return [p]
    starts = [*range(0, len(p) - size, max(1, size // 2)), len(p) - size]
    return [p[s : s + size] for s in starts]


def blocks_of(items: list[tuple[int, str]], q: int, rate: float, block_chars: int, window: int = WINDOW) -> Iterator[Block]:
    """Blocks of at most about block_chars characters, each of items (or windows) that take the same q."""
    by: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, t in items:
        for p in windows(pattern(t), window):
            if len(p):
                by.setdefault(gram_size(len(p), q, rate), []).append((i, p))
    for size, own in sorted(by.items()):
        held, chars = [], 0
        for i, p in own:
            if held and chars + len(p) > block_chars:
                yield Block(held, size, rate)
                held, chars = [], 0
            held.append((i, p))
            chars += len(p)
        yield Block(held, size, rate)


def joined(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Places of windows of one item that overlap are one place, with the edits of the worst."""
    out: list[tuple[int, int, int, int]] = []
    for item, start, end, edits in sorted(found):
        if out and out[-1][0] == item and start < out[-1][2]:
            out[-1] = (item, out[-1][1], max(end, out[-1][2]), max(edits, out[-1][3]))
        else:
            out.append((item, start, end, edits))
    return out


def runs(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """The texts in runs of about `most` characters; a longer text is a run of its own."""
    run: list[str | None] = []
    size = 0
    for t in texts:
        if run and size + len(t or "") > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


MATCH = "array<struct<item_id:long,start:int,end:int,edits:int>>"
MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))


def benchmark_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS, pass_chars: int = PASS_CHARS, window: int = WINDOW) -> DataFrame:
    """docs with a column `matches`: the benchmark passages in the whole text, sorted by item and place (code points,
    end exclusive).

    An item counts where it occurs with at most floor(rate * length) edits; of an item of more than `window` characters
    each window that long counts by itself, and places that overlap are one. Case and kinds and runs of white space
    don't count as edits, nor does the item's outer white space. All columns of docs stay (a column named `matches` is
    replaced). A null or empty text has no matches, nor has a null or blank item any; an empty benchmark gives empty
    lists; repeated rows are each reported, repeated items are one; of places of an item that overlap, the first counts.
    The benchmark is sent to the workers pass_chars characters at a time, and docs are passed once for each; in a pass
    a worker holds the q-grams of block_chars characters.
    """
    docs = docs.drop("matches").withColumn("matches", F.lit(None).cast(MATCH))
    schema = docs.schema

    def with_items(frame: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)
        single = sum(len(t) for _, t in items) <= block_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = list(blocks_of(sent.value, q, rate, block_chars, window)) if single else None
            for b in batches:
                found = [y for texts in runs(b.column("text").to_pylist(), HELD_CHARS if single else 8 * HELD_CHARS) for y in search(texts, whole)]
                old = b.column("matches").to_pylist()
                names = ("item_id", "start", "end", "edits")
                lists = [sorted([*(x or []), *(dict(zip(names, m, strict=True)) for m in y)], key=lambda m: tuple(m[n] for n in names)) for x, y in zip(old, found, strict=True)]
                at = b.schema.get_field_index("matches")
                yield pa.RecordBatch.from_arrays([pa.array(lists, type=MATCH_ARROW) if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

        def search(texts: list[str | None], whole: list[Block] | None) -> list[list]:
            own = [folded(t or "") for t in texts]
            found: list[list] = [[] for _ in texts]
            for block in whole or blocks_of(sent.value, q, rate, block_chars, window):
                for x, more in zip(found, _found(own, block), strict=True):
                    x += more
            return [joined(x) for x in found]

        return frame.mapInArrow(run, schema)

    scratch, frame = Scratch(spark, "decontamination"), docs
    items: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        if items and size + len(r.text) > pass_chars:
            frame = scratch.keep(with_items(frame, items))
            items, size = [], 0
        items.append((r.item_id, r.text))
        size += len(r.text)
    return with_items(frame, items)


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: doc_id, contaminated, item_ids (sorted, distinct), n_matches, spans (item:start:end:edits)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_matches(spark, docs, table(spark, sf_dir, "benchmark"))
    span = lambda m: F.concat_ws(":", m["item_id"], m["start"], m["end"], m["edits"])
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_distinct("matches.item_id").alias("item_ids"), F.size("matches").alias("n_matches"), F.array_join(F.transform("matches", span), ",").alias("spans"))


QUERIES = {"op8_benchmark_leaks": op8_benchmark_leaks}
SQL: dict[str, str] = {}
