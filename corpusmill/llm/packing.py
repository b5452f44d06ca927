"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces; pieces of full length are sequences of their own. The rest are dealt by hash into
blocks of bounded size, each block an independent bin-packing problem that several islands (rows of a small table,
one task each) evolve. A genome is a partition into bins. Crossover injects whole well-filled bins of one parent into
the other, drops the bins that then hold a piece twice and best-fits the displaced pieces. Between epochs the best
genome of each island moves to the next island of the ring by a join. Ill-filled bins of all blocks are pooled and
packed once more, so that the loss does not add up over blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, few, partitions, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be shorter than size."""
    if total <= size:
        return [(0, total)]
    first = total % size or size
    return [(0, first)] + [(s, size) for s in range(first, total, size)]


def token_pieces(docs: DataFrame, size: int, vocabulary: str, end_id: int = 0) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in PIECES_ARROW}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    row = (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=PIECES_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class Bins:
    """Bins under construction. One bit for each residual capacity finds the tightest bin in constant time."""

    def __init__(self, size: int, residuals: list[int]):
        self.size, self.by, self.mask, self.count = size, {}, 0, 0
        for r in residuals:
            self._put(self.count, r)
            self.count += 1

    def _put(self, b: int, residual: int) -> None:
        if residual:
            self.by.setdefault(residual, []).append(b)
            self.mask |= 1 << residual

    def add(self, length: int) -> int:
        fits = self.mask >> length
        if fits:
            residual = length + (fits & -fits).bit_length() - 1
            own = self.by[residual]
            b = own.pop()
            if not own:
                self.mask &= ~(1 << residual)
        else:
            residual, b = self.size, self.count
            self.count += 1
        self._put(b, residual - length)
        return b


def best_fit(lengths: np.ndarray, size: int, order: np.ndarray) -> np.ndarray:
    bins, genome, own = Bins(size, []), np.empty(len(lengths), dtype=np.int32), lengths.tolist()
    for i in order.tolist():
        genome[i] = bins.add(own[i])
    return genome


def fitness(genome: np.ndarray, lengths: np.ndarray, size: int) -> tuple[int, float]:
    """(minus the number of bins, mean squared fill): more full bins leave more room for later merges."""
    load = np.bincount(genome, weights=lengths)
    return -len(load), float(np.mean((load / size) ** 2))


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """A child of a with whole well-filled bins of b: bins of a that share a piece with these go, and the pieces
    this displaces are best-fitted, longest first."""
    load = np.bincount(b, weights=lengths)
    well = np.flatnonzero(load >= np.quantile(load, 0.3))
    chosen = np.zeros(len(load), dtype=bool)
    chosen[rng.choice(well, max(1, int(len(well) * rng.uniform(0.1, 0.5))), replace=False)] = True
    injected = chosen[b]
    gone = np.zeros(int(a.max()) + 1, dtype=bool)
    gone[a[injected]] = True
    held = ~gone[a]
    poor = np.bincount(a, weights=lengths)[a] < 0.97 * size  # mutation: ill-filled bins are opened too
    held &= ~(poor & (rng.random(int(a.max()) + 1) < 0.5)[a])
    child = np.full(len(a), -1, dtype=np.int64)
    n_in = int(chosen.sum())
    child[injected] = (np.cumsum(chosen) - 1)[b[injected]]
    kept, renamed = np.unique(a[held], return_inverse=True)
    child[held] = n_in + renamed
    placed = child >= 0
    bins = Bins(size, (size - np.bincount(child[placed], weights=lengths[placed], minlength=n_in + len(kept))).astype(int).tolist())
    free = np.flatnonzero(~placed)
    own = lengths.tolist()
    for i in free[np.argsort(-lengths[free] + rng.uniform(0, 2, len(free)), kind="stable")].tolist():
        child[i] = bins.add(own[i])
    return child.astype(np.int32)


def evolve(lengths: np.ndarray, size: int, seeds: list[np.ndarray], seed: int, population: int, generations: int) -> np.ndarray:
    """The best genome after some generations of an island. Ends early at the lower bound on the number of bins."""
    bound = -(-int(lengths.sum()) // size)
    rng = np.random.default_rng(seed)
    down = np.argsort(-lengths, kind="stable")
    people = [g for g in seeds if g is not None and len(g) == len(lengths)] or [best_fit(lengths, size, down)]
    scored = sorted(((fitness(g, lengths, size), k, g) for k, g in enumerate(people)), key=lambda x: (x[0], -x[1]), reverse=True)
    if -scored[0][0][0] <= bound:
        return scored[0][2]
    while len(people) < population:
        people.append(best_fit(lengths, size, np.argsort(-lengths * rng.uniform(0.9, 1.1, len(lengths)), kind="stable")))
    scored = [(fitness(g, lengths, size), k, g) for k, g in enumerate(people)]
    number = len(scored)
    for _ in range(generations):
        scored.sort(key=lambda x: (x[0], -x[1]), reverse=True)
        if -scored[0][0][0] <= bound:
            break
        parents = rng.permutation(len(scored))[:2]
        child = crossover(scored[parents.min()][2], scored[parents.max()][2], lengths, size, rng)
        scored[-1] = max(scored[-1], (fitness(child, lengths, size), number, child), key=lambda x: (x[0], x[1]))
        number += 1
    return max(scored, key=lambda x: (x[0], -x[1]))[2]


#: Islands that a task evolves, where there are enough of them for all cores.
ISLANDS_A_TASK = 8

STATE = "block long, island int, items array<long>, lengths array<int>, genome array<int>"


def _epoch(state: DataFrame, size: int, epoch: int, population: int, generations: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples(index=False):
                seeds = [np.asarray(g, dtype=np.int32) for g in (r.genome, r.migrant) if g is not None]
                found.append(evolve(np.asarray(r.lengths, dtype=np.int64), size, seeds, int(r.block) * 1009 + int(r.island) * 31 + epoch, population, generations))
            yield batch.assign(genome=found).drop(columns=["migrant"])

    return state.mapInPandas(run, STATE)


def _pack(spark: SparkSession, scratch: Scratch, items: DataFrame, size: int, block_size: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """(item, length) -> (item, length, block, bin, offset, fill)."""
    n = items.count()
    blocks = max(1, round(n / block_size))
    # some islands a task, where that leaves two tasks a core: each task writes a file in each epoch
    rows = blocks * islands
    wide = min(partitions(spark) * 4, rows, max(2 * spark.sparkContext.defaultParallelism, -(-rows // ISLANDS_A_TASK)))
    base = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    # a block has a bounded number of rows by construction, so its list is bounded too
    base = base.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("x"))
    base = base.select("block", F.col("x.item").alias("items"), F.col("x.length").cast("array<int>").alias("lengths"))
    ring = base.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "items", "lengths", F.lit(None).cast("array<int>").alias("genome"), F.lit(None).cast("array<int>").alias("migrant"))
    state = None
    for epoch in range(epochs):
        if state is not None:
            elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("genome").alias("migrant"))
            ring = state.join(elite, ["block", "island"])
            ring = ring.select("block", "island", "items", "lengths", "genome", "migrant")
        before, state = state, scratch.keep(_epoch(ring.repartition(wide, "block", "island"), size, epoch, population, generations), "islands")
        if before is not None:
            scratch.drop(before)
    best = state.withColumn("bins", F.array_max("genome")).groupBy("block").agg(F.min_by(F.struct("items", "lengths", "genome"), F.struct("bins", "island")).alias("x")).select("block", "x.*")

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                genome, lengths = np.asarray(r.genome, dtype=np.int64), np.asarray(r.lengths, dtype=np.int64)
                order = np.argsort(genome, kind="stable")
                ends = np.cumsum(lengths[order])
                first = np.r_[True, genome[order][1:] != genome[order][:-1]]
                begun = (ends - lengths[order])[first][np.cumsum(first) - 1]
                load = np.bincount(genome, weights=lengths).astype(np.int64)
                yield pd.DataFrame({"item": np.asarray(r.items, dtype=np.int64)[order], "length": lengths[order], "block": np.int64(r.block), "bin": genome[order], "offset": ends - lengths[order] - begun, "fill": load[genome[order]]})

    return best.mapInPandas(lay, "item long, length long, block long, bin long, offset long, fill long")


def pack_documents(spark: SparkSession, docs: DataFrame, size: int = 2048, vocabulary: str | None = None, block_size: int = 8192, islands: int = 3, epochs: int = 3, population: int = 6, generations: int = 12) -> DataFrame:
    """Packs documents (doc_id, text; other columns are ignored) into sequences of at most `size` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, fill (tokens in the
    sequence). A null text counts as empty: one piece that holds the end id only. A null doc_id stays null, and
    repeated rows are packed each for themselves. An empty table gives an empty result. Ties between genomes go to
    the older one, between islands to the lower number, so that results repeat.
    """
    scratch = Scratch(spark, "packing")
    pieces = token_pieces(few(docs), size, vocabulary or tokens.default_vocabulary())
    pieces = scratch.keep(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    args = {"size": size, "block_size": block_size, "islands": islands, "epochs": epochs, "population": population, "generations": generations}
    first = scratch.keep(_pack(spark, scratch, pieces.where(F.col("length") < size).select("item", "length"), **args), "first")
    poor = first.where(F.col("fill") < 0.995 * size).select("item", "length")
    second = scratch.keep(_pack(spark, scratch, poor, **args), "second")
    # sequence numbers: even for the first level, odd for the second, negative for full pieces
    number = lambda level: ((F.col("block") * F.lit(1 << 20) + F.col("bin")) * 2 + level).alias("sequence_id")
    placed = first.where(F.col("fill") >= 0.995 * size).select("item", number(0), "offset", "fill")
    placed = placed.unionByName(second.select("item", number(1), "offset", "fill"))
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", -F.col("item") - 1).withColumn("offset", F.lit(0).cast("long")).withColumn("fill", F.col("length"))
    out = pieces.where(F.col("length") < size).join(placed, "item").unionByName(full)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill")


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op1_pack_documents": op1_pack_documents}
SQL: dict[str, str] = {}
