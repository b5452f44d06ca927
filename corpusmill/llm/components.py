"""Connected components of an edge table: contraction inside tasks, then alternating large-star and small-star steps
until what is left is few enough for the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_groups

#: Edges that a task contracts at a time, and that the driver finishes at most.
EDGES = 100_000


def rooted(edges: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The nodes of edges (u, v) in order, and the place of each one's root, the least node of its component."""
    ends = pa.chunked_array([*edges["u"].chunks, *edges["v"].chunks], type=edges["u"].type).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    place = np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    u, v = place[ends.indices.to_numpy()].reshape(2, -1)
    root = np.arange(len(order))
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return ends.dictionary.take(order), root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars with the same components as the edges (u, v), about EDGES of them at a time: (node, least node)."""
    held: list[pa.RecordBatch] = []

    def stars() -> list[pa.RecordBatch]:
        nodes, root = rooted(pa.Table.from_batches(held))
        leaf = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": nodes.take(pa.array(leaf)), "v": nodes.take(pa.array(root[leaf]))}).to_batches()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= EDGES:
            yield from stars()
            held = []
    if held:
        yield from stars()


def components(scratch: Scratch, edges: DataFrame, at_once: int = EDGES) -> DataFrame:
    """(u, v) of a plain type (numbers, strings, binary) -> (node, root), a written table: root is the least node that
    node is connected with.

    Nodes without an edge don't occur; loops and nulls are ignored; the direction doesn't matter, repeated edges count
    once; an empty table gives an empty result. Each task first contracts its edges to stars, which leaves an edge for
    each node in it at most. At most `at_once` edges are finished by the driver, since a round of joins takes many jobs
    however few edges are left; more go through rounds. There the least neighbour of a node comes from an aggregation
    that is combined before the shuffle, and is joined to the node's edges in parts (with_groups), so a node of very many
    edges never comes together in one task. Edges are written after every round, until none changes.
    """
    contracted = lambda e: scratch.keep(e.mapInArrow(_contracted, e.schema), "edges")
    least = F.min("v").alias("m")
    e = contracted(edges.where(F.col("u") != F.col("v")).select("u", "v"))
    before = None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == before or state[0] == 0:
            break
        if state[0] <= at_once:
            nodes, root = rooted(e.toArrow())
            found = pa.table({"node": nodes, "root": nodes.take(pa.array(root))})
            return scratch.keep(scratch.spark.createDataFrame(found), "roots")
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = with_groups(both, ["u"], "v", least).select("u", "v", F.least("m", "u").alias("m"))
        large = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        near = with_groups(large, ["u"], "v", least)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        now = contracted(small)
        scratch.drop(e)
        e = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return scratch.keep(roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
