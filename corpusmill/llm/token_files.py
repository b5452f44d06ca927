"""Token counts of flat token files by a separator scan.

A flat token file is a run of token ids and nothing else: each document's ids, then an end-of-document id. Blocks of a
file are searched for that id at once, each for itself; what a block can't know, how many documents ended and how many
tokens stand open before it, comes from a prefix scan over block summaries. The scan has two levels, blocks within
segments of bounded length and segments within the file, so that no task reads all blocks of a long file.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, partitions, table

#: Fixed value: the end-of-document id of the vocabulary, which no text is encoded to.
END_ID = 50256
BLOCK_TOKENS, SEGMENT = 1 << 16, 1024


def mounted(path: str) -> str | None:
    """The path in the file system of the machine, for folders that all machines have mounted; None for object stores."""
    bare = re.sub(r"^file:/+", "/", path)
    return bare if bare.startswith("/") else None


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system: one without a scheme is on the default one, which need not be the
    machine's."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


def _encoded(batch: pa.RecordBatch, encode, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        yield doc_id, np.array([*encode(text or ""), end_id], dtype="<u2")


def write_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Writes the flat token file of each partition of docs (doc_id, text) to a folder that all machines have mounted,
    and returns its manifest, (file, ordinal, doc_id), which the scan doesn't read.

    A file is the 16-bit ids of whole texts, each followed by end_id; a partition without rows has none. Files appear
    under their name when they are complete, so that a task that runs again replaces its own. The files are written
    when the manifest is worked out. A null text counts as empty; null and repeated doc_ids are written like others;
    other columns are ignored; an empty table gives no file.
    """
    folder_, docs = mounted(folder), docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if folder_ is None:
        raise ValueError(f"flat files need a folder that is mounted on all machines, not {folder}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, name, ordinal, out = tokens.encoder(vocabulary, plain=True), f"part-{TaskContext.get().partitionId():06d}.bin", 0, None
        growing = os.path.join(folder_, f".{name}.{uuid.uuid4().hex}")
        try:
            for b in batches:
                if out is None and b.num_rows:
                    os.makedirs(folder_, exist_ok=True)
                    out = open(growing, "wb")
                names = []
                for doc_id, ids in _encoded(b, encode, end_id):
                    out.write(ids.tobytes())
                    names.append(doc_id)
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(names), pa.string()), "ordinal": pa.array(range(ordinal, ordinal + len(names)), pa.int64()), "doc_id": pa.array(names, pa.int64())})
                ordinal += len(names)
            if out is not None:
                out.close()
                os.replace(growing, os.path.join(folder_, name))
        finally:
            if out is not None:
                out.close()
            if os.path.exists(growing):
                os.remove(growing)

    return docs.mapInArrow(run, "file string, ordinal long, doc_id long")


def file_blocks(spark: SparkSession, path: str, block_bytes: int = 2 * BLOCK_TOKENS) -> DataFrame:
    """(file, block, begin, size) of the byte ranges of the flat token files at path: only their lengths are read.
    An empty file has none."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))).alias("block"))
    ranges = ranges.withColumn("begin", F.col("block") * block_bytes)
    ranges = ranges.select("file", "block", "begin", F.least(F.lit(block_bytes), F.col("length") - F.col("begin")).alias("size"))
    return ranges.repartition(4 * partitions(spark), "file", "block")


WRITTEN = "file long, block long, payload binary, first long, doc_ids array<long>"
WRITTEN_ARROW = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])


def write_blocks(docs: DataFrame, vocabulary: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The flat token file of each partition of docs (doc_id, text) as rows (file, block, payload) of 16-bit ids, for
    shared folders that aren't mounted.

    Beside them stand, for the manifest, the doc_ids of the documents that end in the block and the number of the
    first of these in its file; the scan reads neither. Null texts and doc_ids, repeated rows, other columns and empty
    tables as in write_files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary, plain=True)
        file, block, ended = TaskContext.get().partitionId(), 0, 0
        held, size, names = [], 0, []

        def row(payload: np.ndarray, own: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([file], [block], [payload.tobytes()], [ended], [own]), WRITTEN_ARROW, strict=True)], schema=WRITTEN_ARROW)

        for b in batches:
            for doc_id, ids in _encoded(b, encode, end_id):
                held.append(ids)
                size += len(ids)
                if size > block_tokens:  # the last separator stands in a later block than these
                    flat, at = np.concatenate(held), 0
                    while size - at > block_tokens:
                        yield row(flat[at : at + block_tokens], names)
                        at, block, ended, names = at + block_tokens, block + 1, ended + len(names), []
                    held, size = [flat[at:]], size - at
                names.append(doc_id)
        if size:
            yield row(np.concatenate(held), names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, WRITTEN)


def _summaries(blocks: DataFrame, end_id: int, width: int) -> DataFrame:
    """Per block: tokens, documents ended, tokens before the first separator and after the last, and place and length
    of the documents between. A block is a payload, or a byte range of a file that is read here."""
    kind, inline = blocks.schema["file"].dataType.simpleString(), "payload" in blocks.columns

    def ids_of(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        if inline:
            for payload in b.column("payload").to_pylist():
                yield np.frombuffer(payload or b"", dtype=f"<u{width}")
        else:
            for file, begin, size in zip(*(b.column(c).to_pylist() for c in ("file", "begin", "size")), strict=True):
                yield np.fromfile(mounted(file), dtype=f"<u{width}", count=size // width, offset=begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {n: [] for n in ("tokens", "ended", "head", "tail")}
            inner: list[tuple[np.ndarray, np.ndarray]] = []
            for ids in ids_of(b):
                at = np.flatnonzero(ids == end_id)
                rows["tokens"].append(len(ids))
                rows["ended"].append(len(at))
                rows["head"].append(int(at[0]) if len(at) else len(ids))
                rows["tail"].append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                inner.append((at[:-1] + 1, np.diff(at) - 1))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in inner] or [np.zeros(0)]).astype(np.int32)) for k in (0, 1)], names=["place", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[0]) for x in inner)]), pa.int32()), flat)
            own = [pa.array(v, pa.int64()) for v in rows.values()]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), *own, lists], names=["file", "block", *rows, "inner"])

    return blocks.select("file", "block", *(["payload"] if inline else ["begin", "size"])).mapInArrow(run, f"file {kind}, block long, tokens long, ended long, head long, tail long, inner array<struct<place:int,n:int>>")


def document_lengths(spark: SparkSession, blocks: DataFrame, end_id: int = END_ID, width: int = 2, segment: int = SEGMENT) -> DataFrame:
    """(file, block, payload), or (file, block, begin, size) with byte ranges of mounted files -> a row per document of
    each file: file, ordinal, start, n_tokens, closed.

    Blocks of a file may be of any length and are ordered by their number, from 0; ids are little-endian of `width`
    bytes and don't straddle blocks. n_tokens leaves the separator out; two separators in a row enclose an empty
    document. Tokens after the last separator of a file are a document that isn't closed; a document may be longer
    than any number of blocks. A null payload counts as empty; other columns are ignored; an empty table gives an empty
    result. Blocks with the same file and number are an error of the caller.
    """
    scratch = Scratch(spark, "separators")
    s = scratch.keep(_summaries(blocks, end_id, width).withColumn("segment", F.floor(F.col("block") / segment)), "summaries")
    by = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda w, c: F.coalesce(F.sum(c).over(w), F.lit(0))
    # open tokens before a block: all tokens so far less those up to the last separator so far
    closed = F.when(F.col("ended") > 0, F.col("before") + F.col("tokens") - F.col("tail"))
    s = s.withColumn("before", past(by, "tokens")).withColumn("number", past(by, "ended"))
    s = s.withColumn("last", F.max(closed).over(by))
    ends = s.groupBy("file", "segment").agg(F.sum("tokens").alias("all_tokens"), F.sum("ended").alias("all_ended"), F.max(closed).alias("all_last"))
    up = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("base", past(up, "all_tokens")).withColumn("base_number", past(up, "all_ended"))
    ends = ends.withColumn("base_last", F.coalesce(F.max(F.col("base") + F.col("all_last")).over(up), F.lit(0)))
    s = s.join(ends.select("file", "segment", "base", "base_number", "base_last"), ["file", "segment"])
    s = s.select("file", "block", "tokens", "ended", "head", "tail", "inner", (F.col("base") + F.col("before")).alias("at"), (F.col("base_number") + F.col("number")).alias("number"), F.coalesce(F.col("base") + F.col("last"), "base_last").alias("open_at"))
    first = F.struct(F.col("open_at").alias("start"), (F.col("at") + F.col("head") - F.col("open_at")).alias("n"))
    later = F.transform("inner", lambda x: F.struct((F.col("at") + x["place"]).alias("start"), x["n"].cast("long").alias("n")))
    grown = F.concat(F.array(first), later)
    done = s.where("ended > 0").select("file", "number", F.posexplode(grown).alias("k", "d"))
    done = done.select("file", (F.col("number") + F.col("k")).alias("ordinal"), F.col("d.start").alias("start"), F.col("d.n").alias("n_tokens"), F.lit(True).alias("closed"))
    last = s.groupBy("file").agg(F.max_by(F.struct("at", "tokens", "ended", "tail", "number", "open_at"), "block").alias("x"))
    end, begin = F.col("x.at") + F.col("x.tokens"), F.when(F.col("x.ended") > 0, F.col("x.at") + F.col("x.tokens") - F.col("x.tail")).otherwise(F.col("x.open_at"))
    rest = last.select("file", (F.col("x.number") + F.col("x.ended")).alias("ordinal"), begin.alias("start"), (end - begin).alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return done.unionByName(rest)


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Writes all documents to flat token files and counts by scanning these: doc_id, n_tokens (without the separator),
    file, start. A null text has no tokens."""
    scratch, docs, vocabulary = Scratch(spark, "tokens"), table(spark, sf_dir, "documents"), vocabulary or tokens.default_vocabulary()
    at = qualified(spark, scratch.at)
    if mounted(at) is None:
        blocks = scratch.keep(write_blocks(docs, vocabulary), "blocks")
        manifest = blocks.select(F.col("file").cast("string"), "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
        blocks = blocks.withColumn("file", F.col("file").cast("string"))
    else:
        folder = f"{at}/flat"
        manifest = scratch.keep(write_files(docs, folder, vocabulary), "manifest")
        if manifest.isEmpty():
            return spark.createDataFrame([], "doc_id long, n_tokens long, file string, start long")
        blocks = file_blocks(spark, folder)
    lengths = document_lengths(spark, blocks).withColumn("file", F.element_at(F.split("file", "/"), -1))
    return lengths.join(manifest, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "start")


QUERIES = {"op3_token_counts": op3_token_counts}
SQL: dict[str, str] = {}
