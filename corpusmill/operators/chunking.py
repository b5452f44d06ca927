"""Overlap-aware chunks of documents, as one fold in the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .gates import gate_before, structural_noise

STATE = "struct<out:array<string>,cur:string>"


def _state(out: Column, cur: Column) -> Column:
    return F.struct(out.alias("out"), cur.alias("cur"))


def chunks_of(text: Column, size: int = 512, overlap: int = 50, least: int = 100) -> Column:
    """The chunks of a text as an array.

    Paragraphs are gathered while they fit. One that doesn't closes the chunk, which is dropped if shorter than
    `least`, and begins the next one after the last `overlap` characters. A paragraph longer than `size` is gathered
    sentence by sentence, without separators; a longer sentence is never split.
    """
    fits = lambda cur, x: F.length(cur) + F.length(x) + 1 <= size
    closed = lambda st: F.when(F.length(st["cur"]) >= least, F.array_append(st["out"], st["cur"])).otherwise(st["out"])
    tail = lambda cur: F.right(cur, F.lit(overlap)) if overlap > 0 else F.lit("")

    def sentence(st: Column, s: Column) -> Column:
        begun = F.concat(tail(st["cur"]), s)
        return F.when(fits(st["cur"], s), _state(st["out"], F.concat(st["cur"], s))).otherwise(_state(closed(st), begun))

    def paragraph(st: Column, p: Column) -> Column:
        sentences = F.filter(F.transform(F.split(p, "[。！？\n]"), T.strip), lambda s: s != "")
        long = F.aggregate(sentences, _state(closed(st), F.lit("")), sentence)
        begun = F.when((st["cur"] == "") | F.lit(overlap <= 0), p).otherwise(F.concat(tail(st["cur"]), F.lit("\n"), p))
        joined = F.when(st["cur"] == "", p).otherwise(F.concat(st["cur"], F.lit("\n"), p))
        return F.when(fits(st["cur"], p), _state(st["out"], joined)).when(F.length(p) > size, long).otherwise(_state(closed(st), begun))

    start = _state(F.array().cast("array<string>"), F.lit(""))
    return F.aggregate(T.paragraphs(text), start, paragraph, closed)


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 512, overlap: int = 50, least: int = 100) -> DataFrame:
    """(key, chunk_index, chunk_id, text): chunks are numbered from 0 within their document."""
    df = docs.select(key, F.posexplode(chunks_of(F.col(text), size, overlap, least)).alias("chunk_index", "text"))
    return df.select(key, "chunk_index", F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text")


def fit_tokens(chunks: DataFrame, most: int = 2048, text: str = "text") -> DataFrame:
    """Chunks of more estimated tokens are cut at a sentence boundary; `cut` tells which."""
    return chunks.withColumn("cut", T.token_estimate(F.col(text)) > most).withColumn(text, T.truncated(F.col(text), most))


def cleaned(docs: DataFrame, text: str = "text", encoding: bool = False, drop_noise: bool = True, near: int | None = 3, simplified: dict[str, str] | None = None) -> DataFrame:
    """The cleaning of whole documents, with the counts of what went: lines, paragraphs and structural noise."""
    from . import dedup

    df = docs.withColumn(text, T.fix_encoding(F.col(text)) if encoding else T.filled(F.col(text)))
    df = T.once(df, text, T.clean_text(F.col(text)))
    df = df.withColumn("structural_noise_removed", (structural_noise(F.col(text)) & F.lit(drop_noise)).cast("int"))
    df = df.withColumn(text, F.when(F.col("structural_noise_removed") == 1, "").otherwise(T.to_simplified(F.col(text), simplified)))
    df = dedup.dedup_lines(df, text)
    df = dedup.dedup_paragraphs(df, text, near=near) if near is not None else df.withColumn("para_dedup_removed", F.lit(0))
    return T.once(df, text, T.sanitize(F.col(text)))


def preprocess(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 80, near: int | None = 3) -> tuple[DataFrame, DataFrame]:
    """(chunks, audit): clean, gate, chunk, gate the chunks and drop near copies; an audit row for each decision.

    Both come from one written table of tagged rows, so the work is done once.
    """
    from ..session import Scratch
    from . import dedup

    scratch = Scratch(docs.sparkSession, "preprocess")
    df = cleaned(docs.withColumn("original_length", F.length(T.filled(F.col(text)))), text, near=near)
    reason = F.nullif(gate_before(F.col(text), least), F.lit("OK"))  # its first rule is that of short texts
    stats = F.struct("line_dedup_removed", "para_dedup_removed", "structural_noise_removed").alias("parse_stats")
    df = df.select(key, "original_length", F.length(text).alias("final_length"), stats, reason.alias("reason"), F.when(reason.isNull(), chunks_of(F.col(text))).alias("chunks"))
    df = scratch.keep(df, "documents")
    parts = df.select(key, F.posexplode("chunks").alias("chunk_index", "text")).withColumn("text", T.sanitize(F.col("text")))
    parts = parts.withColumn("chunk_id", F.format_string("%s_chunk_%d", F.col(key).cast("string"), "chunk_index")).withColumn("reason", gate_before(F.col("text")))
    parts = scratch.keep(parts.withColumn("order", F.format_string("%020d_%08d", F.col(key), "chunk_index")), "parts")
    good = parts.where("reason = 'OK'")
    kept = dedup.near_duplicates(good, "order", "text", near) if near is not None else good.select("order", F.lit(True).alias("kept"))
    tagged = scratch.keep(parts.join(kept, "order", "left"), "tagged")
    none = lambda t: F.lit(None).cast(t)
    rejected = df.where("reason is not null").select(F.col(key), none("string").alias("chunk_id"), F.lit("rejected").alias("action"), "reason", "original_length", "final_length", none("int").alias("chunks_count"), "parse_stats")
    processed = df.where("reason is null").select(F.col(key), none("string").alias("chunk_id"), F.lit("processed").alias("action"), none("string").alias("reason"), "original_length", "final_length", F.size("chunks").alias("chunks_count"), "parse_stats")
    lost = tagged.where("reason <> 'OK' or not kept")
    lost = lost.select(F.col(key), "chunk_id", F.when(F.col("reason") != "OK", "chunk_rejected").otherwise("chunk_deduplicated").alias("action"), F.when(F.col("reason") != "OK", F.col("reason")).alias("reason"), F.length("text").alias("original_length"), none("int").alias("final_length"), none("int").alias("chunks_count"), F.lit(None).cast(df.schema["parse_stats"].dataType).alias("parse_stats"))
    return tagged.where("reason = 'OK' and kept").select(key, "chunk_index", "chunk_id", "text"), rejected.unionByName(processed).unionByName(lost)
