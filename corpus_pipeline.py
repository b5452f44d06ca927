"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever their names: operators see a row as (doc_id,
text, the rest of the row). In every stage a null text counts as empty and stays null where it isn't changed, whole texts
are read, repeated rows are rows of their own (near-duplicates aside), and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontamination, neardup, packing, pii, toxicity
from corpusmill.llm.common import Scratch, ship, table
from corpusmill.session import released, settle

#: The name of the rest of a row among an operator's columns.
ROW = "__row"


def _held(docs: DataFrame) -> DataFrame:
    """(doc_id, text, the row without its text, so that no text is held twice)."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias(ROW))


def _rows(held: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The rows again, with new values of some columns."""
    old = lambda c: F.col("text") if c == "text" else F.col(ROW).getField(c)
    return held.select(*(new.get(c, old(c)).alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labels outside the held-out fold, gives a score of 0.5 or more go.
    Rows of a null doc_id have no label and are scored like others; equal texts are decided alike."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    model = toxicity.fit(spark, docs.select("doc_id", "text"), labels)
    return _rows(toxicity.score(spark, _held(docs), model).where("score < 0.5"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the least doc_id (null counts as largest); of repeated rows one does.
    Texts without words are copies of each other."""
    ship(spark)
    return neardup.deduplicate(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its budget of edits go."""
    found = decontamination.benchmark_matches(spark, _held(docs), table(spark, sf_dir, "benchmark"))
    return _rows(found.where(F.size("matches") == 0), docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what discloses it is masked; a column n_chars follows the text. A null text becomes empty."""
    return _rows(pii.sanitise(spark, _held(docs), **pii.SURE), docs.columns, n_chars=F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a sequence of at most 2048 tokens; of documents only doc_id and
    the pieces' figures are left."""
    ship(spark)
    return packing.pack_documents(spark, docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _settled(stage: Stage) -> Stage:
    """The stage, begun when the driver has given back what the stage before left in its memory."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settle(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _settled(drop_toxic)),
    ("near_duplicates", _settled(drop_near_duplicates)),
    ("decontamination", _settled(drop_contaminated)),
    ("personal_data", _settled(mask_personal_data)),
    ("packing", _settled(pack)),
]

#: No stage but the patterns of the fourth can be stated in SQL; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage wrote for itself is deleted when its result has been written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with released():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
