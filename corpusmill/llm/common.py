"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.groups import PARTS, with_groups
from ..session import Scratch, few, ship, table

__all__ = ["PARTS", "SPACE", "Scratch", "arrow_batches", "few", "partitions", "ship", "table", "text_of", "with_groups"]

#: ASCII white space, as the character class that every word operator splits on.
SPACE = r"[\x20\x09-\x0D]+"


def text_of(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs that run inside send Python workers batches of `size` bytes, or of one row where a row is larger: for rows of
    some megabytes, of which the usual 64 MB are held several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)
