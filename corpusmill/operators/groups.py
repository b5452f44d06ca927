"""Figures of groups joined to their rows, without bringing a large group together in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of a group are spread over (bits of a long).
PARTS = 63


def with_groups(rows: DataFrame, by: list[str], spread: str, *figures: Column, where: str | None = None, over: DataFrame | None = None) -> DataFrame:
    """rows with the figures of their group (nulls group by themselves and drop out); groups outside `where` go. The
    figures are worked out over the rows themselves, or over others that have the columns `by` and `spread` too.

    A group's rows don't come together in one task: figures are combined before the shuffle, and the join is on the
    group and a part that hashes the column `spread`. Which parts a group has is one of its figures, a bit mask.
    """
    rows, over = rows.withColumn("_part", _part(spread)), (rows if over is None else over).withColumn("_part", _part(spread))
    groups = over.groupBy(*by).agg(*figures, _mask())
    groups = groups.where(where) if where else groups
    return rows.join(_in_parts(groups), [*by, "_part"]).drop("_part")


def join_unique(rows: DataFrame, unique: DataFrame, by: list[str], spread: str) -> DataFrame:
    """rows joined to a table that has each key once; the rows of a key are spread in the same way."""
    rows = rows.withColumn("_part", _part(spread))
    groups = unique.join(rows.groupBy(*by).agg(_mask()), by)
    return rows.join(_in_parts(groups), [*by, "_part"]).drop("_part")


def _part(spread: str) -> Column:
    return F.pmod(F.xxhash64(spread), F.lit(PARTS)).cast("int")


def _mask() -> Column:
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_part"))).alias("_mask")


def _in_parts(groups: DataFrame) -> DataFrame:
    """A row of a group for each of its parts."""
    has = lambda i: F.call_function("shiftright", F.col("_mask"), i).bitwiseAND(F.lit(1)) == 1
    parts = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), has)
    return groups.withColumn("_part", F.explode(parts)).drop("_mask")
