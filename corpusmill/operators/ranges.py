"""Running sums in an order, without bringing all rows of a table or a group together in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch


def running_sums(df: DataFrame, by: list[str], order: list[str], **sums: Column) -> DataFrame:
    """df with the sums of these columns over the rows of its group (of `by`; the whole table without) up to each row.

    Rows are dealt by ranges of group and order and written, so that a range is the same whenever it is read. A task sums
    its own range; what the ranges before it hold, a row for each range of a group, is added. Null groups and null values
    of the order (first) count like others; null values add nothing; of rows equal in group and order any goes first.
    """
    names = [f"_sum_{name}" for name in sums]
    df = df.select("*", *(F.coalesce(c, F.lit(0)).alias(n) for n, c in zip(names, sums.values(), strict=True)))
    ranged = df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    ranged = Scratch(df.sparkSession, "ranges").keep(ranged, "ranged")
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_range", *by).agg(*(F.sum(n).alias(n) for n in names))
    bases = parts.select(F.col("_range").alias("_at"), *(F.col(b).alias(f"_by_{b}") for b in by), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_base{n}") for n in names))
    same = F.col("_range") == F.col("_at")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    rows = ranged.select("*", *(F.sum(n).over(inside).alias(f"_own{n}") for n in names)).join(bases, same)
    added = [(F.col(f"_base{n}") + F.col(f"_own{n}")).alias(name) for n, name in zip(names, sums, strict=True)]
    return rows.select(*(c for c in df.columns if c not in names), *added)
