"""Samples, splits and slices. Every sample is decided by a hash of the key, so it repeats, and a larger sample with the
same seed holds the smaller one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running_sums

#: Shares of the years of a weighted sample.
YEAR_WEIGHTS = {2024: 0.40, 2023: 0.30, 2022: 0.20, 2021: 0.10}


def order_of(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(order_of(key, seed), key).limit(n)


def first_of_groups(df: DataFrame, by: list[str], quota: Column, key: str, seed: int = 42) -> DataFrame:
    """df with `_in`: whether a row is among the first `quota` of its group by hash order of its key.

    A group isn't sorted as a whole: its rows are counted in cells of the hash order, a running sum over the cells, a
    bounded number for each group, tells the cell in which the quota is reached, and only rows of that cell, about one
    in CELLS, are ranked. Equal keys are ordered as one.
    """
    cell = F.conv(F.substring(order_of(key, seed), 1, 3), 16, 10).cast("int")  # 4096 cells, in the order of the hash
    rows = df.withColumn("_q", quota).withColumn("_c", cell)
    counts = rows.groupBy(*by, "_c").agg(F.count("*").alias("_n"), F.max("_q").alias("_m"))
    w = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_upto", F.sum("_n").over(w))
    # cells below the border are in whole; of the border cell `_left` rows are
    border = counts.where(F.col("_upto") - F.col("_n") < F.col("_m")).select(*by, "_c", (F.col("_m") - (F.col("_upto") - F.col("_n"))).alias("_left"), (F.col("_upto") <= F.col("_m")).alias("_whole"))
    on = [*by, "_c"]
    rows = rows.join(F.broadcast(border), on, "left") if border.count() <= CELL_ROWS else rows.join(border, on, "left")
    some = rows.where("not coalesce(_whole, true)")
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy(*on).orderBy(order_of(key, seed), key)))
    ranked = ranked.withColumn("_in", F.col("_r") <= F.col("_left")).drop("_r")
    whole = rows.where("coalesce(_whole, true)").withColumn("_in", F.coalesce("_whole", F.lit(False)))
    return whole.unionByName(ranked).drop("_q", "_c", "_left", "_whole")


#: Border tables of up to so many rows (4,096 for each group at most) are broadcast.
CELL_ROWS = 200_000


def coverage(df: DataFrame, items: str, targets: list[str], k: int, key: str, order: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(records, missing targets): the first record of each target item, filled up by hash order to k distinct keys."""
    if k < len(targets):
        raise ValueError(f"{k} records can't cover {len(targets)} targets")
    each = df.select(key, order, F.explode(items).alias("item")).where(F.col("item").isin(targets))
    first = each.groupBy("item").agg(F.min_by(key, F.struct(order, key)).alias(key))
    picked = first.groupBy(key).agg(F.lit(0).alias("rank"))
    ranked = df.dropDuplicates([key]).join(picked, key, "left").withColumn("rank", F.coalesce("rank", F.lit(1)))
    chosen = ranked.orderBy("rank", order_of(key, seed), key).limit(k).drop("rank")
    spark = df.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*(F.lit(t) for t in targets))).alias("item"))
    return chosen, wanted.join(first, "item", "left_anti")


def by_year(df: DataFrame, year: str, target: int, key: str, weights: dict[int, float] | None = None, seed: int = 42) -> DataFrame:
    """int(target * weight) records of each weighted year, or all it has."""
    quota = F.create_map(*(F.lit(x) for y, w in (weights or YEAR_WEIGHTS).items() for x in (y, int(target * w))))
    rows = df.withColumn("_q", F.element_at(quota, F.col(year).cast("int"))).where("_q is not null")
    return first_of_groups(rows.withColumnRenamed("_q", "_quota"), [year], F.col("_quota"), key, seed).where("_in").drop("_in", "_quota")


def by_layer(df: DataFrame, layer: str, ratio: float, key: str, layers: list[str] | None = None, seed: int = 42) -> DataFrame:
    """floor(n * ratio) records of each layer."""
    rows = df.where(F.col(layer).isin(layers)) if layers else df
    sizes = rows.groupBy(layer).agg(F.floor(F.count("*") * F.lit(ratio)).alias("_quota"))
    rows = rows.join(F.broadcast(sizes), layer)  # a row per layer, of which there are a handful
    return first_of_groups(rows, [layer], F.col("_quota"), key, seed).where("_in").drop("_in", "_quota")


def split(df: DataFrame, key: str, ratio: float = 0.05, by: str | None = None, seed: int = 42) -> DataFrame:
    """df with `split`: of each group max(1, floor(n * ratio)) rows are 'eval', the others 'train'."""
    group = F.coalesce(F.col(by).cast("string"), F.lit("\x00")) if by else F.lit("")
    rows = df.withColumn("_g", group)
    sizes = rows.groupBy("_g").agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(ratio))).alias("_quota"))
    rows = first_of_groups(rows.join(F.broadcast(sizes), "_g"), ["_g"], F.col("_quota"), key, seed)  # a row per group
    return rows.withColumn("split", F.when(F.col("_in"), "eval").otherwise("train")).drop("_g", "_quota", "_in")


def split_three(df: DataFrame, key: str, val: float = 0.05, test: float = 0.05, seed: int = 42) -> DataFrame:
    """df with `split`: 'val', 'test' or 'train' by where the hash of the key falls in hash order."""
    total = df.count()
    nv, nt = max(1, int(total * val)), max(1, int(total * test))
    rows = first_of_groups(df.withColumn("_g", F.lit(0)), ["_g"], F.lit(nv), key, seed).withColumnRenamed("_in", "_val")
    rows = first_of_groups(rows, ["_g"], F.lit(nv + nt), key, seed)
    return rows.withColumn("split", F.when(F.col("_val"), "val").when(F.col("_in"), "test").otherwise("train")).drop("_g", "_val", "_in")


def good_sample(df: DataFrame, n: int, key: str, quality: str, least: float, scanned: int | None = None, seed: int = 42) -> DataFrame:
    """n rows of at least that quality, by hash order; with `scanned` out of the first so many rows by key."""
    rows = df if scanned is None else df.orderBy(key).limit(scanned)
    return sample(rows.where(F.col(quality) >= least), n, key, seed)


def plan(runs: DataFrame, tiers: list[str], tier: str = "tier", size: str = "params") -> DataFrame:
    """The runs of these tiers in their order, smaller ones first within a tier, with `place` from 1. A plan is a table
    of some dozens of runs, so one task orders it."""
    order = F.array_position(F.array(*(F.lit(t) for t in tiers)), F.col(tier))
    rows = runs.where(F.col(tier).isin(tiers)).withColumn("_o", order)
    rest = [c for c in runs.columns if c not in (tier, size)]
    return rows.withColumn("place", F.row_number().over(Window.orderBy("_o", size, *rest))).drop("_o")


def newest_first(df: DataFrame, year: str, target: int, key: str) -> DataFrame:
    """Rows of the newest years until there are `target`; of the last year the lowest keys."""
    return df.orderBy(F.desc(year), key).limit(target)


def batch(df: DataFrame, number: int, size: int, key: str, done: DataFrame | None = None) -> DataFrame:
    """The number-th slice (from 1) of `size` rows in key order, less what is done."""
    rows = running_sums(df, [], [key], _r=F.lit(1))
    rows = rows.where((F.col("_r") > (number - 1) * size) & (F.col("_r") <= number * size)).drop("_r")
    return rows.join(done.select(key), key, "left_anti") if done is not None else rows


def latest(df: DataFrame, n: int, order: str, value: str) -> DataFrame:
    """Of the latest n rows: the number, the upper median, the means of the earlier and the later half, the trend."""
    rows = df.orderBy(F.desc(order)).limit(n).select(order, value)
    rows = rows.withColumn("r", F.row_number().over(Window.orderBy(order))).withColumn("s", F.row_number().over(Window.orderBy(value, order)))
    total = rows.agg(F.count("*").alias("n"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    half = F.floor(F.col("n") / 2)
    out = rows.agg(F.max("n").alias("n"), F.max(F.when(F.col("s") == half + 1, F.col(value))).alias("upper_median"), F.avg(F.when(F.col("r") <= half, F.col(value))).alias("first_half"), F.avg(F.when(F.col("r") > half, F.col(value))).alias("second_half"))
    return out.withColumn("trend", F.col("second_half") - F.col("first_half"))


def running_mean(df: DataFrame, by: str, order: str, value: str, out: str = "running_mean") -> DataFrame:
    """The mean of all rows of the group so far."""
    rows = running_sums(df, [by], [order], _s=F.col(value).cast("double"), _n=F.col(value).isNotNull().cast("long"))
    return rows.withColumn(out, F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))).drop("_s", "_n")


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def missing(expected: DataFrame, actual: DataFrame, key: str, layer: str) -> DataFrame:
    """Per layer the expected and missing keys and the share covered."""
    df = expected.join(actual.select(key).distinct().withColumn("_there", F.lit(1)), key, "left")
    df = df.groupBy(layer).agg(F.count("*").alias("expected"), F.count_if(F.col("_there").isNull()).alias("missing"))
    return df.withColumn("coverage", 100.0 * (F.col("expected") - F.col("missing")) / F.col("expected"))
