"""Statistics over corpora, records and runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .ranges import running_sums

#: Upper bounds of the histograms of lengths and of the bins of quality.
CHAR_RANGES = (200, 400, 512, 800, 1200)
TOKEN_RANGES = (256, 512, 1024, 2048)
QUALITY_7 = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
QUALITY_4 = (0.5, 0.7, 0.9)


def range_of(value: Column, bounds: tuple) -> Column:
    """The number of the range [bound, next bound) that a value falls in."""
    out = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        out = F.when(value < bounds[k], k).otherwise(out)
    return F.when(value.isNotNull(), out)


def range_names(bounds: tuple) -> list[str]:
    edges = [0, *bounds]
    return [f"{a}-{b}" for a, b in zip(edges, edges[1:], strict=False)] + [f"{edges[-1]}+"]


def histogram(df: DataFrame, value: Column, bounds: tuple) -> DataFrame:
    """(bin, label, n) with a row for empty ranges too."""
    spark = df.sparkSession
    names = F.array(*(F.lit(x) for x in range_names(bounds)))
    bins = spark.range(1).select(F.posexplode(names).alias("bin", "label"))
    counts = df.select(range_of(value, bounds).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cumulative_quality(df: DataFrame, quality: str, by: list[str], levels: tuple = (0.7, 0.8, 0.9)) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col(quality) >= x).alias(f"ge_{int(x * 100)}") for x in levels))


def corpus_stats(docs: DataFrame, chunks: DataFrame, layer: str, key: str = "doc_id") -> DataFrame:
    """Documents and chunks of each layer, and a row of totals (layer null)."""
    c = chunks.groupBy(key).agg(F.count("*").alias("c"))
    df = docs.select(key, layer).join(c, key, "left")
    return df.rollup(layer).agg(F.count("*").alias("documents"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"))


def year_histogram(chunks: DataFrame, layer: str, name: str = "chunk_id") -> DataFrame:
    """(layer, year, n) of the distinct years from 2015 to 2026 that chunk names hold."""
    years = F.array_distinct(F.regexp_extract_all(name, F.lit("(20[12][0-9])"), F.lit(1)))
    df = chunks.select(layer, F.explode(F.transform(years, lambda y: y.cast("int"))).alias("year")).where("year between 2015 and 2026")
    return df.groupBy(layer, "year").agg(F.count("*").alias("n"))


def matrix(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of rows by two attributes, zeros filled; the values of the second are given, so no extra job asks."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def dataset_stats(records: DataFrame, instruction: str = "instruction", output: str = "output", tokens: Column | None = None, most: int = 2048) -> DataFrame:
    """Numbers and lengths of training records, and of their tokens where a column counts them: one row."""
    a, b = F.length(F.coalesce(F.col(instruction), F.lit(""))), F.length(F.coalesce(F.col(output), F.lit("")))
    aggs = [F.count("*").alias("n"), F.avg(a).alias("avg_instruction"), F.avg(b).alias("avg_output"), F.max(a).alias("max_instruction"), F.max(b).alias("max_output")]
    if tokens is not None:
        aggs += [F.avg(tokens).alias("avg_tokens"), F.max(tokens).alias("max_tokens"), F.count_if(tokens > most).alias("exceeding")]
    return records.agg(*aggs)


def qa_stats(records: DataFrame, experts: str = "experts", quality: str = "quality", instruction: str = "instruction", output: str = "output", meta: str | None = None) -> DataFrame:
    aggs = [
        F.count("*").alias("n"),
        F.avg((F.size(experts) > 1).cast("double")).alias("multi_expert_ratio"),
        F.avg(quality).alias("avg_quality"),
        F.stddev_pop(quality).alias("std_quality"),
        F.avg(F.length(instruction)).alias("avg_instruction"),
        F.avg(F.length(output)).alias("avg_output"),
    ]
    if meta:
        aggs.append(F.avg(F.col(meta).cast("double")).alias("meta_ratio"))
    types = records.select(F.explode(experts).alias("e")).agg(F.count_distinct("e").alias("expert_types"))
    return records.agg(*aggs).crossJoin(types)  # two rows of totals


def frequency(df: DataFrame, items: str, order: str, most: int | None = None) -> DataFrame:
    """(item, n, share, first): how often items of an array column occur, most frequent first; of equally frequent ones
    that which comes first by `order`. share is of the records."""
    total = df.agg(F.count("*").alias("t"))
    each = df.select(order, F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    out = each.crossJoin(F.broadcast(total)).select("item", "n", (F.col("n") / F.col("t")).alias("share"), "first")  # one row
    out = out.orderBy(F.desc("n"), "first", "item")
    return out.limit(most) if most else out


def distinct_items(df: DataFrame, items: str) -> DataFrame:
    """The number of distinct items of an array column."""
    return df.select(F.explode(items).alias("item")).agg(F.count_distinct("item").alias("distinct_items"))


def quality_by(df: DataFrame, items: str, quality: str, good: float = 0.7) -> DataFrame:
    each = df.select(F.explode(items).alias("item"), F.col(quality).alias("q"))
    return each.groupBy("item").agg(F.count("*").alias("uses"), F.avg("q").alias("avg_quality"), F.avg((F.col("q") >= good).cast("double")).alias("pass_rate"))


def low_quality(df: DataFrame, quality: str, items: str, order: str, below: float = 0.5, most: int = 5) -> DataFrame:
    """Frequency of items among the low rows, with their number and share of all rows."""
    counts = df.agg(F.count_if(F.col(quality) < below).alias("low"), F.count("*").alias("all"))
    top = frequency(df.where(F.col(quality) < below), items, order, most)
    return top.crossJoin(F.broadcast(counts)).select("item", "n", "low", (F.col("low") / F.col("all")).alias("low_share"))  # one row


def percentiles(df: DataFrame, value: str, at: tuple = (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)) -> DataFrame:
    """Exact percentiles with linear interpolation, and the mean. Null values don't count.

    Values are counted first. Counts are sorted by range over all tasks and summed within each; the sums of the ranges,
    a row for each task, give every value its places, so no task sees more than its range.
    """
    counts = df.select(F.col(value).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    ranged = Scratch(df.sparkSession, "percentiles").keep(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "counts")
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    parts = ranged.groupBy("part").agg(F.sum("c").alias("own")).withColumn("base", F.coalesce(F.sum("own").over(before), F.lit(0)))
    placed = ranged.withColumn("upto", F.sum("c").over(inside)).join(F.broadcast(parts.select("part", "base")), "part")
    placed = placed.select("v", "c", (F.col("base") + F.col("upto")).alias("upto"))
    total = ranged.agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    rows = placed.crossJoin(F.broadcast(total))  # one row
    aggs = [F.first("mean").alias("mean")]
    for p in at:
        place = (F.col("n") - 1) * F.lit(float(p))
        holds = lambda k: (F.col("upto") - F.col("c") <= k) & (k < F.col("upto"))
        low, high = F.max(F.when(holds(F.floor(place)), F.col("v"))), F.max(F.when(holds(F.ceil(place)), F.col("v")))
        aggs.append((low + (high - low) * F.first(place - F.floor(place))).alias(f"p{int(p * 100)}"))
    out = rows.agg(*aggs)
    return out.select(*(f"p{int(p * 100)}" for p in at), "mean")


def verification(files: DataFrame, ext: str, layer: str, chars: str, short: int = 50) -> DataFrame:
    """Counts by extension, by layer and in all: files, empty and short ones."""
    df = files.groupingSets([[F.col(ext)], [F.col(layer)], []], F.col(ext), F.col(layer))
    return df.agg(F.count("*").alias("files"), F.count_if(F.col(chars) == 0).alias("empty"), F.count_if(F.col(chars) < short).alias("short"))


def coverage(files: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text", short: int = 50) -> DataFrame:
    """One row over processed chunks: chunks, unique documents, empty and short chunks, and the share of files, in per
    cent, that have chunks."""
    bare = F.length(F.btrim(F.coalesce(F.col(text), F.lit(""))))
    counts = chunks.agg(F.count("*").alias("chunks"), F.count_distinct(F.nullif(F.col(key).cast("string"), F.lit(""))).alias("unique_docs"), F.count_if(bare == 0).alias("empty_chunks"), F.count_if((bare > 0) & (bare < short)).alias("short_chunks"))
    total = files.agg(F.count("*").alias("files"))
    return counts.crossJoin(total).withColumn("coverage", F.when(F.col("files") > 0, 100.0 * F.col("unique_docs") / F.col("files")).otherwise(0.0))  # one row each


def best_per_metric(long: DataFrame, method: str = "method", metric: str = "metric", value: str = "value") -> DataFrame:
    """Values with their share of the metric's maximum, and whether they are the best."""
    top = F.max(value).over(Window.partitionBy(metric))
    return long.select(method, metric, value, (F.col(value) / top).alias("normalized"), (F.col(value) == top).alias("best"))


def relative_gain(long: DataFrame, ours: str, method: str = "method", metric: str = "metric", value: str = "value") -> DataFrame:
    """Per metric our value, the best other one, and their ratio."""
    own, other = F.max(F.when(F.col(method) == ours, F.col(value))), F.max(F.when(F.col(method) != ours, F.col(value)))
    return long.groupBy(metric).agg(own.alias("ours"), other.alias("best_other")).withColumn("ratio", F.col("ours") / F.col("best_other"))


def throughput(stages: DataFrame) -> DataFrame:
    """(experiment, value, n_items, seconds, per_minute) of runs, from (experiment, value, n_items, stage, wall_seconds)."""
    df = stages.groupBy("experiment", "value").agg(F.max("n_items").alias("n_items"), F.sum("wall_seconds").alias("seconds"))
    return df.withColumn("per_minute", F.col("n_items") * 60 / F.col("seconds"))


def positive_mean(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.when(F.col(value) > 0, F.col(value))).alias("mean"), F.count("*").alias("n"))


def welch(df: DataFrame, condition: str, value: str, baseline: str) -> DataFrame:
    """Mean, deviation, 95 % interval and Welch's t of each condition against a baseline one, with the degrees of
    freedom. A group of one row has no deviation and no t."""
    g = df.groupBy(condition).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    base = g.where(F.col(condition) == baseline).select(F.col("n").alias("bn"), F.col("mean").alias("bm"), F.col("sd").alias("bs"))
    df = g.crossJoin(F.broadcast(base))  # one row
    half = 1.96 * F.col("sd") / F.sqrt("n")
    va, vb = F.col("sd") * F.col("sd") / F.col("n"), F.col("bs") * F.col("bs") / F.col("bn")
    other = (F.col(condition) != baseline) & (va + vb > 0)
    freedom = F.try_divide((va + vb) * (va + vb), F.try_divide(va * va, F.col("n") - 1) + F.try_divide(vb * vb, F.col("bn") - 1))
    return df.select(condition, "n", "mean", "sd", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), F.when(other, F.try_divide(F.col("mean") - F.col("bm"), F.sqrt(va + vb))).alias("t"), F.when(other, freedom).alias("df"))


#: Cumulative probabilities of a Poisson(1) number.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))


def _uniform(rows: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each row and draw, by mixing their numbers: the same whatever batch a row comes in."""
    with np.errstate(over="ignore"):
        x = rows[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def stars(t: Column, df: Column) -> Column:
    """***, ** or * where a two-sided t test is significant at 0.001, 0.01 or 0.05, else empty; null without a t. The
    deviate that t stands for is Wallace's approximation, and exact for many degrees of freedom."""
    n = F.greatest(df, F.lit(1.0))
    deviate = (8 * n + 1) / (8 * n + 3) * F.sqrt(n * F.log1p(t * t / n))
    return F.when(deviate > 3.290527, "***").when(deviate > 2.575829, "**").when(deviate > 1.959964, "*").when(t.isNotNull(), "")


def bootstrap_means(df: DataFrame, metric: str, value: str, key: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(metric, d, m): the mean of each bootstrap draw. A group of any size is drawn from in parts: every row gets a
    Poisson(1) weight for each draw, by its metric and key, and sums of weights and values are added up over parts."""

    def part(batches):
        for b in batches:
            for name, own in b.groupby(metric, dropna=False):
                x, rows = own[value].to_numpy(dtype=float), own["_row"].to_numpy().astype(np.uint64)
                total, weight = np.zeros(draws), np.zeros(draws)
                for k in range(0, len(x), 1000):
                    w = np.searchsorted(_POISSON, _uniform(rows[k : k + 1000], draws, seed)).astype(np.float64)
                    total += x[k : k + 1000] @ w
                    weight += w.sum(axis=0)
                yield pd.DataFrame({metric: name, "d": np.arange(draws), "t": total, "w": weight})

    kind = df.schema[metric].dataType.simpleString()
    rows = df.where(F.col(value).isNotNull()).select(metric, F.col(value).cast("double").alias(value), F.xxhash64(metric, key).alias("_row"))
    return rows.mapInPandas(part, f"{metric} {kind}, d int, t double, w double").groupBy(metric, "d").agg(F.try_divide(F.sum("t"), F.sum("w")).alias("m"))


def bootstrap_ci(df: DataFrame, metric: str, value: str, key: str, draws: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(metric, mean, low, high): percentile intervals of the mean. key tells the rows of a metric apart."""
    alpha = (1 - level) / 2
    interval = bootstrap_means(df, metric, value, key, draws, seed).groupBy(metric).agg(F.percentile("m", F.lit(alpha)).alias("low"), F.percentile("m", F.lit(1 - alpha)).alias("high"))
    return df.groupBy(metric).agg(F.avg(value).alias("mean")).join(interval, metric)


def paired_bootstrap(pairs: DataFrame, metric: str, key: str, va: str = "va", vb: str = "vb", draws: int = 1000, seed: int = 42) -> DataFrame:
    """(metric, diff, p): the share of draws whose mean difference is at least as large, either way, as the one that was
    seen. Differences aren't centred, so this p is near a half or above wherever a difference is seen at all."""
    d = pairs.select(metric, key, (F.col(va) - F.col(vb)).alias("_d"))
    seen = d.groupBy(metric).agg(F.avg("_d").alias("diff"))
    means = bootstrap_means(d, metric, "_d", key, draws, seed).join(seen, metric)
    return means.groupBy(metric).agg(F.first("diff").alias("diff"), F.avg((F.abs("m") >= F.abs("diff")).cast("double")).alias("p"))


def paired(df: DataFrame, sample: str, model: str, metric: str, value: str, a: str, b: str) -> DataFrame:
    """(metric, sample, va, vb) of the samples that both models have; metrics whose numbers of samples differ go."""
    x = df.where(F.col(model) == a).select(metric, sample, F.col(value).alias("va"))
    y = df.where(F.col(model) == b).select(metric, sample, F.col(value).alias("vb"))
    n = df.where(F.col(model).isin(a, b)).groupBy(metric).agg(F.count_if(F.col(model) == a).alias("na"), F.count_if(F.col(model) == b).alias("nb")).where("na = nb").select(metric)
    return x.join(y, [metric, sample]).join(n, metric)


def wilcoxon(pairs: DataFrame, metric: str, va: str = "va", vb: str = "vb") -> DataFrame:
    """Signed-rank test of each metric: means, difference, W, z and two-sided p; p is 1 if all differences are 0. Of at
    most EXACT differences without ties and zeros p is exact, else by the normal approximation with the correction for
    ties.

    Ranks come from counts of equal differences, summed by ranges of the distinct values, so that a metric of very many
    rows isn't ranked in one task.
    """
    d = pairs.select(metric, va, vb, (F.col(va) - F.col(vb)).alias("d"))
    means = d.groupBy(metric).agg(F.avg(va).alias("mean_a"), F.avg(vb).alias("mean_b"))
    sizes = d.where("d <> 0").groupBy(metric, F.abs("d").alias("m")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = running_sums(sizes, [metric], ["m"], upto=F.col("c")).withColumn("rank", F.col("upto") - (F.col("c") - 1) / 2.0)
    zeros = d.groupBy(metric).agg(F.count_if(F.col("d") == 0).alias("zeros"))
    s = ranked.groupBy(metric).agg(F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48.0
    z = F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)).otherwise(0.0)
    out = means.join(s, metric, "left").join(zeros, metric).withColumn("z", F.coalesce(z, F.lit(0.0)))
    p = F.when((F.col("n") <= EXACT) & (F.col("ties") == 0) & (F.col("zeros") == 0), exact_signed_rank("w_plus", "n")).otherwise(two_sided("z"))
    return out.select(metric, "mean_a", "mean_b", (F.col("mean_a") - F.col("mean_b")).alias("diff"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), "z", p.alias("p")).withColumn("significant", F.col("p") < 0.05)


#: Up to so many differences the signed-rank test is exact.
EXACT = 50


def signed_rank_p(w: float, n: int) -> float:
    """Two-sided p of a rank sum w of n differences: of all choices of ranks, twice the share at least as far out."""
    ways = np.ones(1)
    for r in range(1, n + 1):
        ways = np.concatenate([ways, np.zeros(r)]) + np.concatenate([np.zeros(r), ways])
    share, k = ways / ways.sum(), int(round(w))
    return float(min(1.0, 2 * min(share[: k + 1].sum(), share[k:].sum())))


def exact_signed_rank(w: str, n: str) -> Column:
    @F.pandas_udf("double")
    def run(ws: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(w, int(n)) if n == n and n <= EXACT else None for w, n in zip(ws, ns, strict=True)], dtype="float64")

    return run(F.col(w), F.col(n).cast("double"))


def two_sided(z: str) -> Column:
    """Two-sided p of a normal deviate."""
    from math import erfc, sqrt

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: erfc(abs(v) / sqrt(2)) if v == v else None).astype("float64")

    return run(z)
