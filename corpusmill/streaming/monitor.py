"""Live figures of the newest rows of each key, over a stream and over a table.

Of a key's newest n rows, in the order of a column: how many rows there were in all, the upper median, the means of the
earlier and the later half and their difference, rows a second, and the seconds left to a target. On a stream the newest
rows are a ring buffer in the state of the key, so that a batch costs what it brings and the buffers of the keys it
touches; a timer reports keys that fall silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import ship

#: The provider of keyed state that arbitrary stateful operators need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIGURES = "total long, n int, upper_median double, first_half double, second_half double, trend double, rate double, seconds_left double, last timestamp, idle boolean"
STATE = "total long, places array<long>, figures array<double>, times array<double>"


def figures(values: np.ndarray, seconds: np.ndarray, total: int, target: int | None) -> tuple:
    """The figures of the newest values, oldest first, and the times they came at."""
    n, half = len(values), len(values) // 2
    mean = lambda x: float(x.mean()) if len(x) else None
    first, second = mean(values[:half]), mean(values[half:])
    span = float(seconds.max() - seconds.min())
    rate = (n - 1) / span if span > 0 else None
    left = max(target - total, 0) / rate if target is not None and rate else None
    return total, n, float(np.sort(values)[half]), first, second, None if first is None else second - first, rate, left


class _Newest(StatefulProcessor):
    def __init__(self, key: str, most: int, target: int | None, idle: int):
        self.key, self.most, self.target, self.idle = key, most, target, idle

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("newest", STATE)

    def _frame(self, key: tuple, row: tuple, last: float, idle: bool) -> pd.DataFrame:
        names = [self.key, *(f.split(" ")[0] for f in FIGURES.split(", "))]
        return pd.DataFrame([(key[0], *row, datetime.fromtimestamp(last, UTC).replace(tzinfo=None), idle)], columns=names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, places, values, times = self.held.get() if self.held.exists() else (0, [], [], [])
        parts = [pd.DataFrame({"place": places, "value": values, "time": times})]
        for b in rows:
            total += len(b)
            seconds = pd.to_datetime(b["own_time"]).to_numpy(dtype="datetime64[us]").astype("int64") / 1e6
            parts.append(pd.DataFrame({"place": b["own_place"].to_numpy(), "value": b["own_value"].to_numpy(dtype=float), "time": seconds}))
        new = pd.concat([p for p in parts if len(p)]).sort_values(["place", "time", "value"], kind="stable").tail(self.most)
        self.held.update((int(total), new["place"].astype(int).tolist(), new["value"].tolist(), new["time"].tolist()))
        last = float(new["time"].max())
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.handle.registerTimer(int(last * 1000) + self.idle)
        yield self._frame(key, figures(new["value"].to_numpy(), new["time"].to_numpy(), int(total), self.target), last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, _, values, times = self.held.get()
        row = figures(np.array(values), np.array(times), total, self.target)
        yield self._frame(key, (*row[:6], 0.0, None), max(times), True)

    def close(self) -> None:
        pass


def live_latest(stream: DataFrame, by: str, order: str, value: str, time: str, n: int = 10, target: int | None = None, late: str = "1 hour", idle_seconds: int = 3600) -> DataFrame:
    """A row of figures for each key that a batch touches, and one marked idle, with rate 0, for each key whose last row
    is idle_seconds behind the watermark. In output mode update; the last row of a key holds its figures so far.

    Rows later than the watermark are left out, by Spark; rows without a key, order, value or time too. Equal orders rank
    by time and value. Extra columns are ignored. State: n rows a key.
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = stream.select(F.col(by), F.col(order).cast("long").alias("own_place"), F.col(value).cast("double").alias("own_value"), F.col(time).cast("timestamp").alias("own_time")).dropna()
    kind = rows.schema[by].dataType.simpleString()
    grouped = rows.withWatermark("own_time", late).groupBy(by)
    return grouped.transformWithStateInPandas(_Newest(by, n, target, 1000 * idle_seconds), f"{by} {kind}, {FIGURES}", "Update", "EventTime")


def latest_by(df: DataFrame, by: str, order: str, value: str, time: str, n: int = 10, target: int | None = None) -> DataFrame:
    """The same figures of a table, a row for each key, without `idle`. Newest rows are found within parts of a key first,
    so that no task sorts all of its rows."""
    rows = df.select(F.col(by), F.col(order).cast("long").alias("p"), F.col(value).cast("double").alias("v"), F.col(time).cast("timestamp").alias("t")).dropna()
    down = [F.desc("p"), F.desc("t"), F.desc("v")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("p", "t", "v"), F.lit(63)))
    totals = rows.groupBy(by).agg(F.count("*").alias("total"))
    newest = rows.withColumn("r", F.row_number().over(Window.partitionBy(by, "part").orderBy(*down))).where(F.col("r") <= n)
    newest = newest.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(*down))).where(F.col("r") <= n)
    own = newest.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("p", "t", "v"))).alias("x")).withColumn("n", F.size("x")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    values = own.withColumn("v", F.col("x.v")).withColumn("span", (F.unix_micros(F.array_max("x.t")) - F.unix_micros(F.array_min("x.t"))) / 1e6)
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, y: s + y) / F.size(a))
    first, second = mean(F.slice("v", F.lit(1), F.col("half"))), mean(F.slice("v", F.col("half") + 1, F.col("n") - F.col("half")))
    rate = F.when(F.col("span") > 0, (F.col("n") - 1) / F.col("span"))
    left: Column = F.greatest(F.lit(target) - F.col("total"), F.lit(0)) / F.col("rate") if target is not None else F.lit(None).cast("double")
    out = values.join(totals, by).withColumn("first_half", first).withColumn("second_half", second).withColumn("rate", rate)
    upper = F.element_at(F.sort_array("v"), F.col("half") + 1)
    return out.select(by, "total", "n", upper.alias("upper_median"), "first_half", "second_half", (F.col("second_half") - F.col("first_half")).alias("trend"), "rate", left.alias("seconds_left"), F.array_max("x.t").alias("last"))
