"""Operators over ordered series: rolling statistics, islands, intervals, ranks.

All take ``keys``, the columns that name a series, and order within them, so a
table of many series is spread over tasks by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

MAD = 1.4826


def ordered(keys: list[str], time: str = "time") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def centred(keys: list[str], width: int, time: str = "time") -> WindowSpec:
    """``width`` rows about the current one; of an even width one more before it."""
    after = (width - 1) // 2
    return ordered(keys, time).rowsBetween(-(width - 1 - after), after)


def _enough(value: str, frame: WindowSpec, least: int, x: Column) -> Column:
    return F.when(F.count(value).over(frame) >= least, x)


def gaps(rows: DataFrame, keys: list[str], time: str = "time", name: str = "gap") -> DataFrame:
    """Seconds since the row before."""
    t = F.unix_micros(time)
    return rows.withColumn(name, (t - F.lag(t).over(ordered(keys, time))) / 1e6)


def rolling_median(rows: DataFrame, keys: list[str], width: int, value: str = "value", name: str = "median", least: int | None = None, time: str = "time") -> DataFrame:
    least = max(3, width // 2) if least is None else least
    frame = centred(keys, width, time)
    return rows.withColumn(name, _enough(value, frame, least, F.percentile(value, F.lit(0.5)).over(frame)))


def rolling_sigma(rows: DataFrame, keys: list[str], width: int, value: str = "value", name: str = "sigma", time: str = "time") -> DataFrame:
    """Median absolute deviation from the rolling median, on the scale of a standard deviation."""
    rows = rolling_median(rows, keys, width, value, "_m", time=time).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    rows = rolling_median(rows, keys, width, "_d", "_s", time=time)
    return rows.withColumn(name, MAD * F.col("_s")).drop("_m", "_d", "_s")


def rolling_sum(rows: DataFrame, keys: list[str], width: int, value: str, name: str, time: str = "time") -> DataFrame:
    return rows.withColumn(name, F.sum(value).over(centred(keys, width, time)))


def difference(rows: DataFrame, keys: list[str], value: str = "value", name: str = "diff", time: str = "time") -> DataFrame:
    """Step from the row before; 0 for the first."""
    x = F.col(value)
    return rows.withColumn(name, x - F.lag(value, 1).over(ordered(keys, time))).fillna(0.0, [name])


def islands(rows: DataFrame, keys: list[str], flag: Column, max_gap: int = 1, time: str = "time") -> DataFrame:
    """Rows where ``flag`` holds, with island: rows no more than ``max_gap`` rows apart are one."""
    by = ordered(keys, time)
    rows = rows.withColumn("_i", F.row_number().over(by)).where(flag)
    apart = F.col("_i") - F.lag("_i").over(by)
    rows = rows.withColumn("_new", F.when(apart.isNull() | (apart > max_gap), 1).otherwise(0))
    return rows.withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new").withColumnRenamed("_i", "row")


def runs(rows: DataFrame, keys: list[str], flag: Column, max_gap: int = 1, time: str = "time", more: list[Column] | None = None) -> DataFrame:
    """One row an island: start, end, rows and ``more`` aggregates."""
    found = islands(rows, keys, flag, max_gap, time)
    return found.groupBy(*keys, "island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("rows"), *(more or []))


def longest_constant(rows: DataFrame, keys: list[str], value: str = "value", tolerance: float = 1e-9, time: str = "time") -> DataFrame:
    """The longest time that a series does not move, the first of equals."""
    by = ordered(keys, time)
    rows = rows.withColumn("_new", F.when(F.abs(F.col(value) - F.lag(value).over(by)) <= tolerance, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy(*keys, "_run").agg(F.min(time).alias("start"), F.max(time).alias("end"))
    spans = spans.withColumn("seconds", (F.unix_micros("end") - F.unix_micros("start")) / 1e6)
    best = F.max_by(F.struct("start", "seconds"), F.struct("seconds", -F.unix_micros("start")))
    return spans.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.start", "best.seconds")


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching intervals as one."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    rows = rows.withColumn("_group", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_group")


def circular_mean(rows: DataFrame, keys: list[str], slot: str, value: str, slots: int, name: str) -> DataFrame:
    """Mean of a slot and its neighbours on a circle of ``slots``."""
    near = rows.withColumn("_to", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col(slot) + d, F.lit(slots)))))
    means = near.groupBy(*keys, F.col("_to").alias(slot)).agg(F.avg(value).alias(name))
    return rows.join(means, [*keys, slot])


def average_rank(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rank in which equal values share the mean of their places."""
    least = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    equal = F.count("*").over(Window.partitionBy(*keys, value))
    return rows.withColumn(name, least + (equal - 1) / 2)


def group_rank(rows: DataFrame, keys: list[str], order: Column, tie: str, value: str, name: str) -> DataFrame:
    """1-based places among rows whose ``value`` is known; null for others."""
    known = F.col(value).isNotNull()
    by = Window.partitionBy(*keys, known).orderBy(order, tie)
    return rows.withColumn(name, F.when(known, F.row_number().over(by)))


def last_minutes(rows: DataFrame, keys: list[str], minutes: float, time: str = "time") -> DataFrame:
    """Rows within ``minutes`` of the series' last, the far end left out."""
    last = F.max(time).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_last", last)
    return rows.where(F.unix_micros(time) > F.unix_micros("_last") - int(minutes * 60_000_000)).drop("_last")


def tail(rows: DataFrame, keys: list[str], n: int, time: str = "time") -> DataFrame:
    back = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return rows.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= n).drop("_n")


def evenly(rows: DataFrame, keys: list[str], n: int, time: str = "time") -> DataFrame:
    """At most ``n`` rows of each series, evenly spaced, first and last among them."""
    total = F.count("*").over(Window.partitionBy(*keys))
    rows = rows.withColumns({"_n": total, "_i": F.row_number().over(ordered(keys, time)) - 1})
    # row i is one of floor(k * (total - 1) / (n - 1))
    step = (F.col("_n") - 1) / (n - 1)
    k = F.ceil(F.col("_i") / step)
    return rows.where((F.col("_n") <= n) | (F.floor(k * step) == F.col("_i"))).drop("_n", "_i")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of those that agree in ``keys``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, int]:
    """A page of rows and how many there are; sizes are 1 to 100."""
    size = min(100, max(1, size))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size), rows.count()
