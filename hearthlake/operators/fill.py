"""Regular grids and filling of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.functions.times import date_bin
from hearthlake.operators.windows import gaps, ordered


def median_step(rows: DataFrame, keys: list[str], time: str = "time", default: float = 3_600.0) -> DataFrame:
    """Median seconds between rows of each series; ``default`` for fewer than two rows."""
    steps = gaps(rows, keys, time, "_gap").where("_gap IS NULL OR _gap > 0")
    return steps.groupBy(*keys).agg(F.coalesce(F.percentile("_gap", F.lit(0.5)), F.lit(default)).alias("step"))


def resample(rows: DataFrame, keys: list[str], size: int, value: str = "value", time: str = "time", agg: str = "avg") -> DataFrame:
    """Bins of ``size`` seconds from each series' first to last, null where a bin has no rows."""
    f = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[agg]
    bins = rows.groupBy(*keys, date_bin(F.col(time), size).alias(time)).agg(f(value).alias(value))
    span = bins.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence(F.unix_seconds("_lo"), F.unix_seconds("_hi"), F.lit(size))).alias("_s"))
    return grid.select(*keys, F.timestamp_seconds("_s").alias(time)).join(bins, [*keys, time], "left")


def interpolate(rows: DataFrame, keys: list[str], value: str = "value", limit: int | None = None, time: str = "time", edges: bool = True) -> DataFrame:
    """Nulls on the line between known neighbours, by position; of a longer gap only the
    ``limit`` rows next to a known one. Beyond the ends, with ``edges``, the end's value."""
    by = ordered(keys, time)
    # the next known row is the last one in reverse, so that both frames only grow
    back, ahead = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (by, Window.partitionBy(*keys).orderBy(F.desc("_i"))))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i"), F.col(value).alias("v")))
    rows = rows.withColumn("_i", F.row_number().over(by))
    rows = rows.withColumns({"_p": F.last(known, ignorenulls=True).over(back), "_n": F.last(known, ignorenulls=True).over(ahead)})
    i, p, n = F.col("_i"), F.col("_p"), F.col("_n")
    inner = p["v"] + (n["v"] - p["v"]) * (i - p["_i"]) / F.nullif((n["_i"] - p["_i"]).cast("double"), F.lit(0.0))
    near = F.lit(True) if limit is None else (F.coalesce(i - p["_i"], F.lit(1 << 30)) <= limit) | (F.coalesce(n["_i"] - i, F.lit(1 << 30)) <= limit)
    filled = F.when(p.isNotNull() & n.isNotNull(), inner)
    if edges:
        filled = F.coalesce(filled, F.when(p.isNull(), n["v"]).when(n.isNull(), p["v"]))
    return rows.withColumn(value, F.coalesce(F.col(value), F.when(near, filled))).drop("_i", "_p", "_n")


def on_grid(rows: DataFrame, keys: list[str], step: Column, time: str = "time") -> DataFrame:
    """Exact timestamps of a regular grid from the first row on; null rows where there is none."""
    span = rows.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"), F.first(step).alias("_step"))
    grid = span.select(*keys, F.explode(F.sequence(F.unix_seconds("_lo"), F.unix_seconds("_hi"), F.greatest(F.col("_step").cast("long"), F.lit(1)))).alias("_s"))
    return grid.select(*keys, F.timestamp_seconds("_s").alias(time)).join(rows, [*keys, time], "left")
