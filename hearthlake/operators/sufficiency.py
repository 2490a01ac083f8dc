"""Whether there is enough data for an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.operators.windows import gaps

#: Coarser resolutions in order, in seconds (RAW first).
LADDER = [("RAW", 0), ("1m", 60), ("1h", 3_600), ("1d", 86_400)]


def series_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by kind, and first and last time of each series, in one pass."""
    good = F.col("quality") == 0
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(good).alias("received"),
        F.count_if(good & ~F.col("is_virtual")).alias("usable"),
        F.count_if("is_virtual").alias("virtual_rows"),
        F.min("time").alias("first"),
        F.max("time").alias("last"),
    )


def reporting_interval(rows: DataFrame, keys: list[str], device: str, earliest: int | None = None) -> DataFrame:
    """(keys, step): median of the positive gaps of devices' rows; of each series' ``earliest`` rows only, if given."""
    if earliest is not None:
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("time"))
        rows = rows.withColumn("_n", first).where(F.col("_n") <= earliest)
    return gaps(rows, [*keys, device]).where("gap > 0").groupBy(*keys).agg(F.percentile("gap", F.lit(0.5)).alias("step"))


def missing_rate(stats: DataFrame, period_seconds: float, step_seconds: float) -> DataFrame:
    expected = period_seconds / step_seconds
    return stats.withColumn("missing", F.least(F.greatest(1 - F.col("received") / expected, F.lit(0.0)), F.lit(1.0)))


def verdict(series: DataFrame, keys: list[str], warn: float, fail: float, least_points: int = 0) -> DataFrame:
    """FAIL, WARN or OK by the mean missing rate of the series and their points."""
    rate = F.avg("missing")
    found = series.groupBy(*keys).agg(F.count("*").alias("series"), F.sum("received").alias("points"), F.round(rate, 6).alias("missing_rate"), rate.alias("_rate"))
    word = F.when((F.col("_rate") >= fail) | (F.col("points") < least_points), "FAIL").when(F.col("_rate") >= warn, "WARN").otherwise("OK")
    return found.withColumn("verdict", word).drop("_rate")


def estimate_points(received: int, period_seconds: float, step: int) -> int:
    return received if not step else min(received, int(period_seconds // step) + 1)


def effective_resolution(received: int, period_seconds: float, most: int) -> str:
    """The finest resolution whose points are within ``most``; else the coarsest."""
    for name, step in LADDER:
        if estimate_points(received, period_seconds, step) <= most:
            return name
    return LADDER[-1][0]
