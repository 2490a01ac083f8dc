"""Telemetry tables and the ways to read them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthlake.functions.times import date_bin, instant

COLUMNS = ["device_id", "metric_key", "time", "value", "quality", "is_virtual"]
LEVELS = ["1m", "1h", "1d"]


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as telemetry: a device a user, a metric an event type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("device_id"),
        F.col("event_type").alias("metric_key"),
        instant(F.col("ts")).alias("time"),
        "value",
        F.when(F.col("event_id") % 20 == 0, 1).otherwise(0).alias("quality"),
        (F.col("event_id") % 50 == 7).alias("is_virtual"),
    )


def within(start: datetime | str | None, end: datetime | str | None, column: str = "time") -> Column:
    """Half-open range; a missing end is open."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out & (F.col(column) < F.lit(end).cast("timestamp"))
    return out


def raw_union(recent: DataFrame, long_term: DataFrame, where: Column | None = None) -> DataFrame:
    """Both raw tables under one predicate, which reaches both scans; six columns."""
    where = F.lit(True) if where is None else where
    return recent.select(COLUMNS).where(where).unionByName(long_term.select(COLUMNS).where(where))


def normal(rows: DataFrame, include_all: bool = False, include_virtual: bool = False) -> DataFrame:
    """Rows of quality 0 that are not virtual, unless asked for."""
    if not include_all:
        rows = rows.where("quality = 0")
    return rows if include_virtual else rows.where("NOT is_virtual")


def continuous_aggregate(raw: DataFrame, level: str) -> DataFrame:
    """One row for each device, metric and bin: counts and statistics of rows of quality 0."""
    good = F.col("quality") == 0
    value = F.when(good, F.col("value"))
    return raw.groupBy("device_id", "metric_key", date_bin(F.col("time"), level).alias("bucket")).agg(
        F.count_if(good).alias("count"),
        F.count("*").alias("count_all"),
        F.avg(value).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum(value).alias("sum"),
        F.bool_or("is_virtual").alias("is_virtual"),
    )


def binned(raw: DataFrame, level: str | int, keys: list[str], agg: str = "avg") -> DataFrame:
    """Time bins of raw rows: avg, max or min of value and the worst quality."""
    f = {"avg": F.avg, "max": F.max, "min": F.min}[agg]
    return raw.groupBy(*keys, date_bin(F.col("time"), level).alias("bucket")).agg(f("value").alias("value"), F.max("quality").alias("quality"))


def local_days(aggregate: DataFrame, device: int, metric: str, first: str, last: str, zone: str) -> DataFrame:
    """(time, value): hourly means of one series over the local days ``first`` to ``last``, both included; bins that are empty or
    virtual are left out. The bounds are literals, so they reach the files."""
    start = F.to_utc_timestamp(F.lit(first).cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 DAY"), zone)
    rows = aggregate.where((F.col("device_id") == device) & (F.col("metric_key") == metric) & (F.col("bucket") >= start) & (F.col("bucket") < end))
    return rows.where("count > 0 AND NOT is_virtual").select(F.col("bucket").alias("time"), F.col("avg").alias("value"))


def across_devices(aggregate: DataFrame, keys: list[str], agg: str = "avg") -> DataFrame:
    """Bins of several devices from an aggregate table: every device counts once, however many samples it has."""
    f = {"avg": F.avg, "max": F.max, "min": F.min}[agg]
    rows = aggregate.where("count > 0 AND NOT is_virtual")
    return rows.groupBy(*keys, "bucket").agg(f(agg).alias("value"))


def dirty_start(level: str, start: str, until: Column, dirty: DataFrame) -> DataFrame:
    """(device_id, metric_key, dirty_from): the bin where the earliest dirty range that overlaps [start, until) begins, no earlier
    than ``start``; ranges of this level or a finer one (level, device_id, metric_key, from_ts, to_ts)."""
    finer = LEVELS[: LEVELS.index(level) + 1]
    begin = F.lit(start).cast("timestamp")
    touching = dirty.where(F.col("level").isin(finer) & (F.col("from_ts") < until) & (F.col("to_ts") > begin))
    return touching.groupBy("device_id", "metric_key").agg(F.least(F.greatest(date_bin(F.min("from_ts"), level), begin), until).alias("dirty_from"))


def hybrid(raw: DataFrame, aggregate: DataFrame, level: str, start: str, end: str, processed_until: str | None, dirty: DataFrame | None = None) -> DataFrame:
    """Bins of each device and metric in [start, end): from the aggregate table up to the
    watermark, or up to the bin of the first dirty range that reaches into that time, and from raw rows beyond.

    Raw rows are read by two scans. One has the watermark as a literal, which reaches the
    files' statistics; the other goes from the first dirty bin to the watermark and is joined to the
    dirty series only, so what the aggregate covers is not read raw. Without dirty ranges there is one scan;
    without a watermark all is read raw. A bin that both sides give is the aggregate's.
    """
    keys = ["device_id", "metric_key"]
    limit = F.lit(processed_until if processed_until else start).cast("timestamp")
    limit = F.least(limit, F.lit(end).cast("timestamp"))
    mark = raw.sparkSession.range(1).select(F.greatest(limit, F.lit(start).cast("timestamp"))).first()[0]
    aggregate = aggregate.where(within(start, mark, "bucket"))
    fresh = normal(raw.where(within(mark, end))).select("time", "value", "quality", *keys)
    first = None
    if dirty is not None:
        dirty = dirty_start(level, start, F.lit(mark), dirty).where(F.col("dirty_from") < F.lit(mark))
        first = dirty.agg(F.min("dirty_from")).first()[0]
    if first is None:
        old = aggregate
    else:
        # only series with dirty ranges have rows here, of these only what is not covered
        again = normal(raw.where(within(first, mark))).select("time", "value", "quality", *keys)
        fresh = fresh.unionByName(again.join(dirty, keys).where("time >= dirty_from").select(fresh.columns))
        old = aggregate.join(dirty, keys, "left").where(F.col("dirty_from").isNull() | (F.col("bucket") < F.col("dirty_from")))
    old = old.where((F.col("count") > 0) & ~F.col("is_virtual")).select(*keys, "bucket", F.col("avg").alias("value"), F.lit(0).alias("from_raw"))
    new = binned(fresh, level, keys).select(*keys, "bucket", "value", F.lit(1).alias("from_raw"))
    return old.unionByName(new).groupBy(*keys, "bucket").agg(F.min_by("value", "from_raw").alias("value"), F.min("from_raw").alias("from_raw"))


def boundary_samples(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Samples in [start, end), the last of the day before and the first of the day after, per device and metric."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    day = F.expr("INTERVAL 1 DAY")
    rows = rows.where((F.col("quality") == 0) & F.col("value").isNotNull() & (F.col("time") >= s - day) & (F.col("time") < e + day))
    side = F.when(F.col("time") < s, -1).when(F.col("time") >= e, 1).otherwise(0)
    rows = rows.withColumn("side", side)
    by = Window.partitionBy("device_id", "metric_key", "side")
    near = F.when(F.col("side") < 0, F.col("time") == F.max("time").over(by)).when(F.col("side") > 0, F.col("time") == F.min("time").over(by)).otherwise(True)
    return rows.where(near)


def best_device(rows: DataFrame, signal: str, device: str = "device_id") -> DataFrame:
    """Rows of the device with most rows of each signal; of equals the smallest id."""
    most = rows.groupBy(signal, device).agg(F.count("*").alias("n"))
    best = most.groupBy(signal).agg(F.max_by(device, F.struct("n", -F.col(device))).alias(device))
    return rows.join(best, [signal, device], "left_semi")


def series_key(kind: str, *parts: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.col(p).cast("string") for p in parts])
