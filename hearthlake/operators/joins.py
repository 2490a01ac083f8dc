"""Joins on time and ranges, each an equi-join in the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.functions.times import seconds


def align(rows: DataFrame, series: str, names: list[str], time: str = "time", value: str = "value") -> DataFrame:
    """One row a time, one column a series: a full outer join of all series by one shuffle."""
    return rows.groupBy(time).pivot(series, names).agg(F.first(value, ignorenulls=True))


def nearest(base: DataFrame, other: DataFrame, keys: list[str], tolerance: float, value: str = "value", name: str = "near", time: str = "time") -> DataFrame:
    """``base`` with the ``value`` of ``other`` nearest in time, within ``tolerance`` seconds; of equally near ones the later.

    Time is dealt in buckets of the tolerance, ``other`` to the buckets beside its own
    too, so that one long series spreads over tasks. In a bucket both sides are
    merged and the neighbours on either side found by two windows, one in reverse,
    whose frames only grow.
    """
    bucket = F.floor(seconds(F.col(time)) / F.lit(float(max(tolerance, 1))))
    tagged = base.withColumns({"_at": F.lit(None).cast("timestamp"), "_v": F.lit(None).cast("double"), "_base": F.lit(1), "_bucket": bucket})
    others = other.where(F.col(value).isNotNull()).select(*keys, F.col(time), F.col(time).alias("_at"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_base"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"))
    both = tagged.unionByName(others, allowMissingColumns=True)
    by, reverse = (Window.partitionBy(*keys, "_bucket").orderBy(*(f(c) for c in (time, "_base", "_v"))).rowsBetween(Window.unboundedPreceding, 0) for f in (F.asc, F.desc))
    pair = F.when(F.col("_at").isNotNull(), F.struct("_at", "_v"))
    back, ahead = (F.last(pair, ignorenulls=True).over(w) for w in (by, reverse))
    both = both.withColumns({"_back": back, "_ahead": ahead}).where("_base = 1")
    t = seconds(F.col(time))
    before, after = t - seconds(F.col("_back._at")), seconds(F.col("_ahead._at")) - t
    before = F.when(before <= tolerance, before)
    after = F.when(after <= tolerance, after)
    best = F.when(after.isNotNull() & (before.isNull() | (after <= before)), F.col("_ahead._v")).when(before.isNotNull(), F.col("_back._v"))
    return both.withColumn(name, best).drop("_at", "_v", "_base", "_bucket", "_back", "_ahead")


def split_hours(intervals: DataFrame, keys: list[str], amount: str = "kwh", flag: str = "estimated", start: str = "start", end: str = "end") -> DataFrame:
    """Amounts of intervals by hour, in proportion to time; the flag holds where any part has it."""
    s, e = F.unix_micros(start), F.unix_micros(end)
    hour = 3_600_000_000
    slots = F.sequence(F.floor(s / hour), F.floor((e - 1) / hour))
    rows = intervals.where(e > s).withColumn("_slot", F.explode(slots))
    part = (F.least(e, (F.col("_slot") + 1) * hour) - F.greatest(s, F.col("_slot") * hour)) / (e - s)
    rows = rows.withColumn("_part", F.col(amount) * part)
    return rows.groupBy(*keys, F.timestamp_micros(F.col("_slot") * hour).alias("hour")).agg(F.sum("_part").alias(amount), F.bool_or(flag).alias(flag))


def valid_on(facts: DataFrame, versions: DataFrame, day: str, site: str, columns: list[str]) -> DataFrame:
    """``facts`` with ``columns`` of the version in force on ``day``: that of the fact's site if it has one
    (site column of ``versions``), however old, else that of all sites (null site).

    versions: site, valid_from and columns. Ranges are resolved once for each
    distinct site and day, not for each fact, and facts then join on these.
    """
    found = F.struct("valid_from", *columns)
    own = versions.where("site IS NOT NULL").select(F.col("site").alias(site), "valid_from", *columns)
    general = versions.where("site IS NULL").select(F.lit(1).alias("_one"), "valid_from", *columns)
    pairs = facts.select(site, day).distinct().join(own, site).where(F.col("valid_from") <= F.col(day))
    pairs = pairs.groupBy(site, day).agg(F.max_by(found, "valid_from").alias("_own"))
    days = facts.select(day).distinct().withColumn("_one", F.lit(1)).join(general, "_one").where(F.col("valid_from") <= F.col(day))
    days = days.groupBy(day).agg(F.max_by(found, "valid_from").alias("_general"))
    chosen = F.coalesce("_own", "_general")
    return facts.join(pairs, [site, day], "left").join(days, day, "left").select(*facts.columns, *[chosen[c].alias(c) for c in columns])


def within_intervals(rows: DataFrame, intervals: DataFrame, keys: list[str], slack: float, how: str, time: str = "time", start: str = "start", end: str = "end", bucket: float = 86_400.0) -> DataFrame:
    """left_semi or left_anti of rows and intervals that hold their time, ``slack`` seconds wider on both sides.

    Intervals are dealt to the buckets of time that they touch and joined by key
    and bucket.
    """
    b = int(bucket * 1_000_000)
    lo, hi = F.unix_micros(start) - int(slack * 1_000_000), F.unix_micros(end) + int(slack * 1_000_000)
    spans = intervals.select(*[F.col(k).alias(f"_{k}") for k in keys], lo.alias("_lo"), hi.alias("_hi"))
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / b), F.floor(F.col("_hi") / b))))
    on = F.floor(F.unix_micros(time) / b) == F.col("_b")
    on = on & (F.unix_micros(time) >= F.col("_lo")) & (F.unix_micros(time) <= F.col("_hi"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return rows.join(spans, on, how)


def dense(rows: DataFrame, keys: list[str], ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Every combination of the ranges for each of ``keys``, null where ``rows`` has none."""
    cells = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    for name, (lo, hi) in ranges.items():
        cells = cells.withColumn(name, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return cells.join(rows, [*keys, *ranges], "left")
