"""Queries on telemetry: scans, bins, windows, joins on time, fills, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.functions import texts
from hearthlake.functions.times import date_bin, local_hour
from hearthlake.operators import fill, joins, stats, sufficiency, windows
from hearthlake.plans.catalog import query
from hearthlake.sources import telemetry as tel

METRICS = ["click", "error", "purchase", "signup", "view"]
SERIES = ["device_id", "metric_key"]


def normal(spark, sf_dir: str) -> DataFrame:
    return tel.normal(tel.from_events(spark, sf_dir))


def by_metric(spark, sf_dir: str) -> DataFrame:
    """One value a metric and minute: many devices of a metric as one series."""
    return normal(spark, sf_dir).groupBy("metric_key", date_bin(F.col("time"), "1m").alias("time")).agg(F.avg("value").alias("value"))


BY_METRIC = "(SELECT metric_key, date_trunc('minute', time) AS time, avg(value) AS value FROM {N} GROUP BY ALL)"


def epoch(c: str, name: str | None = None):
    return F.unix_seconds(c).alias(name or c)


def _heatmap(agg: str, sql_agg: str) -> None:
    sql = f"""WITH c AS (SELECT (dayofweek(time + INTERVAL 9 HOUR) + 6) % 7 AS d, hour(time + INTERVAL 9 HOUR) AS h,
        {sql_agg} AS v, count(value) AS n, stddev_samp(value) AS s FROM {{N}} WHERE metric_key = 'view' GROUP BY ALL)
      SELECT day::BIGINT AS day, hour::BIGINT AS hour, round(v, 6) AS value, coalesce(n, 0) AS samples, round(s, 6) AS std
      FROM range(0, 7) a(day), range(0, 24) b(hour) LEFT JOIN c ON day = d AND hour = h"""

    def run(spark, sf_dir: str) -> DataFrame:
        cells = stats.heatmap(normal(spark, sf_dir).where("metric_key = 'view'"), [], agg)
        return cells.select(F.col("day").cast("long"), F.col("hour").cast("long"), F.round("value", 6).alias("value"), "samples", F.round("std", 6).alias("std"))

    run.__name__ = f"heatmap_{agg.lower()}"
    query(sql)(run)


for _agg, _sql in (("MEAN", "avg(value)"), ("MEDIAN", "median(value)"), ("MAX", "max(value)")):
    _heatmap(_agg, _sql)


@query("SELECT metric_key, hour(time + INTERVAL 9 HOUR)::BIGINT AS hour, round(avg(value), 6) AS value FROM {N} GROUP BY ALL")
def hourly_profile(spark, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir).groupBy("metric_key", local_hour(F.col("time")).cast("long").alias("hour"))
    return rows.agg(F.round(F.avg("value"), 6).alias("value"))


@query("""SELECT max({'v': v, 'd': d, 'h': h}).d::BIGINT AS peak_day, max({'v': v, 'd': d, 'h': h}).h::BIGINT AS peak_hour, min({'v': v, 'd': d, 'h': h}).d::BIGINT AS low_day,
  min({'v': v, 'd': d, 'h': h}).h::BIGINT AS low_hour FROM (SELECT (dayofweek(time + INTERVAL 9 HOUR) + 6) % 7 AS d, hour(time + INTERVAL 9 HOUR) AS h, max(value) AS v FROM {N} GROUP BY ALL)""")
def heatmap_peak_low(spark, sf_dir: str) -> DataFrame:
    cell = F.struct("value", "day", "hour")
    cells = stats.heatmap(normal(spark, sf_dir), [], "MAX").where("value IS NOT NULL").agg(F.max(cell).alias("hi"), F.min(cell).alias("lo"))
    return cells.select(*[F.col(f"{a}.{b}").cast("long").alias(f"{n}_{b}") for a, n in (("hi", "peak"), ("lo", "low")) for b in ("day", "hour")])


def _bins(level: str, name: str, sql_bin: str) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        rows = tel.binned(normal(spark, sf_dir), level, ["metric_key"])
        return rows.select("metric_key", epoch("bucket"), F.round("value", 6).alias("value"), F.col("quality").cast("long").alias("quality"))

    run.__name__ = name
    query(f"SELECT metric_key, epoch_us({sql_bin}) // 1000000 AS bucket, round(avg(value), 6) AS value, max(quality)::BIGINT AS quality FROM {{N}} GROUP BY ALL")(run)


_bins("1m", "bin_1m", "time_bucket(INTERVAL 1 MINUTE, time)")
_bins("1h", "bin_1h", "time_bucket(INTERVAL 1 HOUR, time)")
_bins("1d", "bin_1d_local", "time_bucket(INTERVAL 1 DAY, time, TIMESTAMP '1970-01-01 15:00:00')")

AGG = """(SELECT device_id, metric_key, time_bucket(INTERVAL 1 HOUR, time) AS bucket, count(*) FILTER (WHERE quality = 0) AS count, count(*) AS count_all,
  avg(value) FILTER (WHERE quality = 0) AS avg, min(value) FILTER (WHERE quality = 0) AS min, max(value) FILTER (WHERE quality = 0) AS max,
  sum(value) FILTER (WHERE quality = 0) AS sum, bool_or(is_virtual) AS is_virtual FROM {T} GROUP BY ALL)"""


@query(f"SELECT device_id, metric_key, epoch_us(bucket) // 1000000 AS bucket, count, count_all, round(avg, 6) AS avg, min, max, round(sum, 6) AS sum, is_virtual FROM {AGG}")
def continuous_aggregate_1h(spark, sf_dir: str) -> DataFrame:
    rows = tel.continuous_aggregate(tel.from_events(spark, sf_dir), "1h")
    return rows.withColumns({"bucket": F.unix_seconds("bucket"), "avg": F.round("avg", 6), "sum": F.round("sum", 6)})


@query(f"""SELECT (device_id % 10)::BIGINT AS space_id, metric_key, epoch_us(bucket) // 1000000 AS bucket, round(avg(avg), 6) AS value
  FROM {AGG} WHERE count > 0 AND NOT is_virtual GROUP BY ALL""")
def space_average_by_device(spark, sf_dir: str) -> DataFrame:
    rows = tel.continuous_aggregate(tel.from_events(spark, sf_dir), "1h").withColumn("space_id", F.col("device_id") % 10)
    return tel.across_devices(rows, ["space_id", "metric_key"]).select("space_id", "metric_key", epoch("bucket"), F.round("value", 6).alias("value"))


@query("SELECT (device_id % 10)::BIGINT AS space_id, metric_key, epoch_us(time_bucket(INTERVAL 1 HOUR, time)) // 1000000 AS bucket, round(avg(value), 6) AS value FROM {N} GROUP BY ALL")
def space_average_by_sample(spark, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir).withColumn("space_id", F.col("device_id") % 10)
    return tel.binned(rows, "1h", ["space_id", "metric_key"]).select("space_id", "metric_key", epoch("bucket"), F.round("value", 6).alias("value"))


@query(f"""WITH a AS {AGG}, d AS (SELECT 3 AS dev_mod, TIMESTAMP '2024-01-15 06:30:00' AS f),
  u AS (SELECT DISTINCT device_id, metric_key, CASE WHEN device_id % 3 = 0 THEN TIMESTAMP '2024-01-15 06:00:00' ELSE TIMESTAMP '2024-01-21' END AS until FROM {{T}}),
  old AS (SELECT a.device_id, a.metric_key, bucket, avg AS value, 0 AS from_raw FROM a JOIN u USING (device_id, metric_key) WHERE count > 0 AND NOT is_virtual
    AND bucket >= TIMESTAMP '2024-01-05' AND bucket < TIMESTAMP '2024-01-28' AND bucket < until),
  new AS (SELECT device_id, metric_key, time_bucket(INTERVAL 1 HOUR, time) AS bucket, avg(value) AS value, 1 AS from_raw FROM {{N}} JOIN u USING (device_id, metric_key)
    WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-28' AND time >= until GROUP BY ALL)
  SELECT device_id, metric_key, epoch_us(bucket) // 1000000 AS bucket, round(arg_min(value, from_raw), 6) AS value, min(from_raw)::BIGINT AS from_raw
  FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY device_id, metric_key, bucket""")
def hybrid_scan_1h(spark, sf_dir: str) -> DataFrame:
    raw = tel.from_events(spark, sf_dir)
    aggregate = tel.continuous_aggregate(raw, "1h")
    dirty = raw.where("device_id % 3 = 0").select(*SERIES).distinct().select(*SERIES, F.lit("1h").alias("level"), *(F.lit(f"2024-01-15 {t}").cast("timestamp").alias(n) for n, t in (("from_ts", "06:30:00"), ("to_ts", "09:00:00"))))
    rows = tel.hybrid(raw, aggregate, "1h", "2024-01-05", "2024-01-28", "2024-01-21", dirty)
    return rows.select(*SERIES, epoch("bucket"), F.round("value", 6).alias("value"), F.col("from_raw").cast("long").alias("from_raw"))


#: (every n-th device, level, from, to) of dirty ranges: ended before the period, reaching into it, within it, of a coarser level.
RANGES = [(3, "1h", "2024-01-02 00:10:00", "2024-01-05 00:00:00"), (5, "1m", "2024-01-04 10:20:00", "2024-01-05 12:00:00"), (7, "1m", "2024-01-18 03:10:00", "2024-01-18 03:20:00"), (11, "1d", "2024-01-06", "2024-01-07")]


@query(f"""WITH a AS {AGG}, k AS (SELECT DISTINCT device_id, metric_key FROM {{T}}),
  r(n, level, f, t) AS (VALUES {", ".join(f"({n}, '{v}', TIMESTAMP '{f}', TIMESTAMP '{t}')" for n, v, f, t in RANGES)}),
  u AS (SELECT k.*, CASE WHEN min(f) IS NULL THEN TIMESTAMP '2024-01-21' ELSE greatest(TIMESTAMP '2024-01-05', date_trunc('hour', min(f))) END AS until FROM k
    LEFT JOIN r ON device_id % n = 0 AND level IN ('1m', '1h') AND t > TIMESTAMP '2024-01-05' AND f < TIMESTAMP '2024-01-21' GROUP BY ALL),
  old AS (SELECT a.device_id, a.metric_key, bucket, avg AS value, 0 AS from_raw FROM a JOIN u USING (device_id, metric_key) WHERE count > 0 AND NOT is_virtual AND bucket >= TIMESTAMP '2024-01-05' AND bucket < until),
  new AS (SELECT device_id, metric_key, date_trunc('hour', time) AS bucket, avg(value) AS value, 1 AS from_raw FROM {{N}} JOIN u USING (device_id, metric_key) WHERE time < TIMESTAMP '2024-01-28' AND time >= until GROUP BY ALL)
  SELECT device_id, metric_key, epoch_us(bucket) // 1000000 AS bucket, round(value, 6) AS value, from_raw::BIGINT AS from_raw FROM (SELECT * FROM old UNION ALL SELECT * FROM new)""")
def hybrid_scan_overlap(spark, sf_dir: str) -> DataFrame:
    raw = tel.from_events(spark, sf_dir)
    ranges = spark.createDataFrame(RANGES, "n int, level string, from_ts string, to_ts string").withColumns({c: F.col(c).cast("timestamp") for c in ("from_ts", "to_ts")})
    dirty = raw.select(*SERIES).distinct().join(F.broadcast(ranges), F.col("device_id") % F.col("n") == 0).drop("n")
    rows = tel.hybrid(raw, tel.continuous_aggregate(raw, "1h"), "1h", "2024-01-05", "2024-01-28", "2024-01-21", dirty)
    return rows.select(*SERIES, epoch("bucket"), F.round("value", 6).alias("value"), F.col("from_raw").cast("long").alias("from_raw"))


@query("SELECT device_id, metric_key, epoch_us(time) AS us, value FROM {T} WHERE time >= TIMESTAMP '2024-01-03' AND time < TIMESTAMP '2024-01-20' AND quality = 0")
def raw_union_scan(spark, sf_dir: str) -> DataFrame:
    rows = tel.from_events(spark, sf_dir)
    split = F.lit("2024-01-08").cast("timestamp")
    where = tel.within("2024-01-03", "2024-01-20") & (F.col("quality") == 0)
    both = tel.raw_union(rows.where(F.col("time") >= split), rows.where(F.col("time") < split), where)
    return both.select("device_id", "metric_key", F.unix_micros("time").alias("us"), "value")


@query("SELECT metric_key, count(*) AS all_rows, count(*) FILTER (WHERE quality = 0) AS normal_quality, count(*) FILTER (WHERE NOT is_virtual) AS real_rows, count(*) FILTER (WHERE quality = 0 AND NOT is_virtual) AS both FROM {T} GROUP BY ALL")
def quality_and_virtual_filters(spark, sf_dir: str) -> DataFrame:
    real, good = ~F.col("is_virtual"), F.col("quality") == 0
    rows = tel.from_events(spark, sf_dir).groupBy("metric_key")
    return rows.agg(F.count("*").alias("all_rows"), F.count_if(good).alias("normal_quality"), F.count_if(real).alias("real_rows"), F.count_if(good & real).alias("both"))


@query(f"""SELECT epoch_us(bucket) // 1000000 AS bucket, {", ".join(f"round(max(value) FILTER (WHERE metric_key = '{m}'), 6) AS {m}" for m in METRICS)}
  FROM (SELECT metric_key, time_bucket(INTERVAL 1 HOUR, time) AS bucket, avg(value) AS value FROM {{N}} GROUP BY ALL) GROUP BY bucket""")
def aligned_frame(spark, sf_dir: str) -> DataFrame:
    rows = tel.binned(normal(spark, sf_dir), "1h", ["metric_key"])
    wide = joins.align(rows, "metric_key", METRICS, "bucket")
    return wide.select(epoch("bucket"), *[F.round(m, 6).alias(m) for m in METRICS])


@query("""SELECT device_id, metric_key, count(*) AS total, count(*) FILTER (WHERE quality = 0) AS received, count(*) FILTER (WHERE is_virtual) AS virtual_rows,
  epoch_us(min(time)) AS first_us, epoch_us(max(time)) AS last_us FROM {T} GROUP BY ALL""")
def series_stats(spark, sf_dir: str) -> DataFrame:
    rows = sufficiency.series_stats(tel.from_events(spark, sf_dir), SERIES)
    return rows.select(*SERIES, "total", "received", "virtual_rows", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query("""SELECT metric_key, round(median(g), 6) AS step FROM (SELECT metric_key, (epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY metric_key, device_id ORDER BY time)) / 1e6 AS g
  FROM {T}) WHERE g > 0 GROUP BY metric_key""")
def reporting_interval(spark, sf_dir: str) -> DataFrame:
    rows = sufficiency.reporting_interval(tel.from_events(spark, sf_dir), ["metric_key"], "device_id")
    return rows.select("metric_key", F.round("step", 6).alias("step"))


@query("""WITH s AS (SELECT metric_key, device_id, count(*) FILTER (WHERE quality = 0 AND NOT is_virtual) AS n FROM {T} GROUP BY ALL),
  e AS (SELECT metric_key, device_id, n, least(greatest(1 - n / 30.0, 0), 1) AS missing FROM s)
  SELECT metric_key, count(*) AS series, sum(n)::BIGINT AS points, round(avg(missing), 6) AS missing_rate,
    CASE WHEN avg(missing) >= 0.6 THEN 'FAIL' WHEN avg(missing) >= 0.3 THEN 'WARN' ELSE 'OK' END AS verdict FROM e GROUP BY metric_key""")
def sufficiency_verdict(spark, sf_dir: str) -> DataFrame:
    rows = sufficiency.series_stats(tel.from_events(spark, sf_dir), SERIES)
    rows = sufficiency.missing_rate(rows.withColumn("received", F.col("usable")), period_seconds=30 * 86_400, step_seconds=86_400)
    return sufficiency.verdict(rows, ["metric_key"], warn=0.3, fail=0.6)


@query(f"""WITH v AS {BY_METRIC}, a AS (SELECT time, value FROM v WHERE metric_key = 'view'), b AS (SELECT time AS t2, value AS v2 FROM v WHERE metric_key = 'click'),
  p AS (SELECT a.time, a.value, b.v2 AS pv, date_diff('second', b.t2, a.time) AS pd FROM a ASOF LEFT JOIN b ON a.time >= b.t2),
  n AS (SELECT a.time, b.v2 AS nv, date_diff('second', a.time, b.t2) AS nd FROM a ASOF LEFT JOIN b ON a.time <= b.t2)
  SELECT epoch_us(time) // 1000000 AS time, round(value, 6) AS value, round(CASE WHEN nd <= 1800 AND (pd IS NULL OR pd > 1800 OR nd <= pd) THEN nv WHEN pd <= 1800 THEN pv END, 6) AS near
  FROM p JOIN n USING (time)""")
def asof_nearest(spark, sf_dir: str) -> DataFrame:
    rows = by_metric(spark, sf_dir).withColumn("k", F.lit(1))
    a, b = (rows.where(f"metric_key = '{m}'").drop("metric_key") for m in ("view", "click"))
    out = joins.nearest(a, b, ["k"], 1800)
    return out.select(epoch("time"), F.round("value", 6).alias("value"), F.round("near", 6).alias("near"))


@query("""WITH r AS (SELECT *, row_number() OVER w AS i FROM {N} WINDOW w AS (PARTITION BY metric_key ORDER BY time, device_id)),
  f AS (SELECT *, i - lag(i) OVER (PARTITION BY metric_key ORDER BY i) AS g FROM r WHERE value > 60),
  x AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY metric_key ORDER BY i) AS island FROM f)
  SELECT metric_key, island::BIGINT AS island, epoch_us(min(time)) AS start_us, epoch_us(max(time)) AS end_us, count(*) AS rows, max(value) AS peak FROM x GROUP BY metric_key, island""")
def gaps_islands(spark, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir).withColumn("at", F.struct("time", "device_id"))
    found = windows.islands(rows, ["metric_key"], F.col("value") > 60, 2, "at")
    found = found.groupBy("metric_key", "island").agg(F.min("time").alias("s"), F.max("time").alias("e"), F.count("*").alias("rows"), F.max("value").alias("peak"))
    return found.select("metric_key", F.col("island").cast("long"), F.unix_micros("s").alias("start_us"), F.unix_micros("e").alias("end_us"), "rows", "peak")


@query("""WITH r AS (SELECT metric_key, time, device_id, floor(value / 100) AS v FROM {N}),
  c AS (SELECT *, CASE WHEN abs(v - lag(v) OVER w) <= 1e-9 THEN 0 ELSE 1 END AS n FROM r WINDOW w AS (PARTITION BY device_id, metric_key ORDER BY time)),
  g AS (SELECT *, sum(n) OVER (PARTITION BY device_id, metric_key ORDER BY time) AS run FROM c),
  s AS (SELECT device_id, metric_key, run, min(time) AS a, max(time) AS b FROM g GROUP BY ALL)
  SELECT device_id, metric_key, epoch_us(arg_max(a, {'d': b - a, 'a': -epoch_us(a)})) AS start_us, round(max(epoch_us(b) - epoch_us(a)) / 1e6, 6) AS seconds FROM s GROUP BY ALL""")
def longest_stuck_run(spark, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 100).cast("double"))
    out = windows.longest_constant(rows, SERIES)
    return out.select(*SERIES, F.unix_micros("start").alias("start_us"), F.round("seconds", 6).alias("seconds"))


@query("""WITH i AS (SELECT device_id, time AS s, time + INTERVAL 6 HOUR AS e FROM {N}),
  m AS (SELECT *, max(e) OVER (PARTITION BY device_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
  g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
  SELECT device_id, epoch_us(min(s)) AS start_us, epoch_us(max(e)) AS end_us FROM g GROUP BY device_id, k""")
def merge_intervals(spark, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir).select("device_id", F.col("time").alias("start"), (F.col("time") + F.expr("INTERVAL 6 HOURS")).alias("end"))
    return windows.merge_intervals(rows, ["device_id"]).select("device_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


@query(f"""SELECT metric_key, epoch_us(time) // 1000000 AS time, round(CASE WHEN count(value) OVER w >= 12 THEN median(value) OVER w END, 6) AS median
  FROM {BY_METRIC} WINDOW w AS (PARTITION BY metric_key ORDER BY time ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)""")
def rolling_median(spark, sf_dir: str) -> DataFrame:
    rows = windows.rolling_median(by_metric(spark, sf_dir), ["metric_key"], 24)
    return rows.select("metric_key", epoch("time"), F.round("median", 6).alias("median"))


@query(f"""WITH a AS (SELECT *, CASE WHEN count(value) OVER w >= 4 THEN median(value) OVER w END AS m FROM {BY_METRIC} WINDOW w AS (PARTITION BY metric_key ORDER BY time ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
  b AS (SELECT *, abs(value - m) AS d FROM a)
  SELECT metric_key, epoch_us(time) // 1000000 AS time, round(1.4826 * CASE WHEN count(d) OVER w >= 4 THEN median(d) OVER w END, 6) AS sigma
  FROM b WINDOW w AS (PARTITION BY metric_key ORDER BY time ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def rolling_mad_sigma(spark, sf_dir: str) -> DataFrame:
    rows = windows.rolling_sigma(by_metric(spark, sf_dir), ["metric_key"], 9)
    return rows.select("metric_key", epoch("time"), F.round("sigma", 6).alias("sigma"))


RESAMPLED = """(WITH b AS (SELECT metric_key, time_bucket(INTERVAL 30 MINUTE, time) AS time, avg(value) AS value FROM {N} GROUP BY ALL),
  s AS (SELECT metric_key, min(time) AS a, max(time) AS z FROM b GROUP BY ALL), g AS (SELECT metric_key, unnest(generate_series(a, z, INTERVAL 30 MINUTE)) AS time FROM s)
  SELECT g.metric_key, g.time, value, row_number() OVER (PARTITION BY g.metric_key ORDER BY g.time) AS i FROM g LEFT JOIN b USING (metric_key, time))"""


@query(f"""WITH r AS {RESAMPLED}, k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY metric_key ORDER BY i ROWS UNBOUNDED PRECEDING) AS p,
  first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY metric_key ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM r)
  SELECT k.metric_key, epoch_us(k.time) // 1000000 AS time, round(CASE WHEN k.value IS NOT NULL THEN k.value WHEN least(k.i - p, n - k.i) <= 3 THEN a.value + (b.value - a.value) * (k.i - p) / (n - p) END, 6) AS value
  FROM k LEFT JOIN r a ON a.metric_key = k.metric_key AND a.i = p LEFT JOIN r b ON b.metric_key = k.metric_key AND b.i = n""")
def resample_fill_linear(spark, sf_dir: str) -> DataFrame:
    rows = fill.interpolate(fill.resample(normal(spark, sf_dir), ["metric_key"], 1800), ["metric_key"], limit=3)
    return rows.select("metric_key", epoch("time"), F.round("value", 6).alias("value"))


@query("SELECT metric_key, round(1.4826 * mad(value), 6) AS sigma FROM {N} GROUP BY ALL")
def robust_sigma(spark, sf_dir: str) -> DataFrame:
    return stats.robust_sigma(normal(spark, sf_dir), ["metric_key"]).select("metric_key", F.round("sigma", 6).alias("sigma"))


PROFILE = """(WITH r AS (SELECT metric_key, CASE WHEN (dayofweek(time + INTERVAL 9 HOUR) + 6) % 7 >= 5 THEN 1 ELSE 0 END AS day_type, hour(time + INTERVAL 9 HOUR) AS slot, value FROM {N}),
  m AS (SELECT metric_key, day_type, slot, median(value) AS m FROM r GROUP BY ALL)
  SELECT a.metric_key, a.day_type, a.slot, avg(b.m) AS profile FROM m a JOIN m b ON a.metric_key = b.metric_key AND a.day_type = b.day_type AND ((a.slot - b.slot + 24) % 24) IN (0, 1, 23) GROUP BY ALL)"""


@query(f"SELECT metric_key, day_type::BIGINT AS day_type, slot::BIGINT AS slot, round(profile, 6) AS profile FROM {PROFILE}")
def seasonal_profile(spark, sf_dir: str) -> DataFrame:
    rows = stats.seasonal_profile(normal(spark, sf_dir), ["metric_key"])
    return rows.select("metric_key", F.col("day_type").cast("long"), F.col("slot").cast("long"), F.round("profile", 6).alias("profile"))


@query(f"""WITH r AS (SELECT n.metric_key, device_id, time, value - profile AS r FROM {{N}} n JOIN {PROFILE} p ON n.metric_key = p.metric_key
    AND p.slot = hour(time + INTERVAL 9 HOUR) AND p.day_type = CASE WHEN (dayofweek(time + INTERVAL 9 HOUR) + 6) % 7 >= 5 THEN 1 ELSE 0 END)
  SELECT metric_key, device_id, epoch_us(time) AS us, round(r - median(r) OVER (PARTITION BY metric_key), 6) AS residual FROM r""")
def seasonal_residual(spark, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir)
    out = stats.seasonal_residual(rows, stats.seasonal_profile(rows, ["metric_key"]), ["metric_key"])
    return out.select("metric_key", "device_id", F.unix_micros("time").alias("us"), F.round("residual", 6).alias("residual"))


#: Three series of steps of 5, 15 and 60 minutes, two of them without some hours of the day.
STEPPED = """(SELECT * FROM (SELECT CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 15 ELSE 60 END AS series, value,
  TIMESTAMP '2024-01-01' + to_minutes(CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 15 ELSE 60 END * (event_id // 3)) AS time FROM events)
  WHERE NOT (series = 15 AND hour(time + INTERVAL 9 HOUR) IN (2, 3)) AND NOT (series = 60 AND hour(time + INTERVAL 9 HOUR) IN (23, 0)))"""
OWN = f"""(WITH x AS (SELECT *, time + INTERVAL 9 HOUR AS l, CASE WHEN (dayofweek(time + INTERVAL 9 HOUR) + 6) % 7 >= 5 THEN 1 ELSE 0 END AS dt FROM {STEPPED}),
  st AS (SELECT series, median(d) AS step FROM (SELECT series, (epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY series ORDER BY time)) / 6e7 AS d FROM x) GROUP BY series),
  k AS (SELECT series, greatest(15, least(60, floor(step)))::INT AS w, least(count(DISTINCT CASE WHEN dt = 1 THEN l::DATE END), count(DISTINCT CASE WHEN dt = 0 THEN l::DATE END)) AS few, median(value) AS fallback
    FROM x JOIN st USING (series) GROUP BY series, step),
  r AS (SELECT x.*, w, few, fallback, (hour(l) * 60 + minute(l)) // w AS slot, CASE WHEN few >= 4 THEN dt ELSE 0 END AS ty FROM x JOIN k USING (series)),
  m AS (SELECT series, ty, slot, median(value) AS m FROM r GROUP BY ALL),
  g AS (SELECT series, w, few, fallback, ty, slot, m, last_value(CASE WHEN m IS NOT NULL THEN slot END IGNORE NULLS) OVER u AS bs, last_value(m IGNORE NULLS) OVER u AS bm,
      first_value(CASE WHEN m IS NOT NULL THEN slot END IGNORE NULLS) OVER v AS as_, first_value(m IGNORE NULLS) OVER v AS am
    FROM (SELECT *, unnest(range(1440 // w)) AS slot FROM (SELECT *, unnest(CASE WHEN few >= 4 THEN [0, 1] ELSE [0] END) AS ty FROM k)) LEFT JOIN m USING (series, ty, slot)
    WINDOW u AS (PARTITION BY series, ty ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY series, ty ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  f AS (SELECT *, coalesce(m, bm + (am - bm) * (slot - bs) / (as_ - bs), bm, am) AS y FROM g),
  s AS (SELECT a.series, a.w, a.few, a.fallback, a.ty, a.slot, avg(b.y) AS p FROM f a JOIN f b ON a.series = b.series AND a.ty = b.ty AND (a.slot - b.slot + 1440 // a.w) % (1440 // a.w) IN (0, 1, 1440 // a.w - 1) GROUP BY ALL),
  o AS (SELECT r.series, r.dt, median(value - coalesce(p, r.fallback)) AS off FROM r LEFT JOIN s ON r.series = s.series AND r.slot = s.slot AND r.ty = s.ty WHERE r.few BETWEEN 1 AND 3 GROUP BY ALL)
  SELECT s.series, w, fallback, d AS day_type, slot, p + coalesce(off, 0) AS profile FROM (SELECT *, unnest(CASE WHEN few >= 4 THEN [ty] ELSE [0, 1] END) AS d FROM s) s LEFT JOIN o ON s.series = o.series AND s.d = o.dt)"""


def stepped(spark, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(k == 0, 5).when(k == 1, 15).otherwise(60).alias("series"), F.expr("event_id div 3").alias("i"), "value")
    rows = rows.withColumn("time", F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("series") * F.col("i") * 60_000_000)).drop("i")
    hour = local_hour(F.col("time"))
    return rows.where(~((F.col("series") == 15) & hour.isin(2, 3)) & ~((F.col("series") == 60) & hour.isin(23, 0)))


@query(f"SELECT series::BIGINT AS series, w::BIGINT AS width, day_type::BIGINT AS day_type, slot::BIGINT AS slot, round(profile, 6) AS profile FROM {OWN}")
def slot_profile_own_width(spark, sf_dir: str) -> DataFrame:
    out = stats.own_profile(stepped(spark, sf_dir), ["series"])
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("series", "width", "day_type", "slot")], F.round("profile", 6).alias("profile"))


@query(f"""SELECT x.series::BIGINT AS series, epoch_us(time) AS us, round(value - coalesce(p.profile, k.fallback), 6) AS residual FROM {STEPPED} x JOIN (SELECT DISTINCT series, w, fallback FROM {OWN}) k USING (series)
  LEFT JOIN {OWN} p ON x.series = p.series AND p.slot = (hour(time + INTERVAL 9 HOUR) * 60 + minute(time + INTERVAL 9 HOUR)) // k.w AND p.day_type = CASE WHEN (dayofweek(time + INTERVAL 9 HOUR) + 6) % 7 >= 5 THEN 1 ELSE 0 END""")
def slot_residual_own_width(spark, sf_dir: str) -> DataFrame:
    rows = stepped(spark, sf_dir)
    out = stats.own_residual(rows, stats.own_profile(rows, ["series"]), ["series"])
    return out.select(F.col("series").cast("long").alias("series"), F.unix_micros("time").alias("us"), F.round("residual", 6).alias("residual"))


HOURS = "(SELECT metric_key, time_bucket(INTERVAL 1 HOUR, time) AS bucket, avg(value) AS value FROM {N} GROUP BY ALL)"


@query(f"""SELECT x.metric_key AS a, y.metric_key AS b, round(corr(x.value, y.value), 6) AS r FROM {HOURS} x JOIN {HOURS} y ON x.bucket = y.bucket AND x.metric_key < y.metric_key GROUP BY ALL""")
def correlation_matrix(spark, sf_dir: str) -> DataFrame:
    wide = joins.align(tel.binned(normal(spark, sf_dir), "1h", ["metric_key"]), "metric_key", METRICS, "bucket")
    return stats.correlations(wide, METRICS).select("a", "b", F.round("r", 6).alias("r"))


@query(f"""WITH h AS (SELECT metric_key, epoch_us(bucket) // 3600000000 AS i, value FROM {HOURS}),
  l AS (SELECT x.metric_key AS a, y.metric_key AS b, lag, corr(x.value, y.value) AS r FROM h x, range(-6, 7) g(lag), h y WHERE y.i = x.i + lag AND x.metric_key < y.metric_key GROUP BY ALL)
  SELECT a, b, lag, round(r, 6) AS r FROM l""")
def lagged_correlation(spark, sf_dir: str) -> DataFrame:
    rows = tel.binned(normal(spark, sf_dir), "1h", ["metric_key"]).withColumn("i", F.floor(F.unix_seconds("bucket") / 3600))
    out = stats.lagged_correlations(rows, "metric_key", "i", "value", 6)
    return out.select("a", "b", F.col("lag").cast("long"), F.round("r", 6).alias("r"))


@query(f"""WITH p AS (SELECT x.metric_key AS a, y.metric_key AS b, x.value AS u, y.value AS v FROM {HOURS} x JOIN {HOURS} y ON x.bucket = y.bucket AND x.metric_key < y.metric_key),
  k AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY u) + (count(*) OVER (PARTITION BY a, b, u) - 1) / 2.0 AS ru, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0 AS rv FROM p)
  SELECT a, b, round(corr(ru, rv), 6) AS r FROM k GROUP BY ALL""")
def spearman(spark, sf_dir: str) -> DataFrame:
    rows = tel.binned(normal(spark, sf_dir), "1h", ["metric_key"]).select("metric_key", "bucket", "value")
    pairs = rows.toDF("a", "t", "u").join(rows.toDF("b", "t", "v"), "t").where("a < b")
    ranked = windows.average_rank(windows.average_rank(pairs, ["a", "b"], "u", "ru"), ["a", "b"], "v", "rv")
    return ranked.groupBy("a", "b").agg(F.round(stats.pearson(F.col("ru"), F.col("rv")), 6).alias("r"))


@query("""WITH t AS (SELECT metric_key, quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM {N} WHERE time < TIMESTAMP '2024-01-16' GROUP BY ALL),
  i AS (SELECT metric_key, list_distinct(e[2:10]) AS inner_edges FROM t),
  b AS (SELECT n.metric_key, len(list_filter(inner_edges, lambda x: x <= value)) AS bin, len(inner_edges) + 1 AS bins FROM {N} n JOIN i USING (metric_key) WHERE time >= TIMESTAMP '2024-01-16'),
  c AS (SELECT metric_key, bin, bins, count(*) AS c, sum(count(*)) OVER (PARTITION BY metric_key) AS n FROM b GROUP BY metric_key, bin, bins)
  SELECT metric_key, round(sum((greatest(c / n, 1e-4) - 1 / bins) * ln(greatest(c / n, 1e-4) / (1 / bins))), 6) AS psi FROM c GROUP BY metric_key""")
def psi_drift(spark, sf_dir: str) -> DataFrame:
    rows, cut = normal(spark, sf_dir), F.lit("2024-01-16").cast("timestamp")
    edges = stats.deciles(rows.where(F.col("time") < cut), ["metric_key"])
    return stats.psi(rows.where(F.col("time") >= cut), edges, ["metric_key"]).select("metric_key", F.round("psi", 6).alias("psi"))


@query(f"""WITH h AS (SELECT metric_key, value AS actual, lag(value, 24) OVER (PARTITION BY metric_key ORDER BY bucket) AS predicted FROM {HOURS})
  SELECT metric_key, round(avg(abs(actual - predicted)), 6) AS mae, round(100 * avg(CASE WHEN actual <> 0 AND predicted IS NOT NULL THEN abs(actual - predicted) / abs(actual) END), 6) AS mape FROM h GROUP BY ALL""")
def mae_mape(spark, sf_dir: str) -> DataFrame:
    rows = tel.binned(normal(spark, sf_dir), "1h", ["metric_key"])
    rows = rows.withColumn("predicted", F.lag("value", 24).over(windows.ordered(["metric_key"], "bucket")))
    out = stats.errors(rows, ["metric_key"], "value", "predicted")
    return out.select("metric_key", F.round("mae", 6).alias("mae"), F.round("mape", 6).alias("mape"))


@query("""WITH w AS (SELECT *, lag(value) OVER (PARTITION BY device_id, metric_key ORDER BY time) AS p FROM {N})
  SELECT metric_key, round(regr_slope(value, p), 6) AS slope, round(regr_intercept(value, p), 6) AS intercept, round(regr_r2(value, p), 6) AS r2, count(*) AS n FROM w WHERE p IS NOT NULL GROUP BY ALL""")
def autoregression(spark, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir).withColumn("p", F.lag("value").over(windows.ordered(SERIES)))
    fit = stats.regression(rows, ["metric_key"], "p", "value")
    return fit.select("metric_key", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")], "n")


@query("""WITH l AS (SELECT metric_key, time AS a, time + INTERVAL 10 MINUTE AS b FROM {N} WHERE value > 110)
  SELECT metric_key, count(*) AS excluded FROM {N} n WHERE EXISTS (SELECT 1 FROM l WHERE l.metric_key = n.metric_key AND n.time BETWEEN l.a - INTERVAL 5 MINUTE AND l.b + INTERVAL 5 MINUTE) GROUP BY ALL""")
def label_exclusion(spark, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir)
    labels = rows.where("value > 110").select("metric_key", F.col("time").alias("start"), (F.col("time") + F.expr("INTERVAL 10 MINUTES")).alias("end"))
    return joins.within_intervals(rows, labels, ["metric_key"], 300, "left_semi").groupBy("metric_key").agg(F.count("*").alias("excluded"))


@query("""WITH k AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\pL\\pN]', '', 'g') AS p FROM documents),
  b AS (SELECT doc_id, list_distinct(list_transform(range(1, length(p)), lambda i: substr(p, i, 2))) AS g FROM k)
  SELECT doc_id, round(len(list_intersect(g, ['th', 'he', 'er', 're'])) / 4.0, 4) AS score FROM b WHERE len(list_intersect(g, ['th', 'he', 'er', 're'])) > 0
  ORDER BY len(list_intersect(g, ['th', 'he', 'er', 're'])) DESC, doc_id LIMIT 20""")
def keyword_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", texts.share_within("th ere", texts.plain(F.col("text"))).alias("score"))
    return found.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 4).alias("score"))
