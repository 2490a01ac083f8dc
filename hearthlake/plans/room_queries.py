"""Queries on rooms: air changes, intensities, hourly temperatures, intervals of lines, series without forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.operators import energy, stats, ventilation
from hearthlake.plans.catalog import query
from hearthlake.plans.energy_queries import PICKED, SPACES, daily, spaces
from hearthlake.plans.telemetry_queries import HOURS, normal
from hearthlake.sources import telemetry as tel

Z = "1.959963984540054e0"
#: Student's quantile by the series in 1/n round the normal one, which is exact to ten digits from 100 degrees on.
SERIES_T = f"""({Z} + ({Z}^3 + {Z}) / (4 * f) + (5 * {Z}^5 + 16 * {Z}^3 + 3 * {Z}) / (96 * f^2) + (3 * {Z}^7 + 19 * {Z}^5 + 17 * {Z}^3 - 15 * {Z}) / (384 * f^3)
  + (79 * {Z}^9 + 776 * {Z}^7 + 1482 * {Z}^5 - 1920 * {Z}^3 - 945 * {Z}) / (92160 * f^4))"""


@query(f"""WITH h AS (SELECT metric_key, value, epoch_us(bucket) / 3.6e9 - 473352 AS x FROM {HOURS}),
  r AS (SELECT metric_key, regr_count(value, x)::BIGINT AS n, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept, regr_r2(value, x) AS r2, regr_sxx(value, x) AS xx, regr_syy(value, x) AS yy, (regr_count(value, x) - 2)::DOUBLE AS f FROM h GROUP BY ALL),
  e AS (SELECT *, sqrt((1 - r2) * yy / xx / f) AS error, {SERIES_T} AS t FROM r)
  SELECT metric_key, n, round(slope, 6) AS slope, round(intercept, 5) AS intercept, round(r2, 7) AS r2, round(error, 6) AS error, round(slope - t * error, 6) AS low, round(slope + t * error, 6) AS high FROM e""")
def regression_intervals(spark, sf_dir: str) -> DataFrame:
    rows = tel.binned(normal(spark, sf_dir), "1h", ["metric_key"]).withColumn("x", F.unix_micros("bucket") / 3.6e9 - 473352)
    out = stats.bounded_line(rows, ["metric_key"], "x", "value")
    return out.withColumns({c: F.round(c, d) for c, d in (("slope", 6), ("intercept", 5), ("r2", 7), ("error", 6), ("low", 6), ("high", 6))})


@query("""WITH s AS (SELECT device_id % 40 AS device_id, device_id % 8 AS space_id, CAST(time + INTERVAL 9 HOUR AS DATE) AS day, time, value FROM {N} WHERE metric_key = 'view' AND value IS NOT NULL),
  w AS (SELECT DISTINCT space_id, device_id FROM s WHERE space_id NOT IN (3, 6, 7)),
  n AS (SELECT *, row_number() OVER (PARTITION BY device_id, day ORDER BY time, value) AS k, epoch_us(time) / 3.6e9 - min(epoch_us(time)) OVER (PARTITION BY device_id, day) / 3.6e9 AS x, CASE WHEN value > 5 THEN ln(value - 5) END AS y FROM s),
  f AS (SELECT device_id, day, count(*) AS n, median(value) FILTER (WHERE k <= 3) AS first, (max(epoch_us(time)) - min(epoch_us(time))) / 6e7 AS lasts, regr_count(y, x) AS m, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM n GROUP BY ALL),
  r AS (SELECT *, CASE WHEN n < 3 OR lasts < 30 THEN 'TOO_SHORT' WHEN first - 5 < 20 THEN 'LOW_AMPLITUDE' WHEN m < 3 OR slope IS NULL OR slope >= 0 OR r2 < 0.05 THEN 'LOW_FIT' END AS reason FROM f),
  d AS (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-14', INTERVAL 1 DAY))::DATE AS day),
  e AS (SELECT space_id, w.device_id, d.day, CASE WHEN reason IS NULL AND r.n IS NOT NULL THEN round(-slope, 4) END AS ach, CASE WHEN reason IS NULL THEN round(r2, 4) END AS r2, CASE WHEN r.n IS NULL THEN 'NO_DATA' ELSE reason END AS reason FROM w CROSS JOIN d LEFT JOIN r ON r.device_id = w.device_id AND r.day = d.day),
  b AS (SELECT *, row_number() OVER (PARTITION BY space_id, day ORDER BY ach IS NULL, coalesce(r2, -1) DESC, device_id) AS k FROM e)
  SELECT space_id::BIGINT AS space_id, CAST(day AS VARCHAR) AS day, device_id::BIGINT AS device_id, ach, r2, reason, 'OK' AS status, round(ach * CASE WHEN space_id <> 2 THEN (20.0 + space_id) * 2.5 END, 2) AS ventilation_m3h FROM b WHERE k = 1
  UNION ALL SELECT 6, CAST(day AS VARCHAR), NULL, NULL, NULL, NULL, 'INPUT_MISSING', NULL FROM d""")
def air_change_days(spark, sf_dir: str) -> DataFrame:
    """Spaces of five devices each: space 3 has its sensor off, 7 is an occupancy sensor without output, 6 names another metric."""
    samples = normal(spark, sf_dir).withColumn("device_id", (F.col("device_id") % 40).cast("long"))
    space = F.col("device_id") % 8
    found = samples.where("metric_key = 'view' AND value IS NOT NULL").groupBy(space.alias("space_id")).agg(F.array_sort(F.collect_set("device_id")).alias("ids"))
    s = F.col("space_id")
    sensors = found.select(
        "space_id", F.when(s == 7, "OCCUPANCY").otherwise("ACH").alias("kind"), F.when(s % 2 == 1, s != 3).alias("enabled"), F.lit(None).cast("long").alias("output_device_id"),
        F.array(F.struct(F.when(s == 6, "click").otherwise("view").alias("metric_key"), F.col("ids").alias("device_ids"))).alias("inputs"),
    )
    sizes = found.select("space_id", F.when(s != 2, 20.0 + s).alias("area_m2"), F.lit(2.5).alias("height_m"))
    out = ventilation.air_change_days(samples, sensors, sizes, "2024-01-05", "2024-01-14", "view", outdoor=5.0, amplitude=20.0, fit=0.05)
    return out.select("space_id", F.col("day").cast("string").alias("day"), "device_id", "ach", "r2", "reason", "status", "ventilation_m3h")


@query(f"""WITH k AS (SELECT space_id, sum(kwh) AS kwh FROM {PICKED} WHERE day >= DATE '1997-01-01' AND day < DATE '1998-01-01' GROUP BY ALL),
  h AS (SELECT space_id, kwh, area, CASE WHEN space_id % 4 = 0 THEN 100.0 + space_id % 30 WHEN space_id % 4 = 1 THEN 0.0 END AS occupied, CASE WHEN space_id % 5 <> 0 THEN 2000.0 END AS scheduled FROM k JOIN {SPACES} ON id = space_id)
  SELECT space_id, round(CASE WHEN area > 0 THEN kwh / area END + 1e-9, 6) AS eui, CASE WHEN area IS NULL OR area <= 0 THEN 'NO_AREA' END AS eui_reason,
   round(CASE WHEN occupied > 0 THEN kwh / occupied WHEN scheduled > 0 THEN kwh / scheduled END + 1e-9, 6) AS an_hour, CASE WHEN occupied > 0 THEN 'OCCUPANCY_EST' WHEN scheduled > 0 THEN 'OPERATING_SCHEDULE' END AS source,
   CASE WHEN coalesce(occupied, 0) <= 0 AND scheduled IS NULL THEN 'NO_OCCUPANCY' END AS an_hour_reason FROM h""")
def energy_intensities(spark, sf_dir: str) -> DataFrame:
    used = energy.pick_source(daily(spark, sf_dir)).where("day >= DATE '1997-01-01' AND day < DATE '1998-01-01'").groupBy("space_id").agg(F.sum("kwh").alias("kwh"))
    s, area = F.col("space_id"), F.col("area_m2")
    rows = used.join(spaces(spark, sf_dir).select(F.col("id").alias("space_id"), "area_m2"), "space_id")
    occupied = energy.occupied_intensity(F.col("kwh"), F.when(s % 4 == 0, 100.0 + s % 30).when(s % 4 == 1, 0.0), F.when(s % 5 != 0, 2000.0))
    rows = rows.withColumn("o", occupied)
    return rows.select("space_id", F.round(energy.intensity(F.col("kwh"), area) + 1e-9, 6).alias("eui"), energy.intensity_reason(area).alias("eui_reason"), F.round(F.col("o.value") + 1e-9, 6).alias("an_hour"), F.col("o.source").alias("source"), F.col("o.reason").alias("an_hour_reason"))


@query("""SELECT CAST(CAST(bucket + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, round(avg(v), 6) AS temperature, round(greatest(avg(v) - 24, 0), 6) AS cdd, round(greatest(18 - avg(v), 0), 6) AS hdd FROM
  (SELECT time_bucket(INTERVAL 1 HOUR, time) AS bucket, avg(value) FILTER (WHERE quality = 0) AS v, count(*) FILTER (WHERE quality = 0) AS n, bool_or(is_virtual) AS virtual FROM {T} WHERE device_id % 5 = 2 AND metric_key = 'view' GROUP BY ALL)
  WHERE n > 0 AND NOT virtual AND bucket >= TIMESTAMP '2024-01-05' - INTERVAL 9 HOUR AND bucket < TIMESTAMP '2024-01-15' - INTERVAL 9 HOUR GROUP BY ALL""")
def local_day_temperatures(spark, sf_dir: str) -> DataFrame:
    hours = tel.continuous_aggregate(tel.from_events(spark, sf_dir).withColumn("device_id", F.col("device_id") % 5), "1h")
    days = energy.degree_days(energy.daily_temperature(tel.local_days(hours, 2, "view", "2024-01-05", "2024-01-14", "Asia/Seoul"), []))
    return days.select(F.col("day").cast("string").alias("day"), *[F.round(c, 6).alias(c) for c in ("temperature", "cdd", "hdd")])


@query("""SELECT device_id, metric_key, CASE WHEN count(v) < 3 THEN 'TOO_SHORT' ELSE 'NO_CHANGE' END AS reason FROM (SELECT device_id, metric_key, floor(value / 50) AS v FROM {N})
  GROUP BY ALL HAVING count(v) < 3 OR max(v) - min(v) <= 1e-9""")
def unpredictable_series(spark, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 50).cast("double"))
    return stats.unpredictable(rows, ["device_id", "metric_key"])
