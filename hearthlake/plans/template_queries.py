"""Queries on the analysis templates, service tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.operators import models, service, stats
from hearthlake.plans import templates as tpl
from hearthlake.plans.catalog import query
from hearthlake.plans.telemetry_queries import HOURS, by_metric, epoch, normal
from hearthlake.sources import telemetry as tel
from hearthlake.streaming import telemetry as live

WIDE = f"""(SELECT bucket, max(value) FILTER (WHERE metric_key = 'view') AS temp, max(value) FILTER (WHERE metric_key = 'click') AS humidity, 10 * max(value) FILTER (WHERE metric_key = 'error') AS co2 FROM {HOURS} GROUP BY bucket)"""
PENALTY = f"""(SELECT *, coalesce(least(greatest(temp - 26, 20 - temp, 0) * 15, 40), 0) AS p_t, coalesce(least(greatest(humidity - 60, 40 - humidity, 0) * 1.5, 20), 0) AS p_h,
  coalesce(least(greatest(co2 - 1000, 0) * 0.04, 40), 0) AS p_c FROM {WIDE})"""


def room(spark, sf_dir: str) -> DataFrame:
    wide = tpl.aligned(normal(spark, sf_dir), [], "metric_key", ["view", "click", "error"], 3600)
    return wide.select("time", F.col("view").alias("temp"), F.col("click").alias("humidity"), (10 * F.col("error")).alias("co2"))


@query(f"""SELECT epoch_us(bucket) // 1000000 AS time, round(greatest(0, least(100, 100 - p_t - p_h - p_c)), 7) AS score,
  CASE WHEN 100 - p_t - p_h - p_c >= 80 THEN 'GOOD' WHEN 100 - p_t - p_h - p_c >= 60 THEN 'FAIR' WHEN 100 - p_t - p_h - p_c >= 40 THEN 'POOR' ELSE 'BAD' END AS grade FROM {PENALTY}""")
def comfort_scores(spark, sf_dir: str) -> DataFrame:
    return tpl.comfort(room(spark, sf_dir), ["temp", "humidity", "co2"]).select(epoch("time"), F.round("score", 7).alias("score"), "grade")


@query(f"""SELECT round(avg(greatest(0, least(100, 100 - p_t - p_h - p_c))), 6) AS score, round(avg(CASE WHEN p_t > 0 OR p_h > 0 OR p_c > 0 THEN 1.0 ELSE 0 END), 6) AS outside_ratio,
  round(sum(p_t) / (sum(p_t) + sum(p_h) + sum(p_c)), 6) AS share_temp, round(sum(p_h) / (sum(p_t) + sum(p_h) + sum(p_c)), 6) AS share_humidity, round(sum(p_c) / (sum(p_t) + sum(p_h) + sum(p_c)), 6) AS share_co2 FROM {PENALTY}""")
def comfort_items(spark, sf_dir: str) -> DataFrame:
    items = ["temp", "humidity", "co2"]
    out = tpl.comfort_summary(tpl.comfort(room(spark, sf_dir), items), [], items)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


OCCUPIED = """(WITH w AS (SELECT time, 5 * max(value) FILTER (WHERE metric_key = 'view') AS co2, max(value) FILTER (WHERE metric_key = 'click') AS noise FROM
    (SELECT metric_key, time_bucket(INTERVAL 1 HOUR, time) AS time, avg(value) AS value FROM {N} GROUP BY ALL) GROUP BY time),
  q AS (SELECT quantile_cont(co2, 0.05) AS c5, quantile_cont(noise, 0.1) AS n10 FROM w),
  e AS (SELECT time, coalesce((co2 - lag(co2) OVER (ORDER BY time)) / 60 > 3, false) OR coalesce(co2 > c5 + 250, false) AS c, coalesce(noise > n10 + 8, false) AS n FROM w, q),
  o AS (SELECT time, (CASE WHEN c THEN 2 ELSE 0 END + CASE WHEN n THEN 1 ELSE 0 END) / 3.0 >= 0.5 AS f, row_number() OVER (ORDER BY time) AS i FROM e),
  r AS (SELECT *, i - row_number() OVER (PARTITION BY f ORDER BY i) AS g FROM o)
  SELECT time, CASE WHEN f AND count(*) OVER (PARTITION BY f, g) >= 2 THEN 1 ELSE 0 END AS occupied FROM r)"""


def occupied(spark, sf_dir: str) -> DataFrame:
    wide = tpl.aligned(normal(spark, sf_dir), [], "metric_key", ["view", "click"], 3600).withColumn("space", F.lit(1))
    rows = wide.select("space", "time", (5 * F.col("view")).alias("co2"), F.col("click").alias("noise"))
    return tpl.occupancy(rows, ["space"], 3600, min_minutes=120)


@query(f"SELECT epoch_us(time) // 1000000 AS time, occupied::BIGINT AS occupied FROM {OCCUPIED}")
def occupancy_rule(spark, sf_dir: str) -> DataFrame:
    return occupied(spark, sf_dir).select(epoch("time"), F.col("occupied").cast("long").alias("occupied"))


@query(f"""SELECT round(avg(occupied), 6) AS utilization, sum(occupied)::DOUBLE AS occupied_hours FROM {OCCUPIED}
  WHERE (dayofweek(time + INTERVAL 9 HOUR) + 6) % 7 < 5 AND hour(time + INTERVAL 9 HOUR) >= 9 AND hour(time + INTERVAL 9 HOUR) < 18""")
def utilization(spark, sf_dir: str) -> DataFrame:
    out = tpl.utilization(occupied(spark, sf_dir), ["space"], step=3600)
    return out.select(F.round("utilization", 6).alias("utilization"), F.col("occupied_hours").cast("double").alias("occupied_hours"))


@query("""WITH b AS (SELECT device_id, count(*) AS n, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) AS oor FROM {T} GROUP BY device_id), s AS (SELECT *, greatest(0, 1 - n / 60.0) AS miss FROM b)
  SELECT device_id, CASE WHEN miss >= 0.2 OR oor >= 0.1 THEN 'SUSPECT' WHEN miss >= 0.05 OR oor >= 0.02 THEN 'WARN' ELSE 'OK' END AS status, round(miss, 6) AS missing_rate, round(oor, 6) AS out_of_range FROM s""")
def sensor_health(spark, sf_dir: str) -> DataFrame:
    out = tpl.sensor_health(tel.from_events(spark, sf_dir), "device_id", 30 * 86_400, 43_200, stuck_hours=1e6)
    return out.select("device_id", "status", F.round("missing_rate", 6).alias("missing_rate"), F.round("out_of_range", 6).alias("out_of_range"))


@query("""WITH h AS (SELECT metric_key, time_bucket(INTERVAL 1 HOUR, time) AS hour, avg(value) AS v FROM {N} GROUP BY ALL),
  d AS (SELECT a.metric_key, a.hour, a.v - median(b.v) AS d FROM h a JOIN h b ON a.hour = b.hour AND a.metric_key <> b.metric_key GROUP BY a.metric_key, a.hour, a.v)
  SELECT metric_key, round(avg(d), 6) AS drift FROM d GROUP BY metric_key""")
def peer_distance(spark, sf_dir: str) -> DataFrame:
    return tpl.peer_distance(normal(spark, sf_dir), "metric_key").select("metric_key", F.round("drift", 6).alias("drift"))


@query("""WITH s AS (SELECT device_id % 10 AS space_id, device_id % 3 AS purpose, CASE WHEN device_id % 10 <> 4 THEN round(avg(value), 6) END AS score, round(sum(value), 6) AS energy FROM {N} GROUP BY device_id % 10, device_id % 3)
  SELECT space_id, purpose, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY purpose, score IS NULL ORDER BY score DESC, space_id) END AS rank_score,
    row_number() OVER (PARTITION BY purpose ORDER BY energy, space_id) AS rank_energy FROM s""")
def space_benchmark_rank(spark, sf_dir: str) -> DataFrame:
    d = F.col("device_id")
    table = normal(spark, sf_dir).groupBy((d % 10).alias("space_id"), (d % 3).alias("purpose")).agg(F.round(F.avg("value"), 6).alias("score"), F.round(F.sum("value"), 6).alias("energy"))
    table = table.withColumn("score", F.when(F.col("space_id") != 4, F.col("score")))
    out = tpl.space_ranks(table, "purpose", "space_id", ["score"], ["energy"])
    return out.select("space_id", "purpose", *[F.col(c).cast("long").alias(c) for c in ("rank_score", "rank_energy")])


@query("""WITH h AS (SELECT device_id % 10 AS space_id, metric_key, time_bucket(INTERVAL 1 HOUR, time) AS hour, avg(value) AS v FROM {N} GROUP BY ALL), l(metric_key, lo, hi) AS (VALUES ('view', 5.0, 60.0), ('click', 0.0, 40.0)),
  s AS (SELECT space_id, metric_key, avg(CASE WHEN v BETWEEN lo AND hi THEN 1.0 ELSE 0 END) AS share FROM h JOIN l USING (metric_key) GROUP BY ALL)
  SELECT space_id, round(avg(share), 6) AS compliance FROM s GROUP BY space_id""")
def kpi_compliance(spark, sf_dir: str) -> DataFrame:
    hourly = tel.binned(normal(spark, sf_dir).withColumn("space_id", F.col("device_id") % 10), "1h", ["space_id", "metric_key"])
    limits = spark.createDataFrame([("view", 5.0, 60.0), ("click", 0.0, 40.0)], "metric_key string, min double, max double")
    return service.compliance(hourly, ["space_id"], "metric_key", limits).select("space_id", F.round("compliance", 6).alias("compliance"))


@query("""WITH q AS (SELECT device_id, CAST(time AS DATE) AS day, 100.0 * count(*) FILTER (WHERE quality = 0) / count(*) AS c FROM {T} GROUP BY ALL) SELECT device_id % 10 AS space_id, round(avg(c), 6) AS availability FROM q GROUP BY space_id""")
def kpi_availability(spark, sf_dir: str) -> DataFrame:
    days = tel.from_events(spark, sf_dir).groupBy("device_id", F.to_date("time").alias("day")).agg((100.0 * F.count_if(F.col("quality") == 0) / F.count("*")).alias("completeness"))
    return service.availability(days, [(F.col("device_id") % 10).alias("space_id")]).select("space_id", F.round("availability", 6).alias("availability"))


@query("SELECT o_custkey AS analysis_id, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS run_id, arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS status FROM orders GROUP BY o_custkey")
def latest_run(spark, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnsRenamed({"o_custkey": "analysis_id", "o_orderkey": "run_id", "o_orderstatus": "status"})
    return service.latest(runs, ["analysis_id"], ["o_orderdate", "run_id"], ["run_id", "status"])


@query("SELECT o_custkey AS analysis_id, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY o_custkey")
def usage_filter_counts(spark, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_custkey", "analysis_id")
    return service.usage_counts(runs, ["analysis_id"], {"open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 100000})


@query("SELECT l_orderkey AS analysis_id, count(*) AS spaces FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(*) FILTER (WHERE l_suppkey IN (SELECT unnest(range(1, 61))))")
def scope_containment(spark, sf_dir: str) -> DataFrame:
    scopes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("analysis_id")).agg(F.collect_list("l_suppkey").alias("scope"))
    return service.within_scope(scopes, "scope", list(range(1, 61))).select("analysis_id", F.size("scope").cast("long").alias("spaces"))


@query("""SELECT o_orderkey AS run_id, o_custkey % 7 AS org FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') o
  LEFT JOIN (SELECT o_custkey % 7 AS org, count(*) AS a FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 10 = 0 GROUP BY org) q ON q.org = o.o_custkey % 7 WHERE n <= 500 - coalesce(a, 0)""")
def queue_promotion(spark, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("org", F.col("o_custkey") % 7)
    queued, active = runs.where("o_orderstatus = 'O'"), runs.where("o_orderstatus = 'P' AND o_orderkey % 10 = 0")
    return service.promotable(queued, active, "org", 500, ["o_orderdate", "o_orderkey"]).select(F.col("o_orderkey").alias("run_id"), "org")


@query()
def anomaly_statistical(spark, sf_dir: str) -> DataFrame:
    out = tpl.anomalies(by_metric(spark, sf_dir), ["metric_key"], step=300)
    return out.select("metric_key", epoch("start"), epoch("end"), "rows", "kind", "score", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"))


@query()
def anomaly_multivariate(spark, sf_dir: str) -> DataFrame:
    names = ["view", "click", "error"]
    wide = tpl.aligned(normal(spark, sf_dir).withColumn("space_id", F.col("device_id") % 10), ["space_id"], "metric_key", names, 3600)
    return tpl.multivariate_anomalies(wide, "space_id", names)


@query()
def forecast_smoothing(spark, sf_dir: str) -> DataFrame:
    return tpl.forecast(tel.binned(normal(spark, sf_dir), "1h", ["metric_key"]).withColumnRenamed("bucket", "time"), ["metric_key"])


@query()
def forecast_seasonal_regression(spark, sf_dir: str) -> DataFrame:
    return tpl.forecast(tel.binned(normal(spark, sf_dir), "1h", ["metric_key"]).withColumnRenamed("bucket", "time"), ["metric_key"], method="SARIMAX")


@query()
def forecast_boosting(spark, sf_dir: str) -> DataFrame:
    return tpl.forecast(tel.binned(normal(spark, sf_dir), "1h", ["metric_key"]).withColumnRenamed("bucket", "time"), ["metric_key"], method="GRADIENT_BOOSTING")


@query(f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY bucket) AS i, count(*) OVER (PARTITION BY metric_key) AS n, lag(value, 24) OVER (PARTITION BY metric_key ORDER BY bucket) AS p FROM {HOURS})
  SELECT metric_key, max(n) AS points, round(quantile_cont(value, 0.9), 6) AS ninth, round(avg(abs(value - p)) FILTER (WHERE i > n - 48), 6) AS mae FROM h GROUP BY metric_key""")
def training_figures(spark, sf_dir: str) -> DataFrame:
    rows = tel.binned(normal(spark, sf_dir), "1h", ["metric_key"]).withColumnRenamed("bucket", "time")
    out = models.training_figures(rows, ["metric_key"])
    return out.select("metric_key", "points", F.round(F.col("edges")[9], 6).alias("ninth"), F.round("mae", 6).alias("mae"))


@query("""WITH m AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, CASE o_orderstatus WHEN 'O' THEN 'CANDIDATE' WHEN 'F' THEN 'RETIRED' ELSE 'ACTIVE' END AS status, o_totalprice AS mae FROM orders),
  c AS (SELECT k, max(version) AS v, arg_max(mae, version) AS m FROM m WHERE status = 'CANDIDATE' GROUP BY k), a AS (SELECT k, arg_max(mae, version) AS m FROM m WHERE status = 'ACTIVE' GROUP BY k)
  SELECT m.k AS model, m.version::BIGINT AS version, CASE WHEN c.v IS NOT NULL AND coalesce(c.m <= a.m, true) AND m.version = c.v THEN 'ACTIVE' WHEN c.v IS NOT NULL AND coalesce(c.m <= a.m, true) AND status = 'ACTIVE' THEN 'RETIRED' ELSE status END AS status
  FROM m LEFT JOIN c ON c.k = m.k LEFT JOIN a ON a.k = m.k""")
def model_promotion(spark, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "O", "CANDIDATE").when(F.col("o_orderstatus") == "F", "RETIRED").otherwise("ACTIVE")
    version = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    rows = runs.select(F.col("o_custkey").alias("model"), version.alias("version"), status.alias("status"), F.col("o_totalprice").alias("mae"))
    return models.states(rows, ["model"]).select("model", "version", "status")


@query()
def theil_sen_eta(spark, sf_dir: str) -> DataFrame:
    return tpl.threshold_eta(by_metric(spark, sf_dir), ["metric_key"], 100, window=720)


@query()
def battery_life(spark, sf_dir: str) -> DataFrame:
    return tpl.battery_life(by_metric(spark, sf_dir), ["metric_key"])


@query()
def change_points(spark, sf_dir: str) -> DataFrame:
    return tpl.change_points(by_metric(spark, sf_dir), ["metric_key"])


@query()
def intervention_effect(spark, sf_dir: str) -> DataFrame:
    return tpl.intervention(by_metric(spark, sf_dir), ["metric_key"], "2024-01-16", rounds=200)


@query()
def profile_clusters(spark, sf_dir: str) -> DataFrame:
    return tpl.daily_profiles(by_metric(spark, sf_dir), ["metric_key"])


@query()
def air_change_estimates(spark, sf_dir: str) -> DataFrame:
    rows = by_metric(spark, sf_dir).withColumn("value", 420 + 10 * F.col("value"))
    return tpl.air_changes(rows, ["metric_key"])


@query("""SELECT device_id, metric_key, epoch_us(time_bucket(INTERVAL 1 HOUR, time)) // 1000000 AS bucket, count(*) AS count, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM {T}
  GROUP BY ALL""")
def stream_tumbling(spark, sf_dir: str) -> DataFrame:
    out = live.run_once(live.tumbling(live.events_stream(spark, sf_dir), "1 hour"), live.warehouse(spark), "complete")
    return out.withColumns({"bucket": F.unix_seconds("bucket"), "avg": F.round("avg", 6)})


@query("SELECT metric_key, count(*) AS n FROM {T} GROUP BY metric_key")
def stream_dedup(spark, sf_dir: str) -> DataFrame:
    rows = live.events_stream(spark, sf_dir)
    twice = rows.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    once = live.run_once(live.deduplicated(twice, ["event_id"], "40 days"), live.warehouse(spark))
    return once.groupBy("metric_key").agg(F.count("*").alias("n"))


@query()
def stream_anomaly(spark, sf_dir: str) -> DataFrame:
    rows = live.with_baseline(live.events_stream(spark, sf_dir), normal(spark, sf_dir))
    return live.run_once(live.anomaly_alarms(rows), live.warehouse(spark))


@query()
def stream_eta(spark, sf_dir: str) -> DataFrame:
    rows = live.events_stream(spark, sf_dir)  # a device's readings are hours to days apart
    return live.run_once(live.eta_alarms(rows, 100, window_minutes=14 * 1440, horizon_minutes=30 * 1440), live.warehouse(spark))
