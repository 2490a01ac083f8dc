"""Queries on the service's jobs: daily energy, virtual sensors, forecasts with bands, feedback, queues, devices of bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.operators import bindings, daily, rolling, service, virtual
from hearthlake.plans.catalog import query
from hearthlake.plans.energy_queries import SPACES, spaces
from hearthlake.plans.telemetry_queries import HOURS, epoch, normal
from hearthlake.sources import telemetry as tel

H, P = 24, 24


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel.binned(normal(spark, sf_dir), "1h", ["metric_key"]).select("metric_key", F.col("bucket").alias("time"), "value")


#: Seasonal means from four origins, and their errors.
ROLLING = f"""h AS (SELECT metric_key, bucket AS time, value, row_number() OVER (PARTITION BY metric_key ORDER BY bucket) - 1 AS i FROM {HOURS}),
  n AS (SELECT metric_key, count(*) AS n, greatest({H}, floor(count(*) * 0.2::DOUBLE))::BIGINT AS hold, max(time) AS last FROM h GROUP BY metric_key),
  o AS (SELECT DISTINCT metric_key, n, n - hold + k * greatest(1, (hold - {H}) // 3) AS origin FROM n, range(4) g(k)),
  os AS (SELECT * FROM o WHERE origin + 1 <= n - 1 AND origin >= {2 * P}),
  tm AS (SELECT metric_key, origin, i % {P} AS place, avg(value) AS m FROM os JOIN h USING (metric_key) WHERE i < origin GROUP BY ALL),
  ta AS (SELECT metric_key, origin, avg(value) AS a FROM os JOIN h USING (metric_key) WHERE i < origin GROUP BY ALL),
  e AS (SELECT os.metric_key, os.origin, i - os.origin + 1 AS step, value AS actual, coalesce(m, a) AS predicted FROM os JOIN h ON os.metric_key = h.metric_key AND i >= os.origin AND i < os.origin + {H}
    LEFT JOIN tm ON tm.metric_key = os.metric_key AND tm.origin = os.origin AND tm.place = i % {P} LEFT JOIN ta ON ta.metric_key = os.metric_key AND ta.origin = os.origin)"""


@query(f"WITH {ROLLING} SELECT metric_key, origin, step, round(actual, 8) AS actual, round(predicted, 8) AS predicted FROM e")
def forecast_origin_errors(spark, sf_dir: str) -> DataFrame:
    out = rolling.validate(rolling.numbered(hourly(spark, sf_dir), ["metric_key"]), ["metric_key"], H, rolling.seasonal_mean(P), period=P)
    return out.select("metric_key", F.col("origin").cast("long").alias("origin"), F.col("step").cast("long").alias("step"), F.round("actual", 8).alias("actual"), F.round("predicted", 8).alias("predicted"))


@query(f"""WITH {ROLLING}, r AS (SELECT metric_key, min(value) > 0 AS rel FROM h GROUP BY metric_key),
  l AS (SELECT metric_key, rel, count(*) AS n, list_sort(list(abs(actual - predicted) / CASE WHEN rel THEN abs(predicted) ELSE 1 END)) AS l FROM e JOIN r USING (metric_key) GROUP BY ALL),
  q AS (SELECT *, least(1, 0.8::DOUBLE * (n + 1) / n) * (n - 1) AS a80, least(1, 0.95::DOUBLE * (n + 1) / n) * (n - 1) AS a95 FROM l),
  w AS (SELECT metric_key, rel, l[floor(a80)::INT + 1] + (l[least(n, floor(a80)::INT + 2)] - l[floor(a80)::INT + 1]) * (a80 - floor(a80)) AS c80,
    l[floor(a95)::INT + 1] + (l[least(n, floor(a95)::INT + 2)] - l[floor(a95)::INT + 1]) * (a95 - floor(a95)) AS c95 FROM q),
  x AS (SELECT h.metric_key, value, rel, avg(value) OVER p AS m, count(*) OVER p AS c FROM h JOIN r USING (metric_key) WINDOW p AS (PARTITION BY h.metric_key, i % {P})),
  y AS (SELECT metric_key, (value - m) / CASE WHEN rel THEN abs(m) ELSE 1 END AS r, c FROM x),
  z AS (SELECT metric_key, median(r) AS md, avg(c) AS k FROM y GROUP BY metric_key),
  s AS (SELECT y.metric_key, 1.4826::DOUBLE * median(abs(r - md)) * sqrt(k / (k - 1)) * sqrt(1 + 1 / greatest(1, k)) AS wide FROM y JOIN z USING (metric_key) GROUP BY y.metric_key, k),
  b AS (SELECT metric_key, rel, greatest(c80, 1.2816 * wide) AS q80, greatest(c95, 1.96 * wide) AS q95 FROM w JOIN s USING (metric_key)),
  f AS (SELECT n.metric_key, g.k AS step, last + to_hours(g.k::INT) AS time, (SELECT avg(value) FROM h WHERE h.metric_key = n.metric_key AND i % {P} = (n.n - 1 + g.k) % {P}) AS p FROM n, range(1, {H + 1}) g(k))
  SELECT metric_key, step, epoch_us(time) // 1000000 AS time, round(p, 6) AS predicted, round(p - q80 * sc, 6) AS lower80, round(p + q80 * sc, 6) AS upper80, round(p - q95 * sc, 6) AS lower95, round(p + q95 * sc, 6) AS upper95
  FROM (SELECT *, CASE WHEN rel THEN abs(p) ELSE 1 END AS sc FROM f JOIN b USING (metric_key))""")
def forecast_bands(spark, sf_dir: str) -> DataFrame:
    out = rolling.forecast(hourly(spark, sf_dir), ["metric_key"], H, 3600, rolling.seasonal_mean(P), P)
    return out.select("metric_key", F.col("step").cast("long").alias("step"), epoch("time"), *(F.round(c, 6).alias(c) for c in ("predicted", "lower80", "upper80", "lower95", "upper95")))


@query(f"""WITH h AS {HOURS}, n AS (SELECT metric_key, max(bucket) AS last FROM h GROUP BY metric_key), a AS (SELECT metric_key, k AS step, last + to_hours(k::INT) AS time FROM n, range(1, 49) g(k)),
  u AS (SELECT metric_key, isodow(bucket) AS d, hour(bucket) AS hh, avg(value) AS v FROM h WHERE hour(bucket) <> 5 GROUP BY ALL), g AS (SELECT metric_key, avg(value) AS v FROM h WHERE hour(bucket) <> 5 GROUP BY ALL)
  SELECT a.metric_key, step, round(coalesce(u.v, g.v), 6) AS value FROM a LEFT JOIN u ON u.metric_key = a.metric_key AND d = isodow(time) AND hh = hour(time) JOIN g ON g.metric_key = a.metric_key""")
def future_covariates(spark, sf_dir: str) -> DataFrame:
    rows = rolling.numbered(hourly(spark, sf_dir), ["metric_key"])
    ahead = rolling.future(rows, ["metric_key"], 48, 3600)
    out = rolling.future_covariates(rows.where(F.hour("time") != 5).select("metric_key", "time", "value"), ahead, ["metric_key"], ["value"])
    return out.select("metric_key", F.col("step").cast("long").alias("step"), F.round("value", 6).alias("value"))


def feedback(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feedback on runs (orders) and on events of analyses, as line items."""
    items, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    line, order = F.col("l_linenumber").cast("long"), F.col("l_orderkey").cast("long")
    rows = items.select(
        (order * 10 + line).alias("feedback_id"), (order % 3).alias("organization_id"), F.when(line % 2 == 1, order).alias("run_id"), F.when(line >= 3, (order + 4) * 10 + line - 2).alias("realtime_event_id"),
        F.col("l_shipdate").cast("string").alias("occurred_at"), F.col("l_linestatus").alias("series_key"), F.col("l_returnflag").alias("verdict"),
    )
    events = items.select((order * 10 + line).alias("id"), F.col("l_suppkey").cast("long").alias("analysis_id"), (line % 3).alias("organization_id"))
    return rows, orders.select(F.col("o_orderkey").cast("long").alias("id"), (F.col("o_custkey") % 200).cast("long").alias("analysis_id")), events


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS feedback_id, l_orderkey % 3 AS org, CASE WHEN l_linenumber % 2 = 1 THEN l_orderkey END AS run_id, CASE WHEN l_linenumber >= 3 THEN (l_orderkey + 4) * 10 + l_linenumber - 2 END AS event_id,
    l_returnflag AS verdict FROM lineitem), e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS analysis_id, l_linenumber % 3 AS org FROM lineitem),
  a AS (SELECT DISTINCT analysis_id FROM (SELECT o_custkey % 200 AS analysis_id FROM orders UNION ALL SELECT analysis_id FROM e))
  SELECT a.analysis_id::BIGINT AS analysis_id, f.feedback_id::BIGINT AS feedback_id, verdict FROM f LEFT JOIN orders r ON r.o_orderkey = f.run_id, a
  WHERE r.o_custkey % 200 = a.analysis_id OR EXISTS (SELECT 1 FROM e WHERE e.id = f.event_id AND e.analysis_id = a.analysis_id AND e.org = f.org)""")
def feedback_labels(spark, sf_dir: str) -> DataFrame:
    return service.feedback_labels(*feedback(spark, sf_dir)).select("analysis_id", "feedback_id", "verdict")


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.cast("long").alias("id"), (F.col("o_custkey") % 20).cast("long").alias("organization_id"), F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("DONE").alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when(k % 7 != 0, k % 40).cast("int").alias("queue_position"),
    )


@query("""WITH q AS (SELECT o_orderkey AS id, o_custkey % 20 AS org, o_orderdate AS made, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 40 END AS queue_position FROM orders WHERE o_orderstatus = 'O'),
  p AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY made, id) AS pos FROM q) SELECT id::BIGINT AS id, org::BIGINT AS organization_id, pos::BIGINT AS queue_position FROM p WHERE queue_position IS DISTINCT FROM pos""")
def queue_renumbered(spark, sf_dir: str) -> DataFrame:
    out = service.renumbered(queue(spark, sf_dir), "organization_id", ["created_at", "id"])
    return out.select("id", "organization_id", F.col("queue_position").cast("long").alias("queue_position"))


@query("""WITH q AS (SELECT o_orderkey AS id, o_orderstatus, o_custkey % 20 AS org, o_orderdate AS made, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 40 END AS queue_position FROM orders)
  SELECT id::BIGINT AS id, CASE WHEN o_orderstatus = 'O' THEN row_number() OVER (PARTITION BY org, o_orderstatus ORDER BY made, id) ELSE queue_position END::BIGINT AS queue_position FROM q""")
def queue_after_update(spark, sf_dir: str) -> DataFrame:
    table = queue(spark, sf_dir)
    out = service.upsert(table, service.renumbered(table, "organization_id", ["created_at", "id"]), ["id"])
    return out.select("id", F.col("queue_position").cast("long").alias("queue_position"))


@query(f"""WITH s AS {SPACES}, d AS (SELECT c_custkey AS device_id, c_custkey AS space_id FROM customer UNION ALL SELECT 5000000 + n_nationkey, 2000000 + n_nationkey FROM nation),
  below AS (SELECT space_id AS top, device_id FROM d UNION ALL SELECT parent_id, device_id FROM d JOIN s ON s.id = d.space_id UNION ALL SELECT t.parent_id, device_id FROM d JOIN s ON s.id = d.space_id JOIN s t ON t.id = s.parent_id),
  b AS (SELECT n_nationkey AS binding_id, CASE WHEN n_nationkey % 4 = 1 THEN 'DEVICE_METRIC' WHEN n_nationkey % 4 = 3 THEN 'DERIVED_METRIC' ELSE 'SPACE_AGGREGATE' END AS kind,
    CASE WHEN n_nationkey % 4 = 1 OR n_nationkey % 4 = 0 THEN 77 + n_nationkey END AS device_id, CASE WHEN n_nationkey % 3 = 0 THEN 1000000 + n_regionkey ELSE 2000000 + n_nationkey END AS space_id FROM nation)
  SELECT binding_id::BIGINT AS binding_id, device_id::BIGINT AS device_id FROM b WHERE device_id IS NOT NULL AND kind <> 'SPACE_AGGREGATE'
  UNION ALL SELECT binding_id, below.device_id FROM b JOIN below ON b.space_id = below.top WHERE b.device_id IS NULL OR kind = 'SPACE_AGGREGATE'""")
def binding_devices(spark, sf_dir: str) -> DataFrame:
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    n = F.col("n_nationkey").cast("long")
    placed = customer.select(F.col("c_custkey").cast("long").alias("device_id"), F.col("c_custkey").cast("long").alias("space_id")).union(nation.select(5000000 + n, 2000000 + n))
    kind = F.when(n % 4 == 1, "DEVICE_METRIC").when(n % 4 == 3, "DERIVED_METRIC").otherwise("SPACE_AGGREGATE")
    sources = nation.select(
        n.alias("binding_id"), kind.alias("kind"), F.when((n % 4).isin(0, 1), 77 + n).alias("device_id"), F.when(n % 3 == 0, 1000000 + F.col("n_regionkey").cast("long")).otherwise(2000000 + n).alias("space_id")
    )
    return bindings.devices(sources, bindings.devices_below(spaces(spark, sf_dir), placed)).select("binding_id", "device_id")


#: Sensors of four spaces: (space, signal, ordinal, device, metric).
SENSORS = [(1, "pir", 0, 0, "click"), (1, "pir", 1, 1, "click"), (1, "co2", 2, 0, "view"), (1, "co2", 3, 1, "view"), (1, "noise", 4, 0, "error"), (2, "co2", 0, 1, "view"), (2, "noise", 1, 1, "error"), (2, "illuminance", 2, 0, "signup"),
           (3, "noise", 0, 0, "error"), (3, "co2", 1, 0, "nothing"), (4, "co2", 0, 0, "view"), (4, "illuminance", 1, 1, "signup"), (4, "door", 2, 1, "click")]


def _steps(minutes: int) -> str:
    return f"CASE WHEN step > 0 THEN greatest(1, round_even({minutes} / step, 0))::INT ELSE 1 END"


@query(f"""WITH rd AS (SELECT event_id % 2 AS device, event_type AS m, ts AS time, CASE event_type WHEN 'click' THEN (value > 40)::INT WHEN 'view' THEN 5 * value WHEN 'signup' THEN 10 * value ELSE value END::DOUBLE AS v FROM events
    WHERE event_id % 20 <> 0 AND event_id % 50 <> 7),
  se(space, signal, ord, device, m) AS (VALUES {", ".join(map(str, SENSORS))}),
  tk AS (SELECT space, bucket FROM (SELECT DISTINCT space FROM se), (SELECT TIMESTAMP '2024-01-12' - to_hours((2 * k)::INT) AS bucket FROM range(20) g(k)) WHERE NOT (space = 1 AND bucket = TIMESTAMP '2024-01-11')),
  met AS (SELECT space, bucket, signal, ord, device, time, v FROM tk JOIN se USING (space) JOIN rd USING (device, m) WHERE signal <> 'door' AND time <= bucket AND time >= bucket - INTERVAL 24 HOUR),
  best AS (SELECT space, bucket, signal, device FROM (SELECT space, bucket, signal, device, row_number() OVER (PARTITION BY space, bucket, signal ORDER BY count(*) DESC, ord) AS k FROM met GROUP BY space, bucket, signal, device, ord) WHERE k = 1),
  sg AS (SELECT met.* FROM met JOIN best USING (space, bucket, signal, device)),
  hv AS (SELECT space, bucket, list(DISTINCT signal) AS have, arg_min(signal, ord + CASE WHEN signal = 'pir' THEN 0 ELSE 100 END) AS base FROM sg GROUP BY space, bucket),
  ba AS (SELECT space, bucket, base, have, time, max(v) AS own, row_number() OVER (PARTITION BY space, bucket ORDER BY time) AS i, count(*) OVER (PARTITION BY space, bucket) AS n FROM sg JOIN hv USING (space, bucket)
    WHERE signal = base AND len(have) >= 2 GROUP BY space, bucket, base, have, time),
  st AS (SELECT space, bucket, coalesce(median(d), 60) AS step FROM (SELECT space, bucket, (epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY space, bucket ORDER BY time)) / 6e7 AS d FROM ba) GROUP BY space, bucket),
  nr AS (SELECT b.space, b.bucket, b.i, s.signal, s.v FROM ba b JOIN sg s ON b.space = s.space AND b.bucket = s.bucket AND s.signal <> b.base AND abs(epoch_us(s.time) - epoch_us(b.time)) <= 900000000
    QUALIFY row_number() OVER (PARTITION BY b.space, b.bucket, b.i, s.signal ORDER BY abs(epoch_us(s.time) - epoch_us(b.time)), s.time DESC) = 1),
  al AS (SELECT b.*, CASE WHEN base = 'pir' THEN own END AS pir, CASE WHEN base = 'co2' THEN own ELSE c.v END AS c0, CASE WHEN base = 'noise' THEN own ELSE o.v END AS noise, CASE WHEN base = 'illuminance' THEN own ELSE l.v END AS lux FROM ba b
    LEFT JOIN nr c ON c.space = b.space AND c.bucket = b.bucket AND c.i = b.i AND c.signal = 'co2' LEFT JOIN nr o ON o.space = b.space AND o.bucket = b.bucket AND o.i = b.i AND o.signal = 'noise'
    LEFT JOIN nr l ON l.space = b.space AND l.bucket = b.bucket AND l.i = b.i AND l.signal = 'illuminance'),
  ip AS (SELECT *, last_value(CASE WHEN c0 IS NOT NULL THEN i END IGNORE NULLS) OVER u AS bi, last_value(c0 IGNORE NULLS) OVER u AS bv, first_value(CASE WHEN c0 IS NOT NULL THEN i END IGNORE NULLS) OVER v AS ai, first_value(c0 IGNORE NULLS) OVER v AS av FROM al
    WINDOW u AS (PARTITION BY space, bucket ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY space, bucket ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  fi AS (SELECT *, coalesce(c0, bv + (av - bv) * (i - bi) / (ai - bi), bv, av) AS co2, {_steps(5)} AS w5, {_steps(10)} AS w10 FROM ip JOIN st USING (space, bucket)),
  fa AS (SELECT space, bucket, any_value(have) AS have, any_value(step) AS step, any_value(w10) AS w10, count(*) FILTER (WHERE i > n - (w5 - (w5 - 1) // 2) AND pir > 0) AS active, max(co2) FILTER (WHERE i = n) AS co2, max(co2) FILTER (WHERE i = n - w10) AS co2b,
    quantile_cont(co2, 0.05) AS c5, max(noise) FILTER (WHERE i = n) AS noise, quantile_cont(noise, 0.1) AS n10, max(lux) FILTER (WHERE i = n) AS lux, quantile_cont(lux, 0.1) AS l10 FROM fi GROUP BY space, bucket),
  sc AS (SELECT space, bucket, (CASE WHEN list_contains(have, 'pir') AND active >= 2 THEN 2 ELSE 0 END + CASE WHEN list_contains(have, 'co2') AND (coalesce((co2 - co2b) / (w10 * step) > 3, false) OR coalesce(co2 > c5 + 250, false))
      THEN CASE WHEN list_contains(have, 'pir') THEN 1 ELSE 2 END ELSE 0 END + CASE WHEN list_contains(have, 'noise') AND coalesce(noise > n10 + 8, false) THEN 1 ELSE 0 END + CASE WHEN list_contains(have, 'illuminance') AND coalesce(lux > l10 + 100, false) THEN 1 ELSE 0 END)
    / (CASE WHEN list_contains(have, 'pir') THEN 3 - CASE WHEN list_contains(have, 'co2') THEN 0 ELSE 1 END ELSE CASE WHEN list_contains(have, 'co2') THEN 2 ELSE 0 END END + CASE WHEN list_contains(have, 'noise') THEN 1 ELSE 0 END
      + CASE WHEN list_contains(have, 'illuminance') THEN 1 ELSE 0 END)::DOUBLE AS score FROM fa)
  SELECT tk.space::BIGINT AS space_id, epoch_us(tk.bucket) // 1000000 AS bucket, CASE WHEN score IS NULL THEN 'INPUT_MISSING' ELSE 'OK' END AS status, (score >= 0.5)::INT::DOUBLE AS value,
    CASE WHEN score IS NULL THEN array_to_string(list_sort((SELECT list(DISTINCT signal) FROM se WHERE se.space = tk.space AND signal <> 'door' AND NOT list_contains(coalesce(hv.have, []), signal))), ',') END AS missing
  FROM tk LEFT JOIN sc USING (space, bucket) LEFT JOIN hv USING (space, bucket)""")
def occupancy_ticks(spark, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, v = F.col("event_type"), F.col("value")
    value = F.when(kind == "click", (v > 40).cast("double")).when(kind == "view", 5 * v).when(kind == "signup", 10 * v).otherwise(v)
    readings = raw.select((F.col("event_id") % 2).alias("device_id"), kind.alias("metric_key"), F.col("ts").cast("timestamp").alias("time"), value.alias("value"), F.when(F.col("event_id") % 20 == 0, 1).otherwise(0).alias("quality"), (F.col("event_id") % 50 == 7).alias("is_virtual"))
    sensors = spark.createDataFrame([(0, *s) for s in SENSORS], "organization_id long, space_id long, signal string, ordinal int, device_id long, metric_key string")
    ledger = spark.createDataFrame([(0, 1, "2024-01-11")], "organization_id long, space_id long, b string").select("organization_id", "space_id", F.col("b").cast("timestamp").alias("bucket"))
    out = virtual.occupancy(virtual.open_ticks(sensors, ledger, "2024-01-12 00:02:11", 20, 7200), sensors, readings)
    return out.select("space_id", epoch("bucket"), "status", "value", F.array_join("missing", ",").alias("missing"))


#: (tariff, organisation, site, from, mode, flat rate), their bands, holidays (organisation, site, day) and factors.
TARIFFS = [(1, 0, None, "2023-01-01", "TOU", None), (2, 0, 1, "2024-01-10", "FLAT", 120.0), (3, 1, None, "2024-01-01", "FLAT", 95.5)]
TOU = [(1, 1, [1, 2, 12], "WEEKDAY", "09:00", "18:00", 160.0), (1, 2, [1, 2, 12], "WEEKDAY", "00:00", "24:00", 110.0), (1, 3, [1], "WEEKEND_HOLIDAY", "00:00", "12:30", 70.0)]
HOLIDAYS = [(0, 0, "2024-01-10")]
FACTORS = [(0, "2024-01-01", 0.45), (1, "2024-01-11", 0.4), (2, "2020-01-01", 0.5), (2, "2024-01-10", 0.6)]
#: Instants at which the job looks, and the day that was done before.
LOOKS = ["2024-01-09 20:00:00", "2024-01-10 20:00:00", "2024-01-11 16:30:00", "2024-01-11 17:00:00"]


def energy_config(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Sources (a user a device of one of ten spaces), samples (their events), running times, tariffs, holidays and factors."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    u = F.col("user_id")
    sources = events.select("user_id").distinct().select(
        (u % 3).alias("organization_id"), u.alias("source_id"), u.cast("int").alias("ordinal"), (u % 10).alias("space_id"), (u % 2).alias("site_id"), F.when(u % 2 == 0, "Asia/Seoul").otherwise("Asia/Kolkata").alias("timezone"),
        u.alias("device_id"), F.lit("power").alias("metric_key"), F.when(u % 5 == 4, "ESTIMATED").otherwise("METERED").alias("kind"), (u % 5 == 3).alias("cumulative"),
        F.when(u % 25 != 4, 1000.0 + u).alias("rated_w"), F.when(u % 2 == 0, F.lit(5.0)).alias("standby_w"),
    )
    readings = events.select(u.alias("device_id"), F.lit("power").alias("metric_key"), F.col("ts").cast("timestamp").alias("time"), "value", F.when(F.col("event_id") % 20 == 0, 1).otherwise(0).alias("quality"))
    organizations = spark.createDataFrame([(0, "Asia/Seoul"), (1, "Asia/Seoul"), (2, "Asia/Seoul")], "organization_id long, timezone string")
    ledger = spark.createDataFrame([(1, "2024-01-10")], "organization_id long, day string").withColumn("day", F.to_date("day"))
    tasks = daily.due(organizations, ledger, LOOKS[0])
    for now in LOOKS[1:]:
        tasks = tasks.union(daily.due(organizations, ledger, now))
    tasks = tasks.distinct()
    running = sources.where("kind = 'ESTIMATED' AND source_id % 4 <> 1").join(tasks, "organization_id").select("organization_id", "day", "device_id", (F.col("device_id") * 500).alias("on_seconds"))
    dated = {"valid_from": F.to_date("valid_from")}
    return {
        "tasks": tasks, "sources": sources, "readings": readings, "running": running, "known": tasks.where("organization_id <> 2"),
        "tariffs": spark.createDataFrame(TARIFFS, "tariff_id int, organization_id long, site_id long, valid_from string, mode string, flat_rate double").withColumns(dated),
        "bands": spark.createDataFrame(TOU, "tariff_id int, ordinal int, months array<int>, day_type string, from_time string, to_time string, rate double"),
        "holidays": spark.createDataFrame(HOLIDAYS, "organization_id long, site_id long, day string").withColumn("day", F.to_date("day")),
        "factors": spark.createDataFrame(FACTORS, "organization_id long, valid_from string, factor double").withColumns(dated),
    }


@query("""WITH src AS (SELECT DISTINCT user_id AS u, user_id % 3 AS org, user_id % 10 AS space, user_id % 2 AS site, CASE WHEN user_id % 2 = 0 THEN 540 ELSE 330 END AS off, CASE WHEN user_id % 5 = 4 THEN 'ESTIMATED' ELSE 'METERED' END AS kind,
    user_id % 5 = 3 AS cum, CASE WHEN user_id % 25 <> 4 THEN 1000.0::DOUBLE + user_id END AS rated, CASE WHEN user_id % 2 = 0 THEN 5.0::DOUBLE ELSE 0 END AS standby FROM events),
  tk(org, day) AS (VALUES (0, DATE '2024-01-09'), (1, DATE '2024-01-09'), (2, DATE '2024-01-09'), (0, DATE '2024-01-10'), (2, DATE '2024-01-10'), (0, DATE '2024-01-11'), (1, DATE '2024-01-11'), (2, DATE '2024-01-11')),
  b AS (SELECT src.*, day, epoch_us(day::TIMESTAMP) - off * 60000000::BIGINT AS ds, epoch_us(day::TIMESTAMP) - off * 60000000::BIGINT + 86400000000 AS de FROM src JOIN tk USING (org)),
  r AS (SELECT user_id AS u, epoch_us(ts) AS t, value AS v FROM events WHERE event_id % 20 <> 0 AND value IS NOT NULL),
  x AS (SELECT u, day, t, v, CASE WHEN t < ds THEN -1 WHEN t >= de THEN 1 ELSE 0 END AS side FROM b JOIN r USING (u) WHERE kind = 'METERED' AND t >= ds - 86400000000 AND t < de + 86400000000),
  y AS (SELECT * FROM x QUALIFY side = 0 OR (side < 0 AND t = max(t) OVER (PARTITION BY u, day, side)) OR (side > 0 AND t = min(t) OVER (PARTITION BY u, day, side))),
  i AS (SELECT u, day, t AS s, lead(t) OVER w AS e, v, lead(v) OVER w AS nv FROM y WINDOW w AS (PARTITION BY u, day ORDER BY t)),
  c AS (SELECT b.u, b.org, b.day, b.space, b.kind, b.off, ds, CASE WHEN cum THEN greatest(nv - v, 0) ELSE (v + nv) / 2 / 1000 * (e - s) / 3.6e9 END AS kwh, (e - s) > 900000000 AS est, greatest(s, ds) - ds AS f, least(e, de) - ds AS g, e - s AS span
    FROM i JOIN b USING (u, day) WHERE e > s AND greatest(s, ds) < least(e, de)),
  m AS (SELECT org, day, space, kind, ds + h * 3600000000 AS hr, kwh * (least(g, (h + 1) * 3600000000) - greatest(f, h * 3600000000)) / span AS kwh, est FROM (SELECT *, unnest(range(f // 3600000000, (g - 1) // 3600000000 + 1)) AS h FROM c)),
  es AS (SELECT org, day, space, kind, ds, (rated * least(on_s, 86400) + standby * (86400 - least(on_s, 86400))) / 3.6e6 / 24 AS kwh FROM (SELECT *, CASE WHEN u % 4 <> 1 THEN u * 500 ELSE 0 END AS on_s FROM b) WHERE kind = 'ESTIMATED' AND rated > 0 AND org <> 2),
  h AS (SELECT org, day, space, kind, hr, sum(kwh) AS kwh, bool_or(est) AS est FROM (SELECT org, day, space, kind, hr, kwh, est FROM m UNION ALL SELECT org, day, space, kind, ds + k * 3600000000, kwh, true FROM es, range(24) g(k)) GROUP BY ALL),
  sp AS (SELECT org, day, space, kind, arg_min(site, u) AS site, arg_min(off, u) AS off FROM b WHERE kind = 'METERED' OR (rated > 0 AND org <> 2) GROUP BY ALL),
  l AS (SELECT h.*, site, make_timestamp(hr + off * 60000000::BIGINT) AS lt FROM h JOIN sp USING (org, day, space, kind)),
  p AS (SELECT *, CASE WHEN org = 1 THEN 95.5 WHEN org = 0 AND site = 1 AND lt::DATE >= DATE '2024-01-10' THEN 120.0 WHEN org = 0 AND month(lt) IN (1, 2, 12) THEN
      CASE WHEN isodow(lt) >= 6 OR (site = 0 AND lt::DATE = DATE '2024-01-10') THEN CASE WHEN month(lt) = 1 AND hour(lt) * 60 + minute(lt) < 750 THEN 70.0 END WHEN hour(lt) >= 9 AND hour(lt) < 18 THEN 160.0 ELSE 110.0 END END AS rate FROM l)
  SELECT sp.org::BIGINT AS organization_id, strftime(sp.day, '%Y-%m-%d') AS day, sp.space::BIGINT AS space_id, sp.kind AS source_kind, round(coalesce(k.kwh, 0), 6) AS kwh, round(k.krw, 2)::DOUBLE AS krw,
    round(coalesce(k.kwh, 0) / 1000 * CASE WHEN sp.org = 0 THEN 0.45 WHEN sp.org = 1 AND sp.day >= DATE '2024-01-11' THEN 0.4 WHEN sp.org = 2 AND sp.day >= DATE '2024-01-10' THEN 0.6 WHEN sp.org = 2 THEN 0.5 END, 9) AS tco2, coalesce(k.est, false) AS includes_estimate
  FROM sp LEFT JOIN (SELECT org, day, space, kind, sum(kwh) AS kwh, sum(kwh * rate) AS krw, bool_or(est) AS est FROM p GROUP BY ALL) k USING (org, day, space, kind)""")
def energy_daily_rows(spark, sf_dir: str) -> DataFrame:
    out = daily.energy_rows(**energy_config(spark, sf_dir))
    return out.select("organization_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "space_id", "source_kind", F.round("kwh", 6).alias("kwh"), F.round("krw", 2).alias("krw"), F.round("tco2", 9).alias("tco2"), "includes_estimate")
