"""Queries on energy: usage from samples, cost, carbon, roll-up, comparison, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.functions.times import last_year
from hearthlake.operators import energy, tree
from hearthlake.operators.joins import valid_on
from hearthlake.plans.catalog import query
from hearthlake.plans.telemetry_queries import SERIES, normal

KINDS = {"METERED": ["1-URGENT", "2-HIGH"], "ESTIMATED": ["3-MEDIUM"], "BILL_ALLOCATED": ["4-NOT SPECIFIED", "5-LOW"]}

#: orders as daily energy of the space of each customer.
DAILY = """(SELECT o_custkey AS space_id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'METERED' WHEN o_orderpriority = '3-MEDIUM' THEN 'ESTIMATED'
  ELSE 'BILL_ALLOCATED' END AS source_kind, o_totalprice / 1000 AS kwh, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 10 END AS krw, o_totalprice / 2000000 AS tco2, o_orderstatus = 'O' AS includes_estimate FROM orders)"""
#: The best source of each space and day.
PICKED = f"""(WITH s AS (SELECT space_id, day, source_kind, sum(kwh) AS kwh, sum(krw) AS krw, sum(tco2) AS tco2, sum(CASE WHEN includes_estimate THEN kwh ELSE 0 END) AS estimated_kwh FROM {DAILY} GROUP BY ALL)
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY space_id, day ORDER BY CASE source_kind WHEN 'METERED' THEN 1 WHEN 'ESTIMATED' THEN 2 ELSE 3 END) AS n FROM s) WHERE n = 1)"""
#: region > nation > customer as a forest of spaces.
SPACES = """(SELECT 1000000 + r_regionkey AS id, NULL::BIGINT AS parent_id, false AS covers, NULL::DOUBLE AS area FROM region
  UNION ALL SELECT 2000000 + n_nationkey, 1000000 + n_regionkey, n_nationkey % 5 = 0, CASE WHEN n_nationkey % 2 = 0 THEN 500.0 + n_nationkey END FROM nation
  UNION ALL SELECT c_custkey, 2000000 + c_nationkey, false, CASE WHEN c_custkey % 3 <> 0 THEN 20.0 + c_custkey % 50 END FROM customer)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    kind = F.when(p.isin(KINDS["METERED"]), "METERED").when(p.isin(KINDS["ESTIMATED"]), "ESTIMATED").otherwise("BILL_ALLOCATED")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("space_id"), F.to_date("o_orderdate").alias("day"), kind.alias("source_kind"), (F.col("o_totalprice") / 1000).alias("kwh"),
        F.when(s != "P", F.col("o_totalprice") / 10).alias("krw"), (F.col("o_totalprice") / 2000000).alias("tco2"), (s == "O").alias("includes_estimate"),
    )


def spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    n, c = F.col("n_nationkey").cast("long"), F.col("c_custkey")
    site = read("region").selectExpr("1000000L + r_regionkey AS id", "CAST(NULL AS BIGINT) AS parent_id", "false AS covers_descendants", "CAST(NULL AS DOUBLE) AS area_m2")
    block = read("nation").select((2000000 + n).alias("id"), (1000000 + F.col("n_regionkey").cast("long")).alias("parent_id"), (n % 5 == 0).alias("covers_descendants"), F.when(n % 2 == 0, 500.0 + n).alias("area_m2"))
    room = read("customer").select(c.alias("id"), (2000000 + F.col("c_nationkey").cast("long")).alias("parent_id"), F.lit(False).alias("covers_descendants"), F.when(c % 3 != 0, 20.0 + c % 50).alias("area_m2"))
    return site.union(block).union(room)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly kWh of rooms, and of some nations' own meters, for 1997."""
    picked = energy.pick_source(daily(spark, sf_dir)).where("day >= DATE '1997-01-01' AND day < DATE '1998-01-01'")
    month = F.date_format("day", "yyyy-MM").alias("month")
    room = picked.select(F.col("space_id").alias("id"), month, "kwh")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select((2000000 + F.col("n_nationkey").cast("long")).alias("id"))
    own = nation.where("id % 5 = 0").withColumn("month", F.explode(F.array(*[F.lit(f"1997-{m:02d}") for m in range(1, 7)]))).withColumn("kwh", F.lit(5000.0))
    return room.unionByName(own.select("id", "month", "kwh"))


FACTS = f"""(SELECT space_id AS id, strftime(day, '%Y-%m') AS month, sum(kwh) AS kwh FROM {PICKED} WHERE day >= DATE '1997-01-01' AND day < DATE '1998-01-01' GROUP BY ALL
  UNION ALL SELECT 2000000 + n_nationkey, '1997-0' || m, 5000.0 FROM nation, range(1, 7) g(m) WHERE n_nationkey % 5 = 0)"""
#: Roll-up by levels: room, nation (a covering one with its own meter stands for its rooms), region.
ROLLED = f"""(WITH f AS {FACTS}, s AS {SPACES},
  room AS (SELECT f.id, parent_id, month, kwh FROM f JOIN s USING (id) WHERE f.id < 1000000),
  own AS (SELECT id, month, kwh FROM f WHERE id >= 2000000),
  below AS (SELECT parent_id AS id, month, sum(kwh) AS kwh FROM room GROUP BY ALL),
  nation_value AS (SELECT coalesce(o.id, b.id) AS id, coalesce(o.month, b.month) AS month, CASE WHEN o.kwh IS NOT NULL THEN o.kwh ELSE b.kwh END AS kwh, b.kwh AS children FROM own o FULL JOIN below b ON o.id = b.id AND o.month = b.month),
  region_value AS (SELECT s.parent_id AS id, month, sum(kwh) AS kwh FROM nation_value JOIN s USING (id) GROUP BY ALL)
  SELECT id, month, kwh, NULL::DOUBLE AS children FROM room UNION ALL SELECT id, month, kwh, children FROM nation_value UNION ALL SELECT id, month, kwh, kwh FROM region_value)"""


@query(f"SELECT id, month, round(kwh, 6) AS kwh, round(children, 6) AS children_kwh, round(kwh - children, 6) + 0.0 AS other_kwh FROM {ROLLED}")
def tree_rollup(spark, sf_dir: str) -> DataFrame:
    out = tree.roll_up(spaces(spark, sf_dir), facts(spark, sf_dir), ["kwh"], ["month"])
    return out.select("id", "month", *[(F.round(c, 6) + 0.0).alias(c) for c in ("kwh", "children_kwh", "other_kwh")])


@query(f"SELECT month, round(sum(kwh), 6) AS kwh FROM {ROLLED} WHERE id BETWEEN 1000000 AND 1999999 GROUP BY month")
def portfolio(spark, sf_dir: str) -> DataFrame:
    all_spaces = spaces(spark, sf_dir)
    out = tree.portfolio(tree.roll_up(all_spaces, facts(spark, sf_dir), ["kwh"], ["month"]), all_spaces, ["kwh"], ["month"])
    return out.select("month", F.round("kwh", 6).alias("kwh"))


@query(f"""WITH s AS {SPACES}, n AS (SELECT p.id, p.parent_id, coalesce(p.area, sum(c.area)) AS area FROM s p LEFT JOIN s c ON c.parent_id = p.id WHERE p.id >= 2000000 GROUP BY p.id, p.parent_id, p.area)
  SELECT id, area FROM s WHERE id < 1000000 UNION ALL SELECT id, area FROM n UNION ALL SELECT parent_id, sum(area) FROM n GROUP BY parent_id""")
def area_rollup(spark, sf_dir: str) -> DataFrame:
    return tree.areas(spaces(spark, sf_dir))


@query(f"SELECT space_id, strftime(day, '%Y-%m-%d') AS day, source_kind, round(kwh, 6) AS kwh, round(krw, 4) AS krw, round(least(1, greatest(0, CASE WHEN kwh > 0 THEN estimated_kwh / kwh END)), 6) AS estimated_ratio FROM {PICKED}")
def source_priority(spark, sf_dir: str) -> DataFrame:
    out = energy.pick_source(daily(spark, sf_dir))
    ratio = energy.estimated_ratio(F.col("estimated_kwh"), F.col("kwh"))
    return out.select("space_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "source_kind", F.round("kwh", 6).alias("kwh"), F.round("krw", 4).alias("krw"), F.round(ratio, 6).alias("estimated_ratio"))


STEPS = "(SELECT device_id, metric_key, time AS a, lead(time) OVER w AS b, value AS u, lead(value) OVER w AS v FROM {N} WINDOW w AS (PARTITION BY device_id, metric_key ORDER BY time))"
TRAPEZOID = f"(SELECT device_id, metric_key, a, b, (u + v) / 2 / 1000 * (epoch_us(b) - epoch_us(a)) / 3.6e9 AS kwh, epoch_us(b) - epoch_us(a) > 900000000 AS est FROM {STEPS} WHERE b > a)"


@query(f"SELECT device_id, metric_key, round(sum(kwh), 6) AS kwh, bool_or(est) AS estimated FROM {TRAPEZOID} GROUP BY ALL")
def power_trapezoid(spark, sf_dir: str) -> DataFrame:
    return energy.total(energy.integrate_power(normal(spark, sf_dir), SERIES), SERIES).withColumn("kwh", F.round("kwh", 6))


@query(f"SELECT device_id, metric_key, round(sum(greatest(v - u, 0)), 6) AS kwh, bool_or(epoch_us(b) - epoch_us(a) > 900000000) AS estimated FROM {STEPS} WHERE b > a GROUP BY ALL")
def cumulative_difference(spark, sf_dir: str) -> DataFrame:
    return energy.total(energy.difference_counter(normal(spark, sf_dir), SERIES), SERIES).withColumn("kwh", F.round("kwh", 6))


HOURLY = f"""(WITH i AS (SELECT *, epoch_us(a) AS s, epoch_us(b) AS e FROM {TRAPEZOID}),
  x AS (SELECT *, unnest(range(s // 3600000000, (e - 1) // 3600000000 + 1)) AS h FROM i)
  SELECT device_id, metric_key, h, sum(kwh * (least(e, (h + 1) * 3600000000) - greatest(s, h * 3600000000)) / (e - s)) AS kwh, bool_or(est) AS estimated FROM x GROUP BY ALL)"""


def hours(spark, sf_dir: str) -> DataFrame:
    return energy.hourly(energy.integrate_power(normal(spark, sf_dir).where("device_id < 20"), SERIES), SERIES)


@query(f"SELECT device_id, metric_key, h * 3600 AS hour, round(kwh, 6) AS kwh, estimated FROM {HOURLY} WHERE device_id < 20")
def hourly_split(spark, sf_dir: str) -> DataFrame:
    return hours(spark, sf_dir).withColumns({"hour": F.unix_seconds("hour"), "kwh": F.round("kwh", 6)})


BANDS = [(1, 1, list(range(1, 13)), "WEEKEND", "00:00", "24:00", 80.0), (1, 2, [1, 2, 12], "WEEKDAY", "09:00", "18:00", 160.0), (1, 3, [1, 2, 12], "ALL", "18:00", "22:00", 130.0)]


@query(f"""WITH h AS (SELECT *, make_timestamp(h * 3600000000) + INTERVAL 9 HOUR AS t FROM {HOURLY} WHERE device_id < 20),
  r AS (SELECT *, CASE WHEN (dayofweek(t) + 6) % 7 >= 5 THEN 80.0 WHEN month(t) IN (1, 2, 12) AND hour(t) >= 9 AND hour(t) < 18 THEN 160.0 WHEN month(t) IN (1, 2, 12) AND hour(t) >= 18 AND hour(t) < 22 THEN 130.0 END AS rate FROM h)
  SELECT device_id, round(sum(kwh * rate), 4) AS krw, round(sum(CASE WHEN rate IS NULL THEN kwh ELSE 0 END), 6) AS unpriced_kwh, round(sum(kwh), 6) AS kwh FROM r GROUP BY device_id""")
def time_of_use_cost(spark, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame(BANDS, "tariff_id int, ordinal int, months array<int>, day_type string, from_time string, to_time string, rate double")
    priced = energy.time_of_use_rate(hours(spark, sf_dir).withColumn("tariff_id", F.lit(1)), bands)
    out = energy.cost(priced, ["device_id"])
    return out.select("device_id", F.round("krw", 4).alias("krw"), F.round("unpriced_kwh", 6).alias("unpriced_kwh"), F.round("kwh", 6).alias("kwh"))


VERSIONS = [(None, "1996-01-01", 0.45), (None, "1998-06-01", 0.43), (7, "1997-03-01", 0.2), (11, "1995-01-01", 0.9)]


@query(f"""WITH d AS (SELECT space_id, space_id % 20 AS site, day, kwh FROM {PICKED}),
  v(site, f, x) AS (VALUES (NULL, DATE '1996-01-01', 0.45), (NULL, DATE '1998-06-01', 0.43), (7, DATE '1997-03-01', 0.2), (11, DATE '1995-01-01', 0.9)),
  o AS (SELECT d.*, (SELECT arg_max(x, f) FROM v WHERE v.site = d.site AND f <= day) AS own, (SELECT arg_max(x, f) FROM v WHERE v.site IS NULL AND f <= day) AS gen FROM d)
  SELECT site, round(round(sum(kwh / 1000 * coalesce(own, gen)), 9), 2)::DOUBLE AS tco2 FROM o GROUP BY site""")
def carbon_by_site(spark, sf_dir: str) -> DataFrame:
    usage = energy.pick_source(daily(spark, sf_dir)).withColumn("site", F.col("space_id") % 20)
    versions = spark.createDataFrame(VERSIONS, "site long, valid_from string, factor double").withColumn("valid_from", F.to_date("valid_from"))
    return energy.carbon(usage, versions, ["site"], site="site")


@query(f"""WITH d AS (SELECT DISTINCT space_id % 20 AS site, day FROM {DAILY}), v(site, f, x) AS (VALUES (NULL, DATE '1996-01-01', 0.45), (NULL, DATE '1998-06-01', 0.43), (7, DATE '1997-03-01', 0.2), (11, DATE '1995-01-01', 0.9))
  SELECT site, strftime(day, '%Y-%m-%d') AS day, coalesce((SELECT arg_max(x, f) FROM v WHERE v.site = d.site AND f <= day), (SELECT arg_max(x, f) FROM v WHERE v.site IS NULL AND f <= day))::DOUBLE AS factor FROM d""")
def version_in_force(spark, sf_dir: str) -> DataFrame:
    days = daily(spark, sf_dir).select((F.col("space_id") % 20).alias("s"), "day").distinct()
    versions = spark.createDataFrame(VERSIONS, "site long, valid_from string, factor double").withColumn("valid_from", F.to_date("valid_from"))
    return valid_on(days, versions, "day", "s", ["factor"]).select(F.col("s").alias("site"), F.date_format("day", "yyyy-MM-dd").alias("day"), "factor")


@query(f"SELECT space_id % 20 AS site, strftime(day, '%Y-%m') AS month, round(sum(kwh), 6) AS kwh, round(sum(krw), 4) AS krw, round(sum(tco2), 10) AS tco2, round(least(1, greatest(0, sum(estimated_kwh) / sum(kwh))), 6) AS estimated_ratio FROM {PICKED} GROUP BY ALL")
def energy_metrics_month(spark, sf_dir: str) -> DataFrame:
    rows = energy.pick_source(daily(spark, sf_dir)).groupBy((F.col("space_id") % 20).alias("site"), F.date_format("day", "yyyy-MM").alias("month"))
    out = rows.agg(F.round(F.sum("kwh"), 6).alias("kwh"), F.round(F.sum("krw"), 4).alias("krw"), F.round(F.sum("tco2"), 10).alias("tco2"), F.sum("estimated_kwh").alias("e"), F.sum("kwh").alias("k"))
    return out.withColumn("estimated_ratio", F.round(energy.estimated_ratio(F.col("e"), F.col("k")), 6)).drop("e", "k")


@query(f"""WITH p AS (SELECT space_id % 20 AS site, kwh, day FROM {PICKED}), a AS (SELECT site, sum(kwh) AS now FROM p WHERE day >= DATE '1997-01-01' AND day < DATE '1998-01-01' GROUP BY site),
  b AS (SELECT site, sum(kwh) AS before FROM p WHERE day >= DATE '1996-01-01' AND day < DATE '1997-01-01' GROUP BY site)
  SELECT site, round(now, 6) AS now, round(before, 6) AS before, round(now - before, 6) AS diff, round((now - before) / before, 6) AS diff_ratio FROM a FULL JOIN b USING (site)""")
def compare_last_year(spark, sf_dir: str) -> DataFrame:
    rows = energy.pick_source(daily(spark, sf_dir)).withColumn("site", F.col("space_id") % 20)
    now = rows.where("day >= DATE '1997-01-01' AND day < DATE '1998-01-01'")
    before = rows.where((F.col("day") >= last_year(F.lit("1997-01-01").cast("date"))) & (F.col("day") < last_year(F.lit("1998-01-01").cast("date"))))
    return energy.compare(now, before, ["site"]).select("site", *[F.round(c, d).alias(c) for c, d in (("now", 6), ("before", 6), ("diff", 6), ("diff_ratio", 6))])


#: Daily kWh of each site with a temperature made of its date.
WEATHER = f"""(SELECT space_id % 20 AS site, day, sum(kwh) AS kwh, 14 + (month(day) - 1) * 2 - CASE WHEN month(day) > 7 THEN (month(day) - 7) * 4 ELSE 0 END + (day(day) % 5) AS temperature FROM {PICKED} WHERE day < DATE '1997-01-01' GROUP BY site, day)"""
DEGREES = f"(SELECT *, greatest(0, temperature - 24) AS c, greatest(0, 18 - temperature) AS h FROM {WEATHER})"


def weather(spark, sf_dir: str) -> DataFrame:
    rows = energy.pick_source(daily(spark, sf_dir)).where("day < DATE '1997-01-01'").groupBy((F.col("space_id") % 20).alias("site"), "day").agg(F.sum("kwh").alias("kwh"))
    m = F.month("day")
    t = (14 + (m - 1) * 2 - F.when(m > 7, (m - 7) * 4).otherwise(0) + F.dayofmonth("day") % 5).cast("double")
    return energy.degree_days(rows.withColumn("temperature", t)).withColumnsRenamed({"cdd": "cdd_days", "hdd": "hdd_days"})


@query(f"SELECT site, round(avg(kwh), 6) AS intercept, count(*) AS days FROM {WEATHER} GROUP BY site HAVING count(*) >= 30")
def baseline_period_average(spark, sf_dir: str) -> DataFrame:
    return energy.average_baseline(weather(spark, sf_dir), ["site"]).withColumn("intercept", F.round("intercept", 6))


FIT = f"""(SELECT *, cy0 AS cdd, hy0 AS hdd, my - cy0 * mc - hy0 * mh AS intercept, 1 - (yy - cy0 * cy - hy0 * hy) / yy AS r2 FROM (SELECT *, (cy * hh - hy * ch) / (cc * hh - ch * ch) AS cy0, (hy * cc - cy * ch) / (cc * hh - ch * ch) AS hy0 FROM
  (SELECT site, count(*) AS days, covar_pop(c, c) AS cc, covar_pop(h, h) AS hh, covar_pop(c, h) AS ch, covar_pop(c, kwh) AS cy, covar_pop(h, kwh) AS hy, covar_pop(kwh, kwh) AS yy, avg(c) AS mc, avg(h) AS mh, avg(kwh) AS my FROM {DEGREES} GROUP BY site)))"""


@query(f"SELECT site, round(intercept, 5) AS intercept, round(cdd, 5) AS cdd, round(hdd, 5) AS hdd, round(r2, 4) AS r2, days, round(r2, 4) < 0.5 AS low_fit FROM {FIT}")
def baseline_regression(spark, sf_dir: str) -> DataFrame:
    out = energy.degree_day_baseline(weather(spark, sf_dir), ["site"])
    return out.withColumns({c: F.round(c, 5) for c in ("intercept", "cdd", "hdd")})


@query(f"""WITH p AS (SELECT site, d.kwh, f.intercept + f.cdd * d.c + f.hdd * d.h AS predicted FROM {DEGREES} d JOIN {FIT} f USING (site) WHERE day >= DATE '1996-07-01')
  SELECT site, round(sum(kwh), 6) AS actual, round(sum(predicted), 4) AS predicted, round(CASE WHEN sum(predicted) > 0 THEN (sum(kwh) - sum(predicted)) / sum(predicted) END, 6) AS diff FROM p GROUP BY site""")
def baseline_compare(spark, sf_dir: str) -> DataFrame:
    days = weather(spark, sf_dir)
    rows = energy.predict_baseline(days.where("day >= DATE '1996-07-01'"), energy.degree_day_baseline(days, ["site"]).drop("days"), ["site"])
    out = rows.groupBy("site").agg(F.sum("kwh").alias("actual"), F.sum("predicted").alias("predicted"))
    diff = energy.normalized_difference(F.col("actual"), F.col("predicted"))
    return out.select("site", F.round("actual", 6).alias("actual"), F.round("predicted", 4).alias("predicted"), F.round(diff, 6).alias("diff"))


@query(f"""WITH u AS (SELECT device_id, sum(epoch_us(least(e, TIMESTAMP '2024-01-10')) - epoch_us(greatest(s, TIMESTAMP '2024-01-08'))) / 1e6 AS on_s FROM
    (WITH i AS (SELECT device_id, time AS s, time + INTERVAL 3 HOUR AS e FROM {{N}}), m AS (SELECT *, max(e) OVER (PARTITION BY device_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
     g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT device_id, min(s) AS s, max(e) AS e FROM g GROUP BY device_id, k)
    WHERE s < TIMESTAMP '2024-01-10' AND e > TIMESTAMP '2024-01-08' GROUP BY device_id)
  SELECT device_id, round(on_s, 6) AS on_seconds, round((1200.0 * on_s + 5.0 * (172800 - on_s)) / 3.6e6, 6) AS kwh FROM u""")
def estimated_usage(spark, sf_dir: str) -> DataFrame:
    runs = normal(spark, sf_dir).select("device_id", F.col("time").alias("start"), (F.col("time") + F.expr("INTERVAL 3 HOURS")).alias("end"))
    on = energy.running_seconds(runs, ["device_id"], F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-10").cast("timestamp"))
    kwh = energy.rated_usage(F.lit(1200.0), F.lit(5.0), F.col("on_seconds"), F.lit(172_800.0))
    return on.select("device_id", F.round("on_seconds", 6).alias("on_seconds"), F.round(kwh, 6).alias("kwh"))
