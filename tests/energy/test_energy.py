"""Closed-form cases of energy accounting and roll-up."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthlake.functions import numbers, times
from hearthlake.operators import energy, tree

T0 = datetime(2026, 8, 3)


def samples(spark, points):
    return spark.createDataFrame([("d", T0 + timedelta(minutes=m), float(v)) for m, v in points], "k string, time timestamp, value double")


def one(df):
    return df.first()


def test_power_by_trapezoids(spark):
    def kwh(points):
        return one(energy.total(energy.integrate_power(samples(spark, points), ["k"]), ["k"]))

    flat = kwh([(m, 1000) for m in range(61)])
    assert flat.kwh == pytest.approx(1.0) and not flat.estimated
    assert kwh([(m, 20 * m) for m in range(61)]).kwh == pytest.approx(0.6)
    gap = kwh([(0, 600), (20, 600)])
    assert gap.kwh == pytest.approx(0.2) and gap.estimated
    assert not kwh([(0, 600), (15, 600)]).estimated, "15 minutes are not a gap yet"


def test_counter_that_is_reset(spark):
    rows = samples(spark, [(0, 100), (10, 100.5), (20, 0.2), (30, 0.7)])
    assert one(energy.total(energy.difference_counter(rows, ["k"]), ["k"])).kwh == pytest.approx(1.0)


def test_split_by_hours(spark):
    parts = [(-30, 30, 1.0, False), (50, 130, 4.0, True)]
    rows = spark.createDataFrame([("d", T0 + timedelta(minutes=a), T0 + timedelta(minutes=b), k, e) for a, b, k, e in parts], "k string, start timestamp, end timestamp, kwh double, estimated boolean")
    got = {r.hour: (round(r.kwh, 9), r.estimated) for r in energy.hourly(rows, ["k"]).collect()}
    assert got == {T0 - timedelta(hours=1): (0.5, False), T0: (1.0, True), T0 + timedelta(hours=1): (3.0, True), T0 + timedelta(hours=2): (0.5, True)}


def test_rated_and_standby(spark):
    kwh = energy.rated_usage(F.lit(1200.0), F.lit(5.0), F.lit(8 * 3600.0), F.lit(24 * 3600.0))
    assert one(spark.range(1).select(kwh.alias("x"))).x == pytest.approx(9.68)


def test_running_time_counts_overlaps_once(spark):
    rows = spark.createDataFrame([("d", T0 + timedelta(minutes=a), T0 + timedelta(minutes=b)) for a, b in [(-10, 10), (5, 20), (20, 25), (50, 90)]], "k string, start timestamp, end timestamp")
    got = one(energy.running_seconds(rows, ["k"], F.lit(T0), F.lit(T0 + timedelta(hours=1))))
    assert got.on_seconds == 35 * 60


def test_site_version_comes_before_a_newer_general_one(spark):
    from hearthlake.operators.joins import valid_on

    versions = spark.createDataFrame([(None, "2026-01-01", 150.0), (1, "2025-01-01", 120.0), (None, "2026-08-01", 160.0)], "site long, valid_from string, rate double").withColumn("valid_from", F.to_date("valid_from"))
    facts = spark.createDataFrame([(1, "2026-08-02"), (2, "2026-08-02"), (2, "2026-07-31"), (2, "2020-01-01")], "s long, day string").withColumn("day", F.to_date("day"))
    got = {(r.s, str(r.day)): r.rate for r in valid_on(facts, versions, "day", "s", ["rate"]).collect()}
    assert got == {(1, "2026-08-02"): 120.0, (2, "2026-08-02"): 160.0, (2, "2026-07-31"): 150.0, (2, "2020-01-01"): None}


def test_carbon_and_degree_days(spark):
    usage = spark.createDataFrame([(1, "2026-08-02", 6000.0)], "site_id long, day string, kwh double").withColumn("day", F.to_date("day"))
    factors = spark.createDataFrame([(None, "2020-01-01", 0.4567)], "site long, valid_from string, factor double").withColumn("valid_from", F.to_date("valid_from"))
    assert one(energy.carbon(usage, factors, ["site_id"])).tco2 == 2.74
    t = spark.createDataFrame([(28.0,), (10.5,), (None,)], "t double").select(numbers.cooling_degrees(F.col("t")).alias("c"), numbers.heating_degrees(F.col("t")).alias("h")).collect()
    assert [(r.c, r.h) for r in t] == [(4.0, 0.0), (0.0, 7.5), (None, None)]


def test_time_of_use(spark):
    hours = spark.createDataFrame([(1, T0 + timedelta(hours=h), 10.0) for h in (0, 1, 12, 24 * 5)], "tariff_id int, hour timestamp, kwh double")
    bands = spark.createDataFrame([(1, 1, [8], "WEEKDAY", "09:00", "10:00", 100.0), (1, 2, [8], "ALL", "09:00", "24:00", 200.0)], "tariff_id int, ordinal int, months array<int>, day_type string, from_time string, to_time string, rate double")
    got = sorted((r.hour, r.rate) for r in energy.time_of_use_rate(hours, bands).collect())
    assert [r for _, r in got] == [100.0, 200.0, 200.0, 200.0], "09:00, 10:00 and 21:00 on Monday, 09:00 on Saturday in local time"
    assert one(energy.cost(energy.time_of_use_rate(hours, bands), ["tariff_id"])).krw == 7000.0


SPACES = "id long, parent_id long, covers_descendants boolean, area_m2 double"


def test_roll_up(spark):
    spaces = spark.createDataFrame([(1, None, False, None), (2, 1, False, 10.0), (3, 1, True, None), (4, 3, False, 20.0), (5, 3, False, 0.0), (8, 8, False, 5.0), (9, 77, False, None), (20, 21, False, 1.0), (21, 20, False, 1.0)], SPACES)
    facts = spark.createDataFrame([(2, "d", 100.0), (4, "d", 200.0), (5, "d", 300.0), (3, "e", 650.0), (4, "e", 600.0), (9, "d", 7.0), (20, "d", 1.0)], "id long, day string, kwh double")
    got = {(r.id, r.day): (r.kwh, r.children_kwh, r.other_kwh) for r in tree.roll_up(spaces, facts, ["kwh"], ["day"]).collect()}
    assert got[1, "d"] == (600.0, 600.0, 0.0) and got[3, "d"] == (500.0, 500.0, 0.0)
    assert got[3, "e"] == (650.0, 600.0, 50.0) and got[1, "e"] == (650.0, 650.0, 0.0)
    assert got[9, "d"] == (7.0, None, None) and (20, "d") not in got, "a cycle has no root"
    areas = {r.id: r.area for r in tree.areas(spaces).collect()}
    assert areas[1] == 30.0 and areas[3] == 20.0 and areas[8] == 5.0 and areas[9] is None


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 11), st.booleans(), st.one_of(st.none(), st.integers(0, 50))), min_size=1, max_size=12))
def test_roll_up_of_any_forest(spark, nodes):
    """Each space: parent (a smaller number, or none), whether it covers, its own value."""
    rows = [(i, p if p < i else None, c, None) for i, (p, c, _) in enumerate(nodes)]
    own = {i: float(v) for i, (_, _, v) in enumerate(nodes) if v is not None}
    spaces = spark.createDataFrame(rows, SPACES)
    facts = spark.createDataFrame([(i, "d", v) for i, v in own.items()] or [(-1, "d", 0.0)], "id long, day string, kwh double")
    got = {r.id: r.kwh for r in tree.roll_up(spaces, facts, ["kwh"], ["day"]).collect()}

    def value(i):
        below = [value(j) for j, p, _, _ in rows if p == i]
        below = [b for b in below if b is not None]
        if rows[i][2] and i in own:
            return own[i]
        return own.get(i, 0.0) + sum(below) if i in own or below else None

    for i in range(len(rows)):
        assert got.get(i) == value(i)


def test_regression_recovers_coefficients(spark):
    rows = [("s", 50 + 8.0 * (d % 7) + 3.0 * (d % 5), float(d % 7), float(d % 5)) for d in range(60)]
    days = spark.createDataFrame(rows, "s string, kwh double, cdd_days double, hdd_days double")
    fit = one(energy.degree_day_baseline(days, ["s"]))
    assert (fit.intercept, fit.cdd, fit.hdd, fit.r2) == (pytest.approx(50), pytest.approx(8), pytest.approx(3), 1.0)
    only = one(energy.degree_day_baseline(days.withColumns({"hdd_days": F.lit(0.0), "kwh": 50 + 8 * F.col("cdd_days")}), ["s"]))
    assert (only.intercept, only.cdd, only.hdd) == (pytest.approx(50), pytest.approx(8), 0.0)
    assert energy.degree_day_baseline(days.limit(29), ["s"]).count() == 0


def test_source_priority(spark):
    rows = [(1, "2026-01-01", "ESTIMATED", 5.0, None, 0.0, True), (1, "2026-01-01", "METERED", 3.0, 9.0, 0.0, False), (1, "2026-01-01", "METERED", 4.0, None, 0.0, True), (2, "2026-01-01", "BILL_ALLOCATED", 1.0, 1.0, 0.0, False)]
    daily = spark.createDataFrame(rows, "space_id long, day string, source_kind string, kwh double, krw double, tco2 double, includes_estimate boolean")
    got = {r.space_id: (r.source_kind, r.kwh, r.krw, r.estimated_kwh) for r in energy.pick_source(daily).collect()}
    assert got == {1: ("METERED", 7.0, 9.0, 4.0), 2: ("BILL_ALLOCATED", 1.0, 1.0, 0.0)}


def test_calendar(spark):
    row = spark.sql("SELECT DATE '2024-02-29' AS d, TIMESTAMP '2026-08-02 15:00:00' AS t").select(
        times.last_year(F.col("d")).alias("y"), times.date_bin(F.col("t"), "1d").alias("b"), times.local_midnight(F.lit("2026-08-03").cast("date")).alias("m"), times.minutes_of(F.lit("24:00")).alias("x")
    ).first()
    assert str(row.y) == "2023-02-28" and row.b == row.m == datetime(2026, 8, 2, 15) and row.x == 1440
