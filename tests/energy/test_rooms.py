"""Air changes, exact intervals of lines, reasons and bounds of local days."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlake.operators import energy, stats, ventilation
from hearthlake.operators.kernels import student_t
from hearthlake.sources import telemetry as tel

T0 = datetime(2024, 1, 9, 15)  # midnight of the 10th in Seoul


def test_student_quantiles():
    # fixed values: published quantiles at 97.5 %
    known = {1: 12.7062047364, 2: 4.3026527297, 5: 2.5705818356, 10: 2.2281388520, 30: 2.0422724563, 100: 1.9839715185}
    assert student_t(np.array(list(known))) == pytest.approx(list(known.values()), abs=1e-9)
    assert student_t(np.array([1e9]))[0] == pytest.approx(1.959963984540054, abs=1e-7)
    steps = student_t(np.array([998.0, 999.0, 1000.0, 1001.0]))  # both forms of the beta function meet here
    assert np.diff(steps) == pytest.approx(np.full(3, np.diff(steps).mean()), rel=0.02)
    assert np.isnan(student_t(np.array([0.0, np.nan]))).all()


def test_regression_equals_normal_equations(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(x), float(2 * x - 1 + rng.normal())) for g in range(3) for x in rng.uniform(0, 9, 12)]
    flat = [(7, 1.0, 2.0), (7, 1.0, 3.0), (7, 1.0, 4.0), (8, 1.0, 5.0), (8, 2.0, 5.0), (8, 3.0, 5.0), (9, 1.0, 2.0), (9, 2.0, 4.0), (9, None, 4.0), (9, 1.0, None)]
    got = {r.g: r for r in stats.bounded_line(spark.createDataFrame(rows + flat, "g int, x double, y double"), ["g"], "x", "y").collect()}
    for g in range(3):
        x, y = np.array([r[1:] for r in rows if r[0] == g]).T
        a = np.column_stack([np.ones_like(x), x])
        (c, m), rss = np.linalg.lstsq(a, y, rcond=None)[0], None
        rss = ((y - c - m * x) ** 2).sum()
        error = np.sqrt(rss / 10 * np.linalg.inv(a.T @ a)[1, 1])
        assert [got[g].slope, got[g].intercept, got[g].error] == pytest.approx([m, c, error])
        assert [got[g].low, got[g].high] == pytest.approx([m - 2.2281388520 * error, m + 2.2281388520 * error])
    assert got[7].slope is None and got[7].low is None
    assert (got[8].slope, got[8].r2) == (0, 0)
    assert got[9].n == 2 and got[9].slope == 2 and got[9].low is None


def decay(device, rate, start=T0, step=5, n=24, top=900.0, noise=0.0):
    return [(device, "co2", start + timedelta(minutes=step * i), 420 + top * float(np.exp(-rate * step * i / 60)) + noise * (-1) ** i) for i in range(n)]


def test_air_change_days(spark):
    samples = decay(1, 1.5, noise=30) + decay(2, 0.8) + decay(3, 2.0, n=4) + decay(4, 1.0, top=100.0) + decay(5, -0.1) + decay(6, 1.0) + decay(9, 1.1)
    rows = spark.createDataFrame(samples, "device_id long, metric_key string, time timestamp, value double")
    co2 = lambda *ids: [("other", [9]), ("co2", list(ids)), ("co2", [9])]
    sensors = spark.createDataFrame(
        [(10, "ACH", None, None, co2(1, 2)), (11, "ACH", True, None, co2(3, 4)), (12, "ACH", True, None, co2(5)), (13, "ACH", False, None, co2(6)), (14, "ACH", True, None, []), (15, "OCCUPANCY", True, None, co2(6)), (16, "ACH", True, None, co2(77)), (17, "ACH", True, None, co2(4, 3))],
        "space_id long, kind string, enabled boolean, output_device_id long, inputs array<struct<metric_key: string, device_ids: array<long>>>",
    )
    sizes = spark.createDataFrame([(10, 40.0, 2.5), (11, None, 2.5)], "space_id long, area_m2 double, height_m double")
    got = {(r.space_id, r.day): r for r in ventilation.air_change_days(rows, sensors, sizes, "2024-01-10", "2024-01-11").collect()}
    day = date(2024, 1, 10)
    assert {k[0] for k in got} == {10, 11, 12, 14, 16, 17} and len(got) == 12
    best = got[10, day]
    assert best.device_id == 2 and best.ach == 0.8 and best.r2 == 1 and best.ci_low <= 0.8 <= best.ci_high and best.ventilation_m3h == 80
    assert got[10, date(2024, 1, 11)].reason == "NO_DATA"
    assert (got[11, day].device_id, got[11, day].reason) == (3, "TOO_SHORT")
    assert (got[17, day].device_id, got[17, day].reason) == (4, "LOW_AMPLITUDE")
    assert got[12, day].reason == "LOW_FIT" and got[12, day].ventilation_m3h is None
    assert (got[14, day].status, got[14, day].reason) == ("INPUT_MISSING", None)
    assert (got[16, day].status, got[16, day].reason) == ("OK", "NO_DATA")
    assert ventilation.air_change_days(rows.limit(0), sensors, sizes, "2024-01-10", "2024-01-10").where("reason = 'NO_DATA'").count() == 5


def test_enabled_sensors(spark):
    rows = spark.createDataFrame([(1, "OCCUPANCY", True, None), (2, "OCCUPANCY", None, 5), (3, "OCCUPANCY", False, 5), (4, "ACH", None, None)], "id long, kind string, enabled boolean, output_device_id long")
    assert [r.id for r in ventilation.enabled(rows, "OCCUPANCY").collect()] == [2]
    assert [r.id for r in ventilation.enabled(rows, "ACH").collect()] == [4]


def test_intensities_have_reasons(spark):
    rows = spark.createDataFrame([(1, 10.0, 5.0, 4.0, 8.0), (2, 10.0, 0.0, 0.0, 8.0), (3, 10.0, None, None, None)], "id int, kwh double, area double, occupied double, planned double")
    o = energy.occupied_intensity(F.col("kwh"), F.col("occupied"), F.col("planned"))
    got = rows.select(energy.intensity(F.col("kwh"), F.col("area")), energy.intensity_reason(F.col("area")), o["value"], o["reason"], o["source"]).collect()
    assert [tuple(r) for r in got] == [(2.0, None, 2.5, None, "OCCUPANCY_EST"), (None, "NO_AREA", 1.25, None, "OPERATING_SCHEDULE"), (None, "NO_AREA", None, "NO_OCCUPANCY", None)]


def test_unpredictable(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 5.0), (2, 5.0), (2, 6.0), (3, 1.0), (3, 2.0), (3, 3.0), (4, None), (5, float("nan")), (5, 1.0), (5, 1.0), (5, 1.0)], "s int, value double")
    assert {r.s: r.reason for r in stats.unpredictable(rows, ["s"]).collect()} == {1: "NO_CHANGE", 2: "TOO_SHORT", 4: "TOO_SHORT", 5: "NO_CHANGE"}


def test_local_days_have_local_bounds(spark):
    hours = [T0 + timedelta(hours=h) for h in (-1, 0, 23, 24)]
    rows = spark.createDataFrame([(1, "t", h, 1, float(i), False) for i, h in enumerate(hours)] + [(1, "t", T0, 0, 50.0, False), (1, "t", T0, 1, 60.0, True), (2, "t", T0, 1, 70.0, False)], "device_id long, metric_key string, bucket timestamp, count long, avg double, is_virtual boolean")
    assert sorted(r.value for r in tel.local_days(rows, 1, "t", "2024-01-10", "2024-01-10", "Asia/Seoul").collect()) == [1, 2]
