"""Templates on made series with known answers, streams against a replay, and service rules."""

import json
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthlake.operators import fill, joins, kernels, service, stats, sufficiency, windows
from hearthlake.plans import templates as tpl
from hearthlake.streaming import telemetry as live

T0 = datetime(2026, 8, 3)


def series(spark, values, minutes, key="s"):
    rows = [(key, T0 + timedelta(minutes=minutes * i), None if v is None or np.isnan(v) else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, time timestamp, value double")


def daily(n, minutes, rng, noise=0.3):
    t = np.arange(n) * minutes / 1440
    return 22 + 2 * np.sin(2 * np.pi * t) + rng.normal(0, noise, n)


@pytest.mark.parametrize("seed", [1, 2])
def test_spikes_and_shifts_are_found(spark, seed):
    rng = np.random.default_rng(seed)
    y = daily(14 * 144, 10, rng)
    at = [300, 700, 1100, 1500]
    for i, k in enumerate(at):
        y[k : k + (1 if i < 2 else 12)] += 8 * (-1) ** i
    found = tpl.anomalies(series(spark, y, 10), ["k"], 600).collect()
    starts = [T0 + timedelta(minutes=10 * k) for k in at]
    for i, s in enumerate(starts):
        kinds = {r.kind for r in found if abs((r.start - s).total_seconds()) <= 1800}
        assert kinds & ({"SPIKE", "DROP"} if i < 2 else {"LEVEL_SHIFT"})
    assert sum(all(abs((r.start - s).total_seconds()) > 8 * 3600 for s in starts) for r in found) <= 1


def test_eta_of_a_ramp(spark):
    rows = series(spark, [500 + 10 * i for i in range(31)], 1)
    row = tpl.threshold_eta(rows, ["k"], 1000).first()
    assert row.minutes_left == pytest.approx(20, abs=1) and row.confidence == "HIGH" and row.level == "WARN"
    assert tpl.threshold_eta(rows, ["k"], 1000, up=False).first().level == "CRITICAL"
    assert tpl.threshold_eta(series(spark, [5, 6], 1), ["k"], 10).first().reason == "TOO_FEW"


def test_battery(spark):
    y = 90 - 0.8 * np.arange(60 * 24) / 24
    row = tpl.battery_life(series(spark, y, 60), ["k"]).first()
    assert row.days_left == pytest.approx((y[-1] - 20) / 0.8, rel=0.05) and row.recommend
    assert tpl.battery_life(series(spark, [50.0] * 900, 60), ["k"]).first().reason == "NO_CHANGE"


def test_level_changes(spark):
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.normal(10, 0.5, 25 * 24), rng.normal(16, 0.5, 20 * 24), rng.normal(12, 0.5, 15 * 24)])
    found = sorted(r.day for r in tpl.change_points(series(spark, y, 60), ["k"], zone="UTC").collect())
    assert len(found) == 2 and all(abs((d - (T0.date() + timedelta(days=x))).days) <= 1 for d, x in zip(found, (25, 45), strict=True))


def test_profiles(spark):
    rng = np.random.default_rng(4)
    kinds = [i % 3 for i in range(42)]
    shape = [np.sin(np.arange(24) / 4), np.linspace(0, 3, 24), np.full(24, 5.0)]
    y = np.concatenate([shape[k] + rng.normal(0, 0.05, 24) for k in kinds])
    rows = {r.day: r.cluster for r in tpl.daily_profiles(series(spark, y, 60), ["k"], zone="UTC").collect()}
    assert [rows[d] for d in sorted(rows)] == kinds


def test_intervention(spark):
    rng = np.random.default_rng(5)
    y = 100 + 20 * np.sin(np.arange(28 * 24) / 24 * 2 * np.pi) + rng.normal(0, 3, 28 * 24)
    y[14 * 24 :] *= 0.8
    row = tpl.intervention(series(spark, y, 60), ["k"], str(T0 + timedelta(days=14)), rounds=200, zone="UTC").first()
    assert row.effect == pytest.approx(-0.2, abs=0.04) and row.ci_high < 0 and row.verdict == "DOWN"


@pytest.mark.parametrize("method", ["HOLT_WINTERS", "SARIMAX", "GRADIENT_BOOSTING"])
def test_forecast_of_a_season(spark, method):
    rng = np.random.default_rng(6)
    y = 50 + 10 * np.sin(np.arange(22 * 24) / 24 * 2 * np.pi) + rng.normal(0, 0.5, 22 * 24)
    rows = tpl.forecast(series(spark, y[: 20 * 24], 60), ["k"], method=method).orderBy("step").toPandas()
    real = y[20 * 24 :]
    assert np.mean(np.abs(rows.forecast - real) / real) < 0.1
    assert ((rows.lower95 <= real) & (real <= rows.upper95)).mean() >= (0.7 if method == "GRADIENT_BOOSTING" else 0.85)


def test_odd_hours_of_several_series(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (400, 3))
    x[200:208] += 9
    rows = [("r", T0 + timedelta(hours=i), *map(float, v)) for i, v in enumerate(x)]
    found = tpl.multivariate_anomalies(spark.createDataFrame(rows, "k string, time timestamp, a double, b double, c double"), "k", ["a", "b", "c"]).collect()
    assert any(r.start <= T0 + timedelta(hours=204) <= r.end for r in found)


def test_occupancy_and_use(spark):
    rows = []
    for i in range(2 * 1440):
        busy = 9 * 60 <= (i % 1440) < 12 * 60
        rows.append(("room", T0 - timedelta(hours=9) + timedelta(minutes=i), 900.0 if busy else 450.0, 1.0 if busy else 0.0))
    grid = spark.createDataFrame(rows, "k string, time timestamp, co2 double, activity double")
    out = tpl.utilization(tpl.occupancy(grid, ["k"], 60), ["k"]).first()
    assert out.utilization == pytest.approx(1 / 3, abs=0.03)


def test_sick_sensors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for d in range(5):
        for i in range(7 * 144):
            if d == 1 and i % 3 == 0:
                continue
            v = 20 + np.sin(i / 23) + rng.normal(0, 0.1) + (3 if d == 2 else 0)
            if d == 3 and 300 <= i < 360:
                v = 20.0
            rows.append((d, T0 + timedelta(minutes=10 * i), float(v), 0))
    table = spark.createDataFrame(rows, "device_id long, time timestamp, value double, quality int")
    got = {r.device_id: (r.status, r.reasons) for r in tpl.sensor_health(table, "device_id", 7 * 86_400, 600, drift=0.5).collect()}
    assert got[0] == ("OK", "") and got[4] == ("OK", "")
    assert got[1] == ("SUSPECT", "MISSING") and got[2] == ("SUSPECT", "DRIFT") and got[3] == ("SUSPECT", "STUCK")


def test_air_changes():
    hours = np.arange(0, 3, 1 / 12)
    best = kernels.air_changes(hours, 420 + 900 * np.exp(-1.5 * hours))
    assert best["ach"] == pytest.approx(1.5, abs=0.2)
    assert kernels.air_changes(hours, np.full(len(hours), 430.0))["reason"] in ("NO_DATA", "LOW_AMPLITUDE")


def test_nearest_takes_the_later_of_equals(spark):
    a = series(spark, [1], 1).withColumn("time", F.lit(T0 + timedelta(minutes=10)))
    b = spark.createDataFrame([("s", T0 + timedelta(minutes=5), 5.0), ("s", T0 + timedelta(minutes=15), 15.0), ("s", T0, None)], "k string, time timestamp, value double")
    assert joins.nearest(a, b, ["k"], 600).first().near == 15.0
    assert joins.nearest(a, b, ["k"], 200).first().near is None


def test_fill_and_islands(spark):
    rows = fill.interpolate(series(spark, [1, None, None, 4, None, None, None, None, 9], 60), ["k"], limit=1).orderBy("time").collect()
    assert [r.value for r in rows] == [1.0, 2.0, 3.0, 4.0, 5.0, None, None, 8.0, 9.0]
    spans = windows.runs(series(spark, [0, 1, 0, 1, 0, 0, 0, 1], 60), ["k"], F.col("value") > 0, 2).orderBy("start").collect()
    assert [r.rows for r in spans] == [2, 1]
    grid = fill.resample(series(spark, [1, 2, None, 4], 90), ["k"], 3600).orderBy("time").collect()
    assert [r.value for r in grid] == [1.0, 2.0, None, None, 4.0]
    few = windows.evenly(series(spark, range(100), 1), ["k"], 10).count()
    assert few == 10


def test_drift(spark):
    rng = np.random.default_rng(9)
    base = series(spark, rng.normal(0, 1, 2000), 1)
    edges = stats.deciles(base, ["k"])
    assert stats.psi(series(spark, rng.normal(0, 1, 2000), 1), edges, ["k"]).first().psi < 0.1
    assert stats.psi(series(spark, rng.normal(6, 1, 2000), 1), edges, ["k"]).first().psi > 0.2
    assert stats.psi(base, stats.deciles(series(spark, [1.0], 1), ["k"]), ["k"]).first().psi >= 0


def test_sufficiency_rules():
    assert sufficiency.effective_resolution(8_000_000, 347 * 86_400, 5_000_000) == "1m"
    assert sufficiency.effective_resolution(100, 86_400, 5_000_000) == "RAW"
    assert sufficiency.estimate_points(10**9, 86_400, 3_600) == 25


@pytest.mark.parametrize(("cron", "want"), [("0 9 * * *", "2026-08-04T00:00"), ("*/15 * * * *", "2026-08-03T00:15"), ("0 0 1 * *", "2026-08-31T15:00"), ("0 9 * * MON-FRI", "2026-08-04T00:00"), ("0 0 9 * * 0", "2026-08-09T00:00"), ("0 0 29 2 *", "2028-02-28T15:00")])
def test_next_run(cron, want):
    assert service.next_run(cron, datetime(2026, 8, 3, 0, 0, tzinfo=timezone.utc)).strftime("%Y-%m-%dT%H:%M") == want


def test_next_run_of_seconds():
    at = datetime(2026, 8, 3, 0, 0, 20, tzinfo=timezone.utc)
    assert service.next_run("*/15 * 9 * * *", at).strftime("%H:%M:%S") == "00:00:30"
    assert service.next_run("20 0 9 * * *", at).strftime("%d %H:%M:%S") == "04 00:00:20", "strictly later"


@pytest.mark.parametrize("cron", ["", "* * * *", "60 * * * *", "5-1 * * * *", "* * * * MOO", "0 0 31 2 *", "*/0 * * * *"])
def test_bad_cron(cron):
    with pytest.raises(ValueError):
        service.next_run(cron, datetime(2026, 8, 3, tzinfo=timezone.utc))


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id long, v string")
    assert {(r.id, r.v) for r in service.insert_absent(old, new, ["id"]).collect()} == {(3, "d")}
    assert {r.v for r in service.upsert(old, new.distinct(), ["id"]).collect()} == {"a", "c", "d"}
    days = spark.createDataFrame([(1, "x"), (2, "y")], "v long, day string")
    service.replace_days(days, f"{tmp_path}/t")
    service.replace_days(days.where("v = 2").withColumn("v", F.lit(9).cast("long")), f"{tmp_path}/t")
    assert {(r.v, r.day) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, "x"), (9, "y")}
    service.write_csv(old.withColumn("x", F.array(F.lit(1))), f"{tmp_path}/c", {"id": "Number"})
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["Number", "v", "x"]
    with pytest.raises(ValueError):
        service.write_csv(old, f"{tmp_path}/d", most=1)
    assert service.better_model({"mae": 2}, {"mae": 3}) and not service.better_model({"precision": 0.1}, {"precision": 0.2})
    assert service.canonical_hash({"b": 0.1 + 0.2, "a": 1}) == service.canonical_hash({"a": 1, "b": 0.3})


def test_messages_are_parsed(spark):
    good = {"messageId": "m1", "organizationId": 1, "deviceId": 5, "measuredAt": "2026-08-03T00:00:00Z", "virtual": False, "metrics": [{"key": "t", "value": 1.5, "quality": 0}, {"key": "h", "value": 2.0, "quality": 1}]}
    rows = spark.createDataFrame([(json.dumps(good),), ("not json",), (json.dumps(good | {"virtual": True}),), (json.dumps(good | {"organizationId": 2}),), (json.dumps(good | {"measuredAt": "never"}),)], "value string")
    assert [(r.device_id, r.metric_key, r.value) for r in live.readings(rows, organization=1).collect()] == [(5, "t", 1.5)]


def test_alarms_of_a_stream_equal_a_replay(spark, tmp_path):
    values = [0.0] * 10 + [9.0] + [0.0] * 10 + [8.0] * 7 + [20.0]
    rows = [(1, "m", T0 + timedelta(minutes=i), v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, live.READINGS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(live.READINGS).parquet(f"{tmp_path}/in")
    profile = pd.DataFrame([{"metric_key": "m", "centre": 0.0, "sigma": 1.0}])
    got = live.run_once(live.anomaly_alarms(stream, profile), str(tmp_path)).orderBy("time").collect()
    run, last, strength, want = 0, None, 0.0, []
    for i, v in enumerate(values):
        if abs(v) <= 4.5:
            run = 0
            continue
        run += 1
        if last is None or i - last >= 10 or v >= 1.5 * strength:
            want.append((v, "LEVEL_SHIFT" if run >= 6 else "SPIKE"))
            last, strength = i, v
    assert [(r.value, r.kind) for r in got] == want and len(want) == 3


def test_eta_of_a_stream(spark, tmp_path):
    rows = [(1, "m", T0 + timedelta(minutes=i), 500.0 + 10 * i) for i in range(40)]
    spark.createDataFrame(rows, live.READINGS).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = live.run_once(live.eta_alarms(spark.readStream.schema(live.READINGS).parquet(f"{tmp_path}/in"), 1000.0), str(tmp_path)).orderBy("time").collect()
    assert [r.minutes_left for r in got] == list(range(40, 10, -1))


def test_bindings(spark):
    from hearthlake.operators import bindings as b

    binding = [
        {"role": "temp", "sources": [{"kind": "DEVICE_METRIC", "deviceId": 5, "metricKey": "t"}, {"kind": "SPACE_AGGREGATE", "spaceId": 9, "metricKey": "t", "agg": "MAX", "semantic": "temp"}]},
        {"role": "co2", "sources": [{"kind": "SPACE_AGGREGATE", "metricKey": "c"}, {"kind": "NONE", "deviceId": 1, "metricKey": "c"}]},
        {"role": "odd", "sources": [{"kind": "DEVICE_METRIC", "deviceId": 5}]},
    ]
    rows = b.parse(spark.createDataFrame([(1, json.dumps(binding))], "id long, binding string"), ["id"])
    assert sorted((r.role, r.agg, str(r.error)) for r in rows.collect()) == [("co2", "avg", "KIND"), ("co2", "avg", "SPACE"), ("odd", "avg", "METRIC"), ("temp", "avg", "None"), ("temp", "max", "None")]
    roles = [b.Role("temp", 1, 1, "temp"), b.Role("co2", 1, 5), b.Role("noise", optional=True), b.Role("light")]
    assert {(r.role, r.problem) for r in b.problems(rows, ["id"], roles).collect()} == {("temp", "COUNT"), ("light", "COUNT"), ("odd", "UNKNOWN")}
    good = rows.where("error IS NULL")
    below = spark.createDataFrame([(9, 100), (9, 101)], "space_id long, device_id long")
    assert sorted(r.device_id for r in b.devices(good, below).collect()) == [5, 100, 101]
    assert b.spaces(good, ["id"]).first().spaces == [9]
    targets = spark.createDataFrame([(9, "temp", None, 30.0)], "space_id long, semantic string, min double, max double")
    cells = spark.createDataFrame([(9, "temp"), (8, "temp"), (9, "co2")], "space_id long, semantic string")
    got = {(r.space_id, r.semantic): (r.min, r.max, r.from_space) for r in b.with_targets(cells, targets, {"temp": (20, 26), "co2": (None, 1000)}).collect()}
    assert got == {(9, "temp"): (20.0, 30.0, True), (8, "temp"): (20.0, 26.0, False), (9, "co2"): (None, 1000.0, False)}
    now = datetime(2026, 8, 3, 1, 2, 3)
    assert b.period({"type": "RELATIVE", "days": 2}, now) == (datetime(2026, 8, 1, 1, 2), datetime(2026, 8, 3, 1, 2))
    with pytest.raises(ValueError):
        b.period({"type": "FIXED", "from": "2026-01-02", "to": "2026-01-01"}, now)
