"""Pruned scans, medians of the others, own slots, rolling forecasts, virtual sensors, queues: small cases with known answers."""

import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlake.operators import rolling, service, stats, tree, virtual
from hearthlake.plans import templates as tpl
from hearthlake.sources import telemetry as tel

T0 = datetime(2026, 8, 3)
RAW = "device_id long, metric_key string, time timestamp, value double, quality int, is_virtual boolean"


def raw(spark, devices=4, hours=72):
    return spark.createDataFrame([(d, "m", T0 + timedelta(minutes=20 * k), float(d + k % 7), 0, False) for d in range(devices) for k in range(3 * hours)], RAW)


@pytest.fixture
def long_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_hybrid_scan_reads_raw_rows_only_where_it_must(spark, tmp_path, long_plans):
    raw(spark).write.parquet(f"{tmp_path}/raw")
    rows = spark.read.parquet(f"{tmp_path}/raw")
    aggregate = tel.continuous_aggregate(rows, "1h")
    none = spark.createDataFrame([], "level string, device_id long, metric_key string, from_ts timestamp, to_ts timestamp")
    ended = spark.createDataFrame([("1h", 1, "m", T0 - timedelta(days=2), T0), ("1d", 2, "m", T0 + timedelta(hours=9), T0 + timedelta(hours=10))], none.schema)
    within = spark.createDataFrame([("1m", 1, "m", T0 + timedelta(hours=30, minutes=5), T0 + timedelta(hours=31))], none.schema)
    period = ("2026-08-03", "2026-08-06", "2026-08-05 12:00:00")

    def scans(dirty):
        found = tel.hybrid(rows, aggregate, "1h", *period, dirty)
        text = found._jdf.queryExecution().executedPlan().toString()
        return found, [x for x in text.split("\n") if "PushedFilters" in x]

    for dirty in (None, none, ended):
        found, pushed = scans(dirty)
        assert len(pushed) == 2, "the aggregate's and one raw scan"
        assert any("GreaterThanOrEqual(time,2026-08-05" in p for p in pushed), "the watermark reaches the files"
        got = {(r.device_id, r.bucket): r.from_raw for r in found.collect()}
        assert all(v == (k[1] >= datetime(2026, 8, 5, 12)) for k, v in got.items()) and len(got) == 4 * 72
    found, pushed = scans(within)
    assert any("GreaterThanOrEqual(time,2026-08-04" in p and "LessThan(time,2026-08-05" in p for p in pushed), "dirty series from their first bin to the watermark"
    got = {(r.device_id, r.bucket): r.from_raw for r in found.collect()}
    assert all(v == (k[1] >= (datetime(2026, 8, 4, 6) if k[0] == 1 else datetime(2026, 8, 5, 12))) for k, v in got.items()) and len(got) == 4 * 72


@pytest.mark.parametrize("devices", [2, 3, 4, 7, 8])
def test_median_of_the_others(spark, devices):
    rng = random.Random(devices)
    values = {(d, h): float(rng.randint(0, 4)) for d in range(devices) for h in range(5) if rng.random() < 0.8}
    rows = spark.createDataFrame([(d, T0 + timedelta(hours=h), v) for (d, h), v in values.items()], "device string, time timestamp, value double")
    got = {(int(r.device), int((r.hour - T0).total_seconds() // 3600)): r.d for r in tpl._from_peers(rows, "device", "time").collect()}
    want = {}
    for (d, h), v in values.items():
        others = [x for (e, g), x in values.items() if g == h and e != d]
        if others:
            want[d, h] = v - statistics.median(others)
    assert got == pytest.approx(want)


def test_slots_of_constant_and_single_series(spark):
    rows = [("day", T0 + timedelta(days=k), float(k)) for k in range(9)] + [("one", T0, 5.0)] + [("null", T0, None)] + [("quarter", T0 + timedelta(minutes=7 * k), 1.0) for k in range(300)]
    table = spark.createDataFrame(rows, "s string, time timestamp, value double")
    got = {}
    for r in stats.own_profile(table, ["s"]).collect():
        got.setdefault((r.s, r.width), set()).add(r.profile)
    assert got == {("day", 1440): {4.0}, ("one", 60): {5.0}, ("quarter", 15): {1.0}}
    assert {r.width for r in stats.own_profile(table, ["s"], "NONE").collect()} == {1440}


def test_bands_go_round_any_forecaster(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([("a", T0 + timedelta(hours=k), float(50 + 10 * (k % 24 > 8) + rng.normal())) for k in range(400)] + [("b", T0, 1.0)], "s string, time timestamp, value double")
    naive = rolling.per_group(lambda past, steps: np.resize(past[-24:], steps))
    for forecaster in (naive, rolling.seasonal_mean(24)):
        got = rolling.forecast(rows, ["s"], 24, 3600, forecaster, 24).where("s = 'a'").orderBy("step").collect()
        assert len(got) == 24 and all(r.lower95 <= r.lower80 <= r.predicted <= r.upper80 <= r.upper95 for r in got)
        assert 0.5 < got[0].upper80 - got[0].predicted < 6 and abs(got[0].predicted - (60 if 400 % 24 > 8 else 50)) < 4
    errors = rolling.validate(rolling.numbered(rows, ["s"]), ["s"], 24, naive, period=24)
    assert {r.origin for r in errors.collect()} == {320, 338, 356, 374}
    tried = spark.createDataFrame([("a", 24, 0.10), ("a", 168, 0.11), ("b", 24, 0.05), ("b", 168, 0.11), ("c", 24, 0.2), ("c", 168, None)], "s string, period int, mape double")
    assert {r.s: r.period for r in rolling.choose_period(tried, ["s"]).collect()} == {"a": 168, "b": 24, "c": 24}


def test_covariates_on_target_and_ahead(spark):
    target = spark.createDataFrame([("s", T0 + timedelta(hours=h)) for h in range(5)], "s string, time timestamp")
    known = spark.createDataFrame([("s", T0 + timedelta(hours=1), 1.0), ("s", T0 + timedelta(hours=3), 3.0)], "s string, time timestamp, x double")
    assert [r.x for r in rolling.covariates_on(target, known, ["s"], ["x"]).orderBy("time").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]
    ahead = spark.createDataFrame([("s", T0 + timedelta(days=7, hours=1)), ("s", T0 + timedelta(days=1))], "s string, time timestamp")
    assert [r.x for r in rolling.future_covariates(known, ahead, ["s"], ["x"]).orderBy("time").collect()] == [2.0, 1.0]


def test_virtual_states_and_ledger(spark):
    sensors = spark.createDataFrame([(1, 5, "pir", 0, 1, "p"), (1, 5, "noise", 1, 2, "n"), (1, 6, "pir", 0, 9, "p"), (1, 6, "noise", 1, 9, "n")], "organization_id long, space_id long, signal string, ordinal int, device_id long, metric_key string")
    rows = [(1, "p", T0 + timedelta(minutes=k), float(k > 50), 0, False) for k in range(60)] + [(2, "n", T0 + timedelta(minutes=k), 30.0 + 20 * (k > 50), 0, False) for k in range(60)] + [(9, "p", T0, 1.0, 0, True)]
    readings = spark.createDataFrame(rows, RAW)
    done = spark.createDataFrame([(1, 6, T0 + timedelta(minutes=55))], "organization_id long, space_id long, bucket timestamp")
    asked = virtual.open_ticks(sensors, done, "2026-08-03 01:02:00", 3)
    got = {(r.space_id, r.bucket.minute): (r.status, r.value, r.missing) for r in virtual.occupancy(asked, sensors, readings).collect()}
    assert got[5, 0] == got[5, 55] == ("OK", 1.0, None) and got[5, 50] == ("OK", 0.0, None)
    assert got[6, 0] == got[6, 50] == ("INPUT_MISSING", None, ["noise", "pir"]) and (6, 55) not in got and len(got) == 5
    states = spark.createDataFrame([("x", T0, 1.0), ("x", T0 + timedelta(minutes=5), None), ("x", T0 + timedelta(minutes=10), 0.0)], "k string, bucket timestamp, value double")
    times = spark.createDataFrame([("x", T0 + timedelta(minutes=m)) for m in (-1, 0, 7, 10, 500)] + [("y", T0)], "k string, time timestamp")
    assert [r.value for r in virtual.state_at(states, times, ["k"]).orderBy("k", "time").collect()] == [None, 1.0, 1.0, 0.0, 0.0, None]


def test_deep_forests_and_cycles(spark):
    chain = [(k, k - 1 if k else None) for k in range(33)] + [(100, 101), (101, 100), (102, 100)]
    spaces = spark.createDataFrame(chain, "id long, parent_id long")
    got = {(r.ancestor, r.id) for r in tree.closure(spaces).collect()}
    assert got == {(a, k) for k in range(33) for a in range(k + 1)}
    with pytest.raises(ValueError, match="deep"):
        tree.closure(spark.createDataFrame([(k, k - 1 if k else None) for k in range(200)], spaces.schema))


def test_only_changed_rows_are_written(spark):
    table = spark.createDataFrame([(1, "QUEUED", 1, 5), (2, "QUEUED", None, 6), (3, "DONE", None, 7), (4, "QUEUED", 3, 8)], "id long, status string, queue_position int, created int").withColumn("org", F.lit(1))
    assert [(r.id, r.queue_position) for r in service.renumbered(table, "org", ["created", "id"]).collect()] == [(2, 2)]
    rows = spark.createDataFrame([(1, "QUEUED", 1), (2, "QUEUED", None), (3, "LOST", None), (9, "NEW", None)], "id long, status string, queue_position int")
    assert {r.id for r in service.changed(table, rows, ["id"], ["status", "queue_position"]).collect()} == {3, 9}
