"""Keyed real-time state: replay against a plain version, restart, changing registrations, history, timers."""

import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest

from hearthlake.streaming import realtime as live

T0 = datetime(2026, 8, 3)


@pytest.fixture
def session(spark):
    old = {k: spark.conf.get(k, None) for k in live.ROCKSDB}
    for k, v in live.ROCKSDB.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def reading(device, minute, value, virtual=False):
    return (device, "t", 0, 1, T0 + timedelta(minutes=minute), float(value), virtual, *[None] * 12)


def anomaly(device, analysis, version=1, centre=0.0, sigma=1.0):
    return (device, "t", 1, 1, None, None, None, analysis, version, "anomaly-detect", False, centre, sigma, 4.0, 10.0, None, None, None, None)


def threshold(device, analysis, version=1, at=50.0, up=True):
    return (device, "t", 1, 1, None, None, None, analysis, version, "threshold-eta", False, None, None, None, None, at, up, 30.0, 240.0)


def gone(device, analysis):
    return (device, "t", 1, 1, None, None, None, analysis, None, *[None] * 10)


def run(session, folder, batches, start=None, **kw):
    """Each batch is a file and a micro-batch; the query ends when all are read."""
    for n, rows in enumerate(batches):
        session.createDataFrame(rows, live.INPUT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = session.readStream.schema(live.INPUT).parquet(f"{folder}/in")
        first = None if start is None else session.createDataFrame(start, live.INPUT)
        out = live.infer(stream, first, **kw)
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    rows = session.read.schema(live.OUTPUT).parquet(f"{folder}/out").collect()
    return sorted((r.time, r.analysis_id, r.type, r.value, r.score, r.kind, r.minutes_left, r.confidence) for r in rows)


def plain(readings, analysis, centre=0.0, sigma=1.0):
    """Alarms of one series, as the rules say."""
    memory, out = live.NEW, []
    for _, _, _, _, t, v, *_ in sorted(readings, key=lambda r: r[4]):
        z = (v - centre) / sigma
        memory, kind = live.alarm(memory, int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1)), z, 4.0, 10.0)
        if kind:
            out.append((t, analysis, "ANOMALY", v, round(abs(z), 4), kind, None, None))
    return out


def test_replay_and_restart_equal_one_run(session, tmp_path):
    rng = np.random.default_rng(2)
    values = rng.normal(0, 1, 120)
    values[[20, 50, 51, 52, 53, 54, 55, 56, 90]] += [9, 7, 7, 7, 7, 7, 14, 24, -8]
    series = [reading(1, m, v) for m, v in enumerate(values)]
    want = plain(series, 7)
    assert {w[5] for w in want} == {"SPIKE", "DROP", "LEVEL_SHIFT"}
    start = [anomaly(1, 7)]
    assert run(session, str(tmp_path / "one"), [series], start) == want
    # each batch is a query of its own, which goes on from the checkpoint of the last; level shifts cross batches
    assert run(session, str(tmp_path / "many"), [series[:53], series[53:55], series[55:]], start) == want


def test_history_of_two_hours_is_preloaded(session, tmp_path):
    past = [reading(2, m, 10 + 0.2 * m) for m in range(-200, 0, 2)]
    now = [reading(2, 0, 10.0)]
    got = run(session, str(tmp_path / "with"), [now], [threshold(2, 5, at=20.0), *past])
    assert [(g[1], g[2], g[6], g[7]) for g in got] == [(5, "ETA", 50, "HIGH")], "one reading is enough after a start from history"
    assert run(session, str(tmp_path / "without"), [now], [threshold(2, 5, at=20.0)]) == []


def test_registrations_change_between_batches(session, tmp_path):
    batches = [
        [anomaly(3, 1), anomaly(3, 2), reading(3, 0, 9), reading(3, 1, 9)],
        # 1 unchanged: still cooling down; 2 of another version: starts anew with another centre
        [anomaly(3, 1), anomaly(3, 2, version=2, centre=1.0), reading(3, 2, 9)],
        [gone(3, 1), reading(3, 30, 9), reading(3, 31, 9, virtual=True)],
    ]
    got = run(session, str(tmp_path / "x"), batches)
    assert [(g[0], g[1], g[4]) for g in got] == [(T0, 1, 9.0), (T0, 2, 9.0), (T0 + timedelta(minutes=2), 2, 8.0), (T0 + timedelta(minutes=30), 2, 8.0)]


def test_silent_keys_forget_by_timer(session, tmp_path):
    batches = [
        [anomaly(4, 1), anomaly(5, 1), *[reading(4, m, 9) for m in range(5)]],
        [reading(5, 200, 0)], [reading(5, 400, 0)],  # time goes on elsewhere
        [reading(4, 401, 9)],
    ]
    got = run(session, str(tmp_path / "x"), batches, idle_ms=3_600_000)
    assert [(g[0], g[5]) for g in got] == [(T0, "SPIKE"), (T0 + timedelta(minutes=401), "SPIKE")], "the sixth in a row would be a level shift"


def test_registrations_of_analyses(spark):
    analyses = spark.createDataFrame(
        [(1, 1, 3, True, "anomaly-detect", True, False), (2, 1, 1, True, "anomaly-detect", True, False), (3, 1, 1, True, "threshold-eta", False, False), (4, 1, 1, False, "threshold-eta", False, False)],
        "analysis_id long, organization_id long, version int, realtime boolean, template string, needs_model boolean, include_virtual boolean",
    )
    sources = spark.createDataFrame([(1, "DEVICE_METRIC", 10, None, "t"), (2, "DEVICE_METRIC", 11, None, "t"), (3, "SPACE_AGGREGATE", None, 9, "t"), (4, "DEVICE_METRIC", 10, None, "t")], "analysis_id long, kind string, device_id long, space_id long, metric_key string")
    models = spark.createDataFrame([(1, 1, "RETIRED", 1.0, 1.0), (1, 2, "ACTIVE", 20.0, 2.0), (2, 1, "FAILED", 1.0, 1.0)], "analysis_id long, model_version int, status string, centre double, sigma double")
    below = spark.createDataFrame([(9, 20), (9, 21)], "space_id long, device_id long")
    rows = live.registrations(analyses, sources, below, models)
    assert sorted((r.analysis_id, r.device_id, r.version, r.centre) for r in rows.collect()) == [(1, 10, 3, 20.0), (3, 20, 1, None), (3, 21, 1, None)], "2 has no active model"
    later = live.registrations(analyses.where("analysis_id <> 3").replace(3, 4, ["version"]), sources, below, models)
    assert sorted((r.analysis_id, r.device_id, r.version) for r in live.changes(rows, later).collect()) == [(1, 10, 4), (3, 20, None), (3, 21, None)]
