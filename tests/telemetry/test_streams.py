"""Streams against each series' own profile, and the state of times to a threshold."""

import math
from datetime import datetime, timedelta

from hearthlake.streaming import telemetry as live

T0 = datetime(2026, 8, 3)


def stream(spark, rows, folder):
    spark.createDataFrame(rows, live.READINGS).coalesce(1).write.parquet(f"{folder}/in")
    return spark.readStream.schema(live.READINGS).parquet(f"{folder}/in")


def test_alarms_follow_each_device_and_time_of_day(spark, tmp_path):
    def usual(device, hour):
        return 100 * device + 50 * math.sin(hour * math.pi / 12) + 0.1 * ((hour * 7) % 5)

    history = [(d, "m", T0 + timedelta(hours=h), usual(d, h)) for d in (1, 9) for h in range(24 * 14)]
    later = [(d, "m", T0 + timedelta(hours=h), usual(d, h) + (30 if (d, h) == (1, 350) else 0)) for d in (1, 9) for h in range(24 * 14, 24 * 15)]
    rows = live.with_baseline(stream(spark, later, tmp_path), spark.createDataFrame(history, live.READINGS))
    got = live.run_once(live.anomaly_alarms(rows, sensitivity=3), str(tmp_path)).collect()
    assert (1, T0 + timedelta(hours=350)) in {(r.device_id, r.time) for r in got}
    assert all(r.score < 60 for r in got if r.time != T0 + timedelta(hours=350))


def test_eta_is_said_again_after_an_unpredictable_trend(spark, tmp_path):
    values = [100.0 + 10 * i for i in range(20)] + [290.0 - 10 * i for i in range(1, 40)] + [-100.0 + 10 * i for i in range(1, 60)]
    rows = [(1, "m", T0 + timedelta(minutes=i), v) for i, v in enumerate(values)]
    got = live.run_once(live.eta_alarms(stream(spark, rows, tmp_path), 400.0), str(tmp_path)).orderBy("time").collect()
    assert got[0].confidence == "HIGH" and {r.confidence for r in got} > {"HIGH"}
    pairs = [(r.minutes_left, r.confidence) for r in got]
    gaps = [b.time - a.time for a, b in zip(got[:-1], got[1:], strict=True)]
    assert max(gaps) > timedelta(minutes=20) and len(pairs) > 20
