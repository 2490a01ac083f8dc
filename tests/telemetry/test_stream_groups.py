"""State of streams is a row for each group of series, not for each series, and says the same however the rows come."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from hearthlake.streaming import telemetry as live

T0 = datetime(2026, 8, 3)


def figures(rng, devices, minutes):
    return [(d, "m", T0 + timedelta(minutes=i), float(d % 7 + i * (1 + d % 3) + rng.choice([0, 0, 0, 0.5, 40]))) for d in range(devices) for i in range(minutes)]


def alarms(stream, kind):
    if kind == "eta":
        return live.eta_alarms(stream, 60.0)
    return live.anomaly_alarms(stream, pd.DataFrame({"metric_key": ["m"], "centre": [10.0], "sigma": [8.0]}))


def run(spark, folder, files, kind, name):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, live.READINGS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    stream = spark.readStream.schema(live.READINGS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    query = alarms(stream, kind).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    return sorted(map(tuple, spark.table(name).collect())), len(batches), batches[-1]["stateOperators"][0]["numRowsTotal"]


@pytest.mark.parametrize("kind", ["eta", "anomaly"])
def test_state_rows_and_batches(spark, tmp_path, kind):
    rows = figures(random.Random(3), 1200, 3)
    _, _, state = run(spark, tmp_path, [rows], kind, f"{kind}_many")
    assert state <= live.GROUPS < 1200
    rows = figures(random.Random(4), 5, 60)
    middle = T0 + timedelta(minutes=25)
    whole, one, _ = run(spark, tmp_path, [rows], kind, f"{kind}_whole")
    parts, two, _ = run(spark, tmp_path, [[r for r in rows if r[2] < middle], [r for r in rows if r[2] >= middle]], kind, f"{kind}_parts")
    assert (one, two) == (1, 2) and whole == parts and len(whole) > 20
