"""Real-time inference with keyed state: registrations that change while the stream runs, a start from history, and timers.

Readings and changes of registrations are one stream, keyed by device and metric. A key's state has its registered
analyses (by id), what each remembers, and the last readings; a registration whose version did not
change keeps what it remembers, another one starts anew from the last readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hearthlake.operators import bindings
from hearthlake.operators.kernels import theil_sen
from hearthlake.operators.stats import MAD

#: How long a key may be silent in event time before its state goes, and how much history it begins with.
IDLE_MS, HISTORY_MINUTES = 7 * 86_400_000, 120
#: Rows of the one stream: readings (kind 0) and registrations (kind 1; a null version takes the analysis off).
INPUT = (
    "device_id long, metric_key string, kind int, organization_id long, time timestamp, value double, is_virtual boolean, "
    "analysis_id long, version int, template string, include_virtual boolean, centre double, sigma double, z_limit double, cooldown double, threshold double, up boolean, window double, horizon double"
)
OUTPUT = "analysis_id long, device_id long, metric_key string, time timestamp, type string, value double, score double, kind string, minutes_left int, confidence string"
REGISTERED = ["version", "template", "organization_id", "include_virtual", "centre", "sigma", "z_limit", "cooldown", "threshold", "up", "window", "horizon"]
#: What an analysis remembers: readings in a row beyond the limit, time (us) and strength of the last alarm, the last ETA said and its confidence.
MEMORY = "run int, last long, strength double, said int, sure string"
NEW = (0, None, 0.0, None, None)


def registrations(analyses: DataFrame, sources: DataFrame, space_devices: DataFrame, models: DataFrame) -> DataFrame:
    """(device_id, metric_key, ...) one row for each real-time analysis and device of its sources, as INPUT has them (kind 1).

    analyses: analysis_id, organization_id, version, realtime, template, needs_model and the template's parameters; sources as
    ``bindings.parse`` gives them; ``space_devices``: the devices of each space and below (``bindings.devices_below``);
    models: analysis_id, status, centre, sigma. An analysis that needs a model is registered with its ACTIVE one, or not at all.
    """
    active = models.where("status = 'ACTIVE'").groupBy("analysis_id").agg(F.max_by(F.struct("centre", "sigma"), "model_version").alias("m"))
    live = analyses.where("realtime").join(active, "analysis_id", "left").where("NOT needs_model OR m IS NOT NULL")
    live = live.drop("realtime", "needs_model").withColumns({"centre": F.col("m.centre"), "sigma": F.col("m.sigma")}).drop("m")
    targets = bindings.devices(sources, space_devices).select("analysis_id", "device_id", "metric_key").distinct()
    rows = live.join(targets, "analysis_id").withColumn("kind", F.lit(1))
    have = set(rows.columns)
    names = [f.strip().rsplit(" ", 1) for f in INPUT.split(",")]
    return rows.select(*(F.col(n).cast(t).alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in names))


def as_input(readings: DataFrame) -> DataFrame:
    """Readings (device_id, metric_key, time, value, and organization_id, is_virtual if there) as rows of the one stream."""
    have = set(readings.columns)
    names = [f.strip().rsplit(" ", 1) for f in INPUT.split(",")]
    return readings.select(*(F.lit(0).alias(n) if n == "kind" else F.col(n).cast(t).alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in names))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """What has changed from one reading of the registrations to the next: new ones and other versions, and those that are gone (null version)."""
    key = ["analysis_id", "device_id", "metric_key"]
    other = now.join(before.select(*key, "version"), [*key, "version"], "left_anti")
    gone = before.join(now.select(*key), key, "left_anti").withColumn("version", F.lit(None).cast("int"))
    return other.unionByName(gone)


def alarm(memory: tuple, at: int, z: float, limit: float, cooldown_minutes: float) -> tuple[tuple, str | None]:
    """(memory, kind of alarm or None) of a reading (time in us) that lies ``z`` from its centre."""
    run, last, strength, *rest = memory
    if not abs(z) > limit:
        return (0, last, strength, *rest), None
    run += 1
    if last is not None and at - last < cooldown_minutes * 60e6 and abs(z) < 1.5 * strength:
        return (run, last, strength, *rest), None
    return (run, at, float(abs(z)), *rest), "LEVEL_SHIFT" if run >= 6 else "SPIKE" if z > 0 else "DROP"


def eta(times: np.ndarray, values: np.ndarray, threshold: float, up: bool, horizon_minutes: float) -> tuple[int | None, str | None] | None:
    """(minutes left, confidence) until the trend of the readings (minutes, the last at 0) meets the threshold; (None, None) beyond the
    horizon, None where there is no such trend."""
    if len(times) < 3 or times[-1] - times[0] < 10:
        return None
    sign = 1 if up else -1
    slope, level, _, _ = theil_sen(times, values)
    gap = threshold - level
    if not abs(slope) >= 1e-12 or (sign * gap > 0 and sign * slope <= 0):
        return None
    rest = values - (level + slope * times)
    step = float(np.median(np.diff(times)))
    noise = MAD * float(np.median(np.abs(rest - np.median(rest)))) / (abs(slope) * step) if step else np.inf
    left = 0.0 if sign * gap <= 0 else gap / slope
    if left > horizon_minutes:
        return None, None
    return int(round(left)), "HIGH" if noise < 0.5 else "MEDIUM" if noise < 1.5 else "LOW"


class Inference(StatefulProcessor):
    """Alarms and times to a threshold of one device and metric."""

    def __init__(self, idle_ms: int = IDLE_MS, history_minutes: float = HISTORY_MINUTES):
        self.idle_ms, self.history_minutes = idle_ms, history_minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.registered = handle.getMapState("registered", "analysis_id long", ", ".join(f.strip() for f in INPUT.split(",") if f.split()[0] in REGISTERED))
        self.memory = handle.getMapState("memory", "analysis_id long", MEMORY)
        self.recent = handle.getListState("recent", "at long, value double")

    def close(self) -> None:
        pass

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self._register(initialState[initialState["kind"] == 1])
        past = initialState[initialState["kind"] == 0].sort_values("time")
        if len(past):
            at = past["time"].astype("datetime64[us]").astype("int64").to_numpy()
            self._keep(at, past["value"].to_numpy(dtype=float))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        self._register(frame[frame["kind"] == 1])
        frame = frame[frame["kind"] == 0].sort_values("time")
        frame = frame[frame["value"].notna() & frame["time"].notna()]
        out = self._infer(key, frame) if len(frame) else []
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if len(frame):
            self.handle.registerTimer(int(frame["time"].iloc[-1].value // 1_000_000) + self.idle_ms)
        elif timerValues.getCurrentWatermarkInMs() > 0:
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.idle_ms)
        yield self._rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """A silent key forgets its readings and what its analyses remember, but not that they are registered."""
        self.recent.clear()
        self.memory.clear()
        yield self._rows([])

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")]).astype({"analysis_id": "int64", "device_id": "int64", "minutes_left": "Int32"})

    def _register(self, rows: pd.DataFrame) -> None:
        for row in rows.to_dict("records"):
            analysis = (int(row["analysis_id"]),)
            if pd.isna(row["version"]):
                self.registered.removeKey(analysis)
                self.memory.removeKey(analysis)
                continue
            if self.registered.containsKey(analysis) and self.registered.getValue(analysis)[0] == int(row["version"]):
                continue
            self.registered.updateValue(analysis, tuple(None if pd.isna(row[c]) else int(row[c]) if c in ("version", "organization_id") else row[c] for c in self._order()))
            self.memory.removeKey(analysis)

    def _order(self) -> list[str]:
        named = [f.split()[0] for f in INPUT.split(",") if f.split()[0] in REGISTERED]
        return ["version", *[n for n in named if n != "version"]] if named[0] == "version" else named

    def _keep(self, at: np.ndarray, values: np.ndarray) -> None:
        fresh = at > at[-1] - self.history_minutes * 60e6
        self.recent.put([(int(t), float(v)) for t, v in zip(at[fresh], values[fresh], strict=True)])

    def _infer(self, key: tuple, frame: pd.DataFrame) -> list[tuple]:
        past = list(self.recent.get()) if self.recent.exists() else []
        times = np.array([p[0] for p in past] + frame["time"].astype("datetime64[us]").astype("int64").tolist(), np.int64)
        values = np.array([p[1] for p in past] + frame["value"].tolist())
        out = []
        names = self._order()
        for (analysis,), registered in list(self.registered.iterator()) if self.registered.exists() else []:
            r = dict(zip(names, registered, strict=True))
            memory = tuple(self.memory.getValue((analysis,))) if self.memory.containsKey((analysis,)) else NEW
            for k, row in enumerate(frame.itertuples(), len(past)):
                foreign = r["organization_id"] is not None and not pd.isna(row.organization_id) and r["organization_id"] != row.organization_id
                if foreign or (row.is_virtual is True and not r["include_virtual"]):
                    continue
                if r["template"] == "anomaly-detect":
                    z = (values[k] - r["centre"]) / max(r["sigma"], 1e-9)
                    memory, kind = alarm(memory, int(times[k]), z, r["z_limit"], r["cooldown"])
                    if kind:
                        out.append((analysis, key[0], key[1], row.time, "ANOMALY", float(values[k]), round(float(abs(z)), 4), kind, None, None))
                else:
                    first = np.searchsorted(times[: k + 1], times[k] - r["window"] * 60e6, "right")
                    found = eta((times[first : k + 1] - times[k]) / 6e7, values[first : k + 1], r["threshold"], r["up"], r["horizon"])
                    if found is None:
                        memory = (*memory[:3], None, memory[4])
                    elif found[0] is not None and found != (memory[3], memory[4]):
                        memory = (*memory[:3], *found)
                        out.append((analysis, key[0], key[1], row.time, "ETA", float(values[k]), None, None, *found))
            self.memory.updateValue((analysis,), memory)
        self._keep(times, values)
        return sorted(out, key=lambda x: (x[3], x[0]))


def infer(rows: DataFrame, start: DataFrame | None = None, late: str = "10 minutes", idle_ms: int = IDLE_MS, history_minutes: float = HISTORY_MINUTES) -> DataFrame:
    """Alarms (ANOMALY) and times to a threshold (ETA) of a stream of readings and registrations (INPUT), in append mode.

    ``start``: registrations and history (INPUT) that each key begins with; it is read when the stream has no checkpoint yet,
    a restart goes on from its state. Registrations of a micro-batch hold for all its readings; readings of a key are
    taken in order of time within it. A key that is silent for ``idle_ms`` of event time drops what it remembers (a timer);
    readings older than ``history_minutes`` go with each new one. Needs the RocksDB state store.
    """
    stream = rows.withWatermark("time", late) if rows.isStreaming else rows
    initial = None if start is None else start.groupBy("device_id", "metric_key")
    return stream.groupBy("device_id", "metric_key").transformWithStateInPandas(
        statefulProcessor=Inference(idle_ms, history_minutes), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime", initialState=initial
    )


#: The state store that ``infer`` needs.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
