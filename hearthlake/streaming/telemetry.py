"""Telemetry as a stream: parsing, deduplication, continuous aggregates, stateful alarms.

The same functions take static DataFrames where they do not keep state, so a
replay of a batch gives the rows that the stream gave.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from hearthlake.functions.times import instant, minute_of_day, weekday
from hearthlake.operators import stats
from hearthlake.operators.kernels import theil_sen
from hearthlake.operators.lineage import written
from hearthlake.plans.templates import SENSITIVITY

MESSAGE = (
    "v INT, messageId STRING, organizationId BIGINT, deviceId BIGINT, measuredAt STRING, virtual BOOLEAN, "
    "metrics ARRAY<STRUCT<key: STRING, value: DOUBLE, quality: INT>>"
)
READINGS = "device_id BIGINT, metric_key STRING, time TIMESTAMP, value DOUBLE"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows.select("event_id", F.col("user_id").alias("device_id"), F.col("event_type").alias("metric_key"), instant(F.col("ts")).alias("time"), "value")


def readings(messages: DataFrame, column: str = "value", organization: int | None = None) -> DataFrame:
    """Readings of JSON messages: one a metric of quality 0; what cannot be parsed, other
    organisations' and virtual devices' messages are left out."""
    m = messages.select(F.from_json(F.col(column).cast("string"), MESSAGE).alias("m")).where("m.deviceId IS NOT NULL AND NOT coalesce(m.virtual, false)")
    if organization is not None:
        m = m.where(F.col("m.organizationId") == organization)
    rows = m.select("m.messageId", F.col("m.deviceId").alias("device_id"), F.try_to_timestamp("m.measuredAt").alias("time"), F.explode("m.metrics").alias("x"))
    rows = rows.where("time IS NOT NULL AND x.value IS NOT NULL AND coalesce(x.quality, 0) = 0")
    return rows.select("messageId", "device_id", F.col("x.key").alias("metric_key"), "time", F.col("x.value").alias("value"))


def deduplicated(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark("time", late).dropDuplicatesWithinWatermark(keys)


def tumbling(rows: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """Continuous aggregate of each device and metric by tumbling windows; days start on Korean midnight."""
    window = F.window("time", size, size, "15 hours") if size.endswith(("day", "days")) else F.window("time", size)
    out = rows.withWatermark("time", late).groupBy(window.alias("w"), "device_id", "metric_key")
    out = out.agg(F.count("value").alias("count"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))
    return out.select("device_id", "metric_key", F.col("w.start").alias("bucket"), "count", "avg", "min", "max")


def routed(rows: DataFrame, registrations: DataFrame) -> DataFrame:
    """Readings with each registered analysis of their device and metric (a static table, read again each batch)."""
    return rows.join(registrations, ["device_id", "metric_key"])


def anomaly_baseline(history: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """(keys, day_type, slot, centre, sigma) of series with ``least`` values or more: seasonal
    profile plus the median residual, and the robust sigma of the residuals."""
    history = history.where("value IS NOT NULL")
    history = history.join(history.groupBy(*keys).count().where(F.col("count") >= least).select(*keys), keys, "left_semi")
    profile = stats.seasonal_profile(history, keys)
    rows = slotted(history).join(profile, [*keys, "day_type", "slot"]).withColumn("_r", F.col("value") - F.col("profile"))
    offset = rows.groupBy(*keys).agg(stats.median("_r").alias("_o"))
    out = profile.join(offset, keys).join(stats.robust_sigma(rows, keys, "_r"), keys)
    return out.select(*keys, "day_type", "slot", (F.col("profile") + F.col("_o")).alias("centre"), "sigma")


def slotted(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"slot": F.floor(minute_of_day(F.col("time"), stats.ZONE) / 60).cast("int"), "day_type": (weekday(F.col("time"), stats.ZONE) >= 5).cast("int")})


def with_baseline(rows: DataFrame, history: DataFrame) -> DataFrame:
    """``rows`` (a stream) with centre and sigma of their device and metric at that time of
    day; series of fewer than 30 values in ``history`` take their metric's. The baselines are made and written once,
    so a micro-batch reads them and not the history."""
    own = written(anomaly_baseline(history, ["device_id", "metric_key"]))
    metric = written(anomaly_baseline(history, ["metric_key"])).withColumnsRenamed({"centre": "_centre", "sigma": "_sigma"})
    rows = slotted(rows).join(own, ["device_id", "metric_key", "day_type", "slot"], "left").join(metric, ["metric_key", "day_type", "slot"], "left")
    return rows.select("device_id", "metric_key", "time", "value", F.coalesce("centre", "_centre").alias("centre"), F.coalesce("sigma", "_sigma").alias("sigma"))


#: Series are dealt by hash to so many groups: one call and one row of state serve the series of a group, not one each.
GROUPS = 512


def _grouped(rows: DataFrame) -> GroupedData:
    return rows.withColumn("_group", F.pmod(F.xxhash64("device_id", "metric_key"), F.lit(GROUPS))).groupBy("_group")


def _series(frames: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray, list[tuple]]:
    """A group's rows by series and time, where each series begins (and the last ends), and the series' (device, metric)."""
    rows = pd.concat(list(frames), ignore_index=True)
    of = rows.groupby(["device_id", "metric_key"], sort=False, dropna=False).ngroup().to_numpy()
    order = np.lexsort((rows["time"].fillna(pd.Timestamp.max).to_numpy(), of))
    rows, of = rows.iloc[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    heads = rows.iloc[first]
    names = [(None if pd.isna(d) else int(d), None if pd.isna(m) else m) for d, m in zip(heads["device_id"], heads["metric_key"], strict=True)]
    return rows, np.append(first, len(rows)), names


def anomaly_alarms(rows: DataFrame, profiles: pd.DataFrame | None = None, sensitivity: int = 3, cooldown_minutes: float = 10) -> DataFrame:
    """Alarms of readings whose |z| is over the threshold: LEVEL_SHIFT from the sixth in a row, else SPIKE
    or DROP; within the cooldown only if half as strong again as the last.

    ``profiles``: metric_key, centre and sigma, one row a metric; without, the rows have
    columns centre and sigma (``with_baseline``). State: run length,
    time and strength of the last alarm, of each device and metric that has one of them; only readings over the threshold
    are gone through one by one.
    """
    base = None if profiles is None else {r.metric_key: (r.centre, max(r.sigma, 1e-9)) for r in profiles.itertuples()}
    limit = SENSITIVITY[sensitivity]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {(d, m): rest for d, m, *rest in zip(*state.get, strict=True)} if state.exists else {}
        rows, first, names = _series(frames)
        if base is None:
            centre, sigma = rows["centre"].to_numpy(float), np.maximum(rows["sigma"].to_numpy(float), 1e-9)
        else:
            each = [base.get(m, (0.0, np.inf)) for _, m in names]
            centre, sigma = (np.repeat([x[k] for x in each], np.diff(first)) for k in (0, 1))
        value, at = rows["value"].to_numpy(float), rows["time"].to_numpy().astype("datetime64[us]").astype(np.int64)
        z = (value - centre) / sigma
        over = np.abs(z) > limit
        place, of = np.arange(len(z)), np.repeat(np.arange(len(names)), np.diff(first))
        before = np.array([known.get(name, (0,))[0] for name in names])
        calm = np.maximum.accumulate(np.where(over, -1, place))
        run = np.where(over, np.where(calm >= first[of], place - calm, place - first[of] + 1 + before[of]), 0)
        for name, n in zip(names, run[first[1:] - 1].tolist(), strict=True):
            if name in known or n:
                known[name] = [n, *known.get(name, (0, None, 0.0))[1:]]
        out, hits = [], np.flatnonzero(over)
        for i, s, n, strong in zip(hits.tolist(), of[hits].tolist(), run[hits].tolist(), z[hits].tolist(), strict=True):
            kept = known.setdefault(names[s], [0, None, 0.0])
            _, last, strength = kept
            if last is not None and at[i] - last < cooldown_minutes * 60e6 and abs(strong) < 1.5 * strength:
                continue
            kept[1:] = int(at[i]), abs(strong)
            out.append((*names[s], rows["time"].iat[i], float(value[i]), round(abs(strong), 4), "LEVEL_SHIFT" if n >= 6 else "SPIKE" if strong > 0 else "DROP"))
        state.update(tuple(list(x) for x in zip(*((*name, *kept) for name, kept in known.items()), strict=True)) or ([],) * 5)
        yield pd.DataFrame(out, columns=["device_id", "metric_key", "time", "value", "score", "kind"])

    return _grouped(rows).applyInPandasWithState(
        step, "device_id long, metric_key string, time timestamp, value double, score double, kind string",
        "device array<long>, metric array<string>, run array<int>, last array<long>, strength array<double>", "append", GroupStateTimeout.NoTimeout,
    )


#: Slopes that are held at a time.
SLOPES = 1 << 20


def _trends(times: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(slope, level at the end, noise) of each window start to end, by ``theil_sen``: windows of one length together. Noise: the
    spread of what the trend leaves, in what it makes of a step."""
    out = np.full((3, len(start)), np.nan)
    for n in np.unique(end - start + 1):
        mine, (i, j) = np.flatnonzero(end - start + 1 == n), np.triu_indices(n, 1)
        for some in np.array_split(mine, -(-len(mine) * len(i) // SLOPES)):
            at = start[some][:, None] + np.arange(n)
            x, y = times[at] - times[end[some]][:, None], values[at]
            dx = x[:, j] - x[:, i]
            with np.errstate(all="ignore"):
                slope = np.median((y[:, j] - y[:, i]) / dx, axis=1)
            for k in np.flatnonzero((dx == 0).any(1)):
                slope[k] = theil_sen(x[k], y[k])[0]
            level = np.median(y, axis=1) - slope * np.median(x, axis=1)
            rest = y - (level[:, None] + slope[:, None] * x)
            step = np.median(np.diff(x), axis=1)
            spread = stats.MAD * np.median(np.abs(rest - np.median(rest, axis=1)[:, None]), axis=1)
            with np.errstate(all="ignore"):
                out[:, some] = slope, level, np.where(step != 0, spread / (np.abs(slope) * step), np.inf)
    return out


def eta_alarms(rows: DataFrame, threshold: float, up: bool = True, window_minutes: float = 30, horizon_minutes: float = 240) -> DataFrame:
    """Minutes until each series' trend over the last minutes meets a threshold, when that
    figure or its confidence changes, or when the trend was unpredictable in between. State: the last minutes of each
    series and what was said last."""
    sign = 1 if up else -1

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {}
        if state.exists:
            devices, metrics, counts, old_times, old_values, *said = state.get
            upto = np.cumsum([0, *counts]).tolist()
            known = {(d, m): (old_times[a:b], old_values[a:b], *x) for d, m, a, b, *x in zip(devices, metrics, upto, upto[1:], *said, strict=False)}
        rows, first, names = _series(frames)
        at_new, value_new = (rows["time"].to_numpy().astype("datetime64[us]").astype(np.int64) * 1000 / 6e10).tolist(), rows["value"].astype(float).tolist()
        times, values, start, end, bounds = [], [], [], [], []
        for name, a, b in zip(names, first.tolist(), first[1:].tolist(), strict=False):
            old = known.get(name, ([], [], None, None))
            low = len(times)
            times += old[0]
            values += old[1]
            i = len(times)
            times += at_new[a:b]
            values += value_new[a:b]
            for i in range(i, len(times)):
                while not times[low] > times[i] - window_minutes:
                    low += 1
                start.append(low)
                end.append(i)
            bounds.append((low, len(times)))
        t, y, start, end = np.array(times), np.array(values), np.array(start), np.array(end)
        long = np.flatnonzero((end - start >= 2) & ~(t[end] - t[start] < 10))
        slope, level, noise = _trends(t, y, start[long], end[long])
        gap = threshold - level
        with np.errstate(all="ignore"):
            left = np.where(sign * gap <= 0, 0.0, gap / slope)
        clear = np.zeros(len(end), bool)
        clear[long] = (np.abs(slope) >= 1e-12) & ~((sign * gap > 0) & (sign * slope <= 0))
        told = np.full(len(end), np.inf)
        told[long] = np.rint(np.where(left <= horizon_minutes, left, np.inf))
        sure = np.full(len(end), 2)
        sure[long] = np.where(noise < 0.5, 0, np.where(noise < 1.5, 1, 2))
        clear, told, sure, out = clear.tolist(), told.tolist(), sure.tolist(), []
        for name, a, b, (low, high) in zip(names, first.tolist(), first[1:].tolist(), bounds, strict=False):
            last, how = known.get(name, ([], [], None, None))[2:]
            for k in range(a, b):
                if not clear[k]:
                    last = None
                elif told[k] < np.inf and (told[k], SURE[sure[k]]) != (last, how):
                    last, how = int(told[k]), SURE[sure[k]]
                    out.append((*name, k, last, how))
            known[name] = times[low:high], values[low:high], last, how
        kept = list(known.values())
        state.update((
            [d for d, _ in known], [m for _, m in known], [len(x[0]) for x in kept], [v for x in kept for v in x[0]], [v for x in kept for v in x[1]], [x[2] for x in kept], [x[3] for x in kept],
        ))
        found = pd.DataFrame(out, columns=["device_id", "metric_key", "time", "minutes_left", "confidence"])
        found["time"] = rows["time"].iloc[found["time"].astype(int)].to_numpy()
        yield found

    return _grouped(rows).applyInPandasWithState(
        step, "device_id long, metric_key string, time timestamp, minutes_left int, confidence string",
        "device array<long>, metric array<string>, n array<int>, times array<double>, values array<double>, said array<int>, sure array<string>", "append", GroupStateTimeout.NoTimeout,
    )


SURE = ["HIGH", "MEDIUM", "LOW"]


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it has written (exactly once by its checkpoint); its folder is
    deleted, whether it succeeds or not."""
    folder = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema, spark = stream.schema, stream.sparkSession
    try:
        return _run_once(stream, folder, mode, schema)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _run_once(stream: DataFrame, folder: str, mode: str, schema: StructType) -> DataFrame:
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/rows")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return written(stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows"))


def warehouse(spark: SparkSession) -> str:
    """Where streams of queries keep state and rows: the shared folder, or the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
