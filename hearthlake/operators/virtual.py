"""The virtual occupancy sensor: a state for each space and tick of five minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.operators.fill import interpolate
from hearthlake.operators.joins import nearest

#: Seconds of a tick, of what it looks back on, and of how far a value may lie from its place.
STEP, LOOKBACK, NEAR = 300, 86_400, 900
LEAST_SIGNALS = 2
SIGNALS = ["pir", "co2", "noise", "illuminance"]
TICK = ["organization_id", "space_id", "bucket"]


def open_ticks(sensors: DataFrame, ledger: DataFrame, now: str, count: int = 1, every: int = STEP) -> DataFrame:
    """(organization_id, space_id, bucket): the last ``count`` ticks (``every`` seconds apart, whole five minutes) up to ``now`` of each sensor, but
    those that the ledger has. A tick comes whether there was input or not."""
    last = F.floor(F.unix_seconds(F.lit(now).cast("timestamp")) / STEP) * STEP
    seconds = F.explode(F.sequence(last - (count - 1) * every, last, F.lit(every)))
    asked = sensors.select("organization_id", "space_id").distinct().withColumn("_s", seconds)
    return asked.select("organization_id", "space_id", F.timestamp_seconds("_s").alias("bucket")).join(ledger.select(*TICK), TICK, "left_anti")


def signals(asked: DataFrame, sensors: DataFrame, readings: DataFrame) -> DataFrame:
    """(organization_id, space_id, bucket, signal, time, value): for each tick the readings of the 24 hours up to it (ends included), of each signal those of the device
    with most of them, of equals the first listed.

    sensors: organization_id, space_id, signal, ordinal, device_id, metric_key. A reading meets the ticks that look back on it by hours, and each
    tick is asked for once, so work grows with readings times ticks a day, not with the span between ticks.
    """
    first, last = asked.agg(F.min("bucket"), F.max("bucket")).first()
    good = readings.where((F.col("quality") == 0) & F.col("value").isNotNull() & ~F.col("is_virtual"))
    if first is not None:
        good = good.where((F.col("time") >= F.lit(first) - F.make_dt_interval(secs=F.lit(LOOKBACK))) & (F.col("time") <= F.lit(last)))
    inputs = sensors.where(F.col("signal").isin(SIGNALS)).select("organization_id", "space_id", "signal", "ordinal", "device_id", "metric_key")
    own = good.select("device_id", "metric_key", "time", F.col("value").cast("double").alias("value")).join(inputs, ["device_id", "metric_key"])
    hour = F.floor(F.unix_seconds("time") / 3600)
    b = F.unix_seconds("bucket")
    back = asked.withColumn("_hour", F.explode(F.sequence(F.floor((b - LOOKBACK) / 3600), F.floor(b / 3600))))
    met = own.withColumn("_hour", hour).join(back, ["organization_id", "space_id", "_hour"]).where((F.col("time") <= F.col("bucket")) & (F.unix_micros("time") >= (b - LOOKBACK) * 1_000_000))
    devices = met.groupBy(*TICK, "signal", "device_id").agg(F.count("*").alias("n"), F.min("ordinal").alias("ordinal"))
    best = devices.groupBy(*TICK, "signal").agg(F.max_by(F.struct("device_id", "ordinal"), F.struct("n", -F.col("ordinal"))).alias("d"))
    best = best.select(*TICK, "signal", F.col("d.device_id").alias("device_id"), F.col("d.ordinal").alias("ordinal"))
    return met.drop("ordinal").join(best, [*TICK, "signal", "device_id"]).select(*TICK, "signal", "ordinal", "time", "value")


def occupancy(asked: DataFrame, sensors: DataFrame, readings: DataFrame) -> DataFrame:
    """(organization_id, space_id, bucket, status, value, missing): for each tick of ``asked`` whether the space is occupied (1 or 0) at its end.

    The signals of the last 24 hours are brought to the times of the activity sensor (else of the first listed), the nearest value within 15
    minutes, CO2 on the line where it is missing. The last of these times decides: activity twice within five minutes (2), CO2 that rose by over 3 ppm a
    minute in ten minutes or is 250 above its 5th percentile (1; 2 without activity), noise 8 and light 100 above their 10th (1 each); half of the weights of the
    signals there are is enough. With fewer than two signals the status is INPUT_MISSING, there is no value, and ``missing`` lists the signals without values.
    Steps of ten and five minutes are counted in the median step of those times, by tick.
    """
    seen = signals(asked, sensors, readings)
    have = seen.groupBy(*TICK).agg(F.collect_set("signal").alias("have"), F.min_by("signal", F.struct(F.col("signal") != "pir", "ordinal")).alias("base"))
    enough = have.where(F.size("have") >= LEAST_SIGNALS)
    rows = seen.join(enough, TICK)
    base = rows.where("signal = base").groupBy(*TICK, "time").agg(F.max("value").alias("own"), F.first("base").alias("base"))
    by = Window.partitionBy(*TICK).orderBy("time")
    base = base.withColumns({"i": F.row_number().over(by), "_step": F.unix_micros("time") - F.lag(F.unix_micros("time")).over(by)})
    kinds = base.groupBy(*TICK).agg(F.count("*").alias("n"), (F.coalesce(F.percentile("_step", F.lit(0.5)), F.lit(3.6e9)) / 6e7).alias("step"))
    frame = base.drop("_step")
    for signal in ("co2", "noise", "illuminance"):
        frame = nearest(frame, rows.where((F.col("signal") == signal) & (F.col("base") != signal)), TICK, NEAR, name=f"_{signal}")
        frame = frame.withColumn(signal, F.when(F.col("base") == signal, F.col("own")).otherwise(F.col(f"_{signal}"))).drop(f"_{signal}")
    frame = frame.withColumn("pir", F.when(F.col("base") == "pir", F.col("own")))
    frame = interpolate(frame, TICK, "co2").join(kinds, TICK)

    def steps(minutes: int):
        return F.when(F.col("step") > 0, F.greatest(F.lit(1), F.rint(minutes / F.col("step")).cast("int"))).otherwise(1)

    # a centred window ends with the last row, half of it lies before
    recent = steps(5) - F.floor((steps(5) - 1) / 2)
    i, n = F.col("i"), F.col("n")
    facts = frame.groupBy(*TICK, "n", "step").agg(
        F.count_if((i > n - recent) & (F.col("pir") > 0)).alias("active"), F.max(F.when(i == n, F.col("co2"))).alias("co2"), F.max(F.when(i == n - steps(10), F.col("co2"))).alias("co2_before"),
        F.percentile("co2", F.lit(0.05)).alias("co2_low"), *(F.max(F.when(i == n, F.col(s))).alias(s) for s in ("noise", "illuminance")), *(F.percentile(s, F.lit(0.1)).alias(f"{s}_low") for s in ("noise", "illuminance")),
    ).join(enough, TICK)
    slope = (F.col("co2") - F.col("co2_before")) / (steps(10) * F.col("step"))
    is_in = {s: F.array_contains("have", s) for s in SIGNALS}
    evidence = {
        "pir": (F.lit(2.0), F.col("active") >= 2), "co2": (F.when(is_in["pir"], 1.0).otherwise(2.0), (F.coalesce(slope, F.lit(0.0)) > 3) | (F.col("co2") > F.col("co2_low") + 250)),
        "noise": (F.lit(1.0), F.col("noise") > F.col("noise_low") + 8), "illuminance": (F.lit(1.0), F.col("illuminance") > F.col("illuminance_low") + 100),
    }
    total = sum((F.when(is_in[s], w).otherwise(0.0) for s, (w, _) in evidence.items()), F.lit(0.0))
    score = sum((F.when(is_in[s] & F.coalesce(e, F.lit(False)), w).otherwise(0.0) for s, (w, e) in evidence.items()), F.lit(0.0))
    states = facts.select(*TICK, (score / total >= 0.5).cast("double").alias("value"))
    listed = sensors.where(F.col("signal").isin(SIGNALS)).groupBy("organization_id", "space_id").agg(F.collect_set("signal").alias("listed"))
    out = asked.select(*TICK).join(have.select(*TICK, "have"), TICK, "left").join(states, TICK, "left").join(listed, ["organization_id", "space_id"], "left")
    have_any = F.coalesce("have", F.array().cast("array<string>"))
    without = F.array_except(F.coalesce("listed", F.array().cast("array<string>")), have_any)
    without = F.when(F.size(without) > 0, without).otherwise(F.array_except(F.array(*map(F.lit, SIGNALS)), have_any))
    ok = F.col("value").isNotNull()
    return out.select(*TICK, F.when(ok, "OK").otherwise("INPUT_MISSING").alias("status"), "value", F.when(~ok, F.array_sort(without)).alias("missing"))


def state_at(states: DataFrame, times: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """``times`` (keys, time) with value: the last state of ``states`` (keys, bucket, value) at or before it, null where there is none.
    Times without any input get the state that still holds."""
    both = states.where("value IS NOT NULL").select(*keys, F.col("bucket").alias(time), "value", F.lit(0).alias("_asked")).unionByName(times.select(*keys, time, F.lit(None).cast("double").alias("value"), F.lit(1).alias("_asked")))
    by = Window.partitionBy(*keys).orderBy(time, "_asked").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", ignorenulls=True).over(by)).where("_asked = 1").drop("_asked")
