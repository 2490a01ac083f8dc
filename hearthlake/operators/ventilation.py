"""Air changes of rooms: which sensors count, fits of CO2's decay, the best fit of a day, and the air that moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.functions.times import ZONE, local_date
from hearthlake.operators import stats

#: ppm outdoors, ppm above it that a decay starts with at least, its least minutes, and the least R2 of a fit.
OUTDOOR, AMPLITUDE, MINUTES, FIT = 420.0, 200.0, 30.0, 0.8


def enabled(sensors: DataFrame, kind: str) -> DataFrame:
    """Virtual sensors of a kind that are on (where nothing is said, they are); those of occupancy must name an output device."""
    on = sensors.where((F.col("kind") == kind) & F.coalesce("enabled", F.lit(True)))
    return on.where("output_device_id IS NOT NULL") if kind == "OCCUPANCY" else on


def inputs(sensors: DataFrame, metric: str) -> DataFrame:
    """(space_id, device_id, place): the devices of a sensor's first input of ``metric``, numbered from 0 as they stand there;
    a sensor without any has one row of a null device. ``sensors`` has inputs: array of (metric_key, device_ids)."""
    first = F.filter("inputs", lambda x: x["metric_key"] == metric)
    found = sensors.withColumn("_ids", F.when(F.size(first) > 0, F.get(first, 0)["device_ids"]))
    return found.select("space_id", F.posexplode_outer("_ids").alias("place", "device_id")).select("space_id", "device_id", "place")


def decay_fits(rows: DataFrame, keys: list[str], outdoor: float = OUTDOOR, amplitude: float = AMPLITUDE, minutes: float = MINUTES, fit: float = FIT, value: str = "value", time: str = "time") -> DataFrame:
    """(keys, ach, ci_low, ci_high, r2, points, decay_from, decay_to, reason): the least-squares line of ln(ppm - outdoors)
    over hours in each stretch of ``keys``, with the 95 % interval of Student's t.

    The reason stands where there is no estimate: TOO_SHORT (fewer than three values or ``minutes``), LOW_AMPLITUDE (the
    median of the first three values is less than ``amplitude`` above outdoors), LOW_FIT (no fall, or R2 below ``fit``).
    """
    rows = rows.where(F.col(value).isNotNull() & F.col(time).isNotNull())
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(time, value))
    above = F.col(value) - outdoor
    rows = rows.withColumns({"_start": F.when(nth <= 3, F.col(value)), "_h": (F.unix_micros(time) - F.min(F.unix_micros(time)).over(Window.partitionBy(*keys))) / 3.6e9, "_ln": F.when(above > 0, F.ln(above))})
    line = stats.bounded_line(rows, keys, "_h", "_ln", also=[F.count("*").alias("_n"), stats.median("_start").alias("_first"), F.min(time).alias("decay_from"), F.max(time).alias("decay_to")])
    lasts = (F.unix_micros("decay_to") - F.unix_micros("decay_from")) / 6e7
    r2 = F.col("r2")
    reason = (
        F.when((F.col("_n") < 3) | (lasts < minutes), "TOO_SHORT").when(F.col("_first") - outdoor < amplitude, "LOW_AMPLITUDE")
        .when((F.col("n") < 3) | F.col("slope").isNull() | (F.col("slope") >= 0) | (r2 < fit), "LOW_FIT")
    )
    line = line.withColumn("reason", reason)
    good = {c: F.when(F.col("reason").isNull(), x) for c, x in {
        "ach": F.round(-F.col("slope"), 4), "ci_low": F.round(-F.col("high"), 4), "ci_high": F.round(-F.col("low"), 4), "r2": F.round(r2, 4), "points": F.col("n"), "decay_from": F.col("decay_from"), "decay_to": F.col("decay_to"),
    }.items()}
    return line.select(*keys, *[x.alias(c) for c, x in good.items()], "reason")


def best_of_day(fits: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """One row of each ``keys``: the estimate of the highest R2, of equals the first by ``place``; the first's reason where none has one."""
    rank = F.struct(F.col("ach").isNotNull(), F.coalesce("r2", F.lit(-1.0)), -F.col(place))
    columns = [c for c in fits.columns if c not in keys]
    return fits.groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("_b")).select(*keys, "_b.*")


def volume(area: Column, height: Column) -> Column:
    """Cubic metres; null without area or height."""
    return F.when((area > 0) & (height > 0), area * height)


def ventilation(ach: Column, cubic_metres: Column) -> Column:
    """Cubic metres an hour."""
    return F.round(ach * cubic_metres, 2)


def air_change_days(samples: DataFrame, sensors: DataFrame, spaces: DataFrame, first: str, last: str, metric: str = "co2", zone: str = ZONE, **limits: float) -> DataFrame:
    """Best estimate of each space with an enabled sensor and local day from ``first`` to ``last`` (both included), with its
    device, status and ventilation_m3h.

    A day of a device is one stretch: it is not cut into the decays that it may hold.
    A sensor that names no device of the metric has INPUT_MISSING on each day; a device without samples of a day has NO_DATA.
    ``samples``: device_id, metric_key, time, value; ``spaces``: space_id, area_m2, height_m.
    """
    wanted = inputs(enabled(sensors, "ACH"), metric)
    day = local_date(F.col("time"), zone)
    span = F.lit(first).cast("timestamp") - F.expr("INTERVAL 1 DAY"), F.lit(last).cast("timestamp") + F.expr("INTERVAL 2 DAYS")
    rows = samples.where((F.col("metric_key") == metric) & (F.col("time") >= span[0]) & (F.col("time") < span[1])).withColumn("day", day)
    rows = rows.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    fits = decay_fits(rows.join(wanted.select("device_id").distinct(), "device_id", "left_semi"), ["device_id", "day"], **limits)
    # configured devices by days of a period: as many rows as the result's inputs, not as samples
    every = wanted.withColumn("day", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    found = every.join(fits, ["device_id", "day"], "left")
    found = found.withColumn("reason", F.when(F.col("device_id").isNull(), None).when(F.col("ach").isNull(), F.coalesce("reason", F.lit("NO_DATA"))))
    best = best_of_day(found.withColumn("place", F.coalesce("place", F.lit(0))), ["space_id", "day"])
    best = best.withColumn("status", F.when(F.col("device_id").isNull(), "INPUT_MISSING").otherwise("OK"))
    sized = best.join(spaces.select("space_id", "area_m2", "height_m"), "space_id", "left")
    return sized.withColumn("ventilation_m3h", ventilation(F.col("ach"), volume(F.col("area_m2"), F.col("height_m")))).drop("place", "area_m2", "height_m")
