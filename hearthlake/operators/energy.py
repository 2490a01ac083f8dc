"""Energy accounting: from samples to usage, cost, carbon and intensity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.functions.numbers import carbon_tons, cooling_degrees, heating_degrees, ratio
from hearthlake.functions.times import ZONE, local_date, minute_of_day, minutes_of, month_start, weekday
from hearthlake.operators.joins import split_hours, valid_on
from hearthlake.operators.windows import merge_intervals, ordered

#: A gap of more than this many minutes is an estimate.
GAP_MINUTES = 15
#: Which source of a space and day counts, best first.
PRIORITY = ["METERED", "ESTIMATED", "BILL_ALLOCATED"]


def _between(samples: DataFrame, keys: list[str], kwh: Column, value: str, time: str) -> DataFrame:
    by = ordered(keys, time)
    rows = samples.withColumns({"end": F.lead(time).over(by), "_next": F.lead(value).over(by)})
    hours = (F.unix_micros("end") - F.unix_micros(time)) / 3.6e9
    rows = rows.withColumn("_h", hours).where("_h > 0")
    return rows.select(*keys, F.col(time).alias("start"), "end", kwh.alias("kwh"), (F.col("_h") * 60 > GAP_MINUTES).alias("estimated"))


def integrate_power(samples: DataFrame, keys: list[str], value: str = "value", time: str = "time") -> DataFrame:
    """Intervals between neighbouring samples of power (W): kWh by the trapezoid rule."""
    return _between(samples, keys, (F.col(value) + F.col("_next")) / 2 / 1000 * F.col("_h"), value, time)


def difference_counter(samples: DataFrame, keys: list[str], value: str = "value", time: str = "time") -> DataFrame:
    """Intervals between neighbouring readings of a counter (kWh); a step down counts nothing."""
    return _between(samples, keys, F.greatest(F.col("_next") - F.col(value), F.lit(0.0)), value, time)


def hourly(intervals: DataFrame, keys: list[str]) -> DataFrame:
    return split_hours(intervals, keys)


def total(intervals: DataFrame, keys: list[str]) -> DataFrame:
    return intervals.groupBy(*keys).agg(F.sum("kwh").alias("kwh"), F.bool_or("estimated").alias("estimated"))


def rated_usage(rated_w: Column, standby_w: Column, on_seconds: Column, span_seconds: Column) -> Column:
    """kWh of a device that was on for a part of a span and on standby for the rest."""
    on = F.least(F.greatest(on_seconds, F.lit(0.0)), span_seconds)
    return (rated_w * on + standby_w * (span_seconds - on)) / 3.6e6


def running_seconds(runs: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """(keys, on_seconds) of runs within [start, end), overlaps counted once."""
    clipped = runs.withColumns({"start": F.greatest("start", start), "end": F.least("end", end)}).where("start < end")
    merged = merge_intervals(clipped.select(*keys, "start", "end"), keys)
    return merged.groupBy(*keys).agg(F.sum((F.unix_micros("end") - F.unix_micros("start")) / 1e6).alias("on_seconds"))


def time_of_use_rate(usage: DataFrame, bands: DataFrame, tariff: str = "tariff_id", time: str = "hour", holiday: Column | None = None, zone: str = ZONE) -> DataFrame:
    """``usage`` with rate: that of the first band (season, then band) of its tariff that fits month, day type and minute.

    bands: tariff_id, ordinal, months, day_type (WEEKDAY, WEEKEND, HOLIDAY or ALL), from_time, to_time, rate.
    """
    holiday = F.lit(False) if holiday is None else holiday
    day = F.when(holiday, "HOLIDAY").when(weekday(F.col(time), zone) >= 5, "WEEKEND").otherwise("WEEKDAY")
    rows = usage.withColumns({"_id": F.monotonically_increasing_id(), "_day": day, "_minute": minute_of_day(F.col(time), zone), "_month": F.month(F.from_utc_timestamp(time, zone))})
    b = bands.select(F.col("tariff_id").alias("_t"), "ordinal", "months", "day_type", minutes_of(F.col("from_time")).alias("_f"), minutes_of(F.col("to_time")).alias("_to"), "rate")
    on = (F.col(tariff) == F.col("_t")) & F.array_contains("months", F.col("_month")) & F.col("day_type").isin(F.lit("ALL"), F.col("_day"))
    found = rows.join(b, on & (F.col("_minute") >= F.col("_f")) & (F.col("_minute") < F.col("_to")), "left")
    return found.groupBy("_id", *usage.columns).agg(F.min_by("rate", "ordinal").alias("rate")).drop("_id")


def cost(priced: DataFrame, keys: list[str]) -> DataFrame:
    """krw of what has a rate, and kWh of what has none; krw is null where nothing has one."""
    return priced.groupBy(*keys).agg(
        F.sum(F.col("kwh") * F.col("rate")).alias("krw"), F.sum(F.when(F.col("rate").isNull(), F.col("kwh")).otherwise(0.0)).alias("unpriced_kwh"), F.sum("kwh").alias("kwh")
    )


def base_charges(days: DataFrame, tariffs: DataFrame, site: str, day: str = "day") -> DataFrame:
    """(site, month, base_krw): the base charge in force at the start of each month that has days."""
    months = days.select(site, month_start(F.col(day)).alias("month")).distinct()
    return valid_on(months, tariffs, "month", site, ["base_krw"])


def carbon(usage: DataFrame, factors: DataFrame, keys: list[str], site: str = "site_id", day: str = "day") -> DataFrame:
    """(keys, tco2): kWh / 1000 times the factor of the day; days before any factor count nothing."""
    rows = valid_on(usage, factors, day, site, ["factor"])
    return rows.groupBy(*keys).agg(carbon_tons(F.sum(F.col("kwh") / 1000 * F.col("factor"))).alias("tco2"))


def intensity(kwh: Column, area: Column) -> Column:
    """kWh a square metre; null without area."""
    return F.when(area > 0, kwh / area)


def intensity_reason(area: Column) -> Column:
    """Why there is no ``intensity``; null where there is one."""
    return F.when(F.coalesce(area <= 0, F.lit(True)), "NO_AREA")


def occupied_intensity(kwh: Column, occupied: Column, scheduled: Column) -> Column:
    """Struct (value, reason, source): kWh an occupied hour, of estimated occupancy before the schedule's hours."""
    source = F.when(occupied > 0, "OCCUPANCY_EST").when(scheduled > 0, "OPERATING_SCHEDULE")
    hours = F.when(occupied > 0, occupied).when(scheduled > 0, scheduled)
    return F.struct((kwh / hours).alias("value"), F.when(source.isNull(), "NO_OCCUPANCY").alias("reason"), source.alias("source"))


def pick_source(daily: DataFrame, space: str = "space_id") -> DataFrame:
    """One row a space and day: the best kind of source that it has, its rows summed."""
    kinds = F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), F.col("source_kind"))
    sums = daily.groupBy(space, "day", "source_kind").agg(
        F.sum("kwh").alias("kwh"), F.sum("krw").alias("krw"), F.sum("tco2").alias("tco2"), F.sum(F.when(F.col("includes_estimate"), F.col("kwh")).otherwise(0.0)).alias("estimated_kwh")
    )
    by = Window.partitionBy(space, "day").orderBy("_k")
    return sums.withColumn("_k", kinds).where("_k > 0").withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n", "_k")


def estimated_ratio(estimated: Column, kwh: Column) -> Column:
    return F.when(kwh > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), estimated / kwh)))


def daily_temperature(rows: DataFrame, keys: list[str], value: str = "value", time: str = "time", zone: str = ZONE) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, local_date(F.col(time), zone).alias("day")).agg(F.avg(value).alias("temperature"))


def degree_days(temperatures: DataFrame, cool: float = 24.0, heat: float = 18.0) -> DataFrame:
    t = F.col("temperature")
    return temperatures.withColumns({"cdd": cooling_degrees(t, cool), "hdd": heating_degrees(t, heat)})


def average_baseline(days: DataFrame, keys: list[str], least_days: int = 30) -> DataFrame:
    return days.groupBy(*keys).agg(F.avg("kwh").alias("intercept"), F.count("*").alias("days")).where(F.col("days") >= least_days)


def degree_day_baseline(days: DataFrame, keys: list[str], least_days: int = 30) -> DataFrame:
    """(keys, intercept, cdd, hdd, r2, days, low_fit) of kwh = intercept + cdd * CDD + hdd * HDD by least squares.

    One aggregation gives the sums of the normal equations; a regressor that is 0
    on all days has coefficient 0. All series at once, without collecting a day.
    """
    c, h, y = F.col("cdd_days"), F.col("hdd_days"), F.col("kwh")
    s = days.groupBy(*keys).agg(
        F.count("*").alias("days"), F.covar_pop(c, c).alias("cc"), F.covar_pop(h, h).alias("hh"), F.covar_pop(c, h).alias("ch"), F.covar_pop(c, y).alias("cy"), F.covar_pop(h, y).alias("hy"),
        F.covar_pop(y, y).alias("yy"), F.avg(c).alias("mc"), F.avg(h).alias("mh"), F.avg(y).alias("my"),
    ).where(F.col("days") >= least_days)
    det = F.col("cc") * F.col("hh") - F.col("ch") ** 2
    both = det > 1e-12 * F.col("cc") * F.col("hh") + 1e-18
    hdd = F.when(both, (F.col("hy") * F.col("cc") - F.col("cy") * F.col("ch")) / F.when(both, det)).when((F.col("cc") <= 0) & (F.col("hh") > 0), F.col("hy") / F.nullif("hh", F.lit(0.0))).otherwise(0.0)
    cdd = F.when(both, (F.col("cy") * F.col("hh") - F.col("hy") * F.col("ch")) / F.when(both, det)).when(F.col("cc") > 0, F.col("cy") / F.nullif("cc", F.lit(0.0))).otherwise(0.0)
    fit = s.withColumns({"cdd": cdd, "hdd": hdd})
    fit = fit.withColumn("intercept", F.col("my") - F.col("cdd") * F.col("mc") - F.col("hdd") * F.col("mh"))
    rest = F.col("yy") - F.col("cdd") * F.col("cy") - F.col("hdd") * F.col("hy")
    r2 = F.bround(F.when(F.col("yy") > 0, 1 - rest / F.nullif("yy", F.lit(0.0))).otherwise(1.0), 4)
    return fit.withColumn("r2", r2).select(*keys, "intercept", "cdd", "hdd", "r2", "days", (F.col("r2") < 0.5).alias("low_fit"))


def predict_baseline(days: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted kWh of each day; days without temperature drop out."""
    rows = days.where("cdd_days IS NOT NULL AND hdd_days IS NOT NULL")
    rows = rows.join(model, keys) if keys else rows.join(F.broadcast(model), F.lit(True))
    return rows.withColumn("predicted", F.col("intercept") + F.col("cdd") * F.col("cdd_days") + F.col("hdd") * F.col("hdd_days"))


def normalized_difference(actual: Column, predicted: Column) -> Column:
    return F.when(predicted > 0, (actual - predicted) / F.nullif(predicted, F.lit(0.0)))


def compare(now: DataFrame, before: DataFrame, keys: list[str], value: str = "kwh") -> DataFrame:
    """Totals of two periods side by side, with difference and its ratio to the earlier."""
    a, b = (x.groupBy(*keys).agg(F.sum(value).alias(n)) for x, n in ((now, "now"), (before, "before")))
    out = a.join(b, keys, "full")
    return out.withColumns({"diff": F.col("now") - F.col("before"), "diff_ratio": ratio(F.col("now") - F.col("before"), F.col("before"))})
