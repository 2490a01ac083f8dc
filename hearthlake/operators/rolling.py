"""Forecast validation from several origins, and bands of a forecast by its errors.

These functions go round any forecaster: one that takes training rows and targets of
groups (series and origin) and gives a prediction for each target.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.operators.fill import interpolate
from hearthlake.operators.stats import median
from hearthlake.operators.windows import MAD, ordered

#: (training rows: groups, i, value; targets: groups, i; groups) -> targets with predicted
Forecaster = Callable[[DataFrame, DataFrame, list[str]], DataFrame]
#: Quantiles of the normal distribution that belong to the bands.
BANDS = {"80": (0.8, 1.2816), "95": (0.95, 1.96)}


def numbered(rows: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """``rows`` with i, their place in the series from 0."""
    return rows.withColumn("i", F.row_number().over(ordered(keys, time)) - 1)


def origins(rows: DataFrame, keys: list[str], horizon: int, count: int = 4, share: float = 0.2, period: int = 0) -> DataFrame:
    """(keys, origin, steps): where validation forecasts of each series begin, and how far they go.

    They lie in the last ``share`` of the series (or the last ``horizon`` rows, if more), evenly, and leave
    two periods and ten rows at least before them.
    """
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    hold = F.greatest(F.lit(horizon), F.floor(F.col("n") * share))
    gap = F.greatest(F.lit(1), F.floor((hold - horizon) / max(1, count - 1)))
    at = n.select(*keys, "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: (F.col("n") - hold + k * gap).cast("int")))).alias("origin"))
    at = at.where((F.col("origin") + 1 <= F.col("n") - 1) & (F.col("origin") >= max(10, 2 * period)))
    return at.select(*keys, "origin", F.least(F.lit(horizon), F.col("n") - F.col("origin")).cast("int").alias("steps"))


def split(rows: DataFrame, starts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Training rows and targets (keys, origin, i, value) of each origin. A series' rows are repeated for its few origins."""
    both = rows.select(*keys, "i", "value").join(starts, keys)
    train = both.where("i < origin").drop("steps")
    return train, both.where("i >= origin AND i < origin + steps").drop("steps")


def validate(rows: DataFrame, keys: list[str], horizon: int, forecaster: Forecaster, count: int = 4, share: float = 0.2, period: int = 0) -> DataFrame:
    """(keys, origin, step, actual, predicted) of forecasts from each origin."""
    train, targets = split(rows, origins(rows, keys, horizon, count, share, period), keys)
    found = forecaster(train, targets.select(*keys, "origin", "i"), [*keys, "origin"])
    out = targets.join(found, [*keys, "origin", "i"])
    return out.select(*keys, "origin", (F.col("i") - F.col("origin") + 1).alias("step"), F.col("value").alias("actual"), "predicted")


def seasonal_mean(period: int) -> Forecaster:
    """The mean of the training rows at the same place of the period; where there is none, of all."""

    def run(train: DataFrame, targets: DataFrame, groups: list[str]) -> DataFrame:
        place = F.pmod(F.col("i"), F.lit(period))
        means = train.groupBy(*groups, place.alias("_place")).agg(F.avg("value").alias("_m"))
        every = train.groupBy(*groups).agg(F.avg("value").alias("_all"))
        found = targets.withColumn("_place", place).join(means, [*groups, "_place"], "left").join(every, groups, "left")
        return found.withColumn("predicted", F.coalesce("_m", "_all")).drop("_place", "_m", "_all")

    return run


def per_group(predict: Callable, kind: str = "double") -> Forecaster:
    """A forecaster of ``predict(values, steps) -> predictions`` (numpy), a group a task; a group is one series up to an origin."""

    def run(train: DataFrame, targets: DataFrame, groups: list[str]) -> DataFrame:
        schema = f"{', '.join(f'`{g}` {train.schema[g].dataType.simpleString()}' for g in groups)}, i int, predicted {kind}"

        def one(past, asked):
            asked = asked.sort_values("i")
            out = asked[[*groups, "i"]].copy()
            out["predicted"] = predict(past.sort_values("i")["value"].to_numpy(dtype=float), len(asked)) if len(past) else float("nan")
            return out

        # both may come from the same rows; aliases make their columns their own
        train, targets = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (train, targets))
        return train.groupBy(*groups).cogroup(targets.groupBy(*groups)).applyInPandas(one, schema)

    return run


def _quantile(sorted_values: Column, q: Column) -> Column:
    """The quantile on the line between the two values beside it."""
    at = q * (F.size(sorted_values) - 1)
    low = F.floor(at).cast("int")
    a, b = F.element_at(sorted_values, low + 1), F.element_at(sorted_values, F.least(low + 2, F.size(sorted_values)))
    return a + (b - a) * (at - low)


def slot_sigma(rows: DataFrame, keys: list[str], period: int, relative: DataFrame) -> DataFrame:
    """(keys, sigma, k): robust spread around the means of the places of a period, and how many rows a place has on average
    (over rows); no row for series of fewer than two periods or places of one row. ``relative``: (keys, relative)."""
    place = Window.partitionBy(*keys, F.pmod(F.col("i"), F.lit(period)))
    x = rows.select(*keys, "i", "value").withColumns({"_m": F.avg("value").over(place), "_n": F.count("*").over(place)}).join(relative, keys)
    x = x.withColumn("_r", (F.col("value") - F.col("_m")) / F.when(F.col("relative"), F.abs("_m")).otherwise(1.0))
    centre = x.groupBy(*keys).agg(median("_r").alias("_c"), F.avg("_n").alias("k"), F.count("*").alias("_rows"))
    spread = x.join(centre, keys).groupBy(*keys, "k", "_rows").agg(median(F.abs(F.col("_r") - F.col("_c"))).alias("_s"))
    sigma = MAD * F.col("_s") * F.sqrt(F.col("k") / (F.col("k") - 1))
    return spread.where((F.col("_rows") >= 2 * period) & (F.col("k") > 1)).select(*keys, sigma.alias("sigma"), "k")


def band_widths(rows: DataFrame, errors: DataFrame, keys: list[str], period: int) -> DataFrame:
    """(keys, relative, points, mae, mape, q80, q95): half widths of split-conformal bands.

    The quantiles of absolute errors (relative ones where all values are positive) at 80 and 95 % of n + 1, but no
    less than what the spread around the places of the period, with the error of their means, asks for.
    ``errors``: what ``validate`` gives; a series' errors are few (origins times horizon).
    """
    relative = rows.groupBy(*keys).agg((F.min("value") > 0).alias("relative"))
    gap = F.abs(F.col("actual") - F.col("predicted"))
    e = errors.join(relative, keys).withColumn("_e", gap / F.when(F.col("relative"), F.abs("predicted")).otherwise(1.0))
    e = e.groupBy(*keys, "relative").agg(
        F.count("*").alias("points"), F.avg(gap).alias("mae"), F.avg(F.when(F.col("actual") != 0, gap / F.abs("actual"))).alias("mape"), F.array_sort(F.collect_list("_e")).alias("_e")
    )
    e = e.join(slot_sigma(rows, keys, period, relative), keys, "left") if period else e.withColumns({"sigma": F.lit(None).cast("double"), "k": F.lit(None).cast("double")})
    wide = F.sqrt(1 + 1 / F.greatest(F.lit(1.0), F.col("k"))) * F.col("sigma")
    n = F.col("points")
    widths = {f"q{name}": F.greatest(_quantile(F.col("_e"), F.least(F.lit(1.0), q * (n + 1) / n)), z * wide) for name, (q, z) in BANDS.items()}
    return e.withColumns(widths).select(*keys, "relative", "points", "mae", "mape", *widths)


def future(rows: DataFrame, keys: list[str], horizon: int, step: int, time: str = "time") -> DataFrame:
    """(keys, i, step, time) of the ``horizon`` steps of ``step`` seconds after each series' last row (rows with i)."""
    last = rows.groupBy(*keys).agg(F.max(time).alias("_last"), F.max("i").alias("_i"))
    ahead = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return ahead.select(*keys, (F.col("_i") + F.col("step")).alias("i"), "step", F.timestamp_micros(F.unix_micros("_last") + F.col("step").cast("long") * step * 1_000_000).alias(time))


def with_bands(predicted: DataFrame, widths: DataFrame, keys: list[str]) -> DataFrame:
    """``predicted`` with lower80, upper80, lower95 and upper95; series without errors have bands of no width."""
    out = predicted.join(widths.select(*keys, "relative", "q80", "q95"), keys, "left")
    scale = F.when(F.col("relative"), F.abs("predicted")).otherwise(1.0)
    sides = {f"{side}{name}": F.col("predicted") + sign * F.coalesce(f"q{name}", F.lit(0.0)) * scale for name in BANDS for side, sign in (("lower", -1), ("upper", 1))}
    return out.withColumns(sides).drop("relative", "q80", "q95")


def forecast(rows: DataFrame, keys: list[str], horizon: int, step: int, forecaster: Forecaster, period: int = 0, count: int = 4) -> DataFrame:
    """(keys, step, time, predicted, lower80, upper80, lower95, upper95) beyond each series' last row.

    ``rows`` lie on a grid of ``step`` seconds (keys, time, value).
    """
    rows = numbered(rows, keys)
    ahead = future(rows, keys, horizon, step)
    found = forecaster(rows.select(*keys, "i", "value"), ahead.select(*keys, "i"), keys)
    widths = band_widths(rows, validate(rows, keys, horizon, forecaster, count, period=period), keys, period)
    return with_bands(ahead.join(found, [*keys, "i"]), widths, keys).drop("i")


def choose_period(errors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, period): of the periods tried (keys, period, mape) the longest, unless a shorter one's error is under 85 % of it."""
    tried = errors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("period")).alias("p"), "mape"))).alias("t"))
    better = F.reduce(
        F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), F.element_at("t", 1),
        lambda a, x: F.when(x["mape"].isNotNull() & ~F.isnan(x["mape"]) & (a["mape"].isNull() | F.isnan(a["mape"]) | (x["mape"] < 0.85 * a["mape"])), x).otherwise(a),
    )
    return tried.select(*keys, (-better["p"]).alias("period"))


def covariates_on(target: DataFrame, covariates: DataFrame, keys: list[str], names: list[str], time: str = "time") -> DataFrame:
    """The covariates at the target's times, on the line between known ones where they are missing."""
    out = target.select(*keys, time).join(covariates.select(*keys, time, *names), [*keys, time], "left")
    for name in names:
        out = interpolate(out, keys, name, time=time)
    return out


def future_covariates(covariates: DataFrame, ahead: DataFrame, keys: list[str], names: list[str], time: str = "time") -> DataFrame:
    """``ahead`` (keys, time) with what the covariates usually are at that weekday and hour (UTC); where there is none, their mean."""
    slot = (F.weekday(time) * 24 + F.hour(time)).alias("_slot")
    usual = covariates.groupBy(*keys, slot).agg(*(F.avg(n).alias(n) for n in names))
    mean = covariates.groupBy(*keys).agg(*(F.avg(n).alias(f"_{n}") for n in names))
    out = ahead.withColumn("_slot", slot).join(usual, [*keys, "_slot"], "left").join(mean, keys, "left")
    return out.withColumns({n: F.coalesce(n, f"_{n}") for n in names}).drop("_slot", *(f"_{n}" for n in names))
