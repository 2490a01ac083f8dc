"""Robust statistics, seasonal profiles, correlation, drift, regression."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from hearthlake.functions.numbers import ratio
from hearthlake.functions.times import ZONE, local, local_date, minute_of_day, weekday
from hearthlake.operators.kernels import student_t
from hearthlake.operators.windows import MAD


def median(x: Column | str) -> Column:
    return F.percentile(x, F.lit(0.5))


@F.pandas_udf(DoubleType())
def t_quantile(freedom: pd.Series) -> pd.Series:
    """The 97.5 % quantile of Student's t, of rows of finished groups only."""
    kinds, back = np.unique(freedom.to_numpy(float), return_inverse=True)
    return pd.Series(student_t(kinds)[back])


def bounded_line(rows: DataFrame, keys: list[str], x: str, y: str, also: list[Column] | None = None) -> DataFrame:
    """(keys, n, slope, intercept, r2, error, low, high) of the least-squares line of y on x, from rows where both are known.

    low and high bound the slope with 95 % by Student's t; error is its standard error. A constant x has no
    line, a constant y R2 of 0; fewer than three rows have no interval. ``also``: further aggregates, kept as columns.
    """
    a, b = F.col(x), F.col(y)
    sums = rows.groupBy(*keys).agg(
        F.regr_count(b, a).alias("n"), F.regr_sxx(b, a).alias("_xx"), F.regr_syy(b, a).alias("_yy"), F.regr_sxy(b, a).alias("_xy"), F.regr_avgx(b, a).alias("_x"), F.regr_avgy(b, a).alias("_y"), *(also or [])
    )
    xx, yy, xy, none = F.col("_xx"), F.col("_yy"), F.col("_xy"), F.lit(0.0)
    line = sums.withColumn("slope", F.when(xx > 0, xy / xx))
    line = line.withColumns({"intercept": F.col("_y") - F.col("slope") * F.col("_x"), "r2": F.when(xx > 0, F.when(yy > 0, F.least(F.lit(1.0), xy * xy / F.nullif(xx * yy, none))).otherwise(0.0))})
    line = line.withColumn("error", F.when((F.col("n") > 2) & (xx > 0), F.sqrt((1 - F.col("r2")) * yy / F.nullif(xx, none) / F.nullif((F.col("n") - 2).cast("double"), none))))
    half = F.col("error") * t_quantile(F.when(F.col("n") > 2, F.col("n") - 2).cast("double"))
    line = line.withColumn("_half", half).withColumns({"low": F.col("slope") - F.col("_half"), "high": F.col("slope") + F.col("_half")})
    return line.drop("_xx", "_yy", "_xy", "_x", "_y", "_half")


def constant(value: Column) -> Column:
    """Aggregate: whether all known values are one (within 1e-9), or none is known."""
    known = F.when(~F.isnan(value), value)
    return F.coalesce(F.max(known) - F.min(known) <= 1e-9, F.lit(True))


def unpredictable(rows: DataFrame, keys: list[str], least: int = 3, value: str = "value") -> DataFrame:
    """(keys, reason): series that no forecast is made of: NO_CHANGE, or TOO_SHORT with fewer than ``least`` known values."""
    known = F.count(F.when(~F.isnan(value), F.col(value)))
    found = rows.groupBy(*keys).agg(F.when(known < least, "TOO_SHORT").when(constant(F.col(value)), "NO_CHANGE").alias("reason"))
    return found.where("reason IS NOT NULL")


def robust_sigma(rows: DataFrame, keys: list[str], value: str = "value", name: str = "sigma") -> DataFrame:
    """(keys, name): 1.4826 times the median distance from the median; nulls are skipped."""
    centre = rows.groupBy(*keys).agg(median(value).alias("_m"))
    return rows.join(centre, keys).groupBy(*keys).agg((MAD * median(F.abs(F.col(value) - F.col("_m")))).alias(name))


def seasonal_profile(rows: DataFrame, keys: list[str], slot_minutes: int = 60, weekly: bool = True, value: str = "value", time: str = "time", zone: str = ZONE) -> DataFrame:
    """(keys, day_type, slot, profile): what a series usually is at a time of day.

    Medians by slot of local time. With four weekend and four working dates at
    least each day type has a table of its own; with one of each, one table and
    the median residual of each day type; else one table (day_type 0 and 1 alike).
    Missing slots take the mean of the known slots beside them, and the table is
    smoothed over three slots on the circle of the day.
    """
    slots = 1440 // slot_minutes
    rows = rows.where(F.col(value).isNotNull()).withColumns(
        {"slot": F.floor(minute_of_day(F.col(time), zone) / slot_minutes).cast("int"), "day_type": (weekday(F.col(time), zone) >= 5).cast("int"), "_day": local_date(F.col(time), zone)}
    )
    days = rows.groupBy(*keys).agg(F.count_distinct(F.when(F.col("day_type") == 1, F.col("_day"))).alias("_we"), F.count_distinct(F.when(F.col("day_type") == 0, F.col("_day"))).alias("_wd"))
    few = F.least("_we", "_wd") if weekly else F.lit(0)
    rows = rows.join(days.withColumn("_mode", F.when(few >= 4, "table").when(few >= 1, "offset").otherwise("daily")).drop("_we", "_wd"), keys)
    rows = rows.withColumn("_type", F.when(F.col("_mode") == "table", F.col("day_type")).otherwise(-1))
    known = rows.groupBy(*keys, "_mode", "_type", "slot").agg(median(value).alias("m"))
    grid = known.select(*keys, "_mode", "_type").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    full = _fill_circle(grid.join(known, [*keys, "_mode", "_type", "slot"], "left"), [*keys, "_type"], slots)
    near = full.withColumn("_to", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("slot") + d, F.lit(slots)))))
    smooth = near.groupBy(*keys, "_mode", "_type", F.col("_to").alias("slot")).agg(F.avg("m").alias("profile"))
    both = smooth.withColumn("day_type", F.explode(F.when(F.col("_type") < 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("_type")))))
    base = rows.where("_mode = 'offset'").join(smooth.select(*keys, "slot", "profile"), [*keys, "slot"])
    offset = base.groupBy(*keys, "day_type").agg(median(F.col(value) - F.col("profile")).alias("_off"))
    return both.join(offset, [*keys, "day_type"], "left").select(*keys, "day_type", "slot", (F.col("profile") + F.coalesce("_off", F.lit(0.0))).alias("profile"))


def _fill_circle(grid: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """Missing m on the line between the known slots beside it on the circle."""
    turns = grid.withColumn("_t", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_p", F.col("slot") + F.col("_t") * slots)
    by = Window.partitionBy(*keys).orderBy("_p")
    known = F.when(F.col("m").isNotNull(), F.struct("_p", "m"))
    turns = turns.withColumns(
        {"_b": F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "_a": F.last(known, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0))}
    ).where("_t = 0")
    b, a = F.col("_b"), F.col("_a")
    line = b["m"] + (a["m"] - b["m"]) * (F.col("_p") - b["_p"]) / F.nullif((a["_p"] - b["_p"]).cast("double"), F.lit(0.0))
    return turns.withColumn("m", F.coalesce("m", line, b["m"], a["m"])).drop("_t", "_p", "_b", "_a")


def slot_widths(rows: DataFrame, keys: list[str], period: str = "AUTO", time: str = "time") -> DataFrame:
    """(keys, width): minutes of a series' slots, from 15 to 60 by its median step; 1440 (one slot a day) where steps are of a
    day or more, or ``period`` is NONE. A series of one row counts as hourly."""
    step = F.unix_micros(time) - F.lag(F.unix_micros(time)).over(Window.partitionBy(*keys).orderBy(time))
    steps = rows.withColumn("_step", step / 6e7).groupBy(*keys).agg(F.coalesce(median("_step"), F.lit(60.0)).alias("_step"))
    width = F.when(F.lit(period == "NONE") | (F.col("_step") >= 1440), 1440).otherwise(F.greatest(F.lit(15), F.least(F.lit(60), F.floor("_step").cast("int"))))
    return steps.select(*keys, width.alias("width"))


def own_profile(rows: DataFrame, keys: list[str], period: str = "AUTO", value: str = "value", time: str = "time", zone: str = ZONE) -> DataFrame:
    """(keys, width, fallback, day_type, slot, profile): what each series usually is at a time of day, by slots of its own width.

    The width is a column (``slot_widths``), so series of any step go through one job. Medians by slot of local time: with
    four weekend and four working dates at least each day type has a table; with one of each, one table and the median
    residual of each day type; else, or with ``period`` DAILY, one table. Missing slots lie on the line between the known ones of the
    day, those at its ends take the nearest; then each table is smoothed over three slots on the circle. What a day has
    beyond its whole slots is ``fallback``, the series' median.
    """
    rows = rows.where(F.col(value).isNotNull())
    kinds = slot_widths(rows, keys, period, time)
    minute, day_type = minute_of_day(F.col(time), zone), (weekday(F.col(time), zone) >= 5).cast("int")
    days = rows.withColumns({"_day": local_date(F.col(time), zone), "_we": day_type}).groupBy(*keys).agg(
        F.least(F.count_distinct(F.when(F.col("_we") == 1, F.col("_day"))), F.count_distinct(F.when(F.col("_we") == 0, F.col("_day")))).alias("_few"), median(value).alias("fallback")
    )
    few = F.when(F.lit(period in ("WEEKLY", "AUTO")) & (F.col("width") < 1440), F.col("_few")).otherwise(0)
    kinds = kinds.join(days, keys).select(*keys, "width", "fallback", F.when(few >= 4, "table").when(few >= 1, "offset").otherwise("daily").alias("_mode"))
    rows = rows.join(kinds, keys).withColumns({"slot": F.floor(minute / F.col("width")).cast("int"), "day_type": day_type})
    rows = rows.withColumn("_type", F.when(F.col("_mode") == "table", F.col("day_type")).otherwise(0))
    known = rows.groupBy(*keys, "_type", "slot").agg(median(value).alias("m"))
    slots = F.floor(1440 / F.col("width")).cast("int")
    types = F.when(F.col("_mode") == "table", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    grid = kinds.withColumn("_type", F.explode(types)).withColumn("_slots", slots).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)))
    by = Window.partitionBy(*keys, "_type")
    seen = F.when(F.col("m").isNotNull(), F.struct("slot", "m"))
    near = grid.join(known, [*keys, "_type", "slot"], "left").withColumns(
        {"_b": F.last(seen, True).over(by.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)), "_a": F.last(seen, True).over(by.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0))}
    )
    b, a = F.col("_b"), F.col("_a")
    line = b["m"] + (a["m"] - b["m"]) * (F.col("slot") - b["slot"]) / F.nullif((a["slot"] - b["slot"]).cast("double"), F.lit(0.0))
    near = near.withColumn("m", F.coalesce("m", line, b["m"], a["m"]))
    around = near.withColumn("slot", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("slot") + d, F.col("_slots")))))
    table = around.groupBy(*keys, "width", "fallback", "_mode", "_type", "slot").agg(F.avg("m").alias("profile"))
    base = rows.where("_mode = 'offset'").join(table.select(*keys, "_type", "slot", "profile"), [*keys, "_type", "slot"], "left")
    offset = base.groupBy(*keys, "day_type").agg(median(F.col(value) - F.coalesce("profile", "fallback")).alias("_off"))
    both = table.withColumn("day_type", F.explode(F.when(F.col("_mode") == "table", F.array("_type")).otherwise(F.array(F.lit(0), F.lit(1)))))
    return both.join(offset, [*keys, "day_type"], "left").select(*keys, "width", "fallback", "day_type", "slot", (F.col("profile") + F.coalesce("_off", F.lit(0.0))).alias("profile"))


def own_residual(rows: DataFrame, profile: DataFrame, keys: list[str], value: str = "value", time: str = "time", zone: str = ZONE) -> DataFrame:
    """``rows`` with profile (of ``own_profile``, its fallback where it has no such slot) and residual."""
    kinds = profile.select(*keys, "width", "fallback").distinct()
    slot = F.floor(minute_of_day(F.col(time), zone) / F.col("width")).cast("int")
    rows = rows.join(kinds, keys).withColumns({"slot": slot, "day_type": (weekday(F.col(time), zone) >= 5).cast("int")})
    rows = rows.join(profile.select(*keys, "day_type", "slot", "profile"), [*keys, "day_type", "slot"], "left").withColumn("profile", F.coalesce("profile", "fallback"))
    return rows.withColumn("residual", F.col(value) - F.col("profile")).drop("fallback")


def seasonal_residual(rows: DataFrame, profile: DataFrame, keys: list[str], slot_minutes: int = 60, value: str = "value", time: str = "time", zone: str = ZONE) -> DataFrame:
    """``rows`` with residual: value less its profile, centred on the series' median residual."""
    rows = rows.withColumns({"slot": F.floor(minute_of_day(F.col(time), zone) / slot_minutes).cast("int"), "day_type": (weekday(F.col(time), zone) >= 5).cast("int")})
    rows = rows.join(profile, [*keys, "day_type", "slot"], "left").withColumn("_r", F.col(value) - F.col("profile"))
    centre = rows.groupBy(*keys).agg(median("_r").alias("_c"))
    return rows.join(centre, keys).withColumn("residual", F.col("_r") - F.col("_c")).drop("_r", "_c")


def pearson(a: Column, b: Column) -> Column:
    """Correlation of rows where both are known; null for fewer than 3 or without variance."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    r = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.when(F.count_if(both) >= 3, r)


def correlations(frame: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r) of each pair of columns, all in one pass."""
    pairs = list(combinations(names, 2))
    one = frame.agg(*[pearson(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def lagged_correlations(rows: DataFrame, series: str, index: str, value: str, most: int) -> DataFrame:
    """(a, b, lag, r) of each pair of series with b moved by -most..most steps.

    ``index`` counts steps of a common grid, so a lag is an equi-join.
    """
    rows = rows.where(F.col(value).isNotNull())
    left = rows.select(F.col(series).alias("a"), F.col(index).alias("_i"), F.col(value).alias("_x"))
    left = left.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("_j", F.col("_i") + F.col("lag"))
    right = rows.select(F.col(series).alias("b"), F.col(index).alias("_j"), F.col(value).alias("_y"))
    return left.join(right, "_j").where("a < b").groupBy("a", "b", "lag").agg(pearson(F.col("_x"), F.col("_y")).alias("r"))


def best_lag(lags: DataFrame) -> DataFrame:
    """(a, b, best_lag, best_r): the strongest, of equals the least lag; leader is a for positive lags."""
    best = F.max_by(F.struct("lag", "r"), F.struct(F.abs("r"), -F.col("lag")))
    out = lags.where("r IS NOT NULL").groupBy("a", "b").agg(best.alias("x")).select("a", "b", F.col("x.lag").alias("best_lag"), F.col("x.r").alias("best_r"))
    return out.withColumn("leader", F.when(F.col("best_lag") > 0, F.col("a")).when(F.col("best_lag") < 0, F.col("b")))


def regression(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares of y on x: slope, intercept, r2, n and the slope's standard error."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = both.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy")
    )
    error = F.sqrt(F.greatest(1 - F.col("r2"), F.lit(0.0)) * ratio(F.col("_syy"), F.col("_sxx")) / F.nullif(F.greatest(F.col("n") - 2, F.lit(0)).cast("double"), F.lit(0.0)))
    return fit.withColumn("slope_error", error).drop("_sxx", "_syy")


def deciles(rows: DataFrame, keys: list[str], value: str = "value", bins: int = 10) -> DataFrame:
    return rows.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("edges"))


def psi(rows: DataFrame, edges: DataFrame, keys: list[str], value: str = "value", floor: float = 1e-4) -> DataFrame:
    """(keys, psi): population stability of ``rows`` against training ``edges`` (equal shares expected
    in the bins that distinct inner edges leave); 0 with fewer than 3 edges or no rows."""
    inner = F.array_distinct(F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0))))
    edges = edges.select(*keys, inner.alias("_inner"), F.size("edges").alias("_n"))
    bin_of = F.size(F.filter("_inner", lambda e: e <= F.col(value)))
    binned = rows.where(F.col(value).isNotNull()).join(edges, keys).groupBy(*keys, "_inner", "_n", bin_of.alias("bin")).agg(F.count("*").alias("c"))
    total = binned.groupBy(*keys).agg(F.sum("c").alias("total"))
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.size("_inner"))))
    every = every.join(binned.select(*keys, "bin", "c"), [*keys, "bin"], "left").join(total, keys, "left")
    expected = F.greatest(1 / (F.size("_inner") + 1), F.lit(floor))
    actual = F.greatest(F.coalesce("c", F.lit(0)) / F.col("total"), F.lit(floor))
    term = F.sum((actual - expected) * F.ln(actual / expected))
    return every.groupBy(*keys).agg(F.when((F.max("_n") >= 3) & (F.max("total") > 0), term).otherwise(0.0).alias("psi"))


def errors(rows: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """(keys, mae, mape): mape over rows whose actual is not 0, in percent."""
    gap = F.abs(F.col(actual) - F.col(predicted))
    return rows.groupBy(*keys).agg(F.avg(gap).alias("mae"), (100 * F.avg(F.when(F.col(actual) != 0, gap / F.abs(F.col(actual))))).alias("mape"))


def heatmap(rows: DataFrame, keys: list[str], agg: str = "MEAN", value: str = "value", time: str = "time", zone: str = ZONE) -> DataFrame:
    """All 7 x 24 cells of weekday and local hour: value, samples and standard deviation."""
    from hearthlake.operators.joins import dense

    f = {"MEAN": F.avg, "MEDIAN": median, "MAX": F.max}[agg]
    t = local(F.col(time), zone)
    cells = rows.groupBy(*keys, F.weekday(t).alias("day"), F.hour(t).alias("hour")).agg(f(value).alias("value"), F.count(value).alias("samples"), F.stddev_samp(value).alias("std"))
    return dense(cells, keys, {"day": (0, 6), "hour": (0, 23)}).fillna(0, ["samples"])
