"""Models of analyses: training figures, promotion, drift and retraining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.operators import stats
from hearthlake.operators.service import better_model

DRIFT = 0.2


def training_figures(rows: DataFrame, keys: list[str], held_out: float = 0.3, most: int = 48, period: int = 24, time: str = "time") -> DataFrame:
    """(keys, points, edges, mae, mape): decile edges of the values, and the error of the value a period
    before on the last rows (at most ``most``, ``held_out`` of all)."""
    by = Window.partitionBy(*keys).orderBy(time)
    n = F.count("value").over(Window.partitionBy(*keys))
    rows = rows.where("value IS NOT NULL").withColumns({"_before": F.lag("value", period).over(by), "_i": F.row_number().over(by), "_n": n})
    recent = rows.where(F.col("_i") > F.col("_n") - F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("_n") * held_out))))
    errors = stats.errors(recent.where("_before IS NOT NULL"), keys, "value", "_before")
    figures = rows.groupBy(*keys).agg(F.count("*").alias("points")).join(stats.deciles(rows, keys), keys)
    return figures.join(errors, keys, "left")


def next_versions(models: DataFrame, keys: list[str]) -> DataFrame:
    return models.groupBy(*keys).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def states(models: DataFrame, keys: list[str]) -> DataFrame:
    """``models`` (version, status, mae) after promotion: the last CANDIDATE becomes ACTIVE if its error is no
    larger than the ACTIVE one's (or either is unknown), which then is RETIRED."""
    by = Window.partitionBy(*keys)
    candidate = F.max(F.when(F.col("status") == "CANDIDATE", F.struct("version", "mae"))).over(by)
    active = F.max(F.when(F.col("status") == "ACTIVE", F.struct("version", "mae"))).over(by)
    rows = models.withColumns({"_c": candidate, "_a": active})
    better = F.col("_c").isNotNull() & F.coalesce(F.col("_c.mae") <= F.col("_a.mae"), F.lit(True))
    status = F.when(better & (F.col("version") == F.col("_c.version")), "ACTIVE").when(better & (F.col("status") == "ACTIVE"), "RETIRED").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("_c", "_a")


def drifted(recent: DataFrame, edges: DataFrame, keys: list[str], reported: DataFrame | None = None) -> DataFrame:
    """(keys, psi) of models whose recent values have drifted from their training edges, without those reported already."""
    out = stats.psi(recent, edges, keys).where(F.col("psi") > DRIFT)
    return out if reported is None else out.join(reported.select(*keys), keys, "left_anti")


def retrain(policy: str, days_since: int, drift: bool, recent_mape: float | None, trained_mape: float | None) -> str | None:
    """Why a model is to be trained again: DRIFT, SCHEDULE (after a week), DEGRADED (error half as large again), or None."""
    if policy == "ON_DRIFT" and drift:
        return "DRIFT"
    if policy == "SCHEDULE" and days_since >= 7:
        return "SCHEDULE"
    if recent_mape is not None and trained_mape and recent_mape >= 1.5 * trained_mape:
        return "DEGRADED"
    return None


def activate(candidate: dict, active: dict | None, force: bool = False) -> bool:
    """Whether a candidate may be activated by hand: a worse one only with ``force``."""
    return force or better_model(candidate, active)
