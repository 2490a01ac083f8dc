"""Which devices an analysis reads: parsing and checking of bindings, resolution of devices, periods."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.operators.tree import closure

BINDING = "ARRAY<STRUCT<role: STRING, sources: ARRAY<STRUCT<kind: STRING, deviceId: BIGINT, spaceId: BIGINT, metricKey: STRING, agg: STRING, label: STRING, semantic: STRING>>>>"
KINDS = ["DEVICE_METRIC", "SPACE_AGGREGATE", "DERIVED_METRIC"]
AGGREGATES = ["avg", "max", "min"]


@dataclass(frozen=True)
class Role:
    """What an analysis wants in a role: how many sources, of which meaning (None: any)."""

    name: str
    least: int = 1
    most: int = 1
    semantic: str | None = None
    optional: bool = False


def parse(bindings: DataFrame, keys: list[str], column: str = "binding") -> DataFrame:
    """One row a source of JSON bindings: keys, role, kind, device_id, space_id, metric_key, agg, label, semantic
    and error (null if the source is well formed)."""
    rows = bindings.select(*keys, F.explode(F.from_json(column, BINDING)).alias("b")).select(*keys, "b.role", F.explode("b.sources").alias("s"))
    s = F.col("s")
    agg = F.lower(F.coalesce(s["agg"], F.lit("avg")))
    device, space = s["deviceId"].isNotNull(), s["spaceId"].isNotNull()
    error = (
        F.when(F.col("role").isNull(), "ROLE")
        .when(~F.coalesce(s["kind"].isin(KINDS), F.lit(False)), "KIND")
        .when(s["metricKey"].isNull(), "METRIC")
        .when(~agg.isin(AGGREGATES), "AGGREGATE")
        .when((s["kind"] == "DEVICE_METRIC") & ~device, "DEVICE")
        .when((s["kind"] == "SPACE_AGGREGATE") & ~space, "SPACE")
        .when((s["kind"] == "DERIVED_METRIC") & ~device & ~space, "DEVICE")
    )
    return rows.select(
        *keys, "role", s["kind"].alias("kind"), s["deviceId"].alias("device_id"), s["spaceId"].alias("space_id"), s["metricKey"].alias("metric_key"), agg.alias("agg"), s["label"].alias("label"), s["semantic"].alias("semantic"), error.alias("error")
    )


def problems(sources: DataFrame, keys: list[str], roles: list[Role]) -> DataFrame:
    """(keys, role, problem): UNKNOWN roles, COUNT outside a role's bounds, SEMANTIC that does not fit."""
    spec = sources.sparkSession.createDataFrame([(r.name, 0 if r.optional else r.least, r.most, r.semantic) for r in roles], "role string, least int, most int, wanted string")
    found = sources.groupBy(*keys, "role").agg(F.count("*").alias("n"), F.collect_set("semantic").alias("semantics"))
    every = sources.select(*keys).distinct().join(F.broadcast(spec), F.lit(True))  # roles of an analysis are a handful
    known = every.join(found, [*keys, "role"], "left").fillna(0, ["n"])
    unfit = F.exists(F.coalesce("semantics", F.array().cast("array<string>")), lambda x: x != F.col("wanted"))
    problem = F.when((F.col("n") < F.col("least")) | (F.col("n") > F.col("most")), "COUNT").when(F.col("wanted").isNotNull() & unfit, "SEMANTIC")
    known = known.withColumn("problem", problem).where("problem IS NOT NULL").select(*keys, "role", "problem")
    unknown = found.join(spec.select("role"), "role", "left_anti").select(*keys, "role", F.lit("UNKNOWN").alias("problem"))
    return known.unionByName(unknown)


def devices(sources: DataFrame, space_devices: DataFrame) -> DataFrame:
    """One row a source and device: its own device, or, of an aggregate of a space and where it names none, those of its space (``space_devices``: space_id, device_id of a space and all below it)."""
    has_own = F.col("device_id").isNotNull() & (F.col("kind") != "SPACE_AGGREGATE")
    own = sources.where(has_own)
    below = sources.where(~has_own).drop("device_id").join(space_devices, "space_id")
    return own.unionByName(below.select(own.columns))


def devices_below(spaces: DataFrame, devices: DataFrame) -> DataFrame:
    """(space_id, device_id): the devices of each space and of all below it, which ``devices`` (below) takes.
    ``spaces``: id, parent_id; ``devices``: device_id, space_id."""
    ties = closure(spaces).select(F.col("ancestor").alias("_top"), F.col("id").alias("space_id"))
    return devices.join(ties, "space_id").select(F.col("_top").alias("space_id"), "device_id")


def spaces(sources: DataFrame, keys: list[str]) -> DataFrame:
    return sources.where("space_id IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_set("space_id")).alias("spaces"))


def with_targets(rows: DataFrame, targets: DataFrame, defaults: dict[str, tuple[float | None, float | None]], space: str = "space_id", semantic: str = "semantic") -> DataFrame:
    """``rows`` with min, max and from_space: a space's own bounds, each side by itself, before the defaults."""
    def default(side: int) -> Column:
        pairs = [x for k, v in defaults.items() for x in (F.lit(k), F.lit(v[side]).cast("double"))]
        return F.element_at(F.create_map(*pairs), F.col(semantic)) if pairs else F.lit(None).cast("double")

    own = targets.select(space, semantic, F.col("min").alias("_min"), F.col("max").alias("_max"), F.lit(True).alias("_own"))
    out = rows.join(own, [space, semantic], "left")
    return out.withColumns({"min": F.coalesce("_min", default(0)), "max": F.coalesce("_max", default(1)), "from_space": F.coalesce("_own", F.lit(False))}).drop("_min", "_max", "_own")


def period(spec: dict, now: datetime) -> tuple[datetime, datetime]:
    """[from, to) of {type: RELATIVE, days} (up to the minute) or {type: FIXED, from, to}."""
    if spec.get("type") == "RELATIVE":
        days = spec.get("days")
        if not isinstance(days, int) or days < 1:
            raise ValueError("days")
        end = now.replace(second=0, microsecond=0)
        return end - timedelta(days=days), end
    if spec.get("type") == "FIXED":
        start, end = (datetime.fromisoformat(str(spec[k]).replace("Z", "+00:00")) for k in ("from", "to"))
        if start >= end:
            raise ValueError("from is not before to")
        return start, end
    raise ValueError("type")
