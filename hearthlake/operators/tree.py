"""Roll-up of a forest of spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.operators.lineage import written

#: Levels of spaces (site, building, floor, room ...) that are walked at most; deeper forests raise an error.
MAX_DEPTH = 32


def clean_parents(spaces: DataFrame) -> DataFrame:
    """Parents that do not exist, or are the space itself, are none."""
    known = spaces.select(F.col("id").alias("_p")).distinct()
    rows = spaces.join(known, F.col("parent_id") == F.col("_p"), "left")
    return rows.withColumn("parent_id", F.when(F.col("_p") != F.col("id"), F.col("_p"))).drop("_p")


def closure(spaces: DataFrame, stop: str | None = None) -> DataFrame:
    """(ancestor, id): each space under itself and under all above it.

    ``stop``: a boolean column of ``spaces``; what is below a space where it holds
    is counted neither to it nor above it. Spaces in a cycle of parents, and those below one, have no
    root and are absent; a forest deeper than MAX_DEPTH is an error.

    The way up of each space is doubled: it takes on the way of the space where it ends, so n levels
    take log2(n) joins of a row a space. The ways are written once and read by all that need them.
    """
    stop_at = F.lit(False) if stop is None else F.coalesce(stop, F.lit(False))
    edges = clean_parents(spaces).select("id", "parent_id", stop_at.alias("stop"))
    parents = edges.select(F.col("id").alias("parent_id"), F.col("stop").alias("_stop"))
    one = F.array(F.struct("id", "stop"))
    two = F.concat(one, F.array(F.struct(F.col("parent_id").alias("id"), F.col("_stop").alias("stop"))))
    ways = edges.join(parents, "parent_id", "left").select("id", F.when(F.col("parent_id").isNull(), one).otherwise(two).alias("way"), F.col("parent_id").isNotNull().alias("open"))
    ways, length = written(ways), 2
    while not ways.where("open").isEmpty():
        if length > 2 * MAX_DEPTH:
            raise ValueError(f"spaces are nested more than {MAX_DEPTH} deep")
        on = ways.select(F.col("id").alias("_id"), F.slice("way", 2, MAX_DEPTH * 4).alias("_way"), F.col("open").alias("_open"))
        longer = ways.withColumn("_end", F.when(F.col("open"), F.element_at("way", -1)["id"])).join(on, F.col("_end") == F.col("_id"), "left")
        longer = longer.where("NOT open OR _id IS NOT NULL").select("id", F.concat("way", F.coalesce("_way", F.slice("way", 1, 0))).alias("way"), (F.col("open") & F.coalesce("_open", F.lit(False))).alias("open"))
        # a way that meets itself has no root
        ways, length = written(longer.where(F.size(F.array_distinct(F.transform("way", lambda x: x["id"]))) == F.size("way"))), 2 * length
    up = ways.select("id", "way", F.posexplode("way").alias("n", "x"))
    free = ~F.exists(F.slice("way", F.lit(2), F.greatest(F.col("n"), F.lit(0))), lambda x: x["stop"])
    return up.where(free).select(F.col("x.id").alias("ancestor"), "id")


def roll_up(spaces: DataFrame, facts: DataFrame, measures: list[str], period: list[str]) -> DataFrame:
    """(id, period, measures, children_<m>, other_<m>): each space's own value and all below it.

    facts: id, ``period`` columns and ``measures``. A space with covers_descendants
    that has a value of its own in a period stands for all below it: what its
    children have is not added, and other is what they leave of it.
    """
    spaces = clean_parents(spaces)
    ties = closure(spaces)
    tree = spaces.select("id", "parent_id", F.coalesce("covers_descendants", F.lit(False)).alias("covers"))
    own = facts.groupBy("id", *period).agg(*[F.sum(m).alias(m) for m in measures])
    covering = own.join(tree.where("covers"), "id").where(F.coalesce(*[F.col(m) for m in measures]).isNotNull()).select(F.col("id").alias("cover"), *period)
    # a fact is hidden from an ancestor if a covering space stands between them (not the ancestor nor the fact's own space)
    paths = own.join(ties, "id")
    covers = ties.select(F.col("ancestor").alias("cover"), F.col("id").alias("under")).where("cover <> under").join(covering, "cover")
    above = ties.select(F.col("ancestor").alias("top"), F.col("id").alias("cover2"))
    hidden = covers.join(above, F.col("cover") == F.col("cover2")).select(F.col("top").alias("ancestor"), F.col("under").alias("id"), *period).distinct()
    seen = paths.join(hidden, ["ancestor", "id", *period], "left_anti")
    value = seen.groupBy(F.col("ancestor").alias("id"), *period).agg(*[F.sum(m).alias(m) for m in measures])
    up = value.join(tree.select("id", "parent_id"), "id").where("parent_id IS NOT NULL")
    children = up.groupBy(F.col("parent_id").alias("id"), *period).agg(*[F.sum(m).alias(f"children_{m}") for m in measures])
    out = value.join(children, ["id", *period], "left")
    return out.withColumns({f"other_{m}": F.when(F.col(f"children_{m}").isNotNull(), F.col(m) - F.col(f"children_{m}")) for m in measures})


def portfolio(rolled: DataFrame, spaces: DataFrame, measures: list[str], period: list[str]) -> DataFrame:
    roots = clean_parents(spaces).where("parent_id IS NULL").select("id")
    return rolled.join(roots, "id", "left_semi").groupBy(*period).agg(*[F.sum(m).alias(m) for m in measures])


def areas(spaces: DataFrame) -> DataFrame:
    """(id, area): a space's own area if it has one, else what is known of those below it."""
    spaces = clean_parents(spaces).withColumn("_own", F.coalesce(F.col("area_m2") > 0, F.lit(False)))
    ties = closure(spaces, "_own")
    known = spaces.where("_own").select("id", "area_m2")
    return ties.join(known, "id", "left").groupBy(F.col("ancestor").alias("id")).agg(F.sum("area_m2").alias("area"))
