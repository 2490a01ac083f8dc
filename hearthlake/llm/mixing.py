"""Operator 1: mixing sources to target weights (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.llm.common import broadcast_if_small, cut, fresh, named, words

#: Hash keys have 60 bits; the upper 16 number the cells of the first pass.
KEY_BITS, CELL_BITS = 60, 16
LOW_BITS = KEY_BITS - CELL_BITS


def cyclic_weights(*weights: float) -> Column:
    """Weights by rank of the source's name (code points, null last), repeating."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))


def source_targets(sizes: DataFrame, weight: Column, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """Capped water-filling over (source, source_size).

    ``share`` of the total is dealt by ``weight``; no source gets more than
    ``epochs`` times its size, and what a cap cuts off goes to the others by
    weight until all hold. In order of cap / weight, a source is capped exactly
    if the water standing at its cap needs no more than the budget, so one pass
    of prefix sums finds the level that the rounds of clamping end at. It runs
    over sources, not documents. Weights are positive; a source without words
    has target 0.
    """
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    capped = F.sum("cap").over(order) + F.col("ratio") * (F.sum("weight").over(everything) - F.sum("weight").over(order)) <= F.col("budget")
    level = (F.col("budget") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)) / F.nullif(
        F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything), F.lit(0.0)
    )
    return (
        sizes.withColumn("weight", weight.cast("double"))
        .withColumn("cap", epochs * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", share * F.sum("source_size").over(everything))
        .withColumn("capped", capped)
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level))
        .select("source", "source_size", "weight", "target")
    )


def sample_key(name: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def _keyed(docs: DataFrame, seed: int, name: str) -> DataFrame:
    """``docs`` with ``name``, a key that spreads its rows: of doc_id where that stands once, of doc_id and text where several rows
    have it (or none), and of the row's place too where these are equal as well; such rows cannot be told apart."""
    place, text, doc = F.monotonically_increasing_id(), F.xxhash64(F.coalesce("text", F.lit(""))), F.col("doc_id").cast("string")
    many = cut(docs.groupBy(doc.alias("_id")).count().where("count > 1 OR _id IS NULL").select("_id", F.lit(True).alias("_again")))
    own = F.coalesce(doc, F.lit("null"))
    if many.isEmpty():
        return docs.withColumn(name, sample_key(own, seed))
    many = broadcast_if_small(many)
    equal = docs.select(doc.alias("_d"), text.alias("_t")).join(many, F.col("_d").eqNullSafe(F.col("_id"))).groupBy("_d", "_t").count().where("count > 1")
    equal = broadcast_if_small(cut(equal.select("_d", "_t", F.lit(True).alias("_equal"))))
    rows = docs.select(F.struct(*named(docs.columns)).alias("_row"), doc.alias("_doc"), text.alias("_text"), place.alias("_place"))
    rows = rows.join(many, F.col("_doc").eqNullSafe(F.col("_id")), "left").join(equal, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")), "left")
    parts = F.concat_ws(":", F.coalesce("_doc", F.lit("null")), F.when(F.col("_again"), F.col("_text")), F.when(F.col("_equal"), F.col("_place")))
    return rows.select(*named(docs.columns, "_row"), sample_key(parts, seed).alias(name))


def bits(size: Column) -> Column:
    """Class of size: the binary digits of ``size``, 0 for none."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def _class_ends(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, bits, end_key): of each class of size, documents up to end_key fill the rest of the target."""
    of_class = Window.partitionBy("source", "bits")
    cells = rows.where("size > 0").groupBy("source", "bits", F.shiftright("key", LOW_BITS).alias("cell")).agg(F.sum("size").alias("cell_size"))
    cells = cells.withColumn("before", F.sum("cell_size").over(of_class.orderBy("cell")) - F.col("cell_size")).withColumn("class_size", F.sum("cell_size").over(of_class))
    near = _by_source(cells, targets.select("source", "source_size", "rest"))
    near = (
        near.withColumn("quota", F.col("rest") * F.col("class_size") / F.col("source_size"))
        .withColumn("reach", F.expr("shiftleft(4L, bits)"))
        .where("before - reach <= quota AND quota <= before + cell_size + reach")
        .select("source", F.col("bits").alias("class"), F.col("cell").alias("near_cell"), "before", "quota", "reach")
    )
    near = cut(near)
    in_cell = Window.partitionBy("source", "bits", "near_cell").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    upto = _by_source(rows, broadcast_if_small(near), (F.col("bits") == F.col("class")) & (F.shiftright("key", LOW_BITS) == F.col("near_cell")))
    upto = upto.withColumn("upto", F.col("before") + F.sum("size").over(in_cell)).select("source", "class", "quota", "reach", "upto", "key")
    start = near.select("source", "class", "quota", "reach", F.col("before").alias("upto"), (F.shiftleft("near_cell", LOW_BITS) - 1).alias("key"))
    end = F.struct("upto", "key")
    classes = (
        upto.unionByName(start)
        .groupBy("source", "class", "quota")
        .agg(
            F.collect_set(F.when(F.abs(F.col("upto") - F.col("quota")) <= F.col("reach"), end)).alias("ends"),
            F.max(F.when(F.col("upto") <= F.col("quota"), end)).alias("below"),
        )
        .groupBy("source")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("class")).alias("minus"), "quota", F.array_append("ends", F.col("below")).alias("ends")))).alias("classes"))
    )

    def step(acc: Column, x: Column) -> Column:
        want = acc["carry"] + x["quota"]
        best = F.array_min(F.transform(x["ends"], lambda e: F.struct(F.abs(e["upto"] - want).alias("off"), e["upto"].alias("upto"), e["key"].alias("key"))))
        found = F.struct((-x["minus"]).alias("bits"), best["key"].alias("end_key"))
        return F.struct((want - best["upto"]).alias("carry"), F.concat(acc["found"], F.array(found)).alias("found"))

    nothing = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<bits:int,end_key:bigint>>").alias("found"))
    return classes.select("source", F.inline(F.aggregate("classes", nothing, step)["found"]))


def _by_source(left: DataFrame, right: DataFrame, more: Column | None = None) -> DataFrame:
    right = right.withColumnRenamed("source", "_source")
    on = F.col("source").eqNullSafe(F.col("_source"))
    return left.join(right, on if more is None else on & more).drop("_source")


def mix(docs: DataFrame, weight: Column, share: float = 1.5, epochs: int = 2, seed: int = 7, size: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """How often a mix takes each document: ``docs``' doc_id and source with size,
    source_size, target, taken_times (int) and taken (size * taken_times). With
    ``columns``: a struct row of these columns of ``docs``, and taken_times.

    Every document is taken floor(target / source_size) times. The rest of the
    target is sampled by classes of size (powers of two): each class fills its
    share of the rest, in the order of a seeded hash of doc_id, to the nearest
    document, and what is too much or too little passes on to the next smaller
    class. So a very long document leaves no gap, each source ends within a small
    document of its target in whole documents, and reruns agree. Sums by (source,
    class, hash cell) find the few cells around each class's share, windows over
    these cells (2**-16 of the class each) the documents to end at. Nothing but
    small rows is shuffled, and one cell is all that a task ever sorts.

    Nulls: a null text has size 0, a null source is a source of its own. Rows with null or
    equal doc_id are sampled each for itself.
    Documents of size 0 are taken floor(target / source_size) times. Empty tables
    give no rows. Other columns of ``docs`` may have any name.
    """
    size = words(F.col("text")) if size is None else size
    size, key = size.cast("long"), fresh("key", docs.columns)
    docs = _keyed(docs, seed, key)
    rows = cut(docs.select("doc_id", "source", size.alias("size"), F.col(key).alias("key"), bits(size).alias("bits")))
    targets = cut(
        source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weight, share, epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    # a few rows a source, so texts need not be shuffled to meet them
    ends = cut(_class_ends(rows, targets))
    ends = ends.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("bits", "end_key"))).alias("ends"))
    plan = targets.withColumnRenamed("source", "_source").join(ends, F.col("_source").eqNullSafe(F.col("source")), "left")
    plan = broadcast_if_small(cut(plan.select("_source", F.struct("source_size", "target", "whole", "ends").alias("_plan"))))
    if columns is not None:
        rows = docs.select(F.struct(*named(columns)).alias("row"), "source", F.col(key).alias("_key"), bits(size).alias("_bits"))
    else:
        rows = rows.withColumnsRenamed({"key": "_key", "bits": "_bits"})
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    extra = F.coalesce(F.col("_key") <= F.col("_plan.ends")[F.col("_bits")], F.lit(False))
    times = F.least(F.col("_plan.whole") + extra.cast("int"), F.lit(int(epochs)))
    if columns is not None:
        return out.select("row", times.alias("taken_times"))
    return out.select("doc_id", "source", "size", "_plan.source_size", "_plan.target", times.alias("taken_times"), (F.col("size") * times).alias("taken"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, cyclic_weights(5, 2, 1), share=1.5, epochs=2).withColumn("target", F.round("target", 6))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
c AS (SELECT *, sum(cap) OVER w + cap / weight * (sum(weight) OVER () - sum(weight) OVER w) <= budget AS capped FROM r
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * ((budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
  / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) END::DOUBLE AS target FROM c),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
u AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits, sum(size) OVER (PARTITION BY source, size > 0, length(bin(size)) ORDER BY key)::BIGINT AS upto,
    rest * sum(size) OVER (PARTITION BY source, size > 0, length(bin(size))) / source_size AS quota
  FROM d JOIN (SELECT source AS src, source_size, target, whole, target - whole * source_size AS rest FROM q) ON src IS NOT DISTINCT FROM source),
m AS (SELECT DISTINCT source, bits, quota, upto FROM u WHERE bits > 0 UNION SELECT DISTINCT source, bits, quota, 0 FROM u WHERE bits > 0),
n AS (SELECT * FROM m QUALIFY abs(upto - quota) <= 4 * (1::BIGINT << bits) OR upto = max(upto) FILTER (WHERE upto <= quota) OVER (PARTITION BY source, bits)),
k AS (SELECT source, bits, quota, list(upto) AS ends, row_number() OVER (PARTITION BY source ORDER BY bits DESC) AS i FROM n GROUP BY source, bits, quota),
f AS (SELECT DISTINCT source, 0::BIGINT AS i, 0::BIGINT AS bits, 0::DOUBLE AS want, 0::BIGINT AS fit FROM k
  UNION ALL SELECT k.source, k.i, k.bits, f.want - f.fit + k.quota,
    list_aggregate(list_transform(k.ends, lambda e: {'off': abs(e - (f.want - f.fit + k.quota)), 'upto': e}), 'min').upto
  FROM f JOIN k ON k.source IS NOT DISTINCT FROM f.source AND k.i = f.i + 1)
SELECT u.doc_id, u.source, u.size, u.source_size, round(u.target, 6) AS target,
  least(2, u.whole + CASE WHEN u.upto <= f.fit THEN 1 ELSE 0 END)::INTEGER AS taken_times,
  (u.size * least(2, u.whole + CASE WHEN u.upto <= f.fit THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u LEFT JOIN f ON f.bits = u.bits AND f.bits > 0 AND f.source IS NOT DISTINCT FROM u.source
"""
