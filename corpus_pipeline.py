"""A pipeline over the table documents: five operators of hearthlake.llm in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents, whatever their names; columns that a stage needs for itself
have names that docs does not have.

A null text is an empty one. A row is a document of its own where its doc_id is
null or stands with several texts; rows of equal doc_id and text are copies of
one document. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.llm.common import broadcast_if_small, cut, fresh, named, shared_dir, table
from hearthlake.llm.decontaminate import contamination
from hearthlake.llm.mixing import cyclic_weights, mix
from hearthlake.llm.ngram_join import jaccard_components
from hearthlake.llm.quality import learnable, score, train
from hearthlake.llm.sharding import shard


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with a long key that only rows of equal doc_id and text share, its name, and that of a column
    that is true where rows may share it. The key is doc_id where no other row has that id."""
    key, again = fresh("key", docs.columns), fresh("again", docs.columns)
    text = F.coalesce("text", F.lit(""))
    first = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("row"), text)))
    many = cut(first.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit(True).alias(again)))
    if many.isEmpty():
        return first.withColumn(again, F.lit(False)), key, again
    rows = first.join(broadcast_if_small(many), key, "left").withColumn(again, F.coalesce(again, F.lit(False)))
    return rows.withColumn(key, F.when(F.col(again), F.xxhash64(F.lit("row"), F.col(key), text)).otherwise(F.col(key))), key, again


def _without(keyed: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    return keyed.join(broadcast_if_small(cut(dropped.select(F.col("doc_id").alias(key)).distinct())), key, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is not below the score quantile that the labels ask for."""
    model = train(docs, learnable(table(spark, sf_dir, "labels")))
    name = fresh("score", docs.columns)
    return score(docs, model, docs.columns, name).where(F.col(name) >= model.cut).select(*named(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word-shingle similarity of 0.8 or more, that of the
    smallest id; of rows of equal doc_id and text one, that of the least hash of its plain columns.
    Documents without words have no near copies, but for such rows."""
    keyed, key, again = _keyed(docs)
    found = jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), size=5, percent=80)
    kept = _without(keyed, key, found.where("doc_id <> component_id"))
    plain = [f"`{c}`" for c, kind in docs.dtypes if not kind.startswith(("map", "variant", "array", "struct"))]
    one = kept.where(F.col(again)).groupBy(key).agg(F.min_by(F.struct(*named(docs.columns)), F.xxhash64(*plain)).alias("row"))
    return kept.where(~F.col(again)).select(*named(docs.columns)).unionByName(one.select(*named(docs.columns, "row")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any run of ten consecutive words of a benchmark item (or a whole shorter item)."""
    keyed, key, _ = _keyed(docs)
    found = contamination(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), window=10)
    return _without(keyed, key, found.where("contaminated")).select(*named(docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as a mix of the sources by weights 5, 2, 1 takes it (0 to 2 times)."""
    taken = mix(docs, cyclic_weights(5, 2, 1), share=1.5, epochs=2, columns=docs.columns)
    return taken.where("taken_times > 0").select("row", F.explode(F.sequence(F.lit(1), "taken_times"))).select(*named(docs.columns, "row"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to 23) and slot of every row, and its other columns but the text
    (one that has a name of these gets _ at its end)."""
    return shard(docs, shards=24, columns=[c for c in docs.columns if c not in ("doc_id", "text")])


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: The model is fitted numerically, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # what the stage before has written is read no more
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
