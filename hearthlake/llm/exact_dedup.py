"""Operator 6: exact deduplication by a 128-bit content hash with a check of bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.common import SPACE, broadcast_if_small, cut


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, content: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    Rows whose texts are equal after every run of space and \\t..\\r has become one
    space form a group; the row of the smallest doc_id stays (of repeated rows
    with that id all have ``kept``; a null id is larger than any other, and
    keep_id is null only where all ids of a group are). Null texts are empty ones.

    Groups are first found by ``content`` (MD5; tests pass a weak one). Only texts
    of groups of two or more are shuffled (where these groups are broadcast; beyond
    64 MB of them the semi-join shuffles too), and each is compared by bytes with
    the row that its group keeps: an equi-join whose skewed partitions adaptive
    execution splits, as the kept side is one row a group. Rows that differ from it, in a collision of the hash, are grouped by
    the text itself. Aggregations combine before the shuffle, so a group of any
    size is a row a task.
    """
    text = normal_text(F.col("text"))
    small = cut(docs.select("doc_id", "text").withColumn("text", text).select("doc_id", content(F.col("text")).alias("h"), F.sha2("text", 256).alias("text_sha256")))
    sizes = small.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    many = broadcast_if_small(cut(sizes.where("group_size > 1")))
    texts = docs.select("doc_id", text.alias("text")).withColumn("h", content(F.col("text"))).join(many, "h")
    kept = (
        texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("h")
        .agg(F.min("text").alias("kept_text"))
    )
    odd = cut(texts.join(kept, "h").where("text <> kept_text").select("doc_id", "h", "text"))
    odd_groups = odd.groupBy("h", "text").agg(F.min("doc_id").alias("odd_keep"), F.count("*").alias("odd_size"))
    odd_rows = odd_groups.select("h", F.sha2("text", 256).alias("text_sha256"), "odd_keep", "odd_size")
    fewer = odd_rows.groupBy("h").agg(F.sum("odd_size").alias("lost"))
    return (
        small.join(many, "h", "left")
        .join(odd_rows, ["h", "text_sha256"], "left")
        .join(fewer, "h", "left")
        .select(
            "doc_id",
            F.when(F.col("odd_size").isNotNull(), F.col("odd_keep")).otherwise(F.coalesce("keep_id", "doc_id")).alias("keep_id"),
            F.coalesce("odd_size", F.col("group_size") - F.coalesce("lost", F.lit(0)), F.lit(1)).cast("long").alias("group_size"),
            "text_sha256",
        )
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  sha256(n) AS text_sha256 FROM t WINDOW w AS (PARTITION BY n)
"""
