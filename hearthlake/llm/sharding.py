"""Operator 8: contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlake.llm.common import cut, fresh, named

ROW_BYTES = 8


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def shard(docs: DataFrame, shards: int = 24, whole: float = 0.05, columns: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs`` (and ``columns`` of it; one that
    has a name of these gets _ at its end).

    Rows stand in the order of doc_id, equal texts together at the smallest id
    among them. The global prefix sum of size (UTF-8 bytes of the text and 8) is
    cut at equal targets: a row is in the shard that the middle of its bytes
    falls in, so shards are contiguous and differ by about a row. Equal texts
    that together have at most ``whole`` of a shard's target move as one row, so
    a cut does not part them; more than that are cut like other rows. slot
    counts a shard's rows from 0 without gaps.

    Rows are dealt out by range of (smallest id, id where a group is cut), so a
    hot group spreads over tasks; each partition's totals are summed before it
    (one row a partition), and its rows add their running sum to that. Null
    texts have 8 bytes and are equal; null ids stand first; repeated rows have
    slots of their own. No rows give no rows.
    """
    more = [F.struct(*named(columns)).alias("row")] if columns else []
    kept = ["doc_id", "size", "text_crc32", *(["row"] if columns else [])]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("_h"), *more)
    rows = cut(rows)
    groups = rows.groupBy("_h").agg(F.min("doc_id").alias("_first"), F.sum("size").alias("_bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = max(total / shards, 1.0)
    together = F.col("_bytes") <= whole * target
    spread = (
        rows.join(groups, "_h")
        .withColumn("_unit", F.when(together, F.lit(None)).otherwise(F.col("doc_id")))
        .withColumn("_bytes", F.when(together, F.col("_bytes")))
        .repartitionByRange(F.col("_first"), F.col("_h"), F.col("_unit"))
        .sortWithinPartitions("_first", "_h", "_unit", "doc_id", "text_crc32")
    )
    # checkpointed, so the partitions that totals and running sums speak of are the same
    spread = cut(spread.select(*kept, "_h", "_bytes"))
    part = F.spark_partition_id().alias("part")
    totals = spread.groupBy(part).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("b"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n"))
    # one row a partition
    start = {r.part: (r.b, r.n) for r in totals.collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, row = start.get(TaskContext.get().partitionId(), (0, 0))
        group, group_at = None, 0  # the group that the last batch ended in, and its first byte
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("size").to_numpy()
            at = before + np.cumsum(size) - size
            of = batch.column("_h").to_numpy(zero_copy_only=False)
            first = np.ones(len(of), bool)
            first[1:] = of[1:] != of[:-1]
            number = np.cumsum(first) - 1
            begins = at[first]
            if of[0] == group:
                begins[0] = group_at
            whole_bytes = batch.column("_bytes").to_numpy(zero_copy_only=False).astype(float)
            middle = np.where(np.isnan(whole_bytes), at + size / 2, begins[number] + whole_bytes / 2)
            out = np.minimum((middle / target).astype(np.int32), shards - 1)
            arrays = [batch.column(c) for c in kept] + [pa.array(out), pa.array(row + np.arange(len(of)))]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "shard", "_at"])
            before, row, group, group_at = int(at[-1] + size[-1]), row + len(of), of[-1], begins[number[-1]]

    kind = T.StructType([spread.schema[c] for c in kept]).add("shard", T.IntegerType()).add("_at", T.LongType())
    placed = cut(spread.mapInArrow(place, kind))
    names: list[str] = []
    for c in columns or []:
        names.append(fresh(c, ["doc_id", "size", "text_crc32", "shard", "slot", *names]))
    starts = placed.groupBy("shard").agg(F.min("_at").alias("_start"))
    return placed.join(F.broadcast(starts), "shard").select(  # a row a shard
        "doc_id", "size", "text_crc32", "shard", (F.col("_at") - F.col("_start")).alias("slot"), *(F.col("row")[c].alias(to) for c, to in zip(columns or [], names, strict=True))
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=24)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
