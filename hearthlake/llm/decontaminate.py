"""Operator 9: benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.llm import kernels as K
from hearthlake.llm.common import cut, lower_ascii, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 5
#: Bits of the filter that documents' shingles pass before any is emitted: 2 MB for any benchmark.
FILTER_BITS = 24


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, win, len, g, grams) of each window: ``window`` consecutive words of an
    item, or all of an item of fewer; grams are its shingles of g words in order."""
    w = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    return (
        items.select("item_id", w.alias("w"))
        .where(F.size("w") > 0)
        .withColumn("len", F.least(F.size("w"), F.lit(window)))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)))
        .select("item_id", F.slice("w", "at", "len").alias("w"), "len", F.least("len", F.lit(GRAM)).alias("g"))
        .select(
            "item_id",
            F.array_join("w", " ").alias("win"),
            "len",
            "g",
            F.transform(F.sequence(F.lit(1), F.col("len") - F.col("g") + 1), lambda i: F.array_join(F.slice("w", i, F.col("g")), " ")).alias("grams"),
        )
        .distinct()
    )


def _slot(hashes: np.ndarray, g: int) -> np.ndarray:
    return (K.mix(hashes + K.U(g)) >> K.U(64 - FILTER_BITS)).astype(np.int64)


def _gram_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("g").to_numpy()
        for g in np.unique(sizes):
            grams = batch.column("gram").filter(pa.array(sizes == g))
            for _, _, data, at in K.chunks(grams):
                hashes, _ = K.shingles(K.split(data, at, K.BY_LETTER), int(g), short=False)
                yield pa.RecordBatch.from_arrays([pa.array(_slot(hashes, int(g)))], ["slot"])


def _scan(sizes: list[int], words_of: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """n_words and the shingles (g, position, text) that pass the filter, for each document."""
    kind = pa.struct([("g", pa.int32()), ("pos", pa.int32()), ("gram", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in K.chunks(batch.column(1)):
                words = K.split(data, at, K.BY_LETTER)
                found = []
                for g in sizes:
                    hashes, first = K.shingles(words, g, short=False)
                    slot = _slot(hashes, g)
                    hit = np.flatnonzero((words_of[slot >> 6] >> (slot & 63)) & 1)
                    row = np.searchsorted(first, hit, "right") - 1
                    found.append((row, np.full(len(hit), g), hit - first[row]))
                row, g, pos = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
                order = np.argsort(row, kind="stable")
                row, g, pos = row[order], g[order], pos[order]
                begin = words.first[row] + pos
                grams = [words.text(a, a + n).decode("utf-8", "replace") for a, n in zip(begin, g, strict=True)]
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                hits = pa.StructArray.from_arrays([pa.array(g.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(grams, pa.string())], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(words.counts), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits)],
                    ["doc_id", "n_words", "hits"],
                )

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``.

    Words are runs of digits, letters a-z (A-Z lower-cased) and all beyond ASCII.
    A document contains an item's window where all its words stand in order, so
    the overlap that the join must find is the whole window, and one shingle of
    it is a sufficient prefix.

    1. One scan of the documents keeps the shingles that pass a bit filter of all
       items' shingles (fixed size, so a benchmark of any size works; the joins
       below are by shuffle unless Spark knows a side to be small).
    2. What is left is counted by shingle: the rarest of a window's shingles is
       its prefix. Windows with a shingle that no document has are done with.
    3. Documents meet windows by the prefix only. The position of the prefix
       gives where the window would start; it must lie within the document
       (positional and length bound), and the window's first and last shingles,
       which hold all its words, must stand there (comparison of their texts).

    Null texts and items have no words; an item without words has no window; null
    item_ids mark words but are not listed. Equal rows and equal doc_ids keep
    their own results. Without documents there are no rows. Windows of more than 10 words are refused.
    """
    if window > 2 * GRAM:
        raise ValueError(f"two shingles of {GRAM} words do not hold a window of {window}")
    windows = cut(item_windows(items.select("item_id", "text"), window))
    grams = windows.select("g", F.explode("grams").alias("gram")).distinct()
    sizes = sorted(r.g for r in windows.select("g").distinct().collect())  # at most GRAM rows
    slots = grams.mapInArrow(_gram_slots, "slot long")
    bits = slots.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("b")).toArrow()
    words_of = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    words_of[bits.column("w").to_numpy()] = bits.column("b").to_numpy()

    scanned = docs.select("doc_id", "text").mapInArrow(_scan(sizes, words_of), "doc_id long, n_words long, hits array<struct<g:int,pos:int,gram:string>>")
    scanned = cut(scanned.withColumn("row", F.monotonically_increasing_id()))
    hits = scanned.where(F.size("hits") > 0).select("row", "n_words", F.explode("hits").alias("hit")).select("row", "n_words", "hit.*")
    counts = hits.join(grams, ["g", "gram"], "left_semi").groupBy("g", "gram").agg(F.count("*").alias("n"))
    placed = windows.select("*", F.posexplode("grams").alias("off", "gram")).join(counts, ["g", "gram"], "left")
    # a window one of whose shingles nowhere occurs has a null count, which sorts first
    prefix = (
        placed.groupBy("item_id", "win", "len", "g")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "gram")).alias("p"), F.first("grams").alias("grams"))
        .where("p.n > 0")
        .select("item_id", "len", "g", F.col("p.off").alias("off"), F.col("p.gram").alias("gram"), F.col("grams")[0].alias("head"), F.element_at("grams", -1).alias("tail"))
    )
    start = F.col("pos") - F.col("off")
    maybe = (
        hits.join(prefix, ["g", "gram"])
        .withColumn("start", start)
        .where("start >= 0 AND start + len <= n_words")
        .select("row", "g", "item_id", "len", "start", "head", "tail")
        .distinct()
    )
    at = hits.select("row", "g", F.col("pos").alias("p"), F.col("gram").alias("t"))
    sure = maybe.join(at.withColumnsRenamed({"p": "start", "t": "head"}), ["row", "g", "start", "head"], "left_semi")
    sure = sure.withColumn("end", F.col("start") + F.col("len") - F.col("g"))
    sure = cut(sure.join(at.withColumnsRenamed({"p": "end", "t": "tail"}), ["row", "g", "end", "tail"], "left_semi").select("row", "item_id", "len", "start"))
    words = sure.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct()
    marked = words.groupBy("row").agg(F.count("*").alias("n_hit"))
    listed = (
        sure.select("row", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row")
        .agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    )
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return (
        scanned.select("doc_id", "n_words", "row").join(marked, "row", "left").join(listed, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len, array_to_string(w[s : s + len - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS len, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM bw),
dw AS (SELECT doc_id, len, s, array_to_string(w[s : s + len - 1], ' ') AS win
  FROM (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS s FROM d, lens)),
o AS (SELECT DISTINCT doc_id, item_id, s, len FROM dw JOIN bw USING (len, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + len)) AS p FROM o) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM o) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
