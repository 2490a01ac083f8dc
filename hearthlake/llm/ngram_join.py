"""Operator 5: exact n-gram Jaccard self-join by a token-group matrix."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.llm import kernels as K
from hearthlake.llm.common import Scratch, broadcast_if_small, cut, small_batches
from hearthlake.llm.components import components

#: Members of a group that a query opens first, and by how much later rounds grow.
FIRST_MEMBERS, GROWTH = 4, 16
SEEDS = 8
#: Column entries that a task gathers before it sends them, and buckets that they are dealt to for each partition of the shuffle.
GATHERED, BUCKETS = 1 << 18, 8
#: Ratio of the set sizes of a class: queries look up the classes that a partner can be of.
CLASS = 1.04

CELL = "sig long, doc long, n int, need int, lead long, lead_n int"


@lru_cache
def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least set size, most unlike tokens, blocks) of each class of set sizes.

    Two sets of Jaccard similarity p % differ in at most (100 - p) / (100 + p) of
    their summed sizes. Within a class that is at most ``unlike`` tokens for any
    pair whose smaller set is of it, so of more than ``unlike`` blocks of tokens
    that are not empty one at least is the same in both.
    """
    ratio, starts = max(1.5, 120 / percent), [1]
    while starts[-1] < 1 << 31:
        starts.append(max(starts[-1] + 1, int(starts[-1] * ratio)))
    least = np.array(starts, np.int64)
    most = np.append(least[1:] - 1, 1 << 32)
    unlike = (100 - percent) * (most + most * 100 // percent) // (100 + percent)
    spare = np.where(unlike > 0, 1 + unlike // 5, 0)
    return least, unlike, unlike + 1 + spare


def blocks(tokens: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, signatures that a partner must share) of each token block.

    A row's set is cut into blocks by ranges of the token hash, in its own size
    class and, if smaller partners may be of it, in the next lower class; a
    block's signature hashes all its tokens. A set with too few blocks that are
    not empty is cut again under other hashes (its last column is 1 then), and
    in the end token by token, so that no pair goes without a common signature.
    A token in which partners differ spoils one block at most, so of a set with
    enough blocks a partner of the class shares all but as many as it may differ in.
    """
    least, unlike, parts = size_classes(percent)
    n = np.diff(first)
    own = np.searchsorted(least, n, "right") - 1
    smallest = -(-n * percent // 100)
    lower = np.flatnonzero((own > 0) & (smallest < least[np.maximum(own, 0)]))
    out = []
    # with a partner of its own class a set is the smaller one or as good as; one of the lower class is smaller
    partner = np.where(n > 0, n * 100 // percent, 0), np.maximum(least[np.maximum(own, 0)] - 1, 0)
    for rows, of, most in ((np.flatnonzero(n > 0), own, partner[0]), (lower, own - 1, partner[1])):
        for seed in range(SEEDS + 1):
            if not len(rows):
                break
            count = n[rows]
            row = np.repeat(np.arange(len(rows)), count)
            token = tokens[np.repeat(first[rows] - (np.cumsum(count) - count), count) + np.arange(len(row))]
            kind = of[rows]
            if seed == SEEDS:  # token by token
                part = np.arange(len(token)).astype(K.U)
                name = np.zeros(len(token), K.U)
            else:
                if seed:
                    token = K.mix(token ^ K.U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
                    order = np.lexsort((token, row))
                    token, row = token[order], row[order]
                part = ((token >> K.U(32)) * parts[kind].astype(K.U)[row]) >> K.U(32)
                name = part
            new = np.ones(len(token), bool)
            new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            sums = np.add.reduceat(K.mix(token ^ K._STEP[4]), at)
            label = K.mix(name[at] * K._STEP[1] + kind.astype(K.U)[row[at]] * K._STEP[2] + K.U(seed))
            have = np.bincount(row[at], minlength=len(rows))
            good = have > unlike[kind]
            differ = (100 - percent) * (n[rows] + most[rows]) // (100 + percent)
            stated = np.where(good & (seed == 0), np.maximum(have - differ, 1), 1)
            out.append((rows[row[at]], K.mix(sums + label), stated[row[at]]))
            rows = rows[~good]
    if not out:
        return np.empty(0, np.int64), np.empty(0, K.U), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, at in K.chunks(column):
        words = K.split(data, at, K.BY_SPACE)
        tokens, first = K.distinct(*K.shingles(words, size))
        yield lo, hi, tokens, first


def matrix(size: int, percent: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The matrix, packed, in rows (bucket, kind, data) that are to be brought together by bucket.

    kind 0: documents that need no one else: lead (a document of the task with an equal set, or
    itself), doc, n, and 1 for a null id; 1: two hashes, doc and n of each other set; 2: entries of
    columns that two documents of the task share, with the column's least document there; 3: the
    entry of that one only. So a set or block that a third of all documents have is one entry a
    task where columns meet.
    """

    def send(cells: list[np.ndarray], sets: list[np.ndarray], alone: list[np.ndarray]) -> pa.RecordBatch:
        found = list(K.anywhere(0, alone, buckets))
        order = np.lexsort((sets[1], sets[0].view(K.U)))
        sets = [x[order] for x in sets]
        found += K.by_bucket(1, K.bucket(sets[0].view(K.U), buckets), sets)
        order = np.lexsort((cells[1], cells[0].view(K.U)))
        sig, doc, n, need = (x[order] for x in cells)
        start, lead = K.same_as_before(sig)
        other = doc != doc[lead]
        shared = np.zeros(len(sig), np.int64)
        shared[lead[other]] = 1
        found += K.anywhere(2, [sig[other], doc[other], n[other], need[other], doc[lead[other]], n[lead[other]]], buckets)
        found += K.by_bucket(3, K.bucket(sig[start].view(K.U), buckets), [sig[start], doc[start], n[start], 2 * need[start] + shared[start]])
        return K.packed(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        held: list[list[list[np.ndarray]]] = [[], [], []]
        gathered = 0
        for batch in batches:
            for lo, hi, tokens, first in _sets(batch.column(1), size):
                n = np.diff(first)
                ids = batch.column(0).slice(lo, hi - lo)
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                doc = ids.fill_null(0).to_numpy().astype(np.int64)
                whole, some = np.zeros((2, hi - lo), K.U), n > 0
                for k in range(2):
                    if len(tokens):
                        whole[k][some] = np.add.reduceat(K.mix(tokens ^ K._STEP[k]), first[:-1][some])
                    whole[k] = K.mix(whole[k] + n.astype(K.U) * K._STEP[2 + k])
                lead, new = doc.copy(), np.zeros(hi - lo, bool)
                for r in np.flatnonzero(some & named):
                    before = len(seen)
                    lead[r] = seen.setdefault((int(whole[0][r]), int(whole[1][r])), int(doc[r]))
                    new[r] = len(seen) > before
                held[2].append([x[~new] for x in (lead, doc, n, (~named).astype(np.int64))])
                held[1].append([x[new] for x in (*whole.view(np.int64), doc, n)])
                row, sig, need = blocks(tokens, first, percent)
                keep = new[row]
                row = row[keep]
                held[0].append([sig[keep].view(np.int64), doc[row], n[row], need[keep]])
                gathered += len(row) + hi - lo
                if gathered >= GATHERED:
                    yield send(*([np.concatenate(x) for x in zip(*parts, strict=True)] for parts in held))
                    held, gathered = [[], [], []], 0
        if gathered:
            yield send(*([np.concatenate(x) for x in zip(*parts, strict=True)] for parts in held))

    return run


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows that come by bucket and kind: each document (sig null) with the least of its set, and the
    entries of columns that several documents share with the least document of the column."""

    def cells(sig: np.ndarray | None, doc: np.ndarray, n: np.ndarray, have: np.ndarray, lead: np.ndarray, lead_n: np.ndarray, unnamed: np.ndarray | None = None) -> pa.RecordBatch:
        kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()
        columns = [pa.nulls(len(doc), pa.int64()) if sig is None else pa.array(sig)]
        columns += [pa.array(x.astype(t.to_pandas_dtype()), t, mask=unnamed if k in (0, 3) else None) for k, (x, t) in enumerate(zip((doc, n, have, lead, lead_n), kinds[1:], strict=True))]
        return pa.RecordBatch.from_arrays(columns, ["sig", "doc", "n", "need", "lead", "lead_n"])

    for kind, columns in K.unpacked(batches, alone=(0, 2)):
        if kind == 0:
            lead, doc, n, unnamed = columns
            yield cells(None, doc, n, np.zeros_like(n), lead, n, unnamed > 0)
        elif kind == 1:
            order = np.lexsort((columns[2], columns[1], columns[0]))
            a, b, doc, n = (x[order] for x in columns)
            yield cells(None, doc, n, np.zeros_like(n), doc[K.same_as_before(a, b)[1]], n)
        elif kind == 2:
            yield cells(*columns)
        else:
            order = np.lexsort((columns[1], columns[0]))
            sig, doc, n, have = (x[order] for x in columns)
            start, lead = K.same_as_before(sig)
            several = np.maximum.reduceat((doc != doc[lead]) | (have & 1 > 0), np.flatnonzero(start))[np.cumsum(start) - 1]
            yield cells(sig[several], doc[several], n[several], have[several] >> 1, doc[lead][several], n[lead][several])


def token_sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, tokens, first in _sets(batch.column("text"), size):
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(lo, hi - lo), K.lists(tokens, first)], ["doc", "tokens"])

    return run


def compare(size: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) of a group's leading document (rank 0, first in its group) and those after it that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leads = None, []
        for batch in batches:
            a, salt, rank, doc = (batch.column(c).to_numpy() for c in ("a", "salt", "rank", "doc"))
            found = []
            for lo, hi, tokens, first in _sets(batch.column("text"), size):
                for r in range(lo, hi):
                    mine = tokens[first[r - lo] : first[r - lo + 1]]
                    if group != (a[r], salt[r]):
                        group, leads = (a[r], salt[r]), []
                    if rank[r] == 0:
                        leads.append(mine.copy())
                        continue
                    for lead in leads:
                        if 100 * min(len(lead), len(mine)) < percent * max(len(lead), len(mine)):
                            continue
                        both = len(np.intersect1d(lead, mine, assume_unique=True))
                        if both and 100 * both >= percent * (len(lead) + len(mine) - both):
                            found.append((a[r], doc[r]))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

    return run


#: Documents that a leading document's set is compared with in one task; more are dealt to several.
GROUP_ROWS = 512


def _alike(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are alike: each text goes to the leading documents that it is
    compared with, once, and a leading document with many others to several tasks."""
    loads = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("parts"))
    others = pairs.join(loads, "a").select(F.col("b").alias("doc"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("rank"))
    leads = loads.select(F.col("a").alias("doc"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("rank"))
    wanted = broadcast_if_small(cut(others.union(leads)))
    rows = texts.join(wanted, F.col("doc_id") == F.col("doc")).select("a", "salt", "rank", "doc", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "rank")
    return cut(rows.mapInArrow(compare(size, percent), "a long, b long"))


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b).cast("long") >= percent * F.greatest(a, b).cast("long")


def _tokens(texts: DataFrame, crowd: DataFrame, size: int) -> DataFrame:
    """(row, doc, via): the tokens of each row of ``texts`` whose document is in ``crowd``."""
    rows = texts.join(broadcast_if_small(crowd.select("doc")), F.col("doc_id") == F.col("doc")).select("doc", "text")
    rows = rows.mapInArrow(token_sets(size), "doc long, tokens array<long>").withColumn("row", F.monotonically_increasing_id())
    return rows.select("row", "doc", F.explode("tokens").alias("via"))


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Tokens that sets of n and m must share at least."""
    return F.ceil(percent * (n + m).cast("long") / (100 + percent))


def _class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(CLASS)).cast("int")


def _prefixes(tokens: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(via, doc, n, cap, component, weight): of each document that has enough tokens in common with other groups
    the rarest tokens, rare by how many documents have them; cap: its tokens from this one on.

    The first token in this order that two sets have in common leaves each at least the
    overlap that they need, so it is among the rows here. Tokens that one group alone has
    lead to no other and are left out, but they stand before it and lower its cap.
    """
    with_group = tokens.join(groups, "doc")
    counts = with_group.groupBy("via").agg(F.count("*").alias("docs"), (F.min("component") != F.max("component")).alias("common"))
    of_row = Window.partitionBy("row")
    rows = with_group.join(counts, "via").withColumns({
        "cap": F.row_number().over(of_row.orderBy(F.desc("docs"), F.desc("via"))), "n": F.count("*").over(of_row).cast("int"), "in_common": F.count_if("common").over(of_row),
    })
    need = F.ceil(percent * F.col("n").cast("long") / 100)
    return rows.where(F.col("common") & (F.col("in_common") >= need) & (F.col("cap") >= need)).select("via", "doc", "n", "cap", "component", "weight")


def _classes(percent: int) -> Column:
    """Size classes of the sets that one of n can be alike with from a token on that leaves it cap."""
    most = F.floor(F.col("cap").cast("long") * (100 + percent) / percent) - F.col("n")
    least = F.ceil(percent * F.col("n").cast("long") / 100)
    return F.when(most >= least, F.sequence(_class(least), _class(most)))


def _asks(prefix: DataFrame, percent: int) -> DataFrame:
    return prefix.select("via", "doc", "n", "cap", "component", "weight", F.explode(_classes(percent)).alias("class"))


def _queries(prefix: DataFrame, percent: int) -> DataFrame:
    """(doc, group) where the document's overlap with the union of a larger group's tokens, from a common one on,
    reaches what a member needs. Of two groups the smaller one's documents ask."""
    by = ["via", _class(F.col("n")).alias("class"), F.col("component").alias("group"), F.col("weight").alias("group_weight")]
    union = prefix.groupBy(*by).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("cap").alias("most_cap"))
    return (
        _asks(prefix, percent).join(union, ["via", "class"])
        .where(F.struct("weight", "component") < F.struct("group_weight", "group"))
        .where((100 * F.col("n").cast("long") >= percent * F.col("least")) & (100 * F.col("most").cast("long") >= percent * F.col("n")))
        .where(F.least("cap", "most_cap") >= _overlap(F.col("n"), F.greatest("least", F.ceil(percent * F.col("n").cast("long") / 100)), percent))
        .select("doc", "group")
        .distinct()
    )


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    A document's set holds its distinct ``size``-word shingles (words between
    space and \\t..\\r, A-Z lower-cased); one of fewer words has its whole
    sequence as its only shingle, one without words or with a null text the
    empty set, linked with nothing. Two documents are linked when their sets'
    Jaccard similarity is ``percent`` % or more; component_id is the least
    doc_id that links lead to. No link is missed but by a collision of 64-bit
    hashes of shingles, and no step has a cap. Other columns of ``docs`` are not read.

    1. Groups. Similar documents meet in columns of token blocks (see ``blocks``):
       each task sends the columns of its different sets, packed, and of a column
       that several of its documents share one entry; one shuffle brings columns
       together. Each column's documents are compared with its first one, so
       that a group of near copies of any size costs a comparison for each; the
       components of these links and of equal sets are the groups.
    2. The token-group matrix. Documents that may still have a partner in another
       group (their columns with several groups are as many as a partner must
       share) query the token unions of larger groups: from a common token on,
       rarest first, what a document and a group's union have left bounds the
       overlap with any member. Unions are kept by size class, so that near copies
       that are just too unlike do not meet.
    3. Only groups that reach the bound are opened, some members at first, then
       more until none is left; a query that has joined the group stops.

    Comparisons intersect whole token sets. Rows that share a doc_id are one
    node; a null doc_id is linked with nothing and has no component_id.
    """
    spark, texts = docs.sparkSession, docs.select("doc_id", "text")
    with Scratch(spark) as scratch, small_batches(spark):
        buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
        cells = texts.mapInArrow(matrix(size, percent, buckets), "bucket int, kind byte, data binary").repartition("bucket").sortWithinPartitions("bucket", "kind")
        cells = scratch.table(cells.mapInArrow(met, CELL))
        sets, columns = cells.where("sig IS NULL"), cells.where("sig IS NOT NULL")
        same = sets.where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b"))
        # a document whose every set has an equal one of a smaller id has nothing of its own to compare
        copies = sets.where("n > 0").groupBy("doc").agg(F.bool_and(F.col("doc") != F.col("lead")).alias("all")).where("all").select("doc")
        copies = broadcast_if_small(cut(copies))
        columns = columns.join(copies, "doc", "left_anti")
        pairs = columns.where((F.col("doc") != F.col("lead")) & _sizes_fit(F.col("n"), F.col("lead_n"), percent))
        pairs = cut(pairs.select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct())
        groups = cut(components(same.union(_alike(texts, pairs, size, percent))))

        def grouped(rows: DataFrame, groups: DataFrame, key: str, name: str) -> DataFrame:
            groups = broadcast_if_small(groups.select(F.col("node").alias(key), F.col("component").alias(name)))
            return rows.join(groups, key, "left").withColumn(name, F.coalesce(name, key))

        several = grouped(grouped(columns, groups, "doc", "component"), groups, "lead", "lead_component")
        several = broadcast_if_small(cut(several.where("component <> lead_component").select("sig").distinct()))
        hopeful = columns.join(several, "sig", "left_semi").groupBy("doc", "n", "need").agg(F.count("*").alias("have"))
        hopeful = cut(hopeful.where("have >= need").select("doc").distinct())
        if not hopeful.isEmpty():
            crowd = cut(grouped(hopeful, groups, "doc", "component"))
            weights = broadcast_if_small(cut(crowd.groupBy("component").agg(F.count("*").alias("weight"))))
            crowd = broadcast_if_small(cut(crowd.join(weights, "component").select("doc", "component", "weight")))
            prefix = scratch.table(_prefixes(scratch.table(_tokens(texts, crowd, size)), crowd, percent))
            asked = cut(_queries(prefix, percent))
            place = F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("doc"), "doc"))
            members = cut(prefix.select("doc", "component").distinct().withColumn("place", place))
            most = members.agg(F.max("place")).first()[0] or 0
            opened, upto = 0, FIRST_MEMBERS
            while opened < most:
                now = grouped(grouped(asked, groups, "doc", "own"), groups, "group", "other").where("own <> other").select("doc", "group")
                now = cut(now.join(members.where(f"place > {opened}").select(F.col("component").alias("group")).distinct(), "group", "left_semi"))
                if now.isEmpty():
                    break
                member = members.where(f"place > {opened} AND place <= {upto}").join(prefix, ["doc", "component"])
                member = member.select("via", F.col("component").alias("group"), _class(F.col("n")).alias("class"), F.col("doc").alias("with"), F.col("n").alias("m"), F.col("cap").alias("with_cap"))
                found = _asks(prefix, percent).join(broadcast_if_small(now), "doc").join(member, ["via", "group", "class"])
                found = found.where(_sizes_fit(F.col("n"), F.col("m"), percent) & (F.least("cap", "with_cap") >= _overlap(F.col("n"), F.col("m"), percent)))
                found = found.select(F.least("doc", "with").alias("a"), F.greatest("doc", "with").alias("b")).distinct()
                links = _alike(texts, cut(found.join(pairs, ["a", "b"], "left_anti")), size, percent)
                opened, upto = upto, upto * GROWTH
                if not links.isEmpty():
                    groups = cut(components(links.union(groups.select("component", "node"))))

        every = sets.select("doc", F.col("n").cast("long").alias("n_shingles"))
        return cut(grouped(every, groups, "doc", "component").select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id")))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=85)
