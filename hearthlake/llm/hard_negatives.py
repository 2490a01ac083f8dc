"""Operator 12: hard negatives by vantage-point trees over norm-augmented vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.common import Scratch, broadcast_if_small, cut, table

#: Rows of the sample that the upper tree is fitted on, and its leaves (cells) at most.
SAMPLE, CELLS = 4096, 512
#: Rows of a block (part of a cell that is searched together), of a leaf of its tree, and queries that meet it at a time, about.
BLOCK, LEAF, QUERIES = 4096, 64, 8192
#: Cells that a query looks into before it knows its bound.
NEAR = 2
#: Distances are compared with a slack of this share of the largest norm.
SLACK = 1e-6

QUERY = "a long, b long, label int, vector array<double>, positive double"
FOUND = "a long, b long, vec_id long, score double"


@dataclass
class Tree:
    """A vantage-point tree: vantage vectors (and their norms' complements), for each leaf its ancestors, and whether it
    lies inside their radii."""

    vantage: np.ndarray
    rest: np.ndarray
    radius: np.ndarray
    inner: list[int] = field(default_factory=list)
    outer: list[int] = field(default_factory=list)
    leaves: int = 0

    def path(self, leaf: int) -> list[int]:
        return self.paths[leaf]

    def finish(self) -> Tree:
        """Children are numbers of nodes, or -1 - leaf."""
        self.paths: dict[int, list[int]] = {}
        todo = [(0, [])] if len(self.radius) else []
        if not todo:
            self.paths[0] = []
        while todo:
            node, above = todo.pop()
            for child in (self.inner[node], self.outer[node]):
                if child < 0:
                    self.paths[-1 - child] = [*above, node]
                else:
                    todo.append((child, [*above, node]))
        return self

    def leaf_of(self, distance: np.ndarray) -> np.ndarray:
        """The leaf of rows of these distances to the vantage vectors."""
        at = np.full(len(distance), 0 if len(self.radius) else -1)
        while len(rows := np.flatnonzero(at >= 0)):
            node = at[rows]
            near = distance[rows, node] <= self.radius[node]
            at[rows] = np.where(near, np.array(self.inner)[node], np.array(self.outer)[node])
        return -1 - at


def _rest(vectors: np.ndarray, norm2: float) -> np.ndarray:
    """The component that brings each vector to the largest norm."""
    return np.sqrt(np.maximum(norm2 - (vectors * vectors).sum(1), 0))


def _between(vectors: np.ndarray, norm2: float, tree: Tree) -> np.ndarray:
    """Distances of augmented rows to the vantage vectors."""
    return np.sqrt(np.maximum(2 * norm2 - 2 * (vectors @ tree.vantage.T + np.outer(_rest(vectors, norm2), tree.rest)), 0))


def _from_queries(queries: np.ndarray, norm2: float, tree: Tree) -> np.ndarray:
    """Distances of queries, whose augmented component is 0, to the vantage vectors."""
    return np.sqrt(np.maximum((queries * queries).sum(1)[:, None] + norm2 - 2 * queries @ tree.vantage.T, 0))


def grown(vectors: np.ndarray, norm2: float, most: int) -> Tree:
    """A tree whose leaves have at most ``most`` of ``vectors``, but where no radius parts them (equal vectors).

    A node's vantage vector is the row farthest from its first one; the radius is the median distance.
    """
    dims = vectors.shape[1]
    tree = Tree(np.empty((0, dims)), np.empty(0), np.empty(0))
    vantage, rest_of, radius = [], [], []
    rest = _rest(vectors, norm2)
    todo = [(np.arange(len(vectors)), None)]

    def distance(rows: np.ndarray, v: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 * norm2 - 2 * (vectors[rows] @ vectors[v] + rest[rows] * rest[v]), 0))

    def hang(where: tuple[int, bool] | None, child: int) -> None:
        if where is not None:
            (tree.inner if where[1] else tree.outer)[where[0]] = child

    while todo:
        rows, where = todo.pop()
        near = None
        if len(rows) > most:
            v = rows[distance(rows, rows[0]).argmax()]
            d = distance(rows, v)
            r = np.median(d)
            near = d <= r
            if near.all():  # the median is the largest
                r = d[d < r].max() if (d < r).any() else r
                near = d <= r
        if near is None or near.all():
            hang(where, -1 - tree.leaves)
            tree.leaves += 1
            continue
        node = len(radius)
        hang(where, node)
        vantage.append(vectors[v])
        rest_of.append(rest[v])
        radius.append(r)
        tree.inner.append(0)
        tree.outer.append(0)
        todo += [(rows[near], (node, True)), (rows[~near], (node, False))]
    if radius:
        tree.vantage, tree.rest, tree.radius = np.array(vantage), np.array(rest_of), np.array(radius)
    return tree.finish()


def _ranges(tree: Tree, leaf: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) distance of each leaf's rows to each vantage vector above it; others are left open (0, infinite);
    a leaf without rows is (infinite, 0)."""
    lo, hi = np.full((tree.leaves, len(tree.radius)), np.inf), np.zeros((tree.leaves, len(tree.radius)))
    for k in range(tree.leaves):
        mine = distance[leaf == k]
        others = np.setdiff1d(np.arange(len(tree.radius)), tree.path(k))
        if len(mine):
            lo[k], hi[k] = mine.min(0), mine.max(0)
            lo[k][others], hi[k][others] = 0, np.inf
    return lo, hi


def _annuli(distance: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How near and how far each leaf's rows can be from each query, from the queries' distances to the vantage vectors."""
    near, far = np.zeros((len(distance), len(lo))), np.full((len(distance), len(lo)), np.inf)
    for k in range(lo.shape[1]):
        d = distance[:, k : k + 1]
        np.maximum(near, np.maximum(d - hi[:, k], lo[:, k] - d), out=near)
        np.minimum(far, d + hi[:, k], out=far)
    return near, far


def _window(q2: np.ndarray, norm2: float, positive: np.ndarray, percent: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """The distances of the highest and the lowest score that is asked for."""
    if percent is None:
        return np.zeros(len(q2)), np.full(len(q2), np.inf)
    low, high = (percent[k] * positive / 100 for k in (0, 1))
    return np.sqrt(np.maximum(q2 + norm2 - 2 * high, 0)), np.sqrt(np.maximum(q2 + norm2 - 2 * low, 0))


def nearest(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, own: np.ndarray, label: np.ndarray, positive: np.ndarray, k: int, percent: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row's id, score) of the ``k`` rows of highest score (ties: smaller id) for each query: without ``percent``, other rows of its
    label, with it rows of other labels whose score is from percent[0] to percent[1] % of ``positive``.

    Leaves of a vantage-point tree over the rows that cannot meet the query's annulus are not opened; the others are, the nearest
    first, until the next one cannot hold a better row. All queries go on together, leaf by leaf.
    """
    norm2 = float((vectors * vectors).sum(1).max())
    slack = SLACK * np.sqrt(norm2)
    tree = grown(vectors, norm2, LEAF)
    between = _between(vectors, norm2, tree)
    leaf = tree.leaf_of(between)
    near, far = _annuli(_from_queries(queries, norm2, tree), *_ranges(tree, leaf, between))
    q2 = (queries * queries).sum(1)
    inner, outer = _window(q2, norm2, positive, percent)
    near = np.where((near <= outer[:, None] + slack) & (far >= inner[:, None] - slack), near, np.inf)
    order = np.argsort(near, axis=1)
    by = np.argsort(leaf, kind="stable")
    cuts = np.searchsorted(leaf[by], np.arange(tree.leaves + 1))
    best, whose = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    going = np.arange(len(queries))
    for turn in range(tree.leaves):
        at = order[going, turn]
        bound = np.maximum(near[going, at] - slack, 0)
        going = going[np.isfinite(bound) & ((q2[going] + norm2 - bound * bound) / 2 >= best[going, -1])]
        if not len(going):
            break
        at = order[going, turn]
        for one in np.unique(at):
            rows, q = by[cuts[one] : cuts[one + 1]], going[at == one]
            score = queries[q] @ vectors[rows].T
            ok = (labels[rows] == label[q][:, None]) == (percent is None)
            ok &= ids[rows] != own[q][:, None]
            if percent is not None:
                p = positive[q][:, None]
                ok &= (percent[0] * p <= 100 * score) & (100 * score <= percent[1] * p)
            score = np.concatenate([best[q], np.where(ok, score, -np.inf)], axis=1)
            named = np.concatenate([whose[q], np.broadcast_to(ids[rows], ok.shape)], axis=1)
            first = np.lexsort((named, -score), axis=1)[:, :k]
            best[q], whose[q] = np.take_along_axis(score, first, 1), np.take_along_axis(named, first, 1)
    q, j = np.nonzero(np.isfinite(best))
    return q, whose[q, j], best[q, j]


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    size = np.diff(at)
    out = np.zeros((len(size), dims))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(at[:-1], size)] = flat
    return out


@dataclass
class Index:
    """The upper tree, and of its cells the ranges and how many blocks each has; all bounded by CELLS."""

    placed: DataFrame | None
    tree: Tree
    lo: np.ndarray
    hi: np.ndarray
    blocks: np.ndarray
    norm2: float
    dims: int


def _placed(tree: Tree, norm2: float, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of(_between(_matrix(batch.column("vector"), dims), norm2, tree))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "cell"])

    return run


def _extents(tree: Tree, norm2: float, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cell, node, least, largest, rows) of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = tree.leaves, len(tree.radius)
        lo, hi, count = np.full((n, k), np.inf), np.zeros((n, k)), np.zeros(n, np.int64)
        for batch in batches:
            leaf, d = batch.column("cell").to_numpy(), _between(_matrix(batch.column("vector"), dims), norm2, tree)
            np.minimum.at(lo, leaf, d)
            np.maximum.at(hi, leaf, d)
            count += np.bincount(leaf, minlength=n)
        for c in np.flatnonzero(count):
            path = np.array([*tree.path(int(c)), -1])
            least = np.append(lo[c][path[:-1]], 0.0)
            most = np.append(hi[c][path[:-1]], 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(path), c, np.int32)), pa.array(path.astype(np.int32)), pa.array(least), pa.array(most), pa.array(np.full(len(path), count[c]))], ["cell", "node", "lo", "hi", "n"])

    return run


def index(vectors: DataFrame, scratch: Scratch) -> Index | None:
    """The index of all rows (vec_id, label, vector); None where there are none.

    The upper tree is fitted on a sample of SAMPLE rows (the least hashes of the ids), every row is
    placed by it, and the cells' ranges of distances are of all rows.
    """
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).first()
    if not facts["n"]:
        return None
    dims, norm2 = max(facts["dims"], 1), facts["norm2"]
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    most = max(SAMPLE // CELLS, -(-sample.num_rows * BLOCK // facts["n"]))
    tree = grown(_matrix(sample.column("vector"), dims), norm2, most)
    placed = scratch.table(vectors.mapInArrow(_placed(tree, norm2, dims), "vec_id long, label int, vector array<double>, cell int"))
    lo, hi, count = np.zeros((tree.leaves, len(tree.radius))), np.full((tree.leaves, len(tree.radius)), np.inf), np.zeros(tree.leaves, np.int64)
    ranges = placed.mapInArrow(_extents(tree, norm2, dims), "cell int, node int, lo double, hi double, n long")
    for r in ranges.groupBy("cell", "node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect():
        if r.node < 0:
            count[r.cell] = r.n
        else:
            lo[r.cell, r.node], hi[r.cell, r.node] = r.lo, r.hi
    blocks = -(-count // BLOCK)
    per_cell = F.element_at(F.array(*(F.lit(int(max(b, 1))) for b in blocks)), F.col("cell") + 1)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), per_cell).cast("int"))
    return Index(placed, tree, lo, hi, blocks, norm2, dims)


def _visits(found: Index, near_only: bool, percent: tuple[float, float] | None, slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The queries, once for each block of the cells that they are to look into: the NEAR nearest, or of the others those
    that can hold a score of at least the ``bound`` known by then. ``of`` deals a block's queries to groups."""
    tree, slack = found.tree, SLACK * np.sqrt(found.norm2)
    first_block = np.concatenate([[0], np.cumsum(found.blocks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, QUERIES // 8):
                part = batch.slice(k, QUERIES // 8)
                queries, positive = _matrix(part.column("vector"), found.dims), part.column("positive").to_numpy(zero_copy_only=False)
                q2 = (queries * queries).sum(1)
                near, far = _annuli(_from_queries(queries, found.norm2, tree), found.lo, found.hi)
                inner, outer = _window(q2, found.norm2, positive, percent)
                near = np.where((found.blocks > 0) & (near <= outer[:, None] + slack) & (far >= inner[:, None] - slack), near, np.inf)
                order = np.argsort(near, axis=1, kind="stable")
                rank = np.argsort(order, axis=1, kind="stable")
                ok = np.isfinite(near)
                if near_only:
                    ok &= rank < NEAR
                else:
                    least = np.maximum(near - slack, 0)
                    ok &= (rank >= NEAR) & ((q2[:, None] + found.norm2 - least * least) / 2 >= part.column("bound").to_numpy(zero_copy_only=False)[:, None])
                q, cell = np.nonzero(ok)
                times = found.blocks[cell]
                q, cell, inside = np.repeat(q, times), np.repeat(cell, times), np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                for i in range(0, len(q), QUERIES):
                    s = slice(i, i + QUERIES)
                    rows = part.select(["a", "b", "label", "vector", "positive"]).take(pa.array(q[s]))
                    of = (rows.column("a").to_numpy() * 31 + rows.column("b").to_numpy()) % slices
                    at = first_block[cell[s]] + inside[s]
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at.astype(np.int64)), pa.array(of.astype(np.int32))], [*rows.schema.names, "at", "of"])

    return run


def _search(found: Index, queries: DataFrame, k: int, percent: tuple[float, float] | None) -> DataFrame:
    """(a, b, vec_id, score) of the best ``k`` rows for each query (QUERY), as ``nearest`` has them, over all blocks."""
    spark = queries.sparkSession
    slices = -(-queries.count() // QUERIES) or 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dims = found.dims
    first_block = [int(x) for x in np.concatenate([[0], np.cumsum(found.blocks)])]
    at = F.element_at(F.array(*(F.lit(x) for x in first_block)), F.col("cell") + 1).cast("long") + F.col("block")
    rows = found.placed.select("vec_id", F.col("label").alias("kind"), F.col("vector").alias("x"), at.alias("at"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("of"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({n: pa.array([], t) for n, t in (("a", pa.int64()), ("b", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        if not left.num_rows or not right.num_rows:
            return none
        q, whose, score = nearest(
            _matrix(right.column("x"), dims), right.column("vec_id").to_numpy(), right.column("kind").to_numpy(), _matrix(left.column("vector"), dims), left.column("a").to_numpy(), left.column("label").to_numpy(),
            left.column("positive").to_numpy(), k, percent,
        )
        return pa.table({"a": left.column("a").take(pa.array(q)), "b": left.column("b").take(pa.array(q)), "vec_id": whose, "score": score})

    def looked(queries: DataFrame, near_only: bool) -> DataFrame:
        asked = queries.mapInArrow(_visits(replace(found, placed=None), near_only, percent, slices), f"{QUERY}, at long, of int").repartition(parts, "at", "of").groupBy("at", "of")
        return asked.cogroup(rows.repartition(parts, "at", "of").groupBy("at", "of")).applyInArrow(meet, FOUND)

    def best(rows: DataFrame) -> DataFrame:
        kept = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
        return rows.groupBy("a", "b").agg(kept.alias("kept"))

    first = cut(best(looked(queries, True)))
    bound = F.when(F.size("kept") >= k, -F.col("kept")[k - 1]["s"])
    rest = queries.join(first.select("a", "b", bound.alias("bound")), ["a", "b"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    flat = first.select("a", "b", F.explode("kept").alias("x")).select("a", "b", "x.vec_id", (-F.col("x.s")).alias("score"))
    both = best(looked(rest.select("a", "b", "label", "vector", "positive", "bound"), False).union(flat))
    return both.select("a", "b", F.posexplode("kept").alias("rank", "x")).select("a", "b", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, percent: tuple[float, float] = (50, 95)) -> DataFrame:
    """For each anchor and each of its positives the ``negatives`` rows of other labels with the highest scores from percent[0] to
    percent[1] % of the positive's score.

    ``vectors`` has vec_id, label and vector (array<double>); ``anchor`` marks its rows to be asked for. A score is the inner
    product with the anchor; ties go to the smaller vec_id. An anchor's positives are the ``positives`` other rows of
    its label with the highest scores. One row for each find: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    1. Vectors get one component more that brings all to the largest norm; an anchor gets 0 there. Higher scores
       are then smaller distances, and a window of scores is an annulus.
    2. An upper vantage-point tree, fitted on 4,096 rows, deals every row to one of at most 512 cells, and cells to blocks
       of about 4,096 rows, so equal vectors may be any number. Cells keep the range of distances of all their rows.
    3. A query goes to its nearest cells that meet its annulus, then to those that can still hold a better row. In
       each block a vantage-point tree over its rows is searched nearest first, in the annulus. Nothing is approximate.
    4. Blocks meet their queries by a cogroup, queries 8,192 at a time, so neither side of a group grows with the table.

    Rows of null vec_id, label or vector, or with a component that is null or not finite, take no part. Of rows of one
    vec_id the one of the least label and vector takes part. Shorter vectors count as ending in zeros. Anchors without positives, and
    positives without rows in their window, have no rows; an empty table gives none. Other columns are not
    read. Scores are exact for integer components while they are below 2 ** 46.
    """
    spark = vectors.sparkSession
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("vector").cast("array<double>").alias("vector"), anchor.alias("anchor"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(fine)
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("vec_id", "r.*")
    with Scratch(spark) as scratch:
        rows = scratch.table(rows)
        found = index(rows.select("vec_id", "label", "vector"), scratch)
        if found is None:
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double")
        anchors = rows.where("anchor").select(F.col("vec_id").alias("a"), F.lit(0).cast("long").alias("b"), "label", "vector", F.lit(0.0).alias("positive"))
        of = cut(_search(found, anchors, positives, None))
        asked = anchors.select("a", "label", "vector").join(of.select("a", F.col("vec_id").alias("b"), F.col("score").alias("positive")), "a").select("a", "b", "label", "vector", "positive")
        hard = cut(_search(found, scratch.table(asked), negatives, percent))
    scores = broadcast_if_small(of.select("a", F.col("vec_id").alias("b"), F.col("score").alias("positive_score")))
    return hard.join(scores, ["a", "b"]).select(
        F.col("a").alias("anchor_id"), F.col("b").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Each 50th row's negatives; components in whole 256ths, each seventh row's label moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    mined = hard_negatives(rows.where(fine).select("vec_id", label.alias("label"), whole.alias("vector")), F.col("vec_id") % 50 == 0)
    return mined.withColumns({c: F.col(c).cast("long") for c in ("positive_score", "negative_score")})


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, e.vec_id AS o, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score FROM e AS a JOIN e ON a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT a, o AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, o) <= 5),
n AS (SELECT p.a, p.p, ps, s.o AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.o) AS k FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * ps <= 100 * s.score AND 100 * s.score <= 95 * ps)
SELECT a AS anchor_id, p AS positive_id, k::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 3
"""
