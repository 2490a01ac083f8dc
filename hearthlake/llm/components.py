"""Connected components of a graph that no single machine need hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.llm import kernels as K
from hearthlake.llm.common import cut

#: Edges that a task contracts at a time.
EDGES = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (v, u), u < v, that connect the same nodes: each node of the task's edges hangs on the
    least that it is connected with there. A task holds its edges EDGES at a time beside
    what they were contracted to."""
    v = u = np.empty(0, np.int64)
    held, size = [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        node, root = K.roots(*(np.concatenate([x, *(h[k] for h in held)]) for k, x in enumerate((v, u))))
        return node[node != root], root[node != root]

    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in range(2)])
        size += batch.num_rows
        if size >= max(EDGES, len(v)):
            (v, u), held, size = flush(), [], 0
    v, u = flush()
    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], ["v", "u"])


def components(links: DataFrame, a: str = "a", b: str = "b", key: str = "node") -> DataFrame:
    """(``key``, component) of every node of ``links``; component is its least node.

    1. Each task replaces its edges by stars around the least node that they
       connect; then edges are dealt by their larger end and contracted again,
       until no node has two smaller ones. A hub with a third of all edges is the
       smaller end of most and so is never gathered in a task, and where it is the
       larger end, each task's star has sent it one edge only.
       What is EDGES or fewer by then, which a task holds anyway, is contracted by one task and
       done.
    2. What is left is a forest; each round halves a node's way to its root by a
       join of the nodes with their parents (adaptive execution splits a hub).

    Rounds are about the logarithm of the longest path; each is cut by a
    checkpoint. Null nodes and self links are ignored; no links give no rows.
    """
    edges = (
        links.select(F.greatest(a, b).cast("long").alias("v"), F.least(a, b).cast("long").alias("u"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    )
    kind = "v long, u long"
    state = F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
    edges, before = edges.mapInArrow(_contract, kind), None
    while True:
        edges = cut(edges.repartition("v").mapInArrow(_contract, kind))
        now = edges.agg(*state).first()
        if now[0] <= EDGES:
            edges = cut(edges.coalesce(1).mapInArrow(_contract, kind))
            break
        if now == before:
            break
        before = now
    while now[0] > EDGES:
        up = edges.select(F.col("v").alias("_v"), F.col("u").alias("_u"))
        edges = cut(edges.join(up, edges["u"] == up["_v"], "left").select("v", F.coalesce("_u", "u").alias("u")))
        if (now := edges.agg(*state).first()) == before:
            break
        before = now
    leaf = edges.select(F.col("v").alias(key), F.col("u").alias("component"))
    return leaf.union(edges.select("u", "u").distinct())
