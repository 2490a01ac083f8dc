"""Hard negatives against a plain comparison with all rows, with many cells, blocks and equal vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlake.llm import hard_negatives

KIND = "vec_id long, label int, vector array<double>, positive string, a int"


def rows_of(seed, n, dims=6, hot=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-40, 40, (5, dims))
    out = []
    for i in range(n):
        v = centres[0] if rng.random() < hot else centres[rng.integers(5)] + rng.integers(-6, 7, dims)
        out.append((int(i), int(rng.integers(4)), [float(x) for x in v], "x", None))
    return out


def brute(rows, is_anchor, positives=5, negatives=3, percent=(50, 95)):
    least = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2]):
            key = (r[1], r[2])
            if r[0] not in least or key < least[r[0]]:
                least[r[0]] = key
    dims = max((len(v) for _, v in least.values()), default=0)
    ids = np.array(sorted(least))
    labels = np.array([least[i][0] for i in ids.tolist()])
    x = np.array([[*least[i][1], *[0.0] * (dims - len(least[i][1]))] for i in ids.tolist()])
    out = []
    for k in np.flatnonzero([is_anchor(i) for i in ids.tolist()]):
        s = x @ x[k]
        order = np.lexsort((ids, -s))
        for p in [j for j in order if j != k and labels[j] == labels[k]][:positives]:
            hard = [j for j in order if labels[j] != labels[k] and percent[0] * s[p] <= 100 * s[j] <= percent[1] * s[p]][:negatives]
            out += [(int(ids[k]), int(ids[p]), r, int(ids[j]), s[p], s[j]) for r, j in enumerate(hard, 1)]
    return sorted(out)


def got(spark, rows, anchor):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, KIND).repartition(3), anchor).collect())


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_equals_brute_force_over_many_blocks(spark, monkeypatch, hot):
    for name, value in (("BLOCK", 16), ("SAMPLE", 100), ("CELLS", 12), ("QUERIES", 10)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = rows_of(1, 500, hot=hot)
    want = brute(rows, lambda i: i % 7 == 0)
    assert got(spark, rows, F.col("vec_id") % 7 == 0) == want
    assert len(want) > 300


def test_edge_cases(spark):
    rows = rows_of(2, 80)
    rows += [rows[3], (4, 0, rows[9][2], None, None), (None, 1, rows[5][2], None, None), (200, None, rows[5][2], None, None), (201, 1, None, None, None)]
    rows += [(202, 1, [1.0, None, 3.0, 0.0, 0.0, 0.0], None, None), (203, 2, [float("nan")] * 6, None, None), (204, 3, [float("inf")] * 6, None, None)]
    rows += [(205, 1, [30.0, 2.0], None, None), (206, 2, [], None, None), (210, 9, [1.0] * 6, None, None), (215, 1, [0.0] * 6, None, None)]
    assert got(spark, rows, F.col("vec_id") % 5 == 0) == brute(rows, lambda i: i % 5 == 0)
    assert got(spark, [], F.col("vec_id") % 5 == 0) == []
    assert got(spark, [(i, 1, [1.0], None, None) for i in range(6)], F.lit(True)) == [], "no other labels"


@pytest.mark.parametrize("percent", [None, (50, 95), (90, 100)])
def test_tree_finds_what_a_scan_finds(monkeypatch, percent):
    monkeypatch.setattr(hard_negatives, "LEAF", 4)
    rows = rows_of(3, 400, hot=0.2)
    ids, labels, x = np.array([r[0] for r in rows])[::-1], np.array([r[1] for r in rows])[::-1], np.array([r[2] for r in rows])[::-1]
    q = np.arange(0, 400, 9)
    positive = np.abs(x[q] @ x[7])
    found = sorted(zip(*hard_negatives.nearest(x, ids, labels, x[q], ids[q], labels[q], positive, 3, percent), strict=True))
    want = []
    for k, row in enumerate(q):
        s = x @ x[row]
        ok = (labels == labels[row]) & (ids != ids[row]) if percent is None else (labels != labels[row]) & (percent[0] * positive[k] <= 100 * s) & (100 * s <= percent[1] * positive[k])
        want += [(k, ids[j], s[j]) for j in [j for j in np.lexsort((ids, -s)) if ok[j]][:3]]
    assert found == sorted(want)
    tree = hard_negatives.grown(x, float((x * x).sum(1).max()), 4)
    assert tree.leaves > 20


def test_every_row_lies_in_its_cells_ranges():
    x = np.array([r[2] for r in rows_of(4, 300)])
    norm2 = float((x * x).sum(1).max())
    tree = hard_negatives.grown(x[:90], norm2, 10)
    between = hard_negatives._between(x, norm2, tree)
    leaf = tree.leaf_of(between)
    near, far = hard_negatives._annuli(hard_negatives._from_queries(x, norm2, tree), *hard_negatives._ranges(tree, leaf, between))
    true = np.sqrt(np.maximum((x * x).sum(1)[:, None] + norm2 - 2 * x @ x.T, 0))
    slack = hard_negatives.SLACK * np.sqrt(norm2)
    assert (near[:, leaf] <= true + slack).all() and (far[:, leaf] >= true - slack).all()
