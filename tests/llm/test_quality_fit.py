"""The model of operator 7 is that of all labelled documents and of all pairs of them."""

import random

import numpy as np

from hearthlake.llm import quality

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"


def corpus(rng, n):
    """(doc_id, text, label): prose, and texts of digits and signs of which some are marked 1 too."""
    rows = []
    for i in range(n):
        junk = rng.random() < 0.3
        text = " ".join("".join(rng.choice("0123#*abc" if junk else "etaoinshr") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(3, 12)))
        rows.append((i, text, int(rng.random() < (0.2 if junk else 0.9))))
    return rows


def test_cut_is_the_quantile_of_all_labelled_documents(spark):
    rows = corpus(random.Random(3), 9_000)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], DOCS), spark.createDataFrame([(r[0], r[2]) for r in rows], LABELS)
    model = quality.train(docs, labels)
    scores = np.array([r.score for r in quality.score(docs, model, ["doc_id"]).collect()])
    bad = sum(r[2] == 0 for r in rows) / len(rows)
    assert abs(model.cut - np.quantile(scores, bad, method="lower")) < 1e-9


def test_weights_are_those_of_all_pairs(spark):
    rows = corpus(random.Random(4), 300)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], DOCS).repartition(3), spark.createDataFrame([(r[0], r[2]) for r in rows], LABELS)
    model = quality.train(docs, labels)
    data = [r[1].encode() for r in rows]
    x = quality.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    y = np.array([r[2] for r in rows])
    assert np.allclose(model.centre, x.mean(0))
    z = (x - model.centre) / model.scale
    apart = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    w, share = np.zeros(z.shape[1]), 4 * len(y) / len(apart)
    for _ in range(30):
        p = 1 / (1 + np.exp(apart @ w))
        w += np.linalg.solve(share * (apart * (p * (1 - p))[:, None]).T @ apart + 20 * np.eye(len(w)), share * apart.T @ p - 20 * w)
    assert np.abs(z @ (model.weights - w)).max() < 0.02 * np.std(z @ w)
