"""Operator 7: quality scores from preference pairs (Bradley-Terry)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlake.llm import kernels as K
from hearthlake.llm.common import Scratch, broadcast_if_small, cut, named, table

#: Strengths reach so far to both sides, and so many steps a unit are told apart when documents of both labels meet.
REACH, FINE = 32, 32
CENTRES = (np.arange(2 * REACH * FINE) + 0.5) / FINE - REACH
#: Rows of sums that the driver gets at most; bins a unit of log odds, within one of which the quantile is looked for.
GATHER, ODDS = 8, 1024

#: Bytes by class; what none of these has (control bytes and the rest) is class 0, bytes beyond ASCII the last.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\v\f", b".", b",", b"!?", b"'\"()-:;[]/", b"|", b"#$%&*@^~+=<>{}_\\`"]
_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate(CLASSES, 1):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
_IN_LINE = np.arange(256) != 10


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of numbers for each text: how often each class of byte follows each, sizes,
    lengths of words and lines, and how much of them repeats."""
    rows, length = len(at) - 1, np.diff(at)
    kind = _CLASS[data]
    row = np.repeat(np.arange(rows), length)
    inside = row[1:] == row[:-1]
    code = (row[:-1] * N_CLASSES + kind[:-1]) * N_CLASSES + kind[1:]
    pairs = np.bincount(code[inside], minlength=rows * N_CLASSES**2).reshape(rows, -1)
    words = K.split(data, at, K.BY_SPACE)
    lines = K.split(data, at, _IN_LINE)
    n, n_lines = words.counts, lines.counts
    size = (words.ends - words.starts).astype(float)
    of = np.repeat(np.arange(rows), n)
    total = np.bincount(of, size, rows)
    square = np.bincount(of, size**2, rows)
    short = np.bincount(of, size <= 3, rows)
    some, some_lines = np.maximum(n, 1), np.maximum(n_lines, 1)
    different = [np.diff(K.distinct(x, f)[1]) for x, f in ((words.hashes, words.first), (lines.hashes, lines.first), K.shingles(words, 3))]
    mean = total / some
    again = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (of[1:] == of[:-1]))
    again = np.bincount(of[again], minlength=rows)
    more = np.stack(
        [
            np.log1p(n), np.log1p(n_lines), mean, np.sqrt(np.maximum(square / some - mean**2, 0)), short / some,
            different[0] / some, different[1] / some_lines, different[2] / some, n / some_lines, again / some,
        ],
        1,
    )
    return np.hstack([np.sqrt(pairs / np.maximum(length, 1)[:, None]), more])


@dataclass
class Ranking:
    """score = sigmoid(slope * (x - centre) / scale @ weights + level); cut: the score's quantile that the labels ask for."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    level: float
    cut: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Logarithm of the odds of label 1, within -40 to 40."""
        return np.clip(self.slope * (((x - self.centre) / self.scale) @ self.weights) + self.level, -40, 40)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(x)))


def _newton(x: np.ndarray, y: np.ndarray, count: np.ndarray, penalty: np.ndarray, steps: int = 25) -> np.ndarray:
    """Least logistic loss of x @ w against y, each row ``count`` times, with a quadratic penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (count * (p - y)) + penalty * w
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _place(strength: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((strength + REACH) * FINE), 0, 2 * REACH * FINE - 1).astype(np.int64)


def _against(counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each place of ``CENTRES`` the sum over rows ``counts`` at ``CENTRES[at]`` of p = sigmoid(theirs - own), and of p * (1 - p)."""
    p, slope = np.zeros(len(CENTRES)), np.zeros(len(CENTRES))
    for n, centre in zip(counts[at], CENTRES[at], strict=True):
        one = 1 / (1 + np.exp(np.clip(CENTRES - centre, -40, 40)))
        p += n * one
        slope += n * one * (1 - one)
    return p, slope


def _sums(part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(part, total) of a task: the sum of part(y, x) over its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                one = part(y, x)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((p, t) for batch in batches for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    if rows:
        total = sum(np.frombuffer(t) for _, t in rows)
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])


def _total(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(y, x), numbers of one shape, over all batches of ``rows``: by tasks, then by GATHER tasks, so the driver
    gets GATHER rows at most; in order of tasks, so reruns agree."""
    kind = "part int, total binary"
    found = rows.mapInArrow(_sums(part), kind).repartition(GATHER, "part").mapInArrow(_gathered, kind).collect()
    return sum(np.frombuffer(r.total) for r in sorted(found, key=lambda r: r.part))


def fit(rows: DataFrame, penalty: float = 20.0, steps: int = 40) -> Ranking:
    """Bradley-Terry: a document's strength is linear in its features, and the odds that
    one of label 1 is preferred to one of label 0 are exp(difference of strengths).

    ``rows`` (y, x), cheap to read again, are all labelled documents, and every pair of both labels counts: a document meets
    the counts of the other label by strength (in steps of 1 / FINE), so a step of the fit is two passes over
    the rows and no list of pairs; all pairs together weigh as much as four for each row. Strengths are then put on
    the scale of a probability by a logistic fit of two numbers on the labels. ``cut`` is the score quantile at the
    share of the rows that has label 0 (of the two scores beside it the lower: where the labels part well it
    is the highest score of label 0, and no document of label 1 lies below it). Without both labels all scores are the
    share of label 1 (0.5 without labels).
    """
    width = N_CLASSES**2 + 10
    moments = _total(rows, lambda y, x: np.concatenate([[len(y), y.sum()], x.sum(0), (x**2).sum(0)]))
    if not np.ndim(moments):
        moments = np.zeros(2 + 2 * width)
    n, good = int(moments[0]), int(moments[1])
    bad, centre = n - good, moments[2 : 2 + width] / max(n, 1)
    scale = np.sqrt(np.maximum(moments[2 + width :] / max(n, 1) - centre**2, 0))
    scale = np.where(scale > 1e-6, scale, np.inf)
    if not good or not bad:
        p = np.clip((good + 0.5) / (n + 1), 1e-3, 1 - 1e-3)
        return Ranking(centre, scale, np.zeros(width), 0.0, float(np.log(p / (1 - p))), 0.0)
    share = 4 * n / (good * bad)

    def counts(w: np.ndarray) -> np.ndarray:
        """Rows by label and strength."""
        places = 2 * REACH * FINE
        both = _total(rows, lambda y, x: np.bincount(y * places + _place(((x - centre) / scale) @ w), minlength=2 * places).astype(float))
        return both.reshape(2, places)

    def slopes(w: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the loss of all pairs, and its curvature, where what two documents have in common is taken by their labels' means."""
        up, up_slope = _against(held[0], np.flatnonzero(held[0]))
        below, down_slope = _against(held[1], np.flatnonzero(held[1]))
        down = held[1].sum() - below  # label 1 is preferred with 1 - p of ``_against``

        def part(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            z = (x - centre) / scale
            s = z @ w
            pull = np.where(y == 1, -np.interp(s, CENTRES, up), np.interp(s, CENTRES, down))
            bend = np.where(y == 1, np.interp(s, CENTRES, up_slope), np.interp(s, CENTRES, down_slope))
            return np.concatenate([pull @ z, (bend * y) @ z, (bend * (1 - y)) @ z, [bend @ y], ((z * bend[:, None]).T @ z).ravel()])

        found = _total(rows, part)
        gradient, one, none, weight, square = np.split(found, np.cumsum([width, width, width, 1]))
        common = np.outer(one, none) / max(weight[0], 1e-300)
        return share * gradient + penalty * w, share * (square.reshape(width, width) - common - common.T) + penalty * np.eye(width)

    w, before, pace = np.zeros(width), np.inf, 1.0
    for _ in range(steps):
        gradient, curve = slopes(w, counts(w))
        size = float(np.sqrt(gradient @ np.linalg.solve(curve, gradient)))
        if size < 1e-3 * np.sqrt(n):
            break
        pace, before = pace / 2 if size > before else pace, size
        w -= pace * np.linalg.solve(curve, gradient)
    held = counts(w)
    place = np.flatnonzero(held.sum(0))
    strength = np.stack([np.tile(CENTRES[place], 2), np.ones(2 * len(place))], 1)
    slope, level = _newton(strength, np.repeat([0.0, 1.0], len(place)), held[:, place].ravel(), np.array([1e-3, 1e-3]))
    model = Ranking(centre, scale, w, float(slope), float(level), 0.0)
    model.cut = _quantile(rows, model, bad * (n - 1) // n)
    return model


def _quantile(rows: DataFrame, model: Ranking, rank: int) -> float:
    """The score of ``rank`` (from 0) among those of ``rows``: of its bin by counts, then by order within the bin."""

    def place(x: np.ndarray) -> np.ndarray:
        return ((model.odds(x) + 40) * ODDS).astype(np.int64)

    upto = np.cumsum(_total(rows, lambda _, x: np.bincount(place(x), minlength=80 * ODDS + 1).astype(float)))
    here = int(np.searchsorted(upto, rank, side="right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(model.score(x)[place(x) == here])], ["score"])

    inside = rows.mapInArrow(run, "score double").groupBy("score").count().withColumn("upto", F.sum("count").over(Window.orderBy("score")))
    return inside.where(F.col("upto") > rank - int(upto[here - 1] if here else 0)).agg(F.min("score")).first()[0]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in K.chunks(batch.column(1)):
            x = features(data, at)
            at_x = np.arange(len(x) + 1) * x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), K.lists(x.ravel(), at_x)], ["y", "x"])


def _scores(model: Ranking, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            found = [model.score(features(data, at)) for _, _, data, at in K.chunks(column)]
            kept, names = batch.columns[:-1], batch.schema.names[:-1]
            if with_text:
                kept, names = [*kept, column], [*names, "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(found) if found else [], pa.float64())], [*names, "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking:
    """A model fitted on all labelled documents (``label`` 0 or 1; of several labels of a doc_id the least). Their features,
    about 200 numbers a row, are written to the shared folder while the fit goes over them."""
    marks = (
        labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
        .groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    rows = docs.select("doc_id", "text").join(broadcast_if_small(cut(marks)), "doc_id").select("y", "text")
    with Scratch(docs.sparkSession) as scratch:
        return fit(scratch.table(rows.mapInArrow(_features, "y int, x array<double>")))


def score(docs: DataFrame, model: Ranking, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and ``name``, the score (0 to 1; higher: label 1 is likelier), from whole texts alone.

    Null texts are empty ones, which have a score too; no rows give no rows. ``columns`` may
    have any names but ``name``."""
    own = [c for c in columns if c != "text"]
    # the text comes last, where the function finds it, and goes on only if it is asked for
    kept = docs.select(*([F.struct(*named(own)).alias("row")] if own else []), "text")
    kind = T.StructType([*kept.schema.fields] if "text" in columns else kept.schema.fields[:-1]).add("score", T.DoubleType())
    scored = kept.mapInArrow(_scores(model, "text" in columns), kind)
    return scored.select(*(named([c], "row" if c != "text" else "")[0] for c in columns), F.col("score").alias(name))


def learnable(labels: DataFrame, folds: int = 5) -> DataFrame:
    """Rows that a model may learn from: crc32 of doc_id, as text, modulo ``folds`` is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, learnable(table(spark, sf_dir, "labels")))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, model, ["doc_id"]).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
