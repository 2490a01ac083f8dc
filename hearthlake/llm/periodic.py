"""Operator 11: stretches of words that repeat with a period, by a harmonic grid of common-extension queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlake.llm import kernels as K
from hearthlake.llm.common import SPACE, fresh, named, table

#: Pairs of the grid that are looked at in one go.
PAIRS = 1 << 20
#: Equal words in a row from a grid point on, without which it is not asked for its extension; a run has more.
FIRST = 4

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class Suffixes:
    """Longest common extensions of a sequence: suffix array, common prefixes of its neighbours and their range minima.

    The last symbol must occur once. The array is found by doubling; only suffixes
    that are not alone in their bucket are sorted again.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = K.same_as_before(symbols[order])[1]
        levels, step = [rank.astype(np.int32)], 1
        while True:
            shared = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
            if not len(shared):
                break
            shared = shared[np.lexsort((rank[shared + step], rank[shared]))]
            old, later = rank[shared], rank[shared + step]
            rank = rank.copy()
            rank[shared] = old + K.same_as_before(old, later)[1] - K.same_as_before(old)[1]
            levels.append(rank.astype(np.int32))
            step *= 2
        self.rank = rank
        at = np.empty(n, np.int64)
        at[rank] = np.arange(n)
        low = np.zeros(n, np.int32)
        a, b = at[:-1].copy(), at[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            both = np.flatnonzero((a < n) & (b < n))
            both = both[levels[k][a[both]] == levels[k][b[both]]]
            low[1 + both] += 1 << k
            a[both] += 1 << k
            b[both] += 1 << k
        del levels
        self.least = [low]
        while 1 << len(self.least) <= n:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from ``i`` and from ``j`` (another place) on are the same."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.least[k][lo[of]], self.least[k][hi[of] - (1 << k) + 1])
        return out


def _grid(begin: np.ndarray, count: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of each grid point j * p of each document, p up to ``count`` // ``times``, that has a next one."""
    most = count // times
    doc = np.repeat(np.arange(len(count)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = np.maximum(count[doc] - 1, 0) // period
    upto = np.concatenate([[0], np.cumsum(points)])
    row = 0
    while row < len(doc):
        end = max(row + 1, int(np.searchsorted(upto, upto[row] + PAIRS, "right")) - 1)
        p = np.repeat(period[row:end], points[row:end])
        j = np.arange(len(p)) - np.repeat(upto[row:end] - upto[row], points[row:end])
        yield np.repeat(begin[doc[row:end]], points[row:end]) + j * p, p
        row = end


def runs_of(symbols: np.ndarray, first: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of the runs of documents that follow one another in ``symbols``
    (``first``: where each begins, and the end), by document, start and period.

    A run of period p and ``times`` * p words or more holds two neighbours of the grid of p,
    and (at 3 and more) has p more equal words from one of them on. Such points are
    asked for their extension in both directions, which is the maximal run of p; of
    periods with one stretch the least is its smallest.
    """
    count = np.diff(first)
    docs = np.flatnonzero(count >= least)
    none = np.empty(0, np.int64)
    # each document between symbols that occur once
    ids = np.unique(symbols, return_inverse=True)[1].astype(np.int64)

    def framed(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = count[docs]
        begin = np.cumsum(n + 1) - n
        seq = -np.arange(1, int(n.sum() + len(docs)) + 1 + FIRST, dtype=np.int64)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        seq[np.repeat(begin, n) + inner] = ids[np.repeat(first[docs], n) + inner]
        return seq, begin

    seq, begin = framed(docs)
    found = []
    for at, p in _grid(begin, count[docs], times):
        for t in range(FIRST):
            same = seq[at + t] == seq[at + p + t]
            at, p = at[same], p[same]
        found.append((at, p))
    at, p = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)
    if not len(at):
        return none, none, none, none
    # the arrays are built over the documents that have such points
    of = np.searchsorted(begin, at, "right") - 1
    used, mine = np.unique(of, return_inverse=True)
    at = at - begin[of]
    docs = docs[used]
    seq, begin = framed(docs)
    at = at + begin[mine]
    ahead, behind = Suffixes(seq), Suffixes(seq[::-1])
    out = []
    for k in range(0, len(at), PAIRS):
        i, q = at[k : k + PAIRS], p[k : k + PAIRS]
        start = i - behind.extension(len(seq) - i, len(seq) - i - q)
        end = i + q + ahead.extension(i, i + q)
        long = end - start >= np.maximum(least, times * q)
        out.append(np.unique(np.stack([start[long], end[long], q[long]]), axis=1))
    start, end, q = np.unique(np.concatenate(out, axis=1), axis=1)
    smallest = K.same_as_before(start, end)[0]
    start, end, q = start[smallest], end[smallest], q[smallest]
    of = np.searchsorted(begin, start, "right") - 1
    order = np.lexsort((q, start))
    return docs[of[order]], (start - begin[of])[order], (end - start)[order], q[order]


def _joined(words: K.Words, kept: np.ndarray) -> pa.StringArray:
    """The kept words of each row, one space between."""
    index = np.flatnonzero(kept)
    row = np.searchsorted(words.first, index, "right") - 1
    size = words.ends[index] - words.starts[index]
    last = np.ones(len(index), bool)
    last[:-1] = row[1:] != row[:-1]
    to = np.cumsum(size + ~last) - (size + ~last)
    offsets = np.zeros(len(words.first), np.int64)
    np.add.at(offsets, row + 1, size + ~last)
    offsets = np.cumsum(offsets)
    out = np.full(offsets[-1], 0x20, np.uint8)
    before = np.cumsum(size) - size
    byte = np.arange(int(size.sum()))
    out[byte + np.repeat(to - before, size)] = words.data[byte + np.repeat(words.starts[index] - before, size)]
    return pa.StringArray.from_buffers(len(words.first) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))


def _collapse(least: int, times: int, kept_columns: list[int], text: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in K.chunks(batch.column(text)):
                words = K.split(data, at, K.BY_SPACE, lower=False)
                doc, start, length, period = runs_of(words.hashes, words.first, least, times)
                cover = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(cover, words.first[doc] + start + period, 1)
                np.add.at(cover, words.first[doc] + start + length, -1)
                rows = hi - lo
                runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)), runs)
                own = [batch.column(k).slice(lo, rows) for k in kept_columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(words.counts.astype(np.int64)), lists, _joined(words, np.cumsum(cover)[:-1] == 0)], names)

    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, columns: list[str] | None = None) -> DataFrame:
    """Each document with its periodic runs and its text with each run cut to one period.

    One row per row of ``docs``: its ``columns`` (all but the text, if not given), n_words,
    runs (array of start, length, period, in words, by start and period) and collapsed
    (kept words, one space between). A name that ``columns`` has already gets _ at its end.

    A run is a stretch of words with smallest period q and at least max(``least``, ``times`` * q)
    words (``times`` >= 3, ``least`` >= 8) that cannot be extended with that period; all but its
    first q words go. Words are what space and \\t..\\r part, compared as they are.

    1. Each document goes through its task alone, without a shuffle, whatever its
       copies are; documents are taken together up to a quarter of a MB.
    2. Harmonic grid: for each period p the points jp and (j+1)p whose next words agree;
       n * log(n) points for n words, PAIRS at a time.
    3. Extensions of these points ahead and back by the suffix array of the words and
       that of the reversed words, with range minima over common prefixes: the run.

    Null and empty texts have no words and no runs, and an empty table gives no rows. Rows
    are for themselves: equal ids, null ids and repeated rows change nothing. A document of n words
    takes about 300 * n bytes where it has repetitions.
    """
    if times < 3 or least < 8:
        raise ValueError("runs of fewer than three periods or eight words are not found")
    columns = [c for c in docs.columns if c != "text"] if columns is None else columns
    text = fresh("text", columns)
    extra = []
    for name in ("n_words", "runs", "collapsed"):
        extra.append(fresh(name, [*columns, *extra]))
    rows = docs.select(*named(columns), F.coalesce("text", F.lit("")).alias(text))
    kind = T.StructType([*rows.schema.fields[:-1], T.StructField(extra[0], T.LongType()), T.StructField(extra[1], T.ArrayType(RUN)), T.StructField(extra[2], T.StringType())])
    return rows.mapInArrow(_collapse(least, times, list(range(len(columns))), len(columns), [f.name for f in kind]), kind)


def _with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the hash h of their ids, repeat a part of their words from word a on."""
    ws = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda x: x != "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    rows = rows.withColumn("ws", F.when(F.col("h") % 10 == 0, ws)).withColumn("n", F.size("ws")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("IF(n > 0, CAST(g % n AS INT), 0)")).withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    part = F.expr("array_join(slice(concat(slice(ws, 1, a), flatten(array_repeat(slice(ws, a + 1, p), CAST(ceil((n - a) / p) AS INT)))), 1, n), ' ')")
    return rows.select("doc_id", F.when(F.expr("ws IS NOT NULL AND n > 0"), part).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of all documents, of which a tenth was given some, as numbers and digests."""
    rows = periodic_runs(_with_repeats(table(spark, sf_dir, "documents")), columns=["doc_id"])
    best = F.reduce("runs", F.lit(None).cast(RUN), lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a))
    line = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Pairs of equal words of a document are joined, then stretches of places with one distance.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, z: CASE WHEN e % 2 = 1 THEN xor(e >> 1, 3988292384) ELSE e >> 1 END)), 4294967295) AS h FROM documents),
e AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) ELSE 0 END AS a FROM d),
w AS (SELECT doc_id, n, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM e)),
pairs AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM w AS x JOIN w AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
streaks AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS s FROM pairs) GROUP BY doc_id, p, s),
runs AS (SELECT doc_id, start, length, min(p) AS period FROM streaks WHERE length >= greatest(24, 3 * p) GROUP BY doc_id, start, length),
of_doc AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS line,
    first(start ORDER BY length::DOUBLE / period DESC, start, period) AS start, first(length ORDER BY length::DOUBLE / period DESC, start, period) AS length,
    first(period ORDER BY length::DOUBLE / period DESC, start, period) AS period FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM w WHERE NOT EXISTS (SELECT 1 FROM runs AS r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(line, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN of_doc USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
