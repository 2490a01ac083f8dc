"""Periodic runs against brute force over all periods, and the operator's edge cases."""

import random
import re
import zlib

import numpy as np

from hearthlake.llm import periodic

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, runs string, N_WORDS int"


def brute(w, least=24, times=3):
    """(start, length, smallest period) of each run."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs))


def texts(seed):
    rng = random.Random(seed)
    out = ["", None, " \t\n", "word", "a " * 23, "a " * 24, "A a " * 40, "a  b\tc\n" * 8 + "a b c", "x " + "y z " * 30 + "y " + "z " * 40, "é ü " * 500]
    for _ in range(60):
        w = []
        for _ in range(rng.randint(1, 5)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            w += (unit * rng.randint(1, 12))[: rng.randint(1, 90)]
            w += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        out.append(" ".join(w))
    out.append(" ".join(["fib"] + fibonacci(800)))
    out.append(" ".join(f"w{i}" for i in range(3000)) + " q r s t" * 2000)
    return out


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_equal_brute_force(spark):
    rows = [(k % 50, t, "x", None) for k, t in enumerate(texts(3))] + [(None, "u v " * 20, None, 1)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert got[0].__fields__ == ["doc_id", "runs", "N_WORDS", "n_words_", "runs_", "collapsed"], "clashing columns stay"
    want = []
    for i, t, _, _ in rows:
        w = WORD.findall(t or "")
        runs = brute(w)
        want.append((str(i), len(w), runs, collapsed(w, runs)))
    assert sorted((str(r.doc_id), r.n_words_, [tuple(x) for x in r.runs_], r.collapsed) for r in got) == sorted(want)


def test_one_word_repeated_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 50)
    for symbols in (np.zeros(500, np.uint64), np.tile(np.arange(7), 40).astype(np.uint64)):
        doc, start, length, period = periodic.runs_of(symbols, np.array([0, len(symbols)]), 24, 3)
        assert list(zip(doc, start, length, period, strict=True)) == [(0, 0, len(symbols), len(set(symbols.tolist())))]


def test_extensions_equal_plain_comparison():
    rng = np.random.default_rng(1)
    seq = np.append(rng.integers(0, 2, 300), -1)
    seq[100:160] = seq[20:80]
    found = periodic.Suffixes(seq)
    i, j = rng.integers(0, 300, 500), rng.integers(0, 300, 500)
    i, j = i[i != j], j[i != j]
    plain = [next(k for k in range(301) if max(a, b) + k >= 301 or seq[a + k] != seq[b + k]) for a, b in zip(i, j, strict=True)]
    assert found.extension(i, j).tolist() == plain


def test_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_repeats_of_the_query(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 90))) for i in range(300)]
    got = {r.doc_id: r.text for r in periodic._with_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w, h = t.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        assert got[i].split() == w
