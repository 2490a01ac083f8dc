"""Removal of repeated byte strings against brute force, its edge cases, and its refinement."""

import random

import numpy as np
import pytest

from hearthlake.llm import kernels, suffix_dedup

DOCS = "doc_id long, text string, removed string, Kept int"


def brute(rows, length):
    """(id, bytes, spans, kept) of each row."""
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    least = {}
    for i, b in texts:
        if i is not None:
            for k in range(len(b) - length + 1):
                least[b[k : k + length]] = min(i, least.get(b[k : k + length], i))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if i is not None and least[b[k : k + length]] < i:
                gone[1 + k : 1 + k + length] = True
        turns = np.flatnonzero(gone[1:] != gone[:-1])
        kept = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        out.append((str(i), len(b), [(int(a), int(e - a)) for a, e in zip(turns[::2], turns[1::2], strict=True)], kept))
    return sorted(out)


def got(spark, rows, length, parts=4):
    found = suffix_dedup.without_repeats(spark.createDataFrame(rows, DOCS).repartition(parts), length).collect()
    return sorted((str(r.doc_id), r.n_bytes, [tuple(x) for x in r.removed_], bytes(r.kept_)) for r in found)


def corpus(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([20, 49, 50, 51, 70, 200, 900]))) for _ in range(12)]
    texts = ["", None, "a", "x" * 49, "x" * 50, "x" * 51, "x" * 400, "ab" * 100, "abc" * 90, "ß" * 80]
    for _ in range(90):
        t = ""
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.6:
                s = rng.choice(shared)
                a = rng.randint(0, len(s) // 3)
                t += s[a : len(s) - rng.randint(0, len(s) // 3)]
            t += "".join(rng.choice("abcdefghijklmé ") for _ in range(rng.randint(0, 60)))
        texts.append(t)
    rows = [(k * 7 % 113, t, "c", k) for k, t in enumerate(texts)]
    # repeated rows, one id with two texts, null ids
    return rows + rows[20:24] + [(rows[30][0], rows[40][1], None, None), (None, rows[50][1], None, None), (None, None, None, None), (-5, rows[60][1], None, None)]


@pytest.mark.parametrize(("seed", "length"), [(1, 50), (2, 24), (3, 64), (4, 90)])
def test_equals_brute_force(spark, seed, length):
    rows = corpus(seed)
    assert got(spark, rows, length) == brute(rows, length)


def test_hot_anchors_and_small_pieces(spark, monkeypatch):
    """Every anchor of two entries is hot, everything is sent at once, and long texts come in parts."""
    for name, value in (("HOT", 2), ("HOT_SHARE", 10**6), ("GATHERED", 64), ("PIECES", 48), ("REFINED", 4)):
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(kernels, "CHUNK_BYTES", 100)
    rows = corpus(6)
    length = 50
    buckets = 4
    # the stages' functions in this process, as workers import the module anew
    import pyarrow as pa

    def by_bucket(batches):
        table = pa.Table.from_batches(list(batches)).sort_by([("bucket", "ascending"), ("kind", "ascending")])
        return table.to_batches()

    ids, first = {}, [r for r in rows if r[0] is not None]
    many = [r[0] for r in first]
    part = [hash(r[1]) % 1000 if many.count(r[0]) > 1 else 0 for r in first]
    texts = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in first[k::3]]), pa.array(part[k::3]), pa.array([r[1] or "" for r in first[k::3]])], ["doc", "part", "text"]) for k in range(3)]
    anchored = by_bucket(b for t in texts for b in suffix_dedup._anchored(length, buckets)(iter([t])))
    shared = pa.Table.from_batches(list(suffix_dedup._shared(buckets)(iter(anchored)))).sort_by([("bucket", "ascending"), ("kind", "ascending")])
    kinds = shared.column("kind").to_numpy()
    hot = np.sort(np.concatenate([kernels.unpack(x.as_buffer())[0] for x in shared.filter(kinds == 1).column("data")]).view(np.uint64))
    assert len(hot) > 5
    for b in suffix_dedup._of_documents(suffix_dedup._places)(iter(shared.filter(kinds == 0).to_batches())):
        ids.update({(d, p): x for d, p, x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)})
    asked = []
    for t in texts:
        have = [k for k, key in enumerate(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)) if key in ids]
        own = t.take(pa.array(have, pa.int64()))
        data = [ids[key] for key in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True)]
        asked.append(pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(data, pa.binary()), own.column(2)], ["doc", "part", "data", "text"]))
    pieces = by_bucket(b for t in asked for b in suffix_dedup._pieces(length, buckets, hot)(iter([t])))
    removed = by_bucket(suffix_dedup._repeated(length, buckets)(iter(pieces)))
    spans = {}
    for b in suffix_dedup._of_documents(suffix_dedup._merged(length))(iter(removed)):
        for d, p, x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            spans[d, p] = list(zip(*(c.tolist() for c in kernels.unpack(x)), strict=True))
    want = brute(first, length)
    assert sorted((str(r[0]), len((r[1] or "").encode()), spans.get((r[0], p), [])) for r, p in zip(first, part, strict=True)) == sorted(w[:3] for w in want)


def test_a_passage_of_most_documents(spark):
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = [(k, "".join(rng.choice("ijklmnop ") for _ in range(40)) + line + "".join(rng.choice("qrstuv") for _ in range(40)), None, None) for k in range(1500)]
    assert got(spark, rows, 50) == brute(rows, 50)


def test_pointers_are_equal_for_equal_strings_only():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, (40, 84)).astype(np.uint8)
    data[1::2] = data[::2]
    data[1::4, 60] = 120
    more = rng.integers(0, 35, 40)
    pieces = suffix_dedup.Pieces(data, more, np.zeros(40, np.int64))
    piece, pointer = suffix_dedup.refined(pieces, 50)
    assert len(piece) == (more + 1).sum()
    t = np.arange(len(piece)) - np.searchsorted(piece, piece)
    groups = {}
    for p, s, x in zip(piece, t, pointer, strict=True):
        groups.setdefault(int(x), set()).add(data[p, s : s + 50].tobytes())
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set().union(*groups.values()))


def test_empty_table(spark):
    assert suffix_dedup.without_repeats(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="anchor"):
        suffix_dedup.without_repeats(spark.createDataFrame([], DOCS), 20)
