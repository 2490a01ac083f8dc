"""Operator 13: exact removal of repeated byte strings by bucket-pointer refinement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlake.llm import kernels as K
from hearthlake.llm.common import Scratch, broadcast_if_small, cut, fresh, named, table

#: Bytes of an anchor, by which strings are brought together, and of the grams that the refinement begins with.
ANCHOR, GRAM = 16, 8
#: Entries that a task gathers before it sends them: anchors, and pieces of text.
GATHERED, PIECES = 1 << 18, 1 << 16
#: Buckets for each partition of the shuffle, of anchors, of pieces and of documents.
BUCKETS, PIECE_BUCKETS, DOC_BUCKETS = 8, 2, 1
#: Pieces that are refined together, about; those of one anchor always are.
REFINED = 1 << 13
#: An anchor with so many entries and a share of its bucket is dealt by whole strings instead.
HOT, HOT_SHARE = 1 << 12, 8

PACKED = "bucket int, kind byte, data binary"
Batches = Iterator[pa.RecordBatch]


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, first, last, hash): the strings of ``length`` bytes that start from first to last have their anchor, the
    run of ANCHOR bytes with the least hash in them (of equal ones the first), at one place. Equal strings have equal anchors."""
    none = np.empty(0, np.int64)
    size = np.diff(at)
    rows = np.flatnonzero(size >= length)
    if not len(rows):
        return none, none, none, none, np.empty(0, K.U)
    power, inverse = (t[: len(data) + 1] for t in K._power_tables(len(data) + 1))
    sums = np.zeros(len(data) + 1, K.U)
    np.cumsum((data.astype(K.U) + K.U(1)) * power[:-1], out=sums[1:])
    values = K.mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: len(data) + 1 - ANCHOR])
    width = length - ANCHOR + 1
    low, have = values, 1
    while 2 * have <= width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    starts = size[rows] - length + 1
    row = np.repeat(rows, starts)
    j = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
    change = np.ones(len(j), bool)
    change[1:] = (low[j[1:]] != low[j[:-1]]) | (row[1:] != row[:-1]) | (values[j[:-1]] == low[j[:-1]])
    new = np.flatnonzero(change)
    anchor = j[new] + np.lib.stride_tricks.sliding_window_view(values, width)[j[new]].argmin(1)
    keep = np.ones(len(new), bool)
    keep[1:] = (anchor[1:] != anchor[:-1]) | (row[new[1:]] != row[new[:-1]])
    new, anchor = new[keep], anchor[keep]
    last = j[np.append(new, len(j))[1:] - 1]
    base = at[row[new]]
    return row[new], anchor - base, j[new] - base, last - base, values[anchor]


def _parts(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the first byte in it, bytes, offsets of rows): a long row comes in parts that overlap by a string less a byte."""
    for lo, hi, data, at in K.chunks(column, K.CHUNK_BYTES):
        if len(data) <= 2 * K.CHUNK_BYTES:
            yield lo, 0, data, at
            continue
        for row in range(lo, hi):  # one only
            for s in range(0, max(1, len(data) - length + 1), K.CHUNK_BYTES):
                part = data[s : s + K.CHUNK_BYTES + length - 1]
                yield row, s, part, np.array([0, len(part)])


def _anchored(length: int, buckets: int) -> Callable[[Batches], Batches]:
    """Packed anchors. Of those of a task with one hash, those of its least document go to the hash's bucket (kind 3,
    with the number of others); the others are known to be shared (kind 2)."""

    def send(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, doc, part, first, more = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((first, doc, h.view(K.U)))
        h, doc, part, first, more = (x[order] for x in (h, doc, part, first, more))
        lead = K.same_as_before(h)[1]
        own = doc == doc[lead]
        others = np.zeros(len(h), np.int64)
        np.add.at(others, lead[~own], 1)
        rows = list(K.anywhere(2, [x[~own] for x in (doc, first, part, more)], buckets))
        rows += K.by_bucket(3, K.bucket(h[own].view(K.U), buckets), [x[own] for x in (h, doc, part, first, more, others)])
        return K.packed(rows)

    def run(batches: Batches) -> Batches:
        held, gathered = [], 0
        for batch in batches:
            docs, parts = (batch.column(k).to_numpy() for k in (0, 1))
            for lo, base, data, at in _parts(batch.column(2), length):
                row, anchor, first, last, h = anchors(data, at, length)
                held.append((h.view(np.int64), docs[lo + row], parts[lo + row], first + base, 64 * (last - first) + anchor - first if length <= 64 + ANCHOR else (last - first << 32) + anchor - first))
                gathered += len(row)
                if gathered >= GATHERED:
                    yield send(held)
                    held, gathered = [], 0
        if gathered:
            yield send(held)

    return run


class Outbox:
    """Entries (doc, part, first, more) of a task, gathered and then sent (kind 0) to the buckets of their documents."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.gathered = buckets, [], 0

    def put(self, *columns: np.ndarray, at_end: bool = False) -> Batches:
        if columns:
            self.held.append(columns)
            self.gathered += len(columns[0])
        if self.gathered >= GATHERED or at_end and self.gathered:
            doc, *rest = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.gathered = [], 0
            to = K.bucket(K.mix(doc.astype(np.int64).view(K.U)), self.buckets)
            order = np.lexsort((doc, to))
            yield K.packed(list(K.by_bucket(0, to[order], [x[order] for x in (doc, *rest)])))


def _shared(buckets: int) -> Callable[[Batches], Batches]:
    """Of packed anchors in order of bucket and kind: those that several documents have, to the buckets of their documents
    (kind 0), and the few hashes that have a good part of their bucket (kind 1)."""

    def run(batches: Batches) -> Batches:
        out = Outbox(buckets)
        for kind, columns in K.unpacked(batches, alone=(2,)):
            if kind == 2:
                doc, first, part, more = columns
                yield from out.put(doc, part, first, more)
                continue
            order = np.lexsort((columns[1], columns[0].view(K.U)))
            h, doc, part, first, more, others = (x[order] for x in columns)
            start, lead = K.same_as_before(h)
            group = np.cumsum(start) - 1
            at = np.flatnonzero(start)
            several = (np.maximum.reduceat((doc != doc[lead]) | (others > 0), at))[group]
            size = np.add.reduceat(others + 1, at)
            hot = (size >= HOT) & (size * HOT_SHARE >= size.sum())
            if hot.any():
                yield K.packed([(0, 1, K.pack(h[at][hot], size[hot]))])
            yield from out.put(*(x[several] for x in (doc, part, first, more)))
        yield from out.put(at_end=True)

    return run


def _of_documents(finish: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> Callable[[Batches], Batches]:
    """Of packed entries (doc, part, first, more) in order of bucket: for each document one packed row of what ``finish`` makes of its entries."""

    def run(batches: Batches) -> Batches:
        for _, columns in K.unpacked(batches, alone=()):
            order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
            doc, part, first, more = (x[order] for x in columns)
            new = np.flatnonzero(K.same_as_before(doc, part)[0])
            data = [K.pack(*finish(first[i:j], more[i:j])) for i, j in zip(new, np.append(new, len(doc))[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(part[new]), pa.array(data, pa.binary())], ["doc", "part", "data"])

    return run


def _places(first: np.ndarray, more: np.ndarray) -> list[np.ndarray]:
    once = K.same_as_before(first, more)[0]
    return [first[once], more[once]]


def _merged(length: int) -> Callable[[np.ndarray, np.ndarray], list[np.ndarray]]:
    """The maximal runs of bytes (start, size) that strings starting from first to first + more cover."""

    def run(first: np.ndarray, more: np.ndarray) -> list[np.ndarray]:
        end = np.maximum.accumulate(first + more + length)
        new = np.ones(len(first), bool)
        new[1:] = first[1:] > end[:-1]
        at = np.flatnonzero(new)
        return [first[at], end[np.append(at, len(first))[1:] - 1] - first[at]]

    return run


class Pieces:
    """Pieces of text, a row of ``width`` bytes each: the bytes that its strings cover, then zeros; how many strings start in
    it besides the first; where its anchor is (-1: it is one string that goes by its own hash)."""

    def __init__(self, data: np.ndarray, more: np.ndarray, anchor: np.ndarray):
        self.data, self.more, self.anchor = data, more, anchor

    def take(self, k: np.ndarray) -> Pieces:
        return Pieces(self.data[k], self.more[k], self.anchor[k])

    @staticmethod
    def of(several: list[Pieces]) -> Pieces:
        return Pieces(*(np.concatenate([getattr(p, n) for p in several]) for n in ("data", "more", "anchor")))

    def whole_hash(self) -> np.ndarray:
        power = K._power_tables(self.data.shape[1])[0][: self.data.shape[1]]
        total = np.empty(len(self.data), K.U)
        for k in range(0, len(self.data), PIECES):  # eight bytes a byte
            total[k : k + PIECES] = (self.data[k : k + PIECES].astype(K.U) + K.U(1)) @ power
        return K.mix(total ^ K.U(0x9E3779B97F4A7C15) * (self.more + 1).astype(K.U))

    def key(self) -> np.ndarray:
        """The hash of the anchor, or that of all."""
        total = np.zeros(len(self.data), K.U)
        power = K._power_tables(ANCHOR)[0][:ANCHOR]
        row, at = np.arange(len(self.data)), np.maximum(self.anchor, 0)
        for k in range(ANCHOR):
            total += (self.data[row, at + k].astype(K.U) + K.U(1)) * power[k]
        return np.where(self.anchor < 0, self.whole_hash(), K.mix(total))

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.more[a] == self.more[b]) & (self.data[a] == self.data[b]).all(1)

    def strings(self, length: int) -> tuple[np.ndarray, Pieces]:
        """Each string for itself: (piece, pieces)."""
        of = np.repeat(np.arange(len(self.data)), self.more + 1)
        t = np.arange(len(of)) - np.repeat(np.cumsum(self.more + 1) - self.more - 1, self.more + 1)
        data = np.zeros((len(of), self.data.shape[1]), np.uint8)
        data[:, :length] = self.data[of[:, None], t[:, None] + np.arange(length)]
        return of, Pieces(data, np.zeros(len(of), np.int64), np.full(len(of), -1))


def _cut_out(data: np.ndarray, start: np.ndarray, more: np.ndarray, anchor: np.ndarray, length: int) -> Pieces:
    width = 2 * length - ANCHOR
    out = np.zeros((len(start), width), np.uint8)
    step = np.arange(width)
    inside = step < (more + length)[:, None]
    out[inside] = data[(start[:, None] + step)[inside]]
    return Pieces(out, more, anchor)


def _distinct(pieces: Pieces, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lead, new): the order by key, content and document; for each place in it the place of the first piece of equal bytes,
    and whether that is itself. Pieces of equal hash but other bytes stand for themselves."""
    whole = pieces.whole_hash()
    order = np.lexsort((doc, whole, key))
    lead = K.same_as_before(key[order], whole[order])[1]
    place = np.arange(len(order))
    other = np.flatnonzero(lead != place)
    lead[other] = np.where(pieces.same(order[other], order[lead[other]]), lead[other], other)
    return order, lead, lead == place


def _pieces(length: int, buckets: int, hot: np.ndarray) -> Callable[[Batches], Batches]:
    """The pieces of text around the asked anchors, by the anchor's bucket (kind 1). Of equal ones of a task only those of the least
    document go on; the others are repeated for certain (kind 0: doc, first, part, more)."""

    def send(held: list[tuple], split: bool = True) -> list[tuple]:
        pieces = Pieces.of([x[0] for x in held])
        doc, part, first = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
        key = pieces.key()
        at = np.searchsorted(hot, key)
        is_hot = hot[np.minimum(at, len(hot) - 1)] == key if len(hot) and split else np.zeros(len(key), bool)
        rows = []
        if is_hot.any():
            which = np.flatnonzero(is_hot)
            for k in range(0, len(which), PIECES // 16):
                mine = which[k : k + PIECES // 16]
                of, single = pieces.take(mine).strings(length)
                t = np.arange(len(of)) - np.searchsorted(of, of)
                rows += send([(single, doc[mine][of], part[mine][of], first[mine][of] + t)], split=False)
            rest = np.flatnonzero(~is_hot)
            pieces, doc, part, first, key = pieces.take(rest), doc[rest], part[rest], first[rest], key[rest]
        order, lead, new = _distinct(pieces, key, doc)
        doc, part, first = doc[order], part[order], first[order]
        own = doc == doc[lead]
        more = pieces.more[order]
        rows += [(*x, None) for x in K.anywhere(0, [x[~own] for x in (doc, first, part, more)], buckets)]
        of = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        # a piece of equal hash and other bytes may part those of its lead
        of = of[lead]
        to = K.bucket(K.mix(key[order]), buckets)
        by = np.argsort(to[own], kind="stable")
        of, doc, part, first, to = of[own][by], doc[own][by], part[own][by], first[own][by], to[own][by]
        cuts = np.flatnonzero(K.same_as_before(to)[0])
        for i, j in zip(cuts, np.append(cuts, len(to))[1:], strict=True):
            mine, local = np.unique(of[i:j], return_inverse=True)
            sent = pieces.take(order[at[mine]])
            blob = np.concatenate([sent.data, sent.more[:, None].astype("<i4").view(np.uint8), sent.anchor[:, None].astype("<i4").view(np.uint8)], axis=1)
            rows.append((int(to[i]), 1, K.pack(local, doc[i:j], part[i:j], first[i:j]), blob.tobytes()))
        return rows

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        zipped = [None if x[3] is None else pa.compress(x[3], "zstd", asbytes=True) for x in rows]
        size = [None if x[3] is None else len(x[3]) for x in rows]
        kinds = [pa.int32(), pa.int8(), pa.binary()]
        return pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)), pa.array(zipped, pa.binary()), pa.array(size, pa.int64())], ["bucket", "kind", "data", "blob", "size"])

    def run(batches: Batches) -> Batches:
        held, gathered = [], 0
        for batch in batches:
            docs, parts, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for lo, hi, data, at in K.chunks(batch.column(3)):
                places = [K.unpack(asked[r].as_buffer()) for r in range(lo, hi)]
                count = [len(p[0]) for p in places]
                first, both = (np.concatenate([p[k] for p in places]) for k in (0, 1))
                row = np.repeat(np.arange(hi - lo), count)
                bits = 6 if length <= 64 + ANCHOR else 32
                for k in range(0, len(row), PIECES):
                    s = slice(k, k + PIECES)
                    pieces = _cut_out(data, at[row[s]] + first[s], both[s] >> bits, both[s] & ((1 << bits) - 1), length)
                    held.append((pieces, docs[lo + row[s]], parts[lo + row[s]], first[s]))
                    gathered += len(row[s])
                    if gathered >= PIECES:
                        yield batch_of(send(held))
                        held, gathered = [], 0
        if gathered:
            yield batch_of(send(held))

    return run


def refined(pieces: Pieces, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, pointer) of each string of ``length`` that starts in the pieces, by piece and start; equal strings have equal pointers.

    Positions begin in buckets by their first GRAM bytes; a position's pointer is the end of its bucket in the
    sorted order. Each bucket of several is then sorted by the pointers at the depth that all
    have reached, which are exact to that depth already, so the depth doubles; the new ends are the
    pointers that the next round reads. A position that is alone keeps its pointer.
    """
    n, width = pieces.data.shape
    size = pieces.more + length
    grams = np.append(pieces.data.reshape(-1), np.zeros(GRAM, np.uint8)).astype(K.U)
    have = 1
    while have < GRAM:
        grams = (grams[:-have] << K.U(8 * have)) | grams[have:]
        have *= 2
    step = np.tile(np.arange(width), n)
    room = np.repeat(size, width) - step  # bytes from a position to the end of its piece
    members = np.flatnonzero(room >= GRAM)
    members = members[np.argsort(grams[members], kind="stable")]
    start = np.flatnonzero(K.same_as_before(grams[members])[0])
    ends = np.append(start, len(members))[1:] - 1
    pointer = np.full(n * width, -1, np.int64)
    pointer[members] = np.repeat(ends, np.diff(np.append(start, len(members))))
    alone = np.zeros(n * width, bool)
    alone[members] = np.repeat(np.diff(np.append(start, len(members))) == 1, np.diff(np.append(start, len(members))))
    depth = GRAM
    while depth < length:
        offset = min(depth, length - depth)
        members = np.flatnonzero((room >= depth + offset) & ~alone)
        members = members[np.argsort(pointer[members] * (n * width) + pointer[members + offset], kind="stable")]
        old, later = pointer[members], pointer[members + offset]
        start = np.flatnonzero(K.same_as_before(old, later)[0])
        count = np.diff(np.append(start, len(members)))
        end = np.repeat(np.append(start, len(members))[1:] - 1, count)
        whole = np.flatnonzero(K.same_as_before(old)[0])
        whole_end = np.repeat(np.append(whole, len(members))[1:] - 1, np.diff(np.append(whole, len(members))))
        pointer[members] = old - (whole_end - end)
        alone[members] = np.repeat(count == 1, count)
        depth += offset
    at = np.flatnonzero(room >= length)
    return at // width, pointer[at]


def _repeated(length: int, buckets: int) -> Callable[[Batches], Batches]:
    """Of pieces in order of bucket and kind: the strings that a smaller document has too, to the buckets of their documents."""

    def solve(parts: list[tuple[Pieces, list[np.ndarray]]]) -> list[np.ndarray]:
        offset = np.cumsum([0, *(len(p.more) for p, _ in parts)])
        pieces = Pieces.of([p for p, _ in parts])
        of, doc, part, first = (np.concatenate(x) for x in zip(*((c[0] + o, *c[1:]) for (_, c), o in zip(parts, offset, strict=False)), strict=True))
        least = np.full(len(pieces.more), np.iinfo(np.int64).max)
        np.minimum.at(least, of, doc)
        key = pieces.key()
        order, lead, new = _distinct(pieces, key, least)
        number = np.empty(len(order), np.int64)
        number[order] = (np.cumsum(new) - 1)[lead]
        at = order[new]  # of each distinct piece one of its least document, in order of key
        of, pieces, least, key = number[of], pieces.take(at), least[at], key[at]
        found = [(doc[x := doc > least[of]], part[x], first[x], pieces.more[of[x]])]
        # pieces of one anchor that differ may still have strings in common
        start = np.flatnonzero(K.same_as_before(key)[0])
        count = np.diff(np.append(start, len(key)))
        several = np.flatnonzero(np.repeat(count > 1, count))
        upto = np.flatnonzero(K.same_as_before(key[several])[0]) if len(several) else several
        i = 0
        while i < len(upto):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + REFINED)))
            mine = several[upto[i] : upto[j] if j < len(upto) else len(several)]
            i = j
            piece, pointer = refined(pieces.take(mine), length)
            _, group = np.unique(pointer, return_inverse=True)
            low = np.full(len(piece), np.iinfo(np.int64).max)
            np.minimum.at(low, group, least[mine][piece])
            hit = np.flatnonzero(low[group] < least[mine][piece])
            if not len(hit):
                continue
            t = hit - np.searchsorted(piece, piece[hit])
            new = np.ones(len(hit), bool)
            new[1:] = (piece[hit][1:] != piece[hit][:-1]) | (t[1:] != t[:-1] + 1)
            begin = np.flatnonzero(new)
            end = np.append(begin, len(hit))[1:] - 1
            whose, t0, more = mine[piece[hit[begin]]], t[begin], t[end] - t[begin]
            # to all places of the piece in its least document
            entries = np.flatnonzero(doc == least[of])
            entries = entries[np.argsort(of[entries], kind="stable")]
            a, b = np.searchsorted(of[entries], whose), np.searchsorted(of[entries], whose, "right")
            which = np.repeat(np.arange(len(whose)), b - a)
            e = entries[np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange(len(which))]
            found.append((doc[e], part[e], first[e] + t0[which], more[which]))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def run(batches: Batches) -> Batches:
        now, parts, out = None, [], Outbox(buckets)
        for batch in batches:
            data, blob, size = (batch.column(n) for n in ("data", "blob", "size"))
            for k, (at, kind) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                columns = K.unpack(data[k].as_buffer())
                if kind == 0:
                    doc, first, part, more = columns
                    yield from out.put(doc, part, first, more)
                    continue
                if now != at and parts:
                    yield from out.put(*solve(parts))
                    parts = []
                now = at
                width = 2 * length - ANCHOR
                rows = np.frombuffer(pa.decompress(blob[k].as_buffer(), size[k].as_py(), "zstd"), np.uint8).reshape(-1, width + 8)
                numbers = np.ascontiguousarray(rows[:, width:]).view("<i4").astype(np.int64)
                parts.append((Pieces(rows[:, :width], numbers[:, 0], numbers[:, 1]), columns))
        if parts:
            yield from out.put(*solve(parts))
        yield from out.put(at_end=True)

    return run


def _kept(columns: int, kind: T.StructType) -> Callable[[Batches], Batches]:
    """The rows with the number of their bytes, the removed runs and what is left."""
    names = [f.name for f in kind]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            spans = batch.column(columns + 1)
            for lo, hi, data, at in K.chunks(batch.column(columns)):
                places = [K.unpack(spans[r].as_buffer()) if spans[r].is_valid else [np.empty(0, np.int64)] * 2 for r in range(lo, hi)]
                start, size = (np.concatenate([p[k] for p in places]) for k in (0, 1))
                count = np.array([len(p[0]) for p in places])
                row = np.repeat(np.arange(hi - lo), count)
                steps = np.zeros(len(data) + 1, np.int8)
                np.add.at(steps, at[row] + start, 1)
                np.add.at(steps, at[row] + start + size, -1)
                stays = np.cumsum(steps[:-1], dtype=np.int8) == 0
                left = np.concatenate([[0], np.cumsum(stays)])[at].astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(left), pa.py_buffer(data[stays])])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(size)], ["start", "size"]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(columns)), pa.array(np.diff(at)), lists, kept], names)

    return run


def without_repeats(docs: DataFrame, length: int = 50, columns: list[str] | None = None) -> DataFrame:
    """Each document without the bytes that a string of ``length`` bytes covers which also starts in a document of smaller doc_id.

    One row per row of ``docs``: its ``columns`` (all but the text, if not given), n_bytes, removed
    (array of start and size, in bytes: maximal runs), kept (binary, as characters may be cut). A name that
    ``columns`` has already gets _ at its end. Texts are their UTF-8 bytes; matches never cross
    documents and are judged on the input. ``length`` >= 24.

    1. Anchors: of the 16-byte runs of each string the one with the least hash, about 2 in ``length`` - 14 of all
       places; equal strings have equal anchors, so only what has its anchor in several
       documents goes on. Anchors meet by hash, packed; those that a task has several
       times only for its least document.
    2. The pieces of text around such anchors meet by the anchor. Equal ones are one
       piece, of its least document; in a task already, so that a passage of a third of all
       documents is a few pieces a task. An anchor that still has a good part
       of its bucket is dealt by whole strings, each by its own hash; there are at most 64 such for
       each partition of the shuffle.
    3. Pieces of one anchor that differ go through bucket-pointer refinement: positions begin in buckets
       of eight-byte grams, which are sorted by the buckets of later offsets until
       ``length`` bytes are compared; of equal strings all but those of the least document are removed.
       Bytes decide, hashes only bring together.
    4. Each document's removed strings are merged and applied.

    Null and empty texts have 0 bytes. Rows of null doc_id are returned whole and remove nothing. Rows of one doc_id
    never remove from one another, whether their texts are equal or not; each is
    judged for itself. Long texts go through step 1 in parts; a text is held whole
    where it is cut. An empty table gives no rows.
    """
    if length < ANCHOR + GRAM:
        raise ValueError(f"strings of less than {ANCHOR + GRAM} bytes have no anchor of their own")
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c != "text"] if columns is None else columns
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, piece_buckets, doc_buckets = (n * partitions for n in (BUCKETS, PIECE_BUCKETS, DOC_BUCKETS))
    keyed = docs.select(F.struct(*named(columns)).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    many = cut(docs.groupBy(F.col("doc_id").cast("long").alias("doc")).count().where("count > 1 AND doc IS NOT NULL").select("doc", F.lit(True).alias("again")))
    if many.isEmpty():
        keyed = keyed.withColumn("part", F.lit(0).cast("long"))
    else:
        keyed = keyed.join(broadcast_if_small(many), "doc", "left").withColumn("part", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long"))
    texts = keyed.where("doc IS NOT NULL").select("doc", "part", "text")

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket", "kind")

    per_doc = "doc long, part long, data binary"
    with Scratch(spark) as scratch:
        anchored = met(texts.mapInArrow(_anchored(length, buckets), PACKED))
        shared = scratch.table(anchored.mapInArrow(_shared(doc_buckets), PACKED))
        hot = [K.unpack(r.data)[0] for r in shared.where("kind = 1").collect()]  # at most HOT_SHARE a bucket
        hot = np.sort(np.concatenate(hot).view(K.U)) if hot else np.empty(0, K.U)
        # a few bytes for each anchor that several documents have: it grows with the texts, which go to it by shuffle
        asked = cut(met(shared.where("kind = 0")).mapInArrow(_of_documents(_places), per_doc))
        rows = texts.join(asked, ["doc", "part"]).select("doc", "part", "data", "text")
        pieces = met(rows.mapInArrow(_pieces(length, piece_buckets, hot), f"{PACKED}, blob binary, size long"))
        removed = met(pieces.mapInArrow(_repeated(length, doc_buckets), PACKED))
        removed = cut(removed.mapInArrow(_of_documents(_merged(length)), per_doc))
    extra = []
    for name in ("n_bytes", "removed", "kept"):
        extra.append(fresh(name, [*columns, *extra]))
    whole = keyed.join(broadcast_if_small(removed), ["doc", "part"], "left").select(*named(columns, "row"), "text", "data")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("size", T.LongType())])
    kind = T.StructType([*whole.schema.fields[: len(columns)], *(T.StructField(n, t) for n, t in zip(extra, (T.LongType(), T.ArrayType(span), T.BinaryType()), strict=True))])
    return whole.mapInArrow(_kept(len(columns), kind), kind)


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents"), columns=["doc_id"])
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
strings AS (SELECT doc_id, i, x[i + 1:i + 50] AS s FROM (SELECT doc_id, unnest(range(octet_length(x) - 49)) AS i, x FROM d)),
least AS (SELECT s, min(doc_id) AS doc_id FROM strings GROUP BY s),
hits AS (SELECT t.doc_id, i FROM strings AS t JOIN least AS l ON t.s = l.s AND l.doc_id < t.doc_id),
marked AS (SELECT *, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) + 50 AS new FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
    UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(x[a + 1:coalesce(b, octet_length(x))]), '' ORDER BY a) AS y FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, octet_length(x) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN y IS NULL THEN x ELSE unhex(y) END) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
