"""Numpy kernels over Arrow string columns: words, shingles and their hashes.

All work on the column's own byte buffer, a few MB at a time, so that memory
does not follow the size of a batch. Hashes are functions of the bytes alone
and agree between tasks, machines and runs.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Fixed odd multipliers.
_PRIME = 0x9E3779B97F4A7C15
_STEP = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]
CHUNK_BYTES = 1 << 18

_BYTE = np.arange(256)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: Bytes of words, by the pattern [^\x20\x09-\x0D]+ ...
BY_SPACE = ~((_BYTE == 0x20) | ((_BYTE >= 9) & (_BYTE <= 13)))
#: ... and by [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (digits, a-z, all beyond ASCII).
BY_LETTER = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    """p**i and p**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_PRIME, pow(_PRIME, -1, 1 << 64))):
            steps = np.full(size, U(base), U)
            steps[0] = U(1)
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


@dataclass
class Words:
    """Words of some consecutive rows: byte spans, hashes, and first word of each row (one more entry than rows)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, one space between."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def release() -> None:
    """Gives memory that is free back to the system, so a worker that lives on holds what it needs now and not what it once needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them), each of at most ``most`` bytes or one row."""
    data, at = _buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, upto, data[at[row] : at[upto]], at[row : upto + 1] - at[row]
        row = upto
    release()


def split(data: np.ndarray, at: np.ndarray, word_bytes: np.ndarray, lower: bool = True) -> Words:
    """Words of the rows, lower-cased (A-Z) unless told otherwise."""
    n = len(data)
    data = _LOWER[data] if lower else data
    inside = word_bytes[data]
    first_byte = np.zeros(n + 1, bool)
    first_byte[at] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first_byte[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first_byte[1:])) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    hashes = mix(hashes ^ (ends - starts).astype(U) * _STEP[2])
    return Words(data, starts, ends, hashes, np.searchsorted(starts, at))


def shingles(words: Words, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and first shingle of each row. With
    ``short``, a row of fewer words, but not none, has its whole sequence as one."""
    w, counts = words.hashes, words.counts
    total = np.zeros(max(0, len(w) - size + 1), U)
    for j in range(size):
        place = U((j + 1) * int(_STEP[j % 5]) % (1 << 64))
        total += mix(w[j : j + len(total)] + place) * _STEP[(j + 1) % 5]
    kept = np.maximum(counts - size + 1, 0)
    few = np.flatnonzero((counts > 0) & (counts < size)) if short else np.empty(0, np.int64)
    number = kept.copy()
    number[few] = 1
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(number, out=first[1:])
    out = np.empty(first[-1], U)
    row = np.repeat(np.arange(len(counts)), kept)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
    out[first[row] + inner] = mix(total[words.first[row] + inner])
    for r in few:
        h = U(counts[r])
        with np.errstate(over="ignore"):
            for x in w[words.first[r] : words.first[r + 1]]:
                h = mix(np.array([h * _STEP[3] + x], U))[0]
        out[first[r]] = h
    return out, first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values in order, each once."""
    values = values.copy()
    for a, b in zip(first[:-1], first[1:], strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[first[:-1][first[:-1] < len(values)]] = True
    running = np.zeros(len(values) + 1, np.int64)
    np.cumsum(new, out=running[1:])
    return values[new], running[first]


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    values = pa.array(values.view(np.int64) if values.dtype == U else values, kind)
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes: the first, which rises (unsigned), as steps from its least; of each
    the bytes of a rank together, as far as the largest value reaches, so that what is small or
    alike compresses well."""
    base = columns[0][:1].astype(np.int64)
    out = [np.array([len(columns[0]), *base], np.int64).tobytes()] if len(base) else [b""]
    for k, x in enumerate(columns if len(base) else ()):
        x = np.ascontiguousarray(x, np.int64).view(U)
        if k == 0:
            x = np.diff(x, prepend=x[:1])
        width = (int(x.max()).bit_length() + 7) // 8
        out += [bytes([width]), np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return b"".join(out)


def unpack(data: bytes | pa.Buffer) -> list[np.ndarray]:
    """The columns of ``pack``, as int64."""
    data = memoryview(data)
    (n, base), at, out = np.frombuffer(data, np.int64, 2), 16, []
    while at < len(data):
        width, at = data[at], at + 1
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T
        at += width * int(n)
        out.append(x.view(U).reshape(-1))
    out[0] = np.cumsum(out[0]) + base.astype(np.int64).view(U)
    return [x.view(np.int64) for x in out]


def same_as_before(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: which differ from the row before, and for each row the first that equals it."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new, np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.empty(0, np.int64)


#: Entries of a packed row at most, of those that may go to any bucket.
PIECE = 4096

#: (bucket, kind, data of ``pack``)
Packed = tuple[int, int, bytes]


def bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; it rises with the hash."""
    return (((x >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def by_bucket(kind: int, at: np.ndarray, columns: list[np.ndarray]) -> Iterator[Packed]:
    """Packed rows of each bucket; ``at`` and the first column rise."""
    cuts = np.flatnonzero(same_as_before(at)[0])
    for i, j in zip(cuts, np.append(cuts, len(at))[1:], strict=True):
        yield int(at[i]), kind, pack(*(x[i:j] for x in columns))


def anywhere(kind: int, columns: list[np.ndarray], buckets: int) -> Iterator[Packed]:
    """Packed rows of at most PIECE entries, each in some bucket."""
    order = np.argsort(columns[0].view(U), kind="stable")
    for i in range(0, len(order), PIECE):
        piece = [x[order[i : i + PIECE]] for x in columns]
        yield int(bucket(mix(piece[1][:1].view(U)), buckets)[0]), kind, pack(*piece)


def packed(rows: list[Packed]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.int8(), pa.binary()))], ["bucket", "kind", "data"])


def unpacked(batches: Iterator[pa.RecordBatch], alone: tuple[int, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(kind, columns) of packed rows that come in order of bucket and kind: those of the kinds ``alone``
    row by row, of others all of a bucket together."""
    now, parts = None, []
    for batch in batches:
        data = batch.column(2)
        for k, (at, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if kind in alone:
                yield kind, unpack(data[k].as_buffer())
                continue
            if now != (at, kind):
                if parts:
                    yield now[1], [np.concatenate(x) for x in zip(*parts, strict=True)]
                now, parts = (at, kind), []
            parts.append(unpack(data[k].as_buffer()))
    if parts:
        yield now[1], [np.concatenate(x) for x in zip(*parts, strict=True)]
    parts = []
    release()


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it hangs together with) for the nodes of edges (a, b)."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(node))
    while True:
        low = np.minimum(up[x], up[y])
        before = up.copy()
        for end in (x, y):
            np.minimum.at(up, up[end], low)
            np.minimum.at(up, end, low)
        while not np.array_equal(up, up[up]):
            up = up[up]
        if np.array_equal(up, before):
            return node, node[up]
