"""Vectorised text primitives on Arrow batches: byte buffers, words, hashes and shingles without a Python call per word.

Everything here works on chunks of at most CHUNK bytes (or one document, if that is longer), so memory follows the chunk
and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are no ASCII letter or digit and no part of a longer UTF-8 character.
MARK = np.array([not (x >= 0x80 or chr(x).isalnum()) for x in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_MULT = U(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POW = np.cumprod(np.concatenate([np.ones(1, U), np.full(65535, U(0x100000001B3 * 2 + 1), U)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array (null: empty) and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay under most, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n, i + 65535)
        yield i, j
        i = j


def texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) for each chunk of a column."""
    raw, off = buffers(batch.column(name))
    for i, j in chunks(off):
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]


def words(raw: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes other than 0x20 and 0x09-0x0D) and the row that holds it; space may name other separators."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    ink = ~space[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    before = np.concatenate([[False], ink[:-1]])
    after = np.concatenate([ink[1:], [False]])
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes."""
    if not len(start):
        return np.zeros(0, U)
    length = end - start
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(first, length)
    byte = raw[at + np.repeat(start, length)].astype(U) + U(1)
    return mix(np.add.reduceat(byte * _POW[at & 0xFFFF], first) ^ (length.astype(U) * _MULT))


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each row (65,535 rows at most) as sorted 48-bit hashes, end to end, and n + 1 offsets.

    A-Z count as a-z. A row of fewer than k words has its whole sequence as one shingle; a row without words has none.
    """
    n = len(off) - 1
    raw = LOWER[raw]
    start, end, row = words(raw, off)
    h = word_hashes(raw, start, end)
    per = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    first = np.cumsum(per) - per
    got, of = [], []
    if len(h) >= k:
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out = mix(out * _MULT + h[i : len(h) - k + 1 + i])
        whole = row[: len(row) - k + 1] == row[k - 1 :]
        got.append(out[whole])
        of.append(row[: len(row) - k + 1][whole])
    for r in np.flatnonzero((per > 0) & (per < k)):
        one = U(0x51ED270B)
        for x in h[first[r] : first[r] + per[r]]:
            one = mix(np.array([one]) * _MULT + x)[0]
        got.append(np.array([one ^ U(per[r])], U))
        of.append(np.array([r]))
    if not got:
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    both = np.concatenate(of).astype(U) << U(48) | np.concatenate(got) >> U(16)
    both.sort()
    keep = np.ones(len(both), dtype=bool)
    keep[1:] = both[1:] != both[:-1]
    both = both[keep]
    return both & U((1 << 48) - 1), np.concatenate([[0], np.cumsum(np.bincount((both >> U(48)).astype(np.int64), minlength=n))])


def run_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values in each range of off; 0 for an empty range."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[off[1:]] - total[off[:-1]]


np.seterr(over="ignore")
