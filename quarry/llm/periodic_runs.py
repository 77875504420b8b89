"""Periodic runs of words: harmonic grid, prefix hashes, longest common extensions of all pairs at once.

A run of period p and length 3p or more holds a grid point i (a multiple of p) so that i and i + p lie in it with at least
m = least length - 2p + 1 words behind them. So for every period p and each of its n / p grid points (n ln n pairs of a text of
n words) it is asked whether the words from i and from i + p on agree: first in one word, then in m words by prefix hashes,
then as far as they agree in both directions, by binary searches that run for all pairs simultaneously. Neighbouring grid
points that agree lie in one stretch, whose ends alone are searched. Hashes are polynomials modulo 2^31 - 1; equal words have equal
hashes, so no run is missed, and what hashes claim is verified word by word. A claim that fails is a collision: the text is
done again with another base. Of equal stretches the smallest period is kept, which by Fine and Wilf is the run's.

Each row is one task's work for its own words alone, in chunks of CHUNK pairs: memory follows the longest text. Nothing is
shuffled, collected or broadcast; a lost executor's rows are done again.

Defined cases: a null or empty text, or one of white space alone, has no words: no runs, an empty text, and null for the best
run. Texts shorter than the least run have none. Equal exponents go to the smaller start, then to the smaller period.
Repeated rows and rows with null doc_id are done each for itself. An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

CHUNK, PRIME, FLUSH = 1 << 18, (1 << 31) - 1, 8 << 20
RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, text string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_powers: dict[int, np.ndarray] = {}


def _base(n: int) -> int:
    """The n-th base: from a digest, so that a text can't be made to collide in all of them."""
    return int.from_bytes(hashlib.sha256(b"base %d" % n).digest()[:4], "little") % (PRIME - 1000) + 500


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo the prime, by doubling."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.ones(1, np.int64)
        while len(have) <= n:
            have = np.concatenate([have, have * pow(base, len(have), PRIME) % PRIME])
        if len(have) <= 1 << 20:
            _powers[base] = have
    return have


class Hashes:
    """Prefix hashes of a text's word numbers."""

    def __init__(self, ids: np.ndarray, attempt: int = 0):
        self.power = powers(_base(attempt), len(ids) + 1)
        digits = (ids.astype(np.int64) + 1) * 2654435761 % PRIME
        self.prefix = np.concatenate([[0], np.cumsum(digits * self.power[: len(ids)] % PRIME) % PRIME])

    def equal(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` words from at and from at + period on have one hash."""
        there = at + period
        here = (self.prefix[at + length] - self.prefix[at]) % PRIME
        return here * self.power[period] % PRIME == (self.prefix[there + length] - self.prefix[there]) % PRIME

    def extend(self, at: np.ndarray, period: np.ndarray, low: np.ndarray, high: np.ndarray, back: bool) -> np.ndarray:
        """How many words from at and at + period agree, on or back, for all pairs: binary searches between low and high."""
        low, high = low.copy(), high.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo] + 1) // 2
            from_ = at[todo] - mid if back else at[todo]
            ok = self.equal(from_, period[todo], mid)
            low[todo], high[todo] = np.where(ok, mid, low[todo]), np.where(ok, high[todo], mid - 1)
            todo = todo[low[todo] < high[todo]]
        return low


def grid(n: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, grid point) of all pairs, in chunks; a chunk may end within a period."""
    period = np.arange(1, n // times + 1, dtype=np.int64)
    need = np.maximum(least, times * period) - period + 1  # words behind a grid point: a period, and m more
    counts = np.maximum(0, (n - need) // period + 1) * (n >= need)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, CHUNK):
        high = min(total, low + CHUNK)
        a, b = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high - 1, "right") + 1
        begins = ends[a:b] - counts[a:b]
        first, last = np.maximum(begins, low), np.minimum(ends[a:b], high)
        p = np.repeat(period[a:b], last - first)
        k = np.arange(low, high) - np.repeat(begins, last - first)
        yield p, k * p


def _claimed(ids: np.ndarray, least: int, times: int, attempt: int) -> np.ndarray:
    """Rows (start, end, period) that hashes claim, one a stretch: the smallest period."""
    n, hashes, found = len(ids), None, []
    for p, at in grid(n, least, times):
        use = np.flatnonzero(ids[at] == ids[at + p])
        if not len(use):
            continue
        hashes = hashes or Hashes(ids, attempt)
        m = np.maximum(least, times * p[use]) - 2 * p[use] + 1
        ok = hashes.equal(at[use], p[use], m)
        use, m = use[ok], m[ok]
        if not len(use):
            continue
        p, at = p[use], at[use]
        joined = (p[1:] == p[:-1]) & (at[1:] - at[:-1] == p[1:])  # as m >= p, these lie in one stretch
        first, last = np.concatenate([[True], ~joined]), np.concatenate([~joined, [True]])
        period, left, right = p[first], at[first], at[last]
        start = left - hashes.extend(left, period, np.zeros_like(left), left, True)
        end = right + period + hashes.extend(right, period, m[last], n - right - period, False)
        keep = end - start >= np.maximum(least, times * period)
        found.append(np.column_stack([start, end, period])[keep])
    if not found:
        return np.empty((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))[: len(rows)]]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(ids: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """(start, length, period) of every run of at least `least` words and `times` periods (3 or more), by start, then period."""
    if len(ids) < least:
        return np.empty((0, 3), np.int64)
    for attempt in itertools.count():
        rows = _claimed(ids, least, times, attempt)
        if all(np.array_equal(ids[s : e - p], ids[s + p : e]) for s, e, p in rows.tolist()):
            return np.column_stack([rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]])


def best_of(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for s, n, p in runs.tolist():
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    return best


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word stays: those in a run behind its first period go."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:n]) == 0


def collapsed(words: list[bytes], least: int = 24, times: int = 3) -> tuple[np.ndarray, bytes]:
    """The runs of a text's words, and the text without their repetitions."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    runs = runs_of(ids, least, times)
    return runs, b" ".join(itertools.compress(words, kept_words(len(words), runs).tolist()) if len(runs) else words)


def _run(least: int, times: int, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None):
    def record(rows: list) -> pa.RecordBatch:
        ids, n, runs, best, texts = zip(*rows, strict=True)
        flat = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
        parts = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(_RUN))
        ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        top = pa.array([None if b is None else dict(zip(("start", "length", "period"), b, strict=True)) for b in best], _RUN)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), parts), top, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "best", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                words = (text.as_py() or b"").split()  # at the six ASCII white-space characters
                if prepare:
                    words = prepare(doc_id, words)
                runs, rest = collapsed(words, least, times)
                rows.append((doc_id, len(words), runs, best_of(runs), rest))
                held += len(rest) + 24 * len(runs)
                if held > FLUSH:
                    yield record(rows)
                    rows, held = [], 0
        if rows:
            yield record(rows)

    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """docs -> (doc_id, n_words, runs, best, text): all runs, the best one, and the text with each run cut to its first period.

    prepare: what workers make of (doc_id, words) before; it can't see other rows.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods aren't found by this grid")
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run(least, times, prepare), SCHEMA)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The registered query's input: in a tenth of the documents, by crc32 of the doc_id, words from one place on repeat."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digests(found: DataFrame) -> DataFrame:
    """periodic_runs() -> (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
