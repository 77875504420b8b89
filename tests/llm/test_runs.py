"""Periodic runs against their definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import periodic_runs as P
from tests.conftest import SF

DOCS = "doc_id long, text string, runs string, best long, n_words string"  # the last clash with names inside


def brute_runs(words, least=24):
    """By definition: every period's maximal stretches; of a stretch the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text, plant=True):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, original = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        words = [original[i] if i < a else original[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts():
    rng, out = random.Random(4), []
    for _ in range(120):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            at, m = rng.randint(0, len(words)), rng.randint(1, 60)
            words[at:at] = (unit * 60)[:m]
        out.append(rng.choice([" ", "\n", "\t ", " x "]).join(words))
    thue = [0]
    for _ in range(10):
        thue += [1 - x for x in thue]
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    odd = [None, "", " \n\t", "one", "x " * 23, "x " * 24, "x " * 3000, "a b " * 12, "a b " * 11 + "a", "a b c d e f g h i " * 3, " ".join("abcdefghi" * 3)[:-2], " ".join(map(str, thue)) * 2, " ".join(fib[-1]), ("x " * 30 + "y ") * 5, ("a b a b a b a b c " * 9)]
    return out + odd


def test_runs_of_definition():
    for attempt, text in enumerate(texts()):
        words = (text or "").encode().split()
        got, rest = P.collapsed(words)
        assert [tuple(r) for r in got.tolist()] == brute_runs(words), attempt
        gone = {i for s, m, q in got.tolist() for i in range(s + q, s + m)}
        assert rest == b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_chunks_and_collisions(monkeypatch):
    """Tiny chunks, and hashes that collide at first, give the same runs."""
    every = [(t or "").encode().split() for t in texts()]
    want = [P.collapsed(w)[0].tolist() for w in every]
    monkeypatch.setattr(P, "CHUNK", 7)
    assert [P.collapsed(w)[0].tolist() for w in every] == want
    monkeypatch.setattr(P, "CHUNK", 1 << 18)
    true = P.Hashes.__init__

    def weak(self, ids, attempt=0):
        true(self, ids // 2 if attempt == 0 else ids, attempt)  # words 2i and 2i + 1 look alike in the first attempt

    monkeypatch.setattr(P.Hashes, "__init__", weak)
    assert [P.collapsed(w)[0].tolist() for w in every] == want


def test_query_rows(spark):
    rows = list(enumerate(texts())) + [(None, "x " * 30), (5, "x " * 30), (5, "x " * 30)]
    df = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], DOCS)
    got = sorted((tuple(r) for r in P.digests(P.periodic_runs(df, prepare=P.planted)).collect()), key=str)
    assert got == sorted((brute_row(i, t) for i, t in rows), key=str)
    assert P.digests(P.periodic_runs(df.where("false"))).count() == 0


def test_real_documents(spark):
    from quarry.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 30_000).collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for d in docs[:120]:
        assert got[d.doc_id] == brute_row(d.doc_id, d.text)


def test_long_text():
    """200,000 words, a third of them one word: in seconds, and the whole of it."""
    rng = np.random.default_rng(1)
    words = [b"w%d" % x for x in rng.integers(0, 50_000, 130_000)]
    words[40_000:40_000] = [b"same"] * 70_000
    runs, rest = P.collapsed(words)
    assert runs.tolist() == [[40_000, 70_000, 1]]
    assert len(rest.split()) == 130_001


def test_fewer_than_three_periods_refused(spark):
    with pytest.raises(ValueError):
        P.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), times=2)
