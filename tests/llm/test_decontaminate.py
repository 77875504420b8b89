"""Repeated words in items and documents, against every diagonal compared."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import decontaminate as D
from quarry.llm import kernel as K


def brute(items, text, least=13, similar=0.8):
    """All diagonals of every item that has a seed in common: what is found, the longest overlap, the first word."""
    from fractions import Fraction

    share, words, out = Fraction(similar).limit_denominator(1000), text.split(), []
    for i, item in items:
        own = item.split()
        need = min(least, len(own))
        for d in range(-len(own) + 1, len(words)):
            lo, hi = max(0, d), min(len(words), d + len(own))
            if hi - lo >= need > 0:
                same = np.array([words[x] == own[x - d] for x in range(lo, hi)])
                begin, n = D.longest_stretch(same, share.numerator, share.denominator)
                if n >= need:
                    equal = begin + np.flatnonzero(same[begin : begin + n])
                    out.append((int(equal[-1] - equal[0]) + 1, i, int(lo + equal[0])))
    return out and ({x[1] for x in out}, max(out)[0], min(x[2] for x in out))


def ours(items, text):
    raw, off = K.buffers(pa.array([text], pa.large_string()))
    found = D._found(D.Items(*map(list, zip(*items, strict=True))), raw, off, 13, 0.8).get(0, [])
    return found and ({x[1] for x in found}, max(found)[0], min(x[2] for x in found))


def test_few_words_again_and_again():
    """Vocabularies of one to four words, periodic stretches and substitutions."""
    rng = random.Random(6)
    for _ in range(150):
        vocabulary = "abcd"[: rng.randint(1, 4)]

        def junk(n, v=vocabulary):
            unit = [rng.choice(v) for _ in range(rng.randint(1, 5))]
            words = (unit * n)[:n] if rng.random() < 0.6 else [rng.choice(v) for _ in range(n)]
            for _ in range(rng.choice([0, 0, 3])):
                words[rng.randrange(n)] = "z"
            return " ".join(words)

        items = [(i, junk(rng.randint(1, 40))) for i in range(3)]
        text = " ".join([junk(rng.randint(1, 40)), junk(rng.randint(1, 30), "xy"), junk(rng.randint(1, 40))])
        assert ours(items, text) == brute(items, text), (items, text)


def test_progressions_cover_places():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(0, 30))
        value, group = rng.integers(0, 3, n).astype(np.uint64), rng.integers(0, 2, n)
        place = rng.choice(40, n, replace=False) if n else np.zeros(0, np.int64)
        got = {(int(v), int(g), int(p + k * s)) for v, g, p, s, t in zip(*D.progressions(value, group, place), strict=True) for k in range(t)}
        assert got == set(zip(value.tolist(), group.tolist(), place.tolist(), strict=True))


def test_one_word_twenty_thousand_times():
    """Linear, not quadratic, in how often a word comes: seconds, and some tens of MB."""
    for unit in ("a ", "a b ", "a b c a d "):
        item, text = (unit * 20_000)[:40_000], "x " + (unit * 20_000)[:40_000]
        tracemalloc.start()
        began = time.time()
        found = ours([(1, item), (2, "p q r s t u v w x y z a b c d e f")], text)
        assert found[0] == {1} and found[1] == len(item.split()) and found[2] <= 1
        assert time.time() - began < 20
        assert tracemalloc.get_traced_memory()[1] < 300 << 20
        tracemalloc.stop()


def test_one_block_at_a_time(spark, monkeypatch):
    """However many blocks there are, a broadcast is gone before the next one, and rows stay one each."""
    held = []
    context = spark.sparkContext
    true, alive = type(context).broadcast, []

    def broadcast(self, value):
        out = true(self, value)
        if isinstance(value, D.Items):
            alive.append(out)
            held.append(len(alive))
            destroy = out.destroy
            out.destroy = lambda *a, **k: (alive.remove(out), destroy(*a, **k))
        return out

    monkeypatch.setattr(type(context), "broadcast", broadcast)
    monkeypatch.setattr(D, "BLOCK", 300)
    rng = random.Random(3)
    passages = [" ".join(f"w{rng.randrange(500)}" for _ in range(20)) for _ in range(12)]
    bench = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    rows = [(i, f"p q {passages[i]} r") for i in range(12)] + [(None, passages[0]), (7, "clean"), (7, "clean"), (50, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string").repartition(3)
    got = D.decontaminate(docs, bench).collect()
    assert len(held) > 3 and max(held) == 1
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows)
    assert sum(r.contaminated for r in got) == 13
    assert D.clean_documents(docs, bench).select("doc_id", "text", "row").count() == 3
    assert D.clean_documents(docs, bench).where(F.col("row") != "x").count() == 0
