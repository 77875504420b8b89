"""Windows that a first search opens, against one search after the other."""

import random

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import trending

ROWS = "visitor string, event_id long, us long"


def by_rule(rows, per, micros, opened=()):
    state, out = {v: (u, n) for v, u, n in opened}, {}
    for v, e, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        until, n = state.get(v, (-1 << 62, 0))
        until, n = (t + micros, 1) if t >= until else (until, n + 1)
        state[v] = until, n
        out[e] = (n <= per, until, n)
    return out


def ours(spark, rows, per, seconds, opened=()):
    df = spark.createDataFrame(rows, ROWS)
    before = spark.createDataFrame(list(opened), "visitor string, until long, n long") if opened else None
    return {r.event_id: (r.allowed, r.until, r.n) for r in trending.limited(df, per, seconds, before).collect()}


def case(rng, n, visitors, most):
    return [(f"v{rng.randrange(visitors)}", i, rng.randrange(most)) for i in range(n)]


def test_windows(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # windows go on over the ends of batches
    try:
        for seed in range(5):
            rng = random.Random(seed)
            rows = case(rng, 400, rng.choice([1, 3, 40]), 60_000_000)
            opened = [(f"v{i}", rng.randrange(60_000_000), rng.randrange(1, 9)) for i in range(0, 40, 2)]
            seconds = rng.choice([1, 3, 20])
            assert ours(spark, rows, 4, seconds) == by_rule(rows, 4, seconds * 1_000_000)
            assert ours(spark, rows, 4, seconds, opened) == by_rule(rows, 4, seconds * 1_000_000, opened)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ours(spark, [], 4, 1) == {}
    assert ours(spark, [("a", 1, 5), ("a", 2, 5), ("a", 3, 5)], 2, 1) == {1: (True, 1_000_005, 1), 2: (True, 1_000_005, 2), 3: (False, 1_000_005, 3)}
    wide = [("a", 1, 0), ("b", 2, 1 << 61), ("c", 3, 7), ("c", 4, 8)]
    assert ours(spark, wide, 1, 1) == by_rule(wide, 1, 1_000_000)


def test_batches_carry_their_windows(spark):
    """Cut anywhere, batches that hand on their open windows give what one batch gives."""
    rng = random.Random(9)
    rows = sorted(case(rng, 300, 4, 90_000_000), key=lambda r: r[2])
    whole, got, opened = by_rule(rows, 5, 10_000_000), {}, []
    for part in np.array_split(np.arange(300), 4):
        some = [rows[i] for i in part]
        df = spark.createDataFrame(some, ROWS)
        before = spark.createDataFrame(opened, "visitor string, until long, n long")
        out = trending.limited(df, 5, 10, before).cache()
        got |= {r.event_id: (r.allowed, r.until, r.n) for r in out.collect()}
        left = {r.visitor: (r.w.until, r.w.n) for r in out.groupBy("visitor").agg(F.max(F.struct("until", "n")).alias("w")).collect()}
        opened = [(v, *w) for v, w in ({v: (u, n) for v, u, n in opened} | left).items() if w[0] > some[-1][2]]
    assert got == whole
