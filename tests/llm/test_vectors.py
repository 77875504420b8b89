"""Vantage-point trees and centroid clustering against brute force and exact arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from quarry.llm import centroid_clusters as C
from quarry.llm import vptree as V
from tests.conftest import SF

ROWS = "vec_id long, embedding array<float>, pivot string, v long"  # the last two clash with names inside


def brute_near(rows, k=10, every=100):
    once = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            once[i] = min(once.get(i, v), v)
    out = []
    for q in sorted(once):
        if q % every == 0:
            near = []
            for i, v in once.items():
                if i != q and len(v) == len(once[q]):
                    total = 0.0
                    for a, b in zip(once[q], v, strict=True):
                        total += (a - b) * (a - b)
                    near.append((math.sqrt(total), i))
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(sorted(near)[:k])]
    return out


def cases(n=900, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(int(i), (centres[i % 5] + 0.2 * rng.normal(size=dim)).round(2).tolist()) for i in range(n)]
    rows += [(int(1000 + i), [0.5] * dim) for i in range(400)]  # a third are one vector
    rows += [(2000, None), (2100, []), (2200, [0.0] * dim), (2300, [None] * dim), (2400, [float("nan")] * dim), (2500, [float("inf")] * dim), (None, [1.0] * dim)]
    rows += [(2600, [1.0, 2.0]), (2601, [1.0, 2.5]), (2700, [3.0]), (0, rows[0][1]), (100, [9.0] * dim)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], ROWS)


@pytest.mark.parametrize(("shard", "pivots"), [(8192, 1024), (64, 8), (100, 1)])
def test_factor_one_is_exact(spark, monkeypatch, shard, pivots):
    monkeypatch.setattr(V, "QUERIES", 4)
    rows = cases()
    got = [tuple(r) for r in V.neighbours(frame(spark, rows), factor=1.0, shard_rows=shard, most_pivots=pivots).orderBy("query_id", "rank").collect()]
    assert got == brute_near(rows)


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(7)
    points = rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] * 9 + 0.1 * rng.normal(size=(4000, 8))
    ids, asked = np.arange(4000), points[::50]
    tree = V.Tree.loads(V.Tree.build(ids, points).dumps())
    far, who, looked = tree.search(asked, ids[::50], np.full(80, np.inf), 10)
    true = np.sqrt(((asked[:, None] - points) ** 2).sum(axis=2))
    true[np.arange(80), ids[::50]] = np.inf
    assert (who == np.argsort(true, axis=1, kind="stable")[:, :10]).all()
    assert looked < 0.25 * 80 * 4000  # most of the distances are never looked at
    assert tree.search(asked, ids[::50], np.full(80, np.inf), 10, 3.0)[2] <= looked


def test_few_shards_are_asked(spark):
    """Far groups: the second pass goes to none of the shards that the triangle inequality rules out."""
    rng = np.random.default_rng(2)
    rows = [(i, (np.eye(8)[i % 8] * 100 + rng.normal(size=8)).tolist()) for i in range(1600)]
    vecs = V.vectors(frame(spark, rows))
    index = V.build(vecs, shard_rows=25, most_pivots=64)
    asked = vecs.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id").selectExpr("*", "5d AS bound")
    route = V._route(index.pivots, index.shards, index.radius, 1.0, False, 1)
    visits, every = asked.mapInArrow(route, V.ROUTED).count(), sum(index.shards.values()) * asked.count()
    assert visits < every / 3
    assert index.manifest.agg({"n": "sum"}).first()[0] == 1600  # every row is in one file


def test_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_near(rows)
    got = V.neighbours(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    assert len(got) == len(want)
    assert len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in want}) >= 0.95 * len(want)
    exact = {(q, i): d for q, _, i, d in want}
    assert all(exact.get((r.query_id, r.vec_id), r.score) == r.score for r in got)


def test_recall_large(spark):
    """sf0.1, where shards of 256 rows make routing and both passes work."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = {(q, i) for q, _, i, _ in brute_near(rows)}
    got = {(r.query_id, r.vec_id) for r in V.neighbours(df, shard_rows=256).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_empty(spark):
    empty = spark.createDataFrame([], ROWS)
    assert V.neighbours(empty).count() == 0
    assert C.clusters(empty)[0].count() == 0
    assert V.neighbours(frame(spark, [(0, [1.0, 2.0])])).count() == 0


def brute_clusters(rows, k=8, rounds=10, dim=64):
    clamp = lambda x: max(-C.MOST, min(C.MOST, x))
    kept = [(i, tuple(clamp(math.floor(1024 * float(np.float32(x)))) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]
    centres = [v for _, _, v in first]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((away(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [tuple(sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)) if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sums = {}
    for _, c, d in found:
        sums[c] = sums.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, sums[c], sum(sums.values()), digest[c]) for i, c, d in found), key=str)


def test_clusters(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=(4, 64))[i % 4] / 8).tolist()) for i in range(150)]
    rows += [(500 + i, rows[0][1]) for i in range(80)]  # one vector of a third of the rows: centroids may tie, or lose all rows
    rows += [(None, rows[3][1]), (7, rows[7][1]), (8, rows[9][1]), (900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [None] * 64), (904, [1e30] * 64), (905, [-3.4e38] * 64), (906, [0.0] * 64)]
    got = sorted((tuple(r) for r in C.clusters(frame(spark, rows))[0].collect()), key=str)
    assert got == brute_clusters(rows)
    few = rows[:3]
    assert sorted((tuple(r) for r in C.clusters(frame(spark, few))[0].collect()), key=str) == brute_clusters(few)


@pytest.mark.parametrize("size", [1, 300, 1 << 20, C.MOST])
def test_intervals_hold(size):
    """Every exact value lies in its interval, and near ties are decided as integers decide them."""
    rng = np.random.default_rng(size)
    x = rng.integers(-size, size, (400, 64), endpoint=True)
    c = np.concatenate([x[:3], x[:3] + rng.integers(-1, 2, (3, 64)), rng.integers(-size, size, (2, 64), endpoint=True)])
    mid, half = C.intervals(x, c)
    exact = np.array([[sum(int(b) * int(b) - 2 * int(a) * int(b) for a, b in zip(u, w, strict=True)) for w in c] for u in x[:60]], dtype=object)
    assert all(abs(int(e) - int(m)) <= math.ceil(h) + 1 for e, m, h in zip(exact.ravel(), mid[:60].ravel(), half[:60].ravel(), strict=True))
    got, open_ = C.nearest(x, c)
    assert (got[:60] == np.array([min(range(len(c)), key=lambda j: (r[j], j)) for r in exact])).all()
    assert open_ < len(x) or size == 1  # most rows are settled by the intervals alone


def test_clusters_of_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert sorted((tuple(r) for r in C.clusters(df)[0].collect()), key=str) == brute_clusters(rows)
