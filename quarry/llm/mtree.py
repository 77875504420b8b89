"""Exact top-k by inner product with M-trees and best-first search.

Inner products become a metric by one more coordinate: with M the largest norm, x gets sqrt(M^2 - |x|^2) and a query 0, so
|q - x|^2 = |q|^2 + M^2 - 2 q.x and the nearest are those of the highest product. A shard's tree has paged nodes: each knows
its centre, the radius that covers all below it and its distance to its parent's centre. The search takes the node with the
least possible distance first. A child or entry is passed over, before its distance is computed, where
|d(q, parent) - d(child, parent)| - radius already exceeds the k-th best distance. Scores themselves are integers.

Above the trees lie routing balls: rows go to the nearest of up to PIVOTS pivots (a sample by hash; it only decides who lies with
whom), and a pivot's rows by hash into shards of about SHARD, each one tree in a file of the shared folder, written once. A query is
asked at one shard of its nearest pivot first; its k-th score there is a bound, and the second pass goes only to shards of pivots
whose ball can hold a better one. A group of at most QUERIES queries opens a tree once, and a node once for all of them: first each
goes down to its nearest page for a bound, then nodes are taken best-first. The k best per query are merged by a
window over the query. Of equal vectors the k + 1 smallest ids are kept, as no other can be among k. The driver holds pivots and radii.

Defined cases: components are floor(256 * x) of the value as double; vectors that are null, empty, or hold null or
non-finite components take no part, as rows or as queries, nor do rows with null vec_id; a query sees only vectors of its
own length; repeated vec_ids count once (the least vector); extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, ship, stored
from .files import read_file, write_file
from .vptree import PIVOTS, ROUTED, SHARD, _dealt, _file, _matrix, _route, _shards_of

PAGE, FANOUT, QUERIES = 64, 12, 256
NONE = -np.iinfo(np.int64).max
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Node:
    __slots__ = ("centre", "radius", "to_parent", "kids", "rows", "row_to_centre", "kid_centres", "kid_radii", "kid_to")

    def __init__(self, centre):
        self.centre, self.radius, self.to_parent, self.kids, self.rows = centre, 0.0, 0.0, None, None


class MTree:
    """Bulk-loaded: pivots spread over the rows, rows to the nearest pivot, again until a page holds them."""

    def __init__(self, points: np.ndarray, seed: int = 5, top: float | None = None):
        self.ints = points
        norm = (points.astype(np.float64) ** 2).sum(axis=1)
        self.top = top if top is not None else float(norm.max()) if len(points) else 0.0
        self.points = np.column_stack([points, np.sqrt(np.maximum(0.0, self.top - norm))]).astype(np.float64)
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)), self.points.mean(axis=0)) if len(points) else None

    def _build(self, rows: np.ndarray, centre: np.ndarray) -> Node:
        node = Node(centre)
        away = np.sqrt(((self.points[rows] - centre) ** 2).sum(axis=1))
        node.radius = float(away.max())
        if len(rows) <= PAGE:
            node.rows, node.row_to_centre = rows, away
            return node
        pivots = self.points[self.rng.choice(rows, min(FANOUT, len(rows)), replace=False)]
        for _ in range(3):
            to = (self.points[rows] ** 2).sum(axis=1)[:, None] - 2 * self.points[rows] @ pivots.T + (pivots**2).sum(axis=1)
            near = to.argmin(axis=1)
            pivots = np.array([self.points[rows[near == i]].mean(axis=0) if (near == i).any() else pivots[i] for i in range(len(pivots))])
        groups = [rows[near == i] for i in range(len(pivots)) if (near == i).any()]
        if len(groups) == 1:  # equal vectors: pages in order
            groups = [rows[i : i + PAGE] for i in range(0, len(rows), PAGE)]
            if len(groups) > FANOUT:
                step = -(-len(groups) // FANOUT)
                groups = [np.concatenate(groups[i : i + step]) for i in range(0, len(groups), step)]
        node.kids = [self._build(g, self.points[g].mean(axis=0)) for g in groups]
        node.kid_centres = np.array([k.centre for k in node.kids])
        node.kid_radii = np.array([k.radius for k in node.kids])
        node.kid_to = np.sqrt(((node.kid_centres - centre) ** 2).sum(axis=1))
        for k, d in zip(node.kids, node.kid_to, strict=True):
            k.to_parent = float(d)
        return node

    def search(self, asked: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best rows of each query no further than its reach, its own id apart, ties to the smaller id; NONE where there are fewer.

        A node is opened for all queries that can't pass it over, and its distances and scores are one matrix product. Float products are
        exact while the norms say that no sum can leave the integers of a double; beyond that they are taken in 64-bit integers.
        """
        n = len(asked)
        best, who = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
        if self.root is None or not n:
            return best, who
        query = np.column_stack([asked, np.zeros(n)]).astype(np.float64)
        size = (query**2).sum(axis=1)
        base = size + self.top
        slack, wide = 1e-7 * (1 + base), 1e-6 * (1 + np.sqrt(base))  # wide: rounding of distances taken from products
        whole = np.sqrt(self.top * size.max()) < 2.0**52
        far = (np.full(n, np.inf) if reach is None else reach.astype(np.float64)) + wide

        def away(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0.0, size[rows][:, None] + (centres**2).sum(axis=1) - 2 * query[rows] @ centres.T))

        def scan(node: Node, rows: np.ndarray, to: np.ndarray) -> None:
            near = np.abs(to[:, None] - node.row_to_centre) <= far[rows][:, None]
            some, use = near.any(axis=1), near.any(axis=0)
            rows, at = rows[some], node.rows[use]
            score = (query[rows] @ self.points[at].T).astype(np.int64) if whole else asked[rows] @ self.ints[at].T
            hit = (score >= best[rows, -1][:, None]) & (ids[at] != own[rows][:, None])
            some = hit.any(axis=1)
            rows, hit, score = rows[some], hit[some], score[some]
            if not len(rows):
                return
            score, id_ = np.concatenate([best[rows], np.where(hit, score, NONE)], axis=1), np.concatenate([who[rows], np.where(hit, ids[at], np.iinfo(np.int64).max)], axis=1)
            first = np.lexsort((id_, -score), axis=-1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(score, first, axis=1), np.take_along_axis(id_, first, axis=1)
            full = rows[best[rows, -1] != NONE]
            far[full] = np.minimum(far[full], np.sqrt(np.maximum(0.0, base[full] - 2 * best[full, -1].astype(np.float64)) + slack[full]) + wide[full])

        everyone = np.arange(n)
        start = away(everyone, self.root.centre[None])[:, 0]
        home, down = np.zeros(n, np.int64), [(self.root, everyone, start)]
        while down:  # to one page each, for a first bound
            node, rows, to = down.pop()
            if node.rows is not None:
                home[rows] = id(node)
                scan(node, rows, to)
                continue
            d = away(rows, node.kid_centres)
            near = d.argmin(axis=1)
            down += [(node.kids[x], rows[near == x], d[near == x, x]) for x in np.unique(near).tolist()]
        queue, pushed = [(0.0, 0, self.root, everyone, np.maximum(0.0, start - self.root.radius), start)], 0
        while queue:  # the node with the least possible distance of any query first
            _, _, node, rows, low, to = heapq.heappop(queue)
            use = low <= far[rows]
            if node.rows is not None:
                use &= home[rows] != id(node)
            rows, to = rows[use], to[use]
            if not len(rows):
                continue
            if node.rows is not None:
                scan(node, rows, to)
                continue
            can = np.abs(to[:, None] - node.kid_to) - node.kid_radii <= far[rows][:, None]
            kids = np.flatnonzero(can.any(axis=0))
            d = away(rows, node.kid_centres[kids])
            low = np.maximum(0.0, d - node.kid_radii[kids])
            can = can[:, kids] & (low <= far[rows][:, None])
            for x, kid in enumerate(kids.tolist()):
                mine = np.flatnonzero(can[:, x])
                if len(mine):
                    pushed += 1
                    heapq.heappush(queue, (float(low[mine, x].min()), pushed, node.kids[kid], rows[mine], low[mine, x], d[mine, x]))
        return best, who


def _plant(folder: str, top: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        pivot, shard, dim = (x.as_py() for x in key)
        uri = _file(folder, pivot, shard, dim)
        ids = rows["vec_id"].to_numpy()
        tree = MTree(_matrix(rows["v"], dim)[:, :-1].astype(np.int64), top=top)
        write_file(f"{uri}.{uuid.uuid4().hex}", pickle.dumps((ids, tree)), uri)
        return pa.table({"pivot": pa.array([pivot], pa.int32()), "radius": [float(max(rows["away"].to_numpy(), default=0.0))]})

    return run


def _ask(folder: str, k: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        pivot, shard, dim = key[0].as_py(), key[1].as_py(), key[3].as_py()
        try:
            ids, tree = pickle.loads(read_file(_file(folder, pivot, shard, dim)))
        except FileNotFoundError:  # a pivot's shard without a vector of this length
            return FOUND.empty_table()
        own = rows["query_id"].to_numpy()
        score, found = tree.search(_matrix(rows["v"], dim)[:, :-1].astype(np.int64), k, ids, own, rows["bound"].to_numpy())
        use = score != NONE
        return pa.table([pa.array(np.repeat(own, use.sum(axis=1))), pa.array(found[use]), pa.array(score[use])], schema=FOUND)

    return run


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, shard_rows: int | None = None, most_pivots: int = PIVOTS) -> DataFrame:
    """embeddings -> (query_id, rank, vec_id, score) for rows whose vec_id is divisible by `every`, against all others."""
    spark, shard_rows = embeddings.sparkSession, shard_rows or SHARD
    ship(spark)
    whole = F.expr("exists(embedding, x -> x is null or isnan(x) or abs(double(x)) = double('infinity'))")
    good = embeddings.where("vec_id is not null and size(embedding) > 0").where(~whole)
    ints = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, x -> cast(floor(256 * double(x)) as bigint))").alias("i")).groupBy("vec_id").agg(F.min("i").alias("i"))
    ints = stored(ints.withColumn("size", F.expr("aggregate(i, 0D, (a, x) -> a + double(x) * double(x))")), "integers")
    total, top = ints.agg(F.count("*"), F.max("size")).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    point = lambda last: F.concat(F.transform("i", lambda x: x.cast("double")), F.array(last)).alias("v")
    rows = ints.select("vec_id", point(F.sqrt(F.greatest(F.lit(0.0), F.lit(top) - F.col("size")))))
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1).drop("_n")
    by: dict[int, list] = {}
    for i, r in enumerate(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(most_pivots, -(-total // shard_rows))).select("v").collect()):
        by.setdefault(len(r.v), []).append((i, r.v))
    pivots = {dim: (np.array([i for i, _ in x], np.int32), np.array([v for _, v in x])) for dim, x in by.items()}
    dealt = stored(once.mapInArrow(_dealt(pivots), "vec_id long, v array<double>, pivot int, away double"), "dealt")
    shards = _shards_of({r["pivot"]: r["n"] for r in dealt.groupBy("pivot").agg(F.count("*").alias("n")).collect()}, shard_rows)  # a row a pivot
    folder = fresh_path(spark, "mtrees")
    parts = F.element_at(F.create_map(*(F.lit(x) for pair in shards.items() for x in pair)), F.col("pivot"))
    keyed = dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).withColumn("dim", F.size("v"))
    planted = stored(keyed.groupBy("pivot", "shard", "dim").applyInArrow(_plant(folder, float(top)), "pivot int, radius double"), "planted")
    radius = {r["pivot"]: r["radius"] for r in planted.groupBy("pivot").agg(F.max("radius").alias("radius")).collect()}
    asked = ints.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), point(F.lit(0.0)), (F.col("size") + F.lit(top)).alias("base"))
    blocks = max(1, -(-asked.count() // QUERIES))

    def passed(df: DataFrame, first: bool) -> DataFrame:
        route = _route(pivots, shards, radius, 1.0, first, blocks)
        return df.mapInArrow(route, ROUTED).withColumn("dim", F.size("v")).groupBy("pivot", "shard", "block", "dim").applyInArrow(_ask(folder, k), "query_id long, vec_id long, score long")

    one = stored(passed(asked.select("query_id", "v"), True), "first")
    worst = one.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") >= k).select("query_id", "worst")
    bound = F.sqrt(F.greatest(F.lit(0.0), F.col("base") - 2 * F.col("worst").cast("double")) + 1e-7 * (1 + F.col("base")))
    bounded = asked.join(worst, "query_id", "left").select("query_id", "v", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.unionByName(passed(bounded, False)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
     e AS (SELECT vec_id, unnest(v) AS c, generate_subscripts(v, 1) AS i, len(v) AS n FROM v),
     s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(sum(q.c * r.c) AS BIGINT) AS score
           FROM e q JOIN e r ON q.i = r.i AND q.n = r.n AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
