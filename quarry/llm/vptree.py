"""Approximate nearest neighbours: a stored index of vantage-point trees, one a shard, with relaxed triangle-inequality pruning.

Building. Vectors are dealt to the nearest of up to PIVOTS pivots (a sample of that size, the vectors whose ids hash least; it only
decides who lies with whom), and a pivot's vectors by hash into shards of about SHARD rows, so that a pivot that half of all
vectors are nearest to is as many shards as it needs. Each shard becomes one vantage-point tree in a file of the shared folder:
a node is a vantage point with the least and greatest distance of either half of its vectors to it, halves are split at the
median, leaves are pages of LEAF vectors. The manifest has a row a file; every vector is in one file.

Equal vectors. Of equal vectors only the k + 1 smallest ids can be among k nearest without the query's own row, so only those
are indexed; this loses nothing and keeps a vector that a third of all rows share from filling shards. The cut is a ranked
window, which Spark applies before it shuffles.

Searching takes two passes, each a group of at most QUERIES queries at a shard's tree, opened once for all of them. In the
first, a query is asked at one shard of its nearest pivot, which gives a bound b on its k-th distance. In the second it goes to the
shards whose ball it can't rule out: distance to the pivot less the shards' radius, times `factor`, at most b. Within a tree
the same rule holds for either half of a node: a lower bound on its distances, from the triangle inequality, times `factor`,
must not exceed the best k-th distance so far. With factor 1 nothing that could be nearer is passed over and the search is
exact; with more it prunes what is unlikely to be. Distances to candidates are exact in double precision: a matrix product
with a margin for its rounding picks those that can matter, and their differences are squared and summed in order.

The driver holds the pivots and a radius for each; nothing of the vectors is collected or broadcast. Files are written whole and
then moved into place, so a task that runs again leaves one.

Defined cases: vectors null, empty, all zero, or holding null or non-finite components take no part, as rows or as queries, nor
do rows with null vec_id; a query sees only vectors of its own length; repeated vec_ids count once (the least vector); ties go
to the smaller vec_id; fewer candidates than k give all; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import io
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, ship, stored
from .files import read_file, write_file

SHARD, PIVOTS, LEAF, QUERIES = 8192, 1024, 64, 2048
FOUND = "query_id long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
ROUTED = "pivot int, shard int, block int, query_id long, v array<double>, bound double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of a to the same row of b, squares summed in the order of the components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(total)


class Tree:
    """A vantage-point tree: rows in the order of its leaves, and for each node its rows, vantage point, halves and their rings."""

    def __init__(self, ids, points, span, vantage, kids, rings):
        self.ids, self.points, self.span, self.vantage, self.kids, self.rings = ids, points, span, vantage, kids, rings

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, seed: int = 5) -> Tree:
        rng, order = np.random.default_rng(seed), np.argsort(ids, kind="stable")
        span, vantage, kids, rings, todo = [], [], [], [], [(0, len(ids), -1, 0)]
        while todo:
            low, high, parent, side = todo.pop()
            me = len(span)
            if parent >= 0:
                kids[parent][side] = me
            span.append((low, high))
            kids.append([-1, -1])
            vantage.append(-1)
            rings.append((0.0, 0.0, 0.0, 0.0))
            if high - low <= LEAF:
                continue
            rows = order[low:high]
            tried = rows[rng.choice(len(rows), min(5, len(rows)), replace=False)]
            some = points[rows[rng.choice(len(rows), min(64, len(rows)), replace=False)]]
            at = max(tried.tolist(), key=lambda t: float(np.std(np.sqrt(((some - points[t]) ** 2).sum(axis=1)))))
            away = np.sqrt(((points[rows] - points[at]) ** 2).sum(axis=1))
            by, mid = np.argsort(away, kind="stable"), (high - low) // 2
            order[low:high], away = rows[by], away[by]
            vantage[me], rings[me] = at, (away[0], away[mid - 1], away[mid], away[-1])
            todo += [(low, low + mid, me, 0), (low + mid, high, me, 1)]
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        vantage = np.array([where[v] if v >= 0 else -1 for v in vantage], np.int64)
        return cls(ids[order], points[order], np.array(span, np.int64), vantage, np.array(kids, np.int64), np.array(rings))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        small = self.points.astype(np.float32)
        points = small if np.array_equal(small.astype(np.float64), self.points) else self.points  # stored as float where that loses nothing
        np.savez(out, ids=self.ids, points=points, span=self.span, vantage=self.vantage, kids=self.kids, rings=self.rings)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data), allow_pickle=False) as f:
            return cls(f["ids"], f["points"].astype(np.float64), f["span"], f["vantage"], f["kids"], f["rings"])

    def search(self, asked: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, int]:
        """(distances, ids) of the k nearest of each query, its own id apart, no further than its bound; and how many distances were looked at."""
        n, looked = len(asked), 0
        best, who = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        limit = bound.astype(np.float64).copy()
        norms, size = (self.points**2).sum(axis=1), (asked**2).sum(axis=1)
        top = float(norms.max(initial=0.0)) + float(size.max(initial=0.0))
        margin = 1e-12 * (1 + top) * max(8, asked.shape[1])
        slack = 1e-9 * (1 + np.sqrt(top)) if np.isfinite(top) else np.inf

        def scan(node: int, rows: np.ndarray) -> None:
            nonlocal looked
            low, high = self.span[node]
            looked += len(rows) * int(high - low)
            if np.isfinite(top):
                near = size[rows][:, None] + norms[low:high] - 2 * asked[rows] @ self.points[low:high].T <= (limit[rows] ** 2 + margin + slack * limit[rows])[:, None]
            else:
                near = np.ones((len(rows), high - low), bool)
            a, b = np.nonzero(near & (self.ids[low:high] != own[rows][:, None]))
            if not len(a):
                return
            d = distances(asked[rows[a]], self.points[low + b])
            use = d <= limit[rows[a]]
            a, b, d = a[use], b[use], d[use]
            hit, place = np.unique(a, return_inverse=True)
            if not len(hit):
                return
            to = rows[hit]
            far, ids = np.full((len(hit), high - low), np.inf), np.full((len(hit), high - low), np.iinfo(np.int64).max)
            far[place, b], ids[place, b] = d, self.ids[low + b]
            far, ids = np.concatenate([best[to], far], axis=1), np.concatenate([who[to], ids], axis=1)
            first = np.lexsort((ids, far), axis=-1)[:, :k]
            best[to], who[to] = np.take_along_axis(far, first, axis=1), np.take_along_axis(ids, first, axis=1)
            limit[to] = np.minimum(limit[to], best[to, -1])

        def to_vantage(node: int, rows: np.ndarray) -> np.ndarray:
            return np.sqrt(((asked[rows] - self.points[self.vantage[node]]) ** 2).sum(axis=1))

        home, todo = np.zeros(n, np.int64), [(0, np.arange(n))]
        while todo:  # down to one leaf each, for a first bound
            node, rows = todo.pop()
            if self.vantage[node] < 0:
                home[rows] = node
                scan(node, rows)
                continue
            left = to_vantage(node, rows) <= (self.rings[node, 1] + self.rings[node, 2]) / 2
            todo += [(int(self.kids[node, side]), part) for side, part in ((0, rows[left]), (1, rows[~left])) if len(part)]
        todo = [(0, np.arange(n), np.zeros(n))]
        while todo:  # each node once, with the queries that can't pass it over
            node, rows, low = todo.pop()
            use = low * factor <= limit[rows] + slack
            rows, low = rows[use], low[use]
            if self.vantage[node] < 0:
                rows = rows[home[rows] != node]
                if len(rows):
                    scan(node, rows)
                continue
            if not len(rows):
                continue
            d = to_vantage(node, rows)
            for side in (1, 0):
                least, most = self.rings[node, 2 * side], self.rings[node, 2 * side + 1]
                todo.append((int(self.kids[node, side]), rows, np.maximum(low, np.maximum(least - d, d - most))))
        return best, who, looked


@dataclass
class Index:
    """A stored index: its manifest (pivot, shard, uri, n, radius), the pivots, and for each pivot its shards and radius."""

    manifest: DataFrame
    pivots: dict[int, tuple[np.ndarray, np.ndarray]]  # length of the vectors -> (numbers, points)
    shards: dict[int, int]
    radius: dict[int, float]
    k: int
    folder: str


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part, each vec_id once."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(~bad).where(F.exists("embedding", lambda x: x != 0))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch):
    """(row numbers, matrix) of a batch's vectors by their length."""
    sizes = np.diff(batch.column("v").offsets.to_numpy()) if batch.num_rows else np.empty(0, int)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, _matrix(batch.column("v").take(pa.array(rows)), dim)


def _dealt(pivots):
    """Adds each vector's nearest pivot (-1 where none has its length) and its distance to it."""

    def run(batches):
        for batch in batches:
            to, away = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for dim, rows, x in _by_length(batch):
                if dim in pivots:
                    numbers, points = pivots[dim]
                    near = ((x**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * x @ points.T).argmin(axis=1)
                    to[rows], away[rows] = numbers[near], np.sqrt(((x - points[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(to), pa.array(away)], ["vec_id", "v", "pivot", "away"])

    return run


def _file(folder: str, pivot: int, shard: int, dim: int) -> str:
    return f"{folder}/{pivot}-{shard}-{dim}.npz"


def _plant(folder: str):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        pivot, shard, dim = (x.as_py() for x in key)
        uri = _file(folder, pivot, shard, dim)
        tree = Tree.build(rows["vec_id"].to_numpy(), _matrix(rows["v"], dim))
        write_file(f"{uri}.{uuid.uuid4().hex}", tree.dumps(), uri)
        radius = max(rows["away"].to_numpy(), default=0.0)
        return pa.table({"pivot": pa.array([pivot], pa.int32()), "shard": pa.array([shard], pa.int32()), "dim": pa.array([dim], pa.int32()), "uri": [uri], "n": pa.array([rows.num_rows], pa.int64()), "radius": [float(radius)]})

    return run


def _shards_of(counts: dict[int, int], size: int) -> dict[int, int]:
    return {p: max(1, -(-n // size)) for p, n in counts.items()}


def build(rows: DataFrame, k: int = 10, shard_rows: int = SHARD, most_pivots: int = PIVOTS) -> Index:
    """Indexes vectors() for searches of up to k neighbours."""
    spark = rows.sparkSession
    ship(spark)
    total = rows.count()
    n = min(most_pivots, -(-total // shard_rows))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("v").collect()
    by: dict[int, list] = {}
    for i, r in enumerate(sample):
        by.setdefault(len(r.v), []).append((i, r.v))
    pivots = {dim: (np.array([i for i, _ in x], np.int32), np.array([v for _, v in x])) for dim, x in by.items()}
    same = Window.partitionBy("v").orderBy("vec_id")
    once = rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n")
    dealt = stored(once.mapInArrow(_dealt(pivots), "vec_id long, v array<double>, pivot int, away double"), "dealt")
    shards = _shards_of({r["pivot"]: r["n"] for r in dealt.groupBy("pivot").agg(F.count("*").alias("n")).collect()}, shard_rows)  # a row a pivot
    parts = F.element_at(F.create_map(*(F.lit(x) for pair in shards.items() for x in pair)), F.col("pivot")) if shards else F.lit(1)
    folder = fresh_path(spark, "trees")
    keyed = dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).withColumn("dim", F.size("v"))
    manifest = stored(keyed.groupBy("pivot", "shard", "dim").applyInArrow(_plant(folder), "pivot int, shard int, dim int, uri string, n long, radius double"), "manifest")
    radius = {r["pivot"]: r["radius"] for r in manifest.groupBy("pivot").agg(F.max("radius").alias("radius")).collect()}
    return Index(manifest, pivots, shards, radius, k, folder)


def _route(index_pivots, shards, radius, factor, first: bool, blocks: int):
    """Where queries go: first to one shard of the nearest pivot, then to all others whose ball isn't ruled out."""

    def home(query_id: int, parts: int) -> int:
        return query_id * 2654435761 % parts

    def run(batches):
        for batch in batches:
            ids, bounds = batch.column("query_id").to_pylist(), None if first else batch.column("bound").to_numpy(zero_copy_only=False)
            out: list[tuple[int, int, int, int]] = []  # pivot, shard, block, row
            for dim, rows, x in _by_length(batch):
                numbers, points = index_pivots.get(dim, (np.empty(0, np.int32), np.empty((0, dim))))
                away = np.sqrt(np.maximum(0.0, (x**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * x @ points.T))
                homes = numbers[away.argmin(axis=1)] if len(numbers) else np.full(len(rows), -1)
                mine = [(int(p), home(ids[r], shards.get(int(p), 1))) for p, r in zip(homes, rows.tolist(), strict=True)]
                if first:
                    out += [(*m, ids[r] // 7 % blocks, r) for m, r in zip(mine, rows.tolist(), strict=True)]
                    continue
                if len(numbers):  # a pivot without rows has no ball
                    balls = np.array([radius.get(int(p), -np.inf) for p in numbers])
                    at, to = np.nonzero((away - balls) * factor <= bounds[rows][:, None] + 1e-6 * (1 + away))
                    pairs = zip(at.tolist(), numbers[to].tolist(), strict=True)
                else:
                    pairs = ((i, -1) for i in range(len(rows)))
                out += [(p, s, ids[rows[i]] // 7 % blocks, int(rows[i])) for i, p in pairs for s in range(shards.get(p, 0)) if (p, s) != mine[i]]
            for low in range(0, len(out), QUERIES):
                part = out[low : low + QUERIES]
                rows = pa.array([o[3] for o in part], pa.int64())
                bound = pa.array(np.full(len(part), np.inf)) if first else batch.column("bound").take(rows)
                columns = [*(pa.array([o[c] for o in part], pa.int32()) for c in range(3)), batch.column("query_id").take(rows), batch.column("v").take(rows), bound]
                yield pa.RecordBatch.from_arrays(columns, ["pivot", "shard", "block", "query_id", "v", "bound"])

    return run


def _ask(folder: str, k: int, factor: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        pivot, shard, dim = key[0].as_py(), key[1].as_py(), key[3].as_py()
        try:
            tree = Tree.loads(read_file(_file(folder, pivot, shard, dim)))
        except FileNotFoundError:  # a pivot's shard without a vector of this length
            return _FOUND.empty_table()
        own = rows["query_id"].to_numpy()
        far, ids, _ = tree.search(_matrix(rows["v"], dim), own, rows["bound"].to_numpy(), k, factor)
        use = np.isfinite(far)
        return pa.table([pa.array(np.repeat(own, use.sum(axis=1))), pa.array(ids[use]), pa.array(far[use])], schema=_FOUND)

    return run


def search(index: Index, queries: DataFrame, k: int = 10, factor: float = 1.0) -> DataFrame:
    """queries (query_id, v) -> (query_id, rank, vec_id, score): the k nearest found, a query's own vec_id apart."""
    if k > index.k:
        raise ValueError(f"the index holds what searches of up to {index.k} neighbours need")
    if factor < 1:
        raise ValueError("the factor is 1 (exact) or more")
    spark = queries.sparkSession
    ship(spark)
    asked = queries.select("query_id", "v")
    blocks = max(1, -(-asked.count() // QUERIES))
    keys = ["pivot", "shard", "block", "dim"]

    def passed(df: DataFrame, first: bool) -> DataFrame:
        route = _route(index.pivots, index.shards, index.radius, factor, first, blocks)
        return df.mapInArrow(route, ROUTED).withColumn("dim", F.size("v")).groupBy(*keys).applyInArrow(_ask(index.folder, k, factor), FOUND)

    one = stored(passed(asked, True), "first")
    bounds = one.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("top")).select("query_id", F.when(F.col("n") >= k, F.col("top")).alias("bound"))
    two = passed(asked.join(bounds, "query_id", "left").fillna(float("inf"), ["bound"]), False)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = one.unionByName(two).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(embeddings: DataFrame, k: int = 10, every: int = 100, factor: float = 4.0, shard_rows: int = SHARD, most_pivots: int = PIVOTS) -> DataFrame:
    """embeddings -> (query_id, rank, vec_id, score) for rows whose vec_id is divisible by `every`, against all others."""
    ship(embeddings.sparkSession)
    rows = stored(vectors(embeddings), "vectors")
    index = build(rows, k, shard_rows, most_pivots)
    return search(index, rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"), k, factor)
