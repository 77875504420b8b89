"""Centroid clustering on exact integers, screened in float32 with rigorous rounding-error intervals.

A component x counts as the integer floor(scale * x). Centroids start as the vectors whose ids hash least; every round assigns
each vector to its nearest centroid and moves each centroid to the exact floor of its vectors' mean.

What compares centroids of one vector is |c|^2 - 2 x.c. A float32 matrix product gives x.c for a whole batch, in whatever
order the machine sums; with u = 2^-24 its error, that of the conversion to float32 with it, is at most
((1 + u)^(dim + 2) - 1) * |x| * |c|, so each value lies in a known interval. A centroid whose interval begins behind the end of
another's can't be nearest. Where one is left, it is nearest; where several intervals overlap, those centroids are computed
again in 64-bit integers, and equal ones go to the smaller number. So the classes are those of exact arithmetic.

Spark holds the vectors, in a table of the shared folder, and reads it once a round. A task adds its vectors up by centroid, so
a round shuffles k * dim numbers a task, whatever the number of vectors in a class; k centroids come to the driver and go
out again with the next round. Nothing else does.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part and aren't in the
result. A component beyond +-131,072 (2^27 as integer, at scale 1024) counts as that, so that every squared distance fits in a
long. Repeated rows all count, each with its own row in the result; rows with null vec_id are assigned and count but don't
start a centroid. Of rows with one vec_id the least vector comes first as a start. Fewer vectors than k: as many centroids.
An empty table gives an empty result. inertia is null where the sum doesn't fit in a long. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

MOST = 1 << 27
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def intervals(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half width of an interval that holds |c|^2 - 2 x.c, for every row of x and every centroid (64-bit integers)."""
    dot = (x.astype(np.float32) @ centres.astype(np.float32).T).astype(np.float64)
    own, other = (np.sqrt((a.astype(np.float64) ** 2).sum(axis=1)) for a in (x, centres))
    square = (centres * centres).sum(axis=1).astype(np.float64)
    n = (x.shape[1] + 2) * 2.0**-24
    size = own[:, None] * other
    return square - 2 * dot, 2 * (n / (1 - n)) * size * (1 + 1e-9) + 2.0**-48 * (square + 2 * size)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of each row's nearest centroid, the smallest of equally near ones; and how many rows needed integers."""
    mid, half = intervals(x, centres)
    near = mid - half <= (mid + half).min(axis=1)[:, None]
    out, open_ = near.argmax(axis=1), np.flatnonzero(near.sum(axis=1) > 1)
    if len(open_):
        exact = (centres * centres).sum(axis=1) - 2 * (x[open_] @ centres.T)
        out[open_] = np.where(near[open_], exact, np.iinfo(np.int64).max).argmin(axis=1)
    return out, len(open_)


def _ints(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(centres: np.ndarray):
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _ints(batch, dim)
                to, _ = nearest(x, centres)
                for c in np.unique(to):
                    total[c] += x[to == c].sum(axis=0)
                n += np.bincount(to, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(some)), pa.int32()), pa.array(total[some].ravel()), pa.array(np.repeat(n[some], dim))], ["cluster", "at", "total", "n"])

    return run


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _ints(batch, centres.shape[1])
                to, _ = nearest(x, centres)
                away = ((x - centres[to]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(to, pa.int32()), pa.array(away)], ["vec_id", "cluster", "distance"])

    return run


def integers(embeddings: DataFrame, dim: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<int>) of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * scale))).cast("int"))
    return embeddings.where((F.size("embedding") == dim) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def starts(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors whose seed and id hash least, in that order."""
    rows = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "vec_id", "v")
    return np.array([r.v for r in rows.orderBy("h", "vec_id", "v").limit(k).collect()], np.int64)


def moved(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centroids after one round; those without vectors stay."""
    sums = vectors.mapInArrow(_sums(centres), "cluster int, at int, total long, n long")
    rows = sums.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
    out = centres.copy()
    for r in rows.collect():  # k * dim numbers
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def clusters(embeddings: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), centroids) after so many rounds."""
    spark = embeddings.sparkSession
    ship(spark)
    vectors = stored(integers(embeddings, dim, scale), "vectors")
    centres = starts(vectors, k, seed)
    if not len(centres):
        return spark.createDataFrame([], OUT), centres
    for _ in range(rounds):
        centres = moved(vectors, centres)
    found = stored(vectors.mapInArrow(_assigned(centres), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # k rows
    fits = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    digest = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centres.tolist()]
    every = range(len(centres))
    return found.select("vec_id", "cluster", "distance", of([fits(sums.get(c, 0)) for c in every]).alias("cluster_inertia"), fits(sum(sums.values())).alias("inertia"), of(digest).alias("centroid_sha256")), centres


def oracle(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:") -> str:
    """The same in SQL: a pair of tables a round."""
    away = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), vec_id) - 1 AS cluster, v FROM k QUALIFY cluster < {k})"]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(cluster, d * {k} + cluster) AS cluster, min(d) AS distance FROM (SELECT k.vec_id, k.v, c.cluster, CAST({away} AS BIGINT) AS d FROM k, c{i} AS c) GROUP BY vec_id)")
        if i < rounds:
            parts.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v "
                f"FROM (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY cluster, place) GROUP BY cluster) AS m USING (cluster))")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN c{rounds} AS c USING (cluster)")
