"""A stored inverted-file index of vectors with residual codes: cosine neighbours from the lists that a query probes.

Building. Centroids come from Spark ML's k-means on a sample of at most SAMPLE vectors (those whose ids hash least); every vector goes
to the list of its nearest centroid. What is kept of it for the scan is its residual, the unit vector less the centroid, in
one signed byte a component, by a step of its list (the list's largest component / 127). The lists are written range-partitioned
by (list, rid), a folder a list, so a search reads the folders it probes and nothing else, and a list that a third of all
vectors are in is many tasks and files. How many lists a search probes is measured at building: the fewest that find `recall` of the
neighbours of some sample vectors within the sample.

Searching. Codes of the probed lists are scanned (no vector is read), the best few by code are read as vectors by their rids and
ranked by exact distance. `exact=True` goes on: the k-th distance so found is a bound; all lists whose ball may reach below it are
scanned, rows whose code, less its largest error, stays above it are dropped, and the rest is ranked exactly. That gives what
the scan of all vectors gives.

What the driver holds: sample, centroids, steps and radii (at most SAMPLE and LISTS vectors), and a search's candidates (at most
MOST_READ rids). Null, empty, zero and non-finite vectors, and vectors of a length other than the sample's commonest, are not indexed.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import cosine_distance

SAMPLE, LISTS, MOST_READ = 1 << 14, 1024, 1000


def usable(embeddings: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """(rid, embedding, unit) of vectors that have a direction."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = embeddings.where(F.col(id_column).isNotNull() & (F.size("embedding") > 0)).where(~bad).select(F.col(id_column).alias("rid"), "embedding")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.withColumn("_length", length).where("_length > 0").withColumn("unit", F.transform("embedding", lambda x: x.cast("double") / F.col("_length"))).drop("_length")


def _least(rows: DataFrame, most: int) -> DataFrame:
    """The rows whose ids hash least: only those under a bound that about so many are under are sorted, as each task sends its least rows to the driver."""
    hashed, total = F.xxhash64("rid"), rows.count()
    if total > 2 * most:
        some = rows.where(hashed <= F.lit(int(2**64 * (1.1 * most + 100) / total) - 2**63))
        rows = some if some.count() >= most else rows
    return rows.orderBy(hashed, "rid").limit(most)


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 64) -> int:
    """The fewest probed lists that find so many of the neighbours of some sample vectors."""
    to = (sample @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
    some = sample[:: max(1, len(sample) // asked)][:asked]
    near = np.argsort(-(some @ sample.T), axis=1, kind="stable")[:, : k + 1]
    place = np.empty((len(some), len(centres)), np.int64)
    np.put_along_axis(place, np.argsort(-(some @ centres.T - (centres**2).sum(axis=1) / 2), axis=1), np.arange(len(centres))[None], axis=1)
    needed = np.sort(np.take_along_axis(place, to[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


def build(embeddings: DataFrame, path: str, id_column: str = "vec_id", k: int = 100, recall: float = 0.95, lists: int | None = None, sample_rows: int = SAMPLE) -> VectorIndex:
    """Writes the index of all usable vectors to path (a new folder) and opens it."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = embeddings.sparkSession
    rows = usable(embeddings, id_column)
    sample = _least(rows, sample_rows).select("rid", "unit")
    taken = [r.unit for r in sample.collect()]
    sizes = sorted({len(u) for u in taken}, key=lambda n: (-sum(len(u) == n for u in taken), n))
    dim = sizes[0] if sizes else 0
    points = np.array([u for u in taken if len(u) == dim], float).reshape(sum(len(u) == dim for u in taken), dim)
    rows = rows.where(F.size("unit") == dim)
    n = rows.count() if len(points) else 0
    lists = max(1, min(lists or round(math.sqrt(n)), LISTS, len(points)))
    if len(points) > lists > 1:
        train = spark.createDataFrame([(u.tolist(),) for u in points], "unit array<double>").select(array_to_vector("unit").alias("features"))
        model = KMeans(k=lists, seed=7, maxIter=8, initSteps=2).fit(train)
        centres = np.array(model.clusterCenters())
        listed = model.transform(rows.withColumn("features", array_to_vector("unit"))).withColumnRenamed("prediction", "list").drop("features")
    else:
        centres = points.mean(axis=0, keepdims=True) if len(points) else np.zeros((1, dim))
        listed = rows.withColumn("list", F.lit(0))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")  # at most LISTS rows
    residual = listed.join(F.broadcast(table), "list").withColumn("r", F.zip_with("unit", "centre", lambda a, b: a - b)).drop("centre", "unit")
    widest = F.max(F.array_max(F.transform("r", lambda x: F.abs(x))))
    ball = F.max(F.sqrt(F.aggregate("r", F.lit(0.0), lambda a, x: a + x * x)))
    of = {r["list"]: r for r in residual.groupBy("list").agg(widest.alias("widest"), ball.alias("ball"), F.count("*").alias("n")).collect()}  # a row a list
    steps = [(of[i]["widest"] / 127 if i in of else 0.0) or 1e-12 for i in range(len(centres))]
    step = spark.createDataFrame(list(enumerate(steps)), "list int, step double")
    coded = residual.join(F.broadcast(step), "list").select("list", "rid", F.transform("r", lambda x: F.round(x / F.col("step")).cast("tinyint")).alias("code"), "embedding")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded.repartitionByRange(parts, "list", "rid").sortWithinPartitions("list", "rid").write.partitionBy("list").parquet(f"{path}/lists")
    meta = {
        "dim": dim, "n": n, "k": k, "centres": centres.tolist(), "steps": steps, "radius": [of[i]["ball"] if i in of else -1.0 for i in range(len(centres))],
        "sizes": [of[i]["n"] if i in of else 0 for i in range(len(centres))], "probes": _probes(points, centres, min(k, max(1, len(points) - 1)), recall) if len(points) else 1}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.parquet(f"{path}/meta")
    return VectorIndex.open(spark, path)


@dataclass
class VectorIndex:
    """An index in a folder; search() reads the lists it probes."""

    spark: SparkSession
    path: str
    meta: dict

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark, path, json.loads(spark.read.schema("meta string").parquet(f"{path}/meta").first().meta))

    def _unit(self, query: list[float]) -> np.ndarray:
        q = np.array(query, float)
        if len(q) != self.meta["dim"] or not np.isfinite(q).all() or not q.any():
            raise ValueError(f"a query is a vector of {self.meta['dim']} finite components, not all zero")
        return q / np.linalg.norm(q)

    def nearest_lists(self, query: list[float]) -> list[int]:
        """All lists, that of the nearest centroid first; lists without vectors are left out."""
        q, c = self._unit(query), np.array(self.meta["centres"])
        order = np.argsort(((c - q) ** 2).sum(axis=1), kind="stable")
        return [int(i) for i in order if self.meta["sizes"][i]]

    def rows(self, lists: list[int]) -> DataFrame:
        """The rows of some lists: a filter on folders."""
        schema = "rid long, code array<tinyint>, embedding array<float>, list int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/lists").where(F.col("list").isin(lists))

    def by_code(self, lists: list[int], query: list[float]) -> Column:
        """Cosine distance by the code: each list's own part is a constant."""
        q = self._unit(query)
        unit = F.array(*(F.lit(float(x)) for x in q))
        own = {i: (float(q @ np.array(self.meta["centres"][i])), self.meta["steps"][i]) for i in lists}
        part = lambda at: F.element_at(F.create_map(*(F.lit(x) for i in lists for x in (i, own[i][at]))), F.col("list"))
        dot = F.aggregate(F.zip_with("code", unit, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return 1 - part(0) - part(1) * dot

    def candidates(self, lists: list[int], query: list[float], most: int, allowed: DataFrame | None = None) -> DataFrame:
        """(rid, approximate): the best of some lists by code."""
        rows = self.rows(lists).select("rid", self.by_code(lists, query).alias("approximate"))
        rows = rows.join(allowed.select("rid"), "rid", "left_semi") if allowed is not None else rows
        return rows.orderBy("approximate", "rid").limit(most)

    def search(self, query: list[float], k: int = 100, floor: float | None = None, probes: int | None = None, exact: bool = False, allowed: DataFrame | None = None) -> DataFrame:
        """(rid, distance) of the k nearest found, ties by rid, as vector.knn gives; allowed (rid): nothing else is a candidate."""
        lists = self.nearest_lists(query)
        if not lists:
            return self.spark.createDataFrame([], "rid long, distance double")
        probed = lists[: probes or self.meta["probes"]]
        found = [r.rid for r in self.candidates(probed, query, min(MOST_READ, max(4 * k, 200)), allowed).collect()]
        distance = F.round(cosine_distance("embedding", query), 6).alias("distance")
        rows = self.rows(probed).where(F.col("rid").isin(found)).select("rid", distance)
        if exact:
            some = rows.orderBy("distance", "rid").limit(k).agg(F.count("*").alias("n"), F.max("distance").alias("far")).first()
            far = some.far + 2e-6 if some.n == k else 3.0
            far = min(far, floor + 2e-6) if floor is not None else far
            away = np.sqrt(((np.array(self.meta["centres"]) - self._unit(query)) ** 2).sum(axis=1))
            reach = [i for i in lists if max(0.0, away[i] - self.meta["radius"][i] - 1e-9) ** 2 / 2 <= far]
            error = F.element_at(F.create_map(*(F.lit(x) for i in reach for x in (i, 0.5 * self.meta["steps"][i] * math.sqrt(self.meta["dim"]) + 1e-9))), F.col("list")) if reach else None
            rows = self.rows(reach).where(self.by_code(reach, query) - error <= far) if reach else self.rows(probed).where("false")
            rows = (rows.join(allowed.select("rid"), "rid", "left_semi") if allowed is not None else rows).select("rid", distance)
        rows = rows.where(F.col("distance") <= floor) if floor is not None else rows
        return rows.orderBy("distance", "rid").limit(k)
