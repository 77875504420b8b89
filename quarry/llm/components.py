"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(a, b) edges between ids, null-free -> (id, component) for each id that has an edge; component: the smallest id reachable.

    Each round is written to the shared folder. Nothing is collected: only the row count and an order-free sum of hashes
    come to the driver to see whether a round changed anything. Repeated edges and loops are fine; no edges give no rows.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(clean, name)
    state = None
    for _ in range(most):
        now = stored(_small_star(_large_star(now).where("a <> b").distinct()).where("a <> b").distinct(), name)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == state or not row[0]:
            break
        state = tuple(row)
    else:
        raise RuntimeError(f"components not settled in {most} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
