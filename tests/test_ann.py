"""The stored vector index against the scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ann, vector
from tests.conftest import SF

LARGE = "/root/testdata/sf0.1/embeddings.parquet"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return ann.build(spark.read.parquet(LARGE), str(tmp_path_factory.mktemp("ann") / "i"))


def asked(spark, path=LARGE, every=97):
    return [list(r.embedding) for r in spark.read.parquet(path).where(F.col("vec_id") % every == 5).orderBy("vec_id").collect()]


def test_every_vector_is_in_one_list(spark, index):
    rows = spark.read.parquet(f"{index.path}/lists")
    assert rows.count() == rows.select("rid").distinct().count() == 2000 == sum(index.meta["sizes"])


def test_recall(spark, index):
    """Within the probed lists, over queries that took no part in fixing how many there are."""
    df, hits, total = spark.read.parquet(LARGE), 0, 0
    for q in asked(spark, every=401):
        want = {r.rid for r in vector.knn(df, q, 100).collect()}
        hits, total = hits + len(want & {r.rid for r in index.search(q).collect()}), total + len(want)
    assert hits >= 0.9 * total


def test_exact(spark, index):
    df = spark.read.parquet(LARGE)
    for q in asked(spark, every=701):
        assert index.search(q, 20, exact=True, probes=3).collect() == vector.knn(df, q, 20).collect()
        assert index.search(q, 20, 0.8, exact=True).collect() == vector.knn(df, q, 20, 0.8).collect()


def test_allowed(spark, index):
    df, some = spark.read.parquet(LARGE), spark.range(2000).where("id % 3 = 0").withColumnRenamed("id", "rid")
    q = asked(spark)[0]
    assert index.search(q, 10, exact=True, allowed=some).collect() == vector.knn(df.where("vec_id % 3 = 0"), q, 10).collect()


def test_codes_are_within_their_error(spark, index):
    q = asked(spark)[1]
    lists = index.nearest_lists(q)
    rows = index.rows(lists).select("list", (index.by_code(lists, q) - vector.cosine_distance("embedding", q)).alias("off")).collect()
    assert all(abs(r.off) <= 0.5 * index.meta["steps"][r["list"]] * 8 + 1e-9 for r in rows)


def test_only_probed_lists_are_read(spark, index):
    """The plan has a filter on folders, and the files it names are those of the lists."""
    q = asked(spark)[0]
    probed = index.nearest_lists(q)[:4]
    plan = index.candidates(probed, q, 100)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list#" in plan and "embedding" not in plan.split("ReadSchema:")[1].splitlines()[0]
    assert {r["list"] for r in index.rows(probed).select("list").distinct().collect()} == set(probed)
    tenth = index.rows(probed).count()
    assert tenth == sum(index.meta["sizes"][i] for i in probed) < 2000 / 4


def test_clustered_vectors_need_few_probes(spark, tmp_path):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] * 4 + 0.3 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    index = ann.build(df, str(tmp_path / "i"), k=20)
    assert index.meta["probes"] <= len(index.meta["centres"]) / 5
    got, want = ([{r.rid for r in f(points[i].tolist()).collect()} for i in (5, 77)] for f in (lambda q: index.search(q, 20), lambda q: vector.knn(df, q, 20)))
    assert sum(len(a & b) for a, b in zip(got, want, strict=True)) >= 36


def test_odd_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, list string, code int"  # the last two clash with names inside
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [None, 1.0])] + [(100 + i, [3.0, 3.0]) for i in range(50)]
    index = ann.build(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], schema), str(tmp_path / "a"))
    assert sum(index.meta["sizes"]) == 52
    assert [r.rid for r in index.search([2.0, 2.0], 3, exact=True).collect()] == [100, 101, 102]
    with pytest.raises(ValueError):
        index.search([0.0, 0.0])
    empty = ann.build(spark.createDataFrame([], schema), str(tmp_path / "b"))
    assert empty.meta["n"] == 0
    one = ann.build(spark.createDataFrame([(9, [0.5, 0.5], "x", 1)], schema), str(tmp_path / "c"))
    assert [tuple(r) for r in one.search([1.0, 1.0], exact=True).collect()] == [(9, 0.0)]


def test_small_table(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    index, q = ann.build(df, str(tmp_path / "i")), asked(spark, f"{SF}/embeddings.parquet", 250)[0]
    assert index.search(q, exact=True).collect() == vector.knn(df, q, 100).collect()


def test_the_sample_is_of_least_hashes_and_few_rows_are_sorted_for_it(spark):
    """The bound leaves a little more than is taken, and what is taken is what sorting all would give."""
    rows = spark.range(20000).withColumnRenamed("id", "rid")
    want = [r.rid for r in rows.orderBy(F.xxhash64("rid"), "rid").limit(300).collect()]
    got = ann._least(rows, 300)
    assert [r.rid for r in got.collect()] == want
    assert "xxhash64(" in got._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1]
    assert [r.rid for r in ann._least(rows, 15000).collect()][:300] == want
