"""Bitmaps of facets against the rows."""

import random

from pyspark.sql import functions as F

from quarry.operators import facets, search, segments, visibility

SCHEMA = "rid long, exposure int, facets map<string,array<string>>"


def docs(spark, n=300, seed=2):
    rng = random.Random(seed)
    rows = [(0, 3, {"a": ["x"]}), (-7, 3, {"a": ["x"]}), (-40_000, 3, {"a": ["y"]}), (32_768, 3, {"a": ["x", "x"]}), (32_769, 3, {"a": ["x"], "b": ["1"]}), (5_000_000_000, 3, {"b": ["2", None]}), (9, 3, None), (10, 3, {}), (11, 0, {"a": ["x"]})]
    rows += [(100 + i * 97, rng.choice([0, 1, 2, 3]), {k: [rng.choice("xyz") for _ in range(rng.randint(0, 3))] for k in rng.sample(["a", "b", "c", "lang"], rng.randint(0, 4))}) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_filters(spark):
    df = docs(spark)
    index = facets.build(df)
    for wanted in ({"a": ["x"]}, {"a": ["x", "y"], "b": ["z", "1"]}, {"a": ["x"], "none": ["x"]}, {"c": []}, {"a": ["x"], "b": ["x"], "c": ["x", "y", "z"]}):
        want = {r.rid for r in search.facet_filter(df, wanted).collect()}
        found = facets.matching(index, wanted)
        assert {r.rid for r in facets.rids(found).collect()} == want
        assert {r.rid for r in facets.within(df, found).collect()} == want


def test_counts(spark):
    df = docs(spark)
    some = df.where("exposure > 1 and rid % 2 = 0")
    key = lambda r: (r.key, r.value, r["count"])
    want = {key(r) for r in search.facet_counts(some, ["a", "b", "none"], 2).collect()}
    assert {key(r) for r in facets.counts(facets.build(df), some, ["a", "b", "none"], 2).collect()} == want
    assert facets.counts(facets.build(df), df.where("false"), ["a"]).count() == 0


def test_bitmap_rows(spark):
    """A value that all documents have is a row for each bucket, and a bitmap gives back its rids."""
    df = spark.range(100_000).select(F.col("id").alias("rid"), F.lit(3).alias("exposure"), F.create_map(F.lit("k"), F.array(F.lit("v"))).alias("facets"))
    index = facets.build(df)
    assert index.count() <= 5
    assert facets.rids(index).count() == 100_000 == facets.rids(index).distinct().count()
    rows = spark.createDataFrame([(i,) for i in (0, 1, 7, 8, 32_767, 32_768, 32_769, 65_536, 65_537, -1, -32_768, -50_000)], "rid long")
    assert sorted(r.rid for r in facets.rids(segments.bitmaps(rows)).collect()) == sorted(r.rid for r in rows.collect())


def test_first_number(spark):
    df = spark.createDataFrame([(1, 3, {"n": ["b", "10", "9", "9.5"]}), (2, 3, {"n": ["-1", "1e5", "1."]}), (3, 3, {"n": ["007"]}), (4, 3, None), (5, 3, {"m": ["1"]})], SCHEMA)
    assert {(r.rid, r.key, r.number) for r in facets.numbers(df, ["n", "m"]).collect()} == {(1, "n", 10.0), (3, "n", 7.0), (5, "m", 1.0)}
    assert visibility.facet_pairs(df).where("key = 'n'").count() == 8
