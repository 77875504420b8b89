"""The index in segments against one built whole."""

import random

import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.operators import index, search, segments
from quarry.schema import Match, Viewer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    queries.docs_of(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def same_as_scan(idx, now, match=Match(("the", "of")), viewer=Viewer("u1", ("g1",), ("e1",))):
    s = idx.open()
    rows = search.search_set(now, match, viewer, profile=queries.FIXED)
    want = search.page(rows, 500).select(*search.ORDER).collect()
    assert s.top(500, match, viewer, profile=queries.FIXED)[0] == want
    assert s.top(5, match, viewer, profile=queries.FIXED)[0] == want[:5]
    weights = search.weights_of(now, Match(("the", "zzz"), any=True))
    assert index.weights_of(s.postings, Match(("the", "zzz"), any=True)) == weights
    return want


def test_batches_equal_a_scan_after_each(spark, docs, tmp_path):
    """Puts, changes, removals and restores; tiers are merged on the way."""
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    idx, rng, now = segments.SegmentedIndex(spark, str(tmp_path / "i")), random.Random(1), None
    state: dict[int, int] = {}  # rid -> which text it has; -1: removed
    for batch in range(6):
        for rid in rng.sample(range(200), 60 if batch < 3 else 12):
            state[rid] = rng.choice([0, 0, 0, 1, 2, -1])
        touched = [(r, v) for r, v in state.items()] if batch == 0 else [(r, state[r]) for r in rng.sample(sorted(state), 25)]
        if batch:  # what a batch doesn't bring stays as the index has it
            for r in state:
                if r not in dict(touched) and r not in applied:
                    touched.append((r, state[r]))
        applied = {**(applied if batch else {}), **dict(touched)}
        rows = spark.createDataFrame(list(applied.items()), "rid long, v int")
        now = docs.join(rows, "rid").withColumn("body", F.when(F.col("v") == 1, F.concat("body", F.lit(" the of the"))).when(F.col("v") == 2, F.lit("nothing here")).otherwise(F.col("body"))).withColumn("exposure", F.when(F.col("v") < 0, 0).otherwise(F.col("exposure"))).drop("v")
        changed = now.join(spark.createDataFrame(touched, "rid long, v int").select("rid"), "rid", "left_semi")
        idx.apply(changed, batch)
        state = dict(applied)
        if batch in (0, 3):
            same_as_scan(idx, now)
    found = idx.segments()
    assert [s["tier"] for s in found] == [1, 0, 0]
    gone = idx.vacuum()
    assert "0" in gone
    same_as_scan(idx, now)
    assert len(same_as_scan(idx, now)) > 5


def test_a_batch_that_runs_again(spark, docs, tmp_path):
    """Whatever part of a batch is left of a lost run, the next run of it gives the same index."""
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    idx = segments.SegmentedIndex(spark, str(tmp_path / "i"))
    idx.apply(docs.where("rid < 100"), 0)
    idx.apply(docs.where("rid between 50 and 150").withColumn("exposure", F.lit(0)), 1)  # a run that was lost after it was done
    later = docs.where("rid between 50 and 150")
    idx.apply(later, 1)
    same_as_scan(idx, docs.where("rid <= 150"))
    assert [s["id"] for s in idx.segments()] == ["0", "1"]
    old = segments.commit
    with pytest.raises(RuntimeError), pytest.MonkeyPatch.context() as m:
        m.setattr(segments, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        idx.apply(docs.where("rid > 150").withColumn("title", F.lit("wrong")), 2)
    assert segments.commit is old
    same_as_scan(idx, docs.where("rid <= 150"))  # nothing of it counts
    idx.apply(docs.where("rid > 150"), 2)
    same_as_scan(idx, docs)


def test_repair_touches_only_what_differs(spark, docs, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    idx = segments.SegmentedIndex(spark, str(tmp_path / "i"))
    idx.apply(docs.where("rid % 10 <> 0"), 0)
    now = docs.where("rid % 7 <> 0").withColumn("title", F.when(F.col("rid") % 11 == 0, F.lit("the of another")).otherwise(F.col("title")))
    listed = {r.rid: r.exposure for r in docs.where("exposure in (1, 3)").select("rid", "exposure").collect()}
    want = {"missing": sum(r % 10 == 0 and r % 7 > 0 for r in listed), "extra": sum(r % 10 > 0 and r % 7 == 0 for r in listed), "stale": sum(r % 11 == 0 and r % 10 > 0 and r % 7 > 0 for r in listed)}
    assert idx.repair(now, 1) == {k: n for k, n in want.items() if n}
    same_as_scan(idx, now)
    touched = spark.read.parquet(f"{tmp_path}/i/segments/1/touched").select(F.sum(F.bitmap_count("bits"))).first()[0]
    assert touched == sum(want.values())
    assert idx.repair(now, 2) == {} and [s["id"] for s in idx.segments()] == ["0", "1"]


def test_empty(spark, docs, tmp_path):
    idx = segments.SegmentedIndex(spark, str(tmp_path / "i"))
    assert idx.open() is None and idx.segments() == []
    idx.apply(docs.where("false"), 0)
    assert idx.open() is None
    idx.apply(docs.where("rid < 30"), 1)
    same_as_scan(idx, docs.where("rid < 30"))
