"""Pages from blocks against the whole ranked set, and how little of the postings they read."""

import random

import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.engine import Engine
from quarry.operators import index, search
from quarry.schema import Filters, Match, Profile, Sites, Viewer

SF = "/root/testdata/sf0.01"
CASES = [
    (Match(("the", "of")), Viewer(), None), (Match(("the",)), Viewer("u1", ("g1",), ("e1",)), None), (Match(("the", "ing"), prefix=True), Viewer(), None),
    (Match(("that", "erer"), any=True, question=True), Viewer(), None), (Match(("the", "and", "of", "to", "in")), Viewer(), None),
    (Match(("th",), prefix=True, field=search.TITLE), Viewer(), None), (Match(("idiot", "clown", "the"), any=True), Viewer(), {"idiot": 5.1, "clown": 4.9, "the": 2.4}), (Match(("zzz", "the")), Viewer(), None)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks") / "i")
    index.store(queries.docs_of(spark, SF), path)
    return path


#: How many blocks come first, and how many are listed at most: few enough to go through every way.
STEPS = [(1, 2), (2, 2048), (64, 2048)]


def steps(monkeypatch, i):
    monkeypatch.setattr(index, "FIRST", STEPS[i % 3][0])
    monkeypatch.setattr(index, "MOST_BLOCKS", STEPS[i % 3][1])


@pytest.mark.parametrize("case", range(len(CASES)))
def test_top_is_the_page(spark, stored, monkeypatch, case):
    steps(monkeypatch, case)
    match, viewer, weights = CASES[case]
    s = index.Stored.open(spark, stored)
    whole = index.search_set(s.postings, s.records, match, viewer, weights, queries.FIXED)
    want = search.page(whole, 11).select(*search.ORDER).collect()
    got, read = s.top(11, match, viewer, Filters(), None, weights, queries.FIXED)
    assert got == want
    if len(want) > 6:
        key = tuple(want[5])
        assert s.top(9, match, viewer, Filters(), key, weights, queries.FIXED)[0] == search.page(whole, 9, key).select(*search.ORDER).collect()


def test_bounds_are_bounds(spark, stored):
    """No document ranks better than its block's bound."""
    s = index.Stored.open(spark, stored)
    for match, viewer, weights in CASES:
        for profile in (queries.FIXED, Profile(now=queries.CLOCK, freshness=0.0, half_life_days=3.0)):
            rows = index.search_set(s.postings, s.records, match, viewer, weights, profile).withColumn("block", index.block_of())
            over = rows.join(index.bounds(s.blocks, s.tops, match, viewer, weights, profile), ["audience", "block"], "left")
            assert over.where("bound is null or -rank > bound + 1e-6").count() == 0


def test_share_read_of_a_large_index(spark, tmp_path, monkeypatch):
    """20,000 documents, of which some have both words in the title: fewer than a fifth of the blocks are read."""
    monkeypatch.setattr(index, "FIRST", 8)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(4)) + (" alpha" if rng.random() < 0.03 else "") + (" beta" if rng.random() < 0.03 else ""), "alpha beta " * rng.randint(1, 3) + " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for i in range(20_000)]
    docs = queries.docs_of(spark, SF).limit(1).drop("rid", "title", "body", "exposure", "owner").crossJoin(spark.createDataFrame(rows, "rid long, title string, body string")).withColumn("exposure", F.lit(3)).withColumn("owner", F.concat(F.lit("o"), F.col("rid")))
    index.store(docs, str(tmp_path / "i"))
    s = index.Stored.open(spark, str(tmp_path / "i"))
    match = Match(("alpha", "beta"))
    got, read = s.top(10, match, profile=queries.FIXED)
    assert got == search.page(index.search_set(s.postings, s.records, match, profile=queries.FIXED), 10).select(*search.ORDER).collect()
    assert index.bounds(s.blocks, s.tops, match, profile=queries.FIXED).count() == 313 and read < 313 / 5
    plan = s.within([(3, 5), (3, 90)])[0]._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(rid,320)" in plan


def test_filters_and_sites(spark, stored, monkeypatch):
    steps(monkeypatch, 0)
    docs = queries.docs_of(spark, SF)
    sites = Sites("the", "{word}.example", (("of", ("src3.example",)),), "src4.example")
    for text, filters, sites_ in (("the of", Filters(language="en", facets=(("size", ("medium", "large")),)), None), ("the of and", Filters(), sites), ("the of", Filters(owner="src3"), sites)):
        a, b = (Engine(docs, path, sites=sites_, profile=queries.FIXED).search(text, filters=filters, limit=7) for path in (None, stored))
        assert a.rows == b.rows and len(a.rows) > 3
        assert a.cursor == b.cursor


def test_pages_keep_the_first_clock(spark, stored):
    """The clock of a session is its first page's, whatever later calls are given."""
    engine = Engine(queries.docs_of(spark, SF), stored)
    whole = engine.search("the of", limit=20, now=queries.CLOCK).rows
    one = engine.search("the of", limit=10, now=queries.CLOCK)
    two = engine.search("the of", limit=10, cursor=one.cursor, now=queries.CLOCK + 90 * 86_400_000)
    assert one.rows + two.rows == whole
    assert engine.search("the of", limit=20, now=queries.CLOCK + 90 * 86_400_000).rows != whole


def test_hybrid_from_the_index(spark, stored, tmp_path):
    """Words and vectors fused, from the stored indexes as from the scans."""
    from quarry.operators import ann

    docs = queries.docs_of(spark, SF)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("rid"), "embedding")
    asked = list(rows.where("rid = 7").first().embedding)
    ann.build(rows, str(tmp_path / "v"), "rid")
    for text in ("the", "the idiot clown moron"):
        pages = [Engine(docs, path, embeddings=rows, profile=queries.FIXED, dim=64, vectors=vectors).search(text, limit=15, vector_=asked) for path, vectors in ((None, None), (stored, None), (stored, str(tmp_path / "v")))]
        assert pages[0].rows == pages[1].rows and len(pages[0].rows) > 5
        assert len({r.rid for r in pages[0].rows} & {r.rid for r in pages[2].rows}) >= len(pages[0].rows) - 2


def test_words_are_counted_where_documents_are_read(spark):
    """The counts are those of a plain count, and no token is shuffled for them; a large table is dealt into more tasks."""
    from collections import Counter

    texts = {1: ("a b a", "", "a c " * 300), 2: ("", None, "b"), 3: (None, "", ""), 4: ("d", "d d", "d a")}
    docs = spark.createDataFrame([(rid, 3, *t) for rid, t in texts.items()], "rid long, exposure int, title string, summary string, body string")
    pieces, _ = index._pieces(docs)
    assert "Exchange" not in pieces._jdf.queryExecution().executedPlan().toString()
    want = sorted((rid, 3, w, *(Counter((x or "").split())[w] for x in t)) for rid, t in texts.items() for w in {w for x in t for w in (x or "").split()})
    assert sorted(map(tuple, pieces.collect())) == want == sorted(map(tuple, index.build(docs)[0].collect()))
    assert index._files(spark, 1000 * index.PART) == 1000
