"""Federated queries, code search, periodic work and the embedder's clock."""

import pytest

from quarry import queries
from quarry.engine import Engine
from quarry.fabric import Fabric, code_search
from quarry.operators import ladder, vector
from quarry.schema import Filters, Viewer
from quarry.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(queries.docs_of(spark, SF).cache(), profile=queries.FIXED)


def web(spark, folder, answers):
    told = spark.createDataFrame(answers, "req long, step string, ok boolean, cost_usd double, results array<struct<url:string,title:string,published:string>>")
    none = spark.createDataFrame([], "key string, results array<struct<url:string,title:string,published:string>>")
    return lambda request, own: ladder.run(request, own, told, none, spark.createDataFrame([], "step string, calls long"), str(folder), 10)


def test_scopes(spark, engine, tmp_path):
    answers = [(0, "exchange", True, 0.002, [("https://x.example/a", "A", "2024-12-31T00:00:00Z"), (None, "none", None), ("https://y.example/", "B", None)]), (0, "wikipedia", True, 0.0, [("https://w.example/", "W", "2001-01-01T00:00:00Z")])]
    fabric = Fabric(engine, {"videos": [Filters(type="vod")], "both": [Filters(type="vod"), Filters(type="offer"), Filters(type="vod")], "none": []}, web(spark, tmp_path, answers), ("src3",))
    out = fabric.query("the", ("network", "mine", "videos", "both", "none", "web"), Viewer("u1", ("g1",), ("e1",)), limit=5)
    first = engine.search("the", Viewer("u1", ("g1",), ("e1",)), limit=5)
    have = {r.rid for r in engine.docs.where("canonical_url is not null").select("rid").collect()}
    assert [r["rid"] for r in out.results if r["scope"] == "network"] == [r["rid"] for r in first.rows if r["rid"] in have] and out.cursors["network"] == first.cursor
    assert {r["type"] for r in out.results if r["scope"] == "videos"} == {"vod"} and {r["type"] for r in out.results if r["scope"] == "both"} <= {"vod", "offer"}
    both = [r["rid"] for r in out.results if r["scope"] == "both"]
    assert len(both) == len(set(both)) <= 5
    assert out.groups["none"] == 0 and sum(out.groups.values()) == len(out.results)
    told = {(e["scope"], e["step"]): e for e in out.explain}
    assert told["none", "index"]["skipped"] == "not indexed yet" and told["web", "open_index"]["ok"]
    assert all(r["url"] for r in out.results) and [c["n"] for c in out.citations] == list(range(1, out.groups["web"] + 1))
    deep = fabric.query("zzzz", ("web",), Viewer("u1"), depth="deep")
    assert [r["url"] for r in deep.results] == ["https://x.example/a", "https://y.example/", "https://w.example/"]
    assert [r["url"] for r in fabric.query("zzzz", ("web",), Viewer("u1"), depth="deep", freshness="week").results] == ["https://x.example/a", "https://y.example/"]
    assert [r["url"] for r in fabric.query("zzzz", ("web",), Viewer("u1"), depth="deep", site="www.Y.example").results] == ["https://y.example/"]
    alone = fabric.query("the", ("mine", "web"), depth="quick")
    assert alone.results == [r for r in alone.results if r["scope"] == "web"] and {e["scope"]: e for e in alone.explain}["mine"]["skipped"] == "needs a signed-in person"
    with pytest.raises(ValueError):
        fabric.query(" ")


def test_code_search(spark):
    schema = "position long, source string, repo string, ref string, path string, permalink string, lines array<struct<number:int,text:string,match:boolean>>, line_start int, line_end int, stars long, last_commit string, licence string, language string"
    file = lambda i, repo, stars, text, source="a", number=5: (i, source, repo, "c", "p.py", "l", [(1, "top", False), (number, text, True)], None, None, stars, "2024", "mit", "py")
    rows = spark.createDataFrame([file(0, "r/one", 1, "call myName here"), file(1, "R/one", 3, "other", "b", 9), file(2, "r/two", 9, "myNameX"), file(3, "r/three", 5, "nothing")], schema)
    page, cursor = code_search(rows, "find myName", limit=2)
    got = page.collect()
    assert [(r.repo, r.stars, r.exact) for r in got] == [("r/one", 3, 1), ("r/two", 9, 0)]
    assert [x.number for x in got[0].lines] == [5, 9] and list(got[0].sources) == ["a", "b"]
    rest, end = code_search(rows, "find myName", limit=2, cursor=cursor)
    assert [r.repo for r in rest.collect()] == ["r/three"] and end is None
    assert code_search(rows, "x", repo="TWO")[0].count() == 1
    with pytest.raises(ValueError):
        code_search(rows, "another", cursor=cursor)


def test_periodic(spark, tmp_path):
    done = []
    work = jobs.Periodic(spark, str(tmp_path), {"prune": 100, "embed": 10})

    def fails():
        raise RuntimeError("no answer")

    assert work.due(0) == ["embed", "prune"]
    assert work.run(0, 1000, {"prune": lambda: done.append("prune"), "embed": fails}) == {"embed": "failed: no answer", "prune": "done"}
    assert work.due(1001) == ["embed"]
    assert work.run(1, 1001, {"embed": lambda: done.append("embed")}) == {"embed": "done"} == work.run(1, 1001, {"embed": lambda: done.append("embed")})  # a lost run is done again
    assert work.due(1012) == ["embed"] and work.due(1100) == ["prune", "embed"] and work.due(1010) == []
    assert done == ["prune", "embed", "embed"]


def test_embedder_clock(spark):
    pending, clock = spark.range(100).withColumnRenamed("id", "rid"), vector.EmbedClock()
    rows, clock = vector.embed_tick(pending, clock, 100_000, 70)
    assert rows.count() == 70 and rows.groupBy("call").count().count() == 3 and clock.used == 70
    assert vector.embed_tick(pending, clock, 110_000, 70)[0].count() == 0
    clock = vector.embed_done(clock, False, 110_000)
    clock = vector.embed_done(clock, False, 113_000)
    assert (clock.failures, clock.next_try) == (2, 123_000)
    assert vector.embed_tick(pending, clock, 122_000, 70)[0].count() == 0
    rows, after = vector.embed_tick(pending, clock, 161_000, 70)
    assert rows.count() == 70 and vector.embed_done(after, True, 161_500).failures == 0


def test_code_lines_where_positions_of_two_sources_are_equal(spark, tmp_path):
    """A user's turn 6 of conversation 10003 has the position of another's turn of conversation 3: neither takes the other's lines."""
    import duckdb

    from quarry import queries

    rows = [(conv, turn, role, "t") for conv in (3, 10003, 24, 10024) for turn, role in ((1, "user"), (3, "assistant"), (6, "user" if conv > 10000 else "system"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    cursor = duckdb.sql(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'") or duckdb.sql(queries.SQL["code_lines"])
    got = queries.QUERIES["code_lines"](spark, str(tmp_path)).select(*cursor.columns).collect()
    assert got and sorted(map(tuple, got)) == sorted(cursor.fetchall())
