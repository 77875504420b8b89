"""The web ladder over many requests against one request after the other."""

import random

from pyspark.sql import functions as F

from quarry.operators import ladder

REQ = "req long, q string, limit long, depth string, freshness string, site string, signed_in boolean, seq long"
OWN = "req long, position long, url string, title string, published string"
ANSWER = "req long, step string, ok boolean, cost_usd double, results array<struct<url:string,title:string,published:string>>"
STEPS = ("exchange", "deepseek", "wikipedia")


def by_rule(requests, own, answers, cached, had, cap, web=True):
    """As the rule has it: requests in order, each climbing alone."""
    left, results, explain = {s: cap - had.get(s, 0) for s in STEPS[:2]}, {}, {}
    state = {r[0]: {"merged": [], "seen": set(), "explain": []} for r in requests}

    def add(st, rows):
        n = 0
        for url in rows:
            key = (url or "").rstrip("/")
            if key and key not in st["seen"]:
                st["seen"].add(key)
                st["merged"].append(url)
                n += 1
        return n

    for step in ("open_index", *STEPS):
        for req, q, limit, depth, _, _, signed, _ in sorted(requests, key=lambda r: r[7]):
            st = state[req]
            row = lambda ok, n, skipped=None, cached_=False, cost=0.0: st["explain"].append((step, ok, n, skipped, cached_, cost))  # noqa: B023, E731
            if step == "open_index":
                row(True, add(st, [u for _, u in sorted(own.get(req, []))][:limit]))
                continue
            paid = step != "wikipedia"
            told = [e for e in st["explain"] if e[0] == "exchange" and e[1] and e[2] > 0]
            if step == "deepseek" and depth == "deep" and told:
                row(False, 0, "exchange asked it already")
            elif depth != "deep" and len(st["merged"]) >= min(limit, 3):
                row(False, 0, "earlier steps answered")
            elif (q, step) in cached:
                row(True, add(st, cached[q, step]), None, True)
            elif depth == "quick":
                row(False, 0, "quick search reads indexes only")
            elif paid and not signed:
                row(False, 0, "paid providers need a signed-in person")
            elif not web:
                row(False, 0, "web search is off")
            elif paid and left[step] <= 0:
                row(False, 0, "daily cap reached")
            else:
                if paid:
                    left[step] -= 1
                ok, cost, urls = answers.get((req, step), (False, 0.0, []))
                if ok:
                    add(st, urls[:limit])
                row(ok, len(urls[:limit]) if ok else 0, None, False, cost)
    for req, _, limit, *_ in requests:
        results[req], explain[req] = state[req]["merged"][:limit], state[req]["explain"]
    return results, explain


def test_ladder(spark, tmp_path):
    rng = random.Random(3)
    url = lambda: rng.choice([None, "", "no url"] + [f"https://s{i}.example/{rng.choice(['', 'a', 'b/'])}" for i in range(5)] * 3)
    requests = [(i, f"q{rng.randrange(20)}", rng.randint(1, 6), rng.choice(["quick", "standard", "deep"]), "any", None, rng.random() < 0.7, 1000 - i) for i in range(120)]
    good = lambda: [u for u in (url() for _ in range(rng.randint(0, 5))) if u != "no url"]
    own = {r[0]: list(enumerate(good())) for r in requests if rng.random() < 0.7}
    answers = {(r[0], s): (rng.random() < 0.8, 0.001, good()) for r in requests for s in STEPS if rng.random() < 0.9}
    cached = {(f"q{i}", s): good() for i in range(0, 20, 5) for s in STEPS if rng.random() < 0.7}
    struct = lambda urls: [(u, "t", None) for u in urls]
    frame = spark.createDataFrame(requests, REQ)
    mine = spark.createDataFrame([(r, p, u, "t", None) for r, rows in own.items() for p, u in rows], OWN)
    told = spark.createDataFrame([(r, s, ok, c, struct(us)) for (r, s), (ok, c, us) in answers.items()], ANSWER)
    held = spark.createDataFrame([(q, s, struct(us)) for (q, s), us in cached.items()], "q string, s string, results array<struct<url:string,title:string,published:string>>").withColumns({"freshness": F.lit("any"), "site": F.lit(None).cast("string")})
    keys = None
    for s in STEPS:
        one = held.where(F.col("s") == s).select(ladder.step_key(s).alias("key"), "results")
        keys = one if keys is None else keys.unionByName(one)
    calls = spark.createDataFrame([("exchange", 5)], "step string, calls long")
    for n, (cap, web) in enumerate(((30, True), (5, True), (1000, False))):
        results, explain, fresh = ladder.run(frame, mine, told, keys, calls, str(tmp_path / str(n)), cap, web)
        want, why = by_rule(requests, own, answers, cached, {"exchange": 5}, cap, web)
        got = {}
        for r in results.orderBy("req", "position").collect():
            got.setdefault(r.req, []).append(r.url)
        assert got == {r: [u for u in us] for r, us in want.items() if us}
        said = {}
        for r in explain.orderBy("req", "at").collect():
            said.setdefault(r.req, []).append((r.step, r.ok, r["count"], r.skipped, r.cached, r.cost_usd))
        assert said == why
        assert fresh.count() <= sum(e[1] and not e[4] for rows in why.values() for e in rows)


def test_asks(spark):
    rows = [(1, "x" * 600, 50, "deep", "week", "WWW.Site.Example", True, 1), (2, "q", 0, "standard", "day", "bad site", True, 2), (3, "q", 5, "quick", "any", None, True, 3)]
    got = {r.req: r for r in ladder.asks(spark.createDataFrame(rows, REQ), 1_780_000_000_000).collect()}
    assert (len(got[1].q), got[1].depth, got[1].max_cost_usd, got[1].timeout_ms, got[1]["limit"], got[1].include_domains, got[1].freshness, got[1].since) == (500, "standard", 0.012, 45000, 20, ["site.example"], None, "2026-05-21")
    assert (got[2].depth, got[2].max_cost_usd, got[2]["limit"], got[2].include_domains, got[2].freshness, got[2].since) == ("fast", 0.003, 1, [], "day", None)
    assert got[3].freshness is None and got[3].since is None


def test_narrowed(spark):
    now = 1_780_000_000_000
    results = spark.createDataFrame([(1, "https://a.site.example/x", "2026-05-28T00:00:00Z"), (1, "https://site.example/", None), (1, "https://othersite.example/", None), (1, "https://site.example/old", "2020-01-01T00:00:00Z"), (2, "https://z.example/", "soon")], "req long, url string, published string")
    requests = spark.createDataFrame([(1, "q", 5, "deep", "week", "www.site.example", True, 1), (2, "q", 5, "deep", "day", None, True, 2)], REQ)
    assert {r.url for r in ladder.narrowed(results, requests, now).collect()} == {"https://a.site.example/x", "https://site.example/", "https://z.example/"}


def test_no_requests(spark, tmp_path):
    empty = lambda schema: spark.createDataFrame([], schema)
    results, explain, _ = ladder.run(empty(REQ), empty(OWN), empty(ANSWER), empty("key string, results array<struct<url:string,title:string,published:string>>"), empty("step string, calls long"), str(tmp_path), 5)
    assert results.count() == 0 and explain.count() == 0


def test_tasks_hold_few_requests(spark, tmp_path, monkeypatch):
    """Small files of many requests are neither broadcast nor put into one task."""
    monkeypatch.setattr(ladder, "REQUESTS_A_TASK", 500, raising=False)
    c = F.col("id")
    rows = spark.range(4000).select(c.alias("req"), F.lit("q").alias("q"), F.lit(5).cast("long").alias("limit"), F.lit("deep").alias("depth"), F.lit("any").alias("freshness"), F.lit(None).cast("string").alias("site"), F.lit(True).alias("signed_in"), c.alias("seq"))
    page = F.struct(F.lit("https://w.example/").alias("url"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("published"))
    own = rows.select("req", F.lit(0).cast("long").alias("position"), F.lit("https://o.example/").alias("url"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("published"))
    answers = rows.select("req", F.lit("wikipedia").alias("step"), F.lit(True).alias("ok"), F.lit(0.0).alias("cost_usd"), F.array(page).alias("results"))
    cache = spark.createDataFrame([], "key string, results array<struct<url:string,title:string,published:string>>")
    results, explain, _ = ladder.run(rows, own, answers, cache, spark.createDataFrame([], "step string, calls long"), str(tmp_path), 3)
    for df in (results, explain):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    for name in ("found-0", "got-3", "found-3"):
        of_file = spark.read.parquet(f"{tmp_path}/{name}").groupBy(F.input_file_name()).count()
        assert of_file.agg(F.max("count")).first()[0] < 1000, name
    assert results.count() == 8000 and explain.where("ok").count() == 8000
