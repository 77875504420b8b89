"""Registered queries of the engine: each applies operators to whole tables; quarry.oracles has the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.functions.text import clean_text, hmac_sha256, host, parse_query, parse_time, relaxed, tokens
from quarry.operators import federation as fed
from quarry.operators import ann, facets, index, ingest, ladder, saved, search, trending, vector
from quarry.operators import visibility as vis
from quarry.oracles import SQL  # noqa: F401
from quarry.schema import Filters, Match, Profile, Sites, Viewer
from quarry.sources.adapter import CLOCK, FIELDS, beacons, index_documents, revision_log, table_stream
from quarry.streaming import beacons as beacon_job
from quarry.streaming import ingest as stream_ingest
from quarry.streaming import jobs, watching

QUERIES: dict = {}
#: The ranking of the queries here: the default one at a fixed clock.
FIXED = Profile(now=CLOCK)
#: Facets that the content hash covers, by key.
HASHED = [("duration_seconds", "duration"), ("followers", "followers"), ("live", "live"), ("size", "size_bucket")]
HIT = ("rid", "rank", "importance", "recency")


def query(f):
    QUERIES[f.__name__] = f
    return f


def named(name: str, f) -> None:
    f.__name__ = name
    QUERIES[name] = f


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def docs_of(spark, sf_dir):
    return vis.with_exposure(index_documents(spark, sf_dir))


def top(spark, sf_dir, match, viewer=Viewer(), weights=None, limit=20):
    return search.page(search.search_set(docs_of(spark, sf_dir), match, viewer, weights, FIXED), limit)


# retrieval
named("keyword_and_search", lambda s, d: top(s, d, Match(("the", "of"))).select(*HIT))
named("keyword_signed_in", lambda s, d: top(s, d, Match(("the", "of")), Viewer("u1", ("g1",), ("e1",))).select(*HIT))
named("prefix_search", lambda s, d: top(s, d, Match(("the", "ing"), prefix=True)).select(*HIT))
named("question_lift", lambda s, d: top(s, d, Match(("that", "erer"), any=True, question=True)).select(*HIT))
named("suggest_titles", lambda s, d: top(s, d, Match(("th",), prefix=True, field=search.TITLE), limit=8).select("rid", "title", "rank"))


@query
def keyword_relaxed(spark, sf_dir):
    """Any word, weighted by how rare it is among listed documents; two bounded counts come first."""
    docs, match = docs_of(spark, sf_dir), Match(("idiot", "clown"), any=True)
    return search.page(search.search_set(docs, match, Viewer(), search.weights_of(docs, match), FIXED)).select(*HIT)


def page_rows(spark, page, *columns):
    """A page (bounded by the engine's limit) as rows again."""
    kinds = {"rid": "long", "rank": "double", "importance": "long", "recency": "string", "position": "int", "sort_at": "string"}
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in page.rows], ", ".join(f"{c} {kinds[c]}" for c in columns))


def asked(spark, sf_dir, text, *args, **kw):
    return Engine(docs_of(spark, sf_dir), **{"profile": FIXED} | {k: kw.pop(k) for k in ("sites", "index_path", "profile") if k in kw}).search(text, *args, **kw)


SITES = Sites("example", aliases=(("old", ("src1.example", "src2.example")),), help_host="src3.example")

# the engine, asked with texts
named("search_folded", lambda s, d: page_rows(s, asked(s, d, "MÁS la"), *HIT))
named("search_question", lambda s, d: page_rows(s, asked(s, d, "how do the erer"), *HIT))
named("keyword_or_relaxed", lambda s, d: page_rows(s, asked(s, d, "the idiot clown moron trash scum stupid loser"), *HIT))
named("search_filtered", lambda s, d: page_rows(s, asked(s, d, "the of", filters=Filters(owner="src3", language="en", since="2024-02-01", facets=(("size", ("medium", "large")),)), limit=500), *HIT))
named("search_mine", lambda s, d: page_rows(s, Engine(docs_of(s, d), profile=FIXED).mine("the", Viewer("u1", ("g1",), ("e1",)), limit=50), *HIT))
named("site_tier", lambda s, d: page_rows(s, asked(s, d, "the of and", sites=Sites("the", "{word}.example", (("of", ("src3.example",)),), "src4.example")), *HIT))
named("site_candidates", lambda s, d: page_rows(s, asked(s, d, "example old", sites=SITES), *HIT))
named("search_boilerplate", lambda s, d: search.page(search.search_set(docs_of(s, d), Match(("the",)), profile=Profile(boilerplate="[a-m]$", now=CLOCK))).select(*HIT))
named("search_undated", lambda s, d: search.page(search.search_set(docs_of(s, d), Match(("the",)), profile=Profile(freshness=0.0, now=CLOCK))).select(*HIT))


@query
def search_page_cursor(spark, sf_dir):
    """The third page, by the cursors of the first two."""
    engine, cursor = Engine(docs_of(spark, sf_dir), profile=FIXED), None
    for _ in range(3):
        page = engine.search("the of", limit=7, cursor=cursor)
        cursor = page.cursor
    return page_rows(spark, page, *HIT)


@query
def browse_cursor(spark, sf_dir):
    engine = Engine(docs_of(spark, sf_dir))
    return page_rows(spark, engine.browse(limit=15, cursor=engine.browse(limit=15).cursor), "rid", "sort_at")


_built: dict[tuple[str, str, str], str] = {}


def built(spark, sf_dir, name, build):
    """The folder of an index that this application has built of these tables: searches don't build it again."""
    key = (spark.sparkContext.applicationId, str(sf_dir), name)
    if key not in _built:
        path = jobs._folder(spark, name)
        build(path)
        _built[key] = path
    return _built[key]


def stored_index(spark, sf_dir):
    return built(spark, sf_dir, "index", lambda path: index.store(docs_of(spark, sf_dir), path))


named("index_search", lambda s, d: page_rows(s, asked(s, d, "the of", index_path=stored_index(s, d)), *HIT))
named("index_search_signed_in", lambda s, d: page_rows(s, asked(s, d, "the of", Viewer("u1", ("g1",), ("e1",)), index_path=stored_index(s, d)), *HIT))
named("index_relaxed", lambda s, d: page_rows(s, asked(s, d, "the idiot clown moron trash scum stupid loser", index_path=stored_index(s, d)), *HIT))


@query
def index_merge(spark, sf_dir):
    """The index after every fifth document is removed, as (term, audience, documents)."""
    docs = docs_of(spark, sf_dir)
    postings, _ = index.merged(*index.build(docs), docs.where("rid % 5 = 0").withColumn("exposure", F.lit(0)))
    return postings.groupBy("audience", "term").agg(F.count("*").alias("n"))


@query
def keyset_page2(spark, sf_dir):
    rows = search.search_set(docs_of(spark, sf_dir), Match(("the", "of")), profile=FIXED)
    last = search.page(rows, 20).select(*HIT).collect()
    key = (last[-1]["rank"], last[-1]["importance"], last[-1]["recency"], last[-1]["rid"]) if last else None
    return search.page(rows, 20, key).select(*HIT)


@query
def facet_filter(spark, sf_dir):
    docs = search.facet_filter(docs_of(spark, sf_dir), {"lang": ["en", "de"], "size": ["medium"]})
    return search.page(search.search_set(docs, Match(("the",)), profile=FIXED)).select(*HIT)


@query
def facet_counts(spark, sf_dir):
    return search.facet_counts(search.search_set(docs_of(spark, sf_dir), Match(("the",)), profile=FIXED), ["lang", "size", "live", "type"])


@query
def rank_components(spark, sf_dir):
    rows = search.matched(vis.visible(docs_of(spark, sf_dir), Viewer()), Match(("the", "of")))
    return rows.select("rid", "tier", "title_words", "cover", F.col("doc_len").cast("long").alias("doc_len"), F.round("relevance", 6).alias("relevance"))


@query
def snippet(spark, sf_dir):
    match = Match(("the",))
    return search.snippet(docs_of(spark, sf_dir), top(spark, sf_dir, match), match)


@query
def snippet_prefix(spark, sf_dir):
    """Snippets of a prefix query on titles, less those that only repeat the title."""
    docs, match = docs_of(spark, sf_dir), Match(("erth",), prefix=True)
    found = search.snippet(docs, top(spark, sf_dir, match), match).join(docs.select("rid", "title"), "rid")
    return found.where(~search.repeats_title(F.col("snippet"), F.col("title"))).select("rid", "snippet")


named("result_projection", lambda s, d: search.projected(vis.visible(docs_of(s, d), Viewer("u1"))))
named("browse_newest", lambda s, d: search.browse(docs_of(s, d)).select("rid", "sort_at"))

# derived columns and visibility
named("effective_indexability", lambda s, d: docs_of(s, d).select("rid", "index_decision", F.array_join("reasons", ",").alias("reasons")))
named("exposure_levels", lambda s, d: docs_of(s, d).select("rid", "exposure"))
named("exposure_counts", lambda s, d: docs_of(s, d).groupBy("exposure").agg(F.count("*").alias("n"), F.count_if("deleted").alias("tombstones")))
named("normalize_hash", lambda s, d: index_documents(s, d).select("rid", ingest.content_hash(HASHED).alias("content_hash")))
named("acl_keys", lambda s, d: vis.acl_keys(docs_of(s, d)))
named("facet_pairs", lambda s, d: vis.facet_pairs(docs_of(s, d)))
named("visible_anonymous", lambda s, d: vis.visible(docs_of(s, d), Viewer()).select("rid"))
named("visible_user", lambda s, d: vis.visible(docs_of(s, d), Viewer("u2")).select("rid"))
named("visible_delegate", lambda s, d: vis.visible(docs_of(s, d), Viewer("u9", ("g0", "g2"), ("e1",))).select("rid"))
named("can_view_by_id", lambda s, d: docs_of(s, d).select("rid", vis.can_view(Viewer("u2", ("g1",))).alias("can_view")))
named("acl_leak_audit", lambda s, d: vis.visible(docs_of(s, d), Viewer()).agg(F.count_if((F.col("visibility") != "public") | F.col("deleted") | (F.col("publication_state") != "published")).alias("leaks")))

# index
named("postings", lambda s, d: search.postings(docs_of(s, d)))
named("term_df", lambda s, d: search.term_df(docs_of(s, d)))
named("word_weights", lambda s, d: search.term_df(docs_of(s, d)).select("term", search.word_weight(F.col("df")).alias("weight")))


@query
def index_reconcile(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return search.reconcile(docs, search.postings(docs))


named("freshness_boost", lambda s, d: docs_of(s, d).select("rid", F.round(search.freshness(FIXED), 6).alias("boost")))
named("importance", lambda s, d: index_documents(s, d).select("rid", search.importance().alias("importance")))
named("thin_flag", lambda s, d: index_documents(s, d).select("rid", search.thin().alias("thin")))

# aggregates over the visible set
named("coverage_by_kind", lambda s, d: vis.visible(docs_of(s, d), Viewer()).groupBy("owner", "type").agg(F.count("*").alias("n")))
named("coverage_rollup", lambda s, d: vis.visible(docs_of(s, d), Viewer()).rollup("owner", "type").agg(F.count("*").alias("n")))
named("newest_public", lambda s, d: vis.visible(docs_of(s, d), Viewer()).agg(F.max(F.nullif(F.col("sort_at"), F.lit(""))).alias("newest")))
named("shelves_top4", lambda s, d: long(fed.shelves(vis.visible(docs_of(s, d), Viewer())), "place"))
named("owner_page", lambda s, d: index_documents(s, d).where("owner = 'src3' and rid > 100").orderBy("rid").limit(21).select("rid", "type", "deleted"))


# vectors
def nearest(spark, sf_dir, floor=None):
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id = 7").select("embedding").first()
    return vector.knn(rows, asked[0], 100, floor)


named("knn_cosine", lambda s, d: nearest(s, d))
named("distance_floor", lambda s, d: nearest(s, d).where("distance <= 0.9"))


def stored_vectors(spark, sf_dir):
    """The vector index of all embeddings, and the vector that is asked."""
    rows = read(spark, sf_dir, "embeddings")
    path = built(spark, sf_dir, "vectors", lambda path: ann.build(rows, path))
    return ann.VectorIndex.open(spark, path), list(rows.where("vec_id = 7").select("embedding").first()[0])


@query
def vector_index(spark, sf_dir):
    """The 100 nearest from the probed lists alone: approximate, so tests hold its recall against the scan."""
    stored, asked = stored_vectors(spark, sf_dir)
    return stored.search(asked)


@query
def vector_index_exact(spark, sf_dir):
    """The same, gone on with until no other list can hold a nearer one."""
    stored, asked = stored_vectors(spark, sf_dir)
    return stored.search(asked, exact=True)


@query
def rrf_fusion(spark, sf_dir):
    order = (F.asc("rank"), F.desc("importance"), F.desc("recency"), F.asc("rid"))
    keyword = vector.ranked(top(spark, sf_dir, Match(("the", "of")), limit=100), *order)
    return long(vector.rrf(keyword, vector.ranked(nearest(spark, sf_dir), F.asc("distance"), F.asc("rid"))), "keyword_rank", "vector_rank")


@query
def embedding_pending(spark, sf_dir):
    """Public documents (noindex ones too) without a current embedding: none, of other content, or of another dimension."""
    docs = index_documents(spark, sf_dir).where("not deleted and visibility = 'public' and publication_state = 'published'").select("rid", ingest.content_hash(HASHED).alias("content_hash"))
    had = index_documents(spark, sf_dir).select("rid", F.when(F.col("rid") % 6 == 0, F.lit("old")).otherwise(ingest.content_hash(HASHED)).alias("content_hash"))
    kept = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rid"), F.lit("m").alias("model"), F.when(F.col("vec_id") % 7 != 0, F.size("embedding")).otherwise(0).alias("dim")).join(had, "rid")
    return vector.embedding_pending(docs, kept, "m", 64).select("rid")


@query
def embedding_upsert(spark, sf_dir):
    """Embeddings after some are made anew and documents that aren't public are dropped."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rid"), F.lit("m").alias("model"), F.col("label").cast("long").alias("version"))
    fresh = rows.where("rid % 3 = 0").withColumn("version", F.col("version") + 1000)
    return vector.embedding_upsert(rows, fresh, vis.visible(docs_of(spark, sf_dir), Viewer())).select("rid", "version")


named("embedding_text", lambda s, d: index_documents(s, d).select("rid", F.sha2(vector.embedding_text(), 256).alias("text_hash")))


@query
def embedding_batches(spark, sf_dir):
    """Batches of at most 32 for the embedding client; how many there are and that none is larger."""
    rows = vector.batches(vis.visible(docs_of(spark, sf_dir), Viewer()).select("rid"), 32)
    return rows.groupBy("part", "batch").agg(F.count("*").alias("n")).agg(F.sum("n").alias("documents"), (F.max("n") <= 32).alias("bounded"))


@query
def hybrid_search(spark, sf_dir):
    """The engine's hybrid page: words and a vector, both lists fused, tiers, one of each title; the second page by its cursor."""
    docs = docs_of(spark, sf_dir)
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rid"), "embedding")
    vector_ = list(rows.where("rid = 7").first().embedding)
    engine = Engine(docs, embeddings=rows, dim=len(vector_), profile=FIXED)
    first = engine.search("the of", limit=20, vector_=vector_)
    return page_rows(spark, engine.search("the of", limit=20, cursor=first.cursor, vector_=vector_), "rid", "position")


@query
def vector_join(spark, sf_dir):
    """Nearest listed documents with their kinds: the floor, the join and the owner filter."""
    near = nearest(spark, sf_dir).where("distance <= 0.95")
    return vis.visible(docs_of(spark, sf_dir), Viewer()).join(near, "rid").select("rid", "owner", "type", "distance")


@query
def deals_order(spark, sf_dir):
    """Offers of a fused list: head-noun matches, keyword hits, the rest."""
    offers = vis.visible(docs_of(spark, sf_dir), Viewer()).where("type = 'offer'").select("rid", tokens(F.col("title")).alias("words"))
    fused = offers.withColumns({"keyword_rank": F.when(F.col("rid") % 3 == 0, F.col("rid")), "vector_rank": F.when(F.col("rid") % 3 != 0, F.col("rid")), "score": F.round(1 / (60 + F.col("rid") % 17), 9)})
    return vector.deals_order(fused, F.col("words"), ("the",)).limit(40).select("rid", "tier")


# ingest
named("revision_outcomes", lambda s, d: ingest.outcomes(revision_log(s, d)).select("arrival", "key", "revision", "deleted", "outcome"))
named("latest_documents", lambda s, d: ingest.latest(revision_log(s, d)))


@query
def inbox_dedupe(spark, sf_dir):
    events = read(spark, sf_dir, "events").select((F.col("event_id") % 4000).alias("event_id"), F.col("event_id").alias("arrival"))
    return ingest.inbox(events, read(spark, sf_dir, "events").where("event_id < 500"))


@query
def rejections(spark, sf_dir):
    """Envelopes read from events; those refused, with the reason."""
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        e.alias("rid"), F.when(F.col("event_type") == "view", "wiki.page.viewed").when(F.col("event_type") == "click", "shop.index_document.upserted").otherwise("wiki.index_document.upserted").alias("event_type"),
        F.lit("wiki").alias("source"), (F.col("user_id") % 4 != 0).alias("accepted"), F.lit("page").alias("subject_type"), F.when(e % 10 == 3, "other").otherwise(e.cast("string")).alias("subject_id"),
        F.lit("wiki").alias("owner"), F.lit("page").alias("type"), e.cast("string").alias("id"), F.when(e % 10 == 4, -1).otherwise(1).alias("revision"))
    return rows.select("rid", ingest.envelope_outcome().alias("outcome")).where(~F.col("outcome").isin("ignored", "accepted"))


@query
def exposure_changes(spark, sf_dir):
    applied = ingest.outcomes(revision_log(spark, sf_dir)).where("outcome = 'applied'")
    level = F.when(F.col("deleted"), 0).when(F.col("content") == "view", 1).otherwise(3)
    versions = applied.groupBy("key", "revision").agg(F.when(F.bool_or("deleted"), 0).otherwise(F.max(level)).alias("exposure"))
    return ingest.exposure_changes(versions)


@query
def purge_urls(spark, sf_dir):
    zones = spark.createDataFrame([("com", "example.com"), ("net", "example.net"), ("blog", "blog.thther.example.net"), ("m", "m.thther.example.com")], "zone string, suffix string")
    return ingest.purge_urls(read(spark, sf_dir, "pages").select("url"), zones, ["/", "/feed"])


@query
def purge_step(spark, sf_dir):
    e = F.col("event_id")
    status = F.element_at(F.array(F.lit(200), F.lit(429), F.lit(503), F.lit(404), F.lit(None).cast("int"), F.lit(408)), (e % 6 + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select(e.cast("string").alias("url"), (e % 8).cast("int").alias("attempts"), (e % 3).cast("int").alias("batch"), status.alias("status"))
    return ingest.purge_step(rows).select(F.col("url").cast("long").alias("event_id"), "attempts", "state", "delay")


# trends
named("trend_hourly", lambda s, d: trending.hourly(beacons(s, d)))
named("trend_visitors", lambda s, d: trending.visitors(beacons(s, d)))
named("trend_by_day", lambda s, d: trending.by_day(beacons(s, d)))
named("trend_by_site", lambda s, d: trending.by_site(beacons(s, d)))
named("trend_suggestions", lambda s, d: trending.suggestions(docs_of(s, d), 480000, banned=("th\\w*",)))


@query
def trending_rising(spark, sf_dir):
    rows = beacons(spark, sf_dir)
    return trending.rising(rows, rows.agg(F.max("hour")).first()[0])


@query
def rate_limit(spark, sf_dir):
    """Five searches of a visitor group in six hours from the first one on."""
    rows = beacons(spark, sf_dir).withColumn("who", F.col("visitor")).withColumn("visitor", F.col("visitor") % 3)
    return trending.rate_limited(rows, 5, 6 * 3600).select(F.col("who").alias("visitor"), "event_id")


@query
def trending_list(spark, sf_dir):
    rows = beacons(spark, sf_dir)
    return long(trending.trending_list(rows, docs_of(spark, sf_dir), rows.agg(F.max("hour")).first()[0], "view", 12), "place")


named("beacon_normalised", lambda s, d: read(s, d, "conversations").select("conv_id", "turn", trending.counted_query(F.col("text"), ("idiot", "scum\\w*")).alias("query")))
named("trend_visitor_hash", lambda s, d: read(s, d, "events").select("event_id", trending.visitor_hash(F.to_date("ts").cast("string"), F.col("user_id").cast("string"), F.col("event_type")).alias("visitor")))
named("trend_retention", lambda s, d: trending.retained(trending.hourly(beacons(s, d)), 474000, 8).agg(F.count("*").alias("kept")))


# continuous and federated
@query
def saved_percolate(spark, sf_dir):
    saved = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("saved_id"), F.slice(tokens(F.col("text")), 1, 3).alias("words"))
    return fed.percolate(saved, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), "text"))


@query
def seen_diff(spark, sf_dir):
    found = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("watch")).agg(F.array_sort(F.collect_set(F.concat("event_type", F.lit("-"), (F.col("event_id") % 7).cast("string")))).alias("urls"))
    return fed.unseen(found.withColumn("seen", F.filter("urls", lambda u: u < "e"))).select("watch", F.array_join("new", ",").alias("new"))


@query
def url_dedupe_union(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("position"), "url")
    return fed.url_union([pages.where("position % 2 = 0"), pages]).select("url_key", "step", "position")


def web_requests(spark, sf_dir):
    """Requests made of events, with what the own index, the cache and the providers have for them."""
    e, i = F.col("event_id"), F.col("i")
    rows = read(spark, sf_dir, "events").select(
        e.alias("req"), F.concat(F.lit("q"), e % 40).alias("q"), (2 + e % 4).alias("limit"), F.element_at(F.array(*map(F.lit, ("quick", "standard", "deep"))), (e % 3 + 1).cast("int")).alias("depth"),
        F.lit("any").alias("freshness"), F.lit(None).cast("string").alias("site"), (F.col("user_id") % 4 != 0).alias("signed_in"), e.alias("seq"))
    url = lambda head, number: F.concat(F.lit(f"https://{head}"), number, F.lit(".example/"))
    own = rows.where("req % 3 > 0").select("req", F.explode(F.sequence(F.lit(0), F.col("req") % 3 - 1)).alias("i")).select("req", i.alias("position"), url("o", (F.col("req") + i) % 5).alias("url"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("published"))
    made = lambda n, head, number: F.transform(F.slice(F.array(*(F.lit(x).cast("long") for x in range(4))), F.lit(1), n.cast("int")), lambda i: F.struct(url(head, number(i)).alias("url"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("published")))
    r = F.col("req")
    kinds = {"exchange": (r % 5 != 0, 0.002, made(r % 4, "o", lambda i: (r + 2 * i) % 7)), "deepseek": (r % 2 == 0, 0.001, made(F.lit(2), "d", lambda i: i)), "wikipedia": (F.lit(True), 0.0, made(F.lit(1), "w", lambda i: r % 9))}
    answers = None
    for step, (ok, cost, results) in kinds.items():
        one = rows.select("req", F.lit(step).alias("step"), ok.alias("ok"), F.lit(cost).alias("cost_usd"), results.alias("results"))
        answers = one if answers is None else answers.unionByName(one)
    cache = rows.where("q in ('q0', 'q10', 'q20', 'q30')").select("q", "freshness", "site").distinct().select(ladder.step_key("exchange").alias("key"), made(F.lit(2), "c", lambda i: i).alias("results"))
    return rows, own, answers, cache


def climbed(spark, sf_dir):
    calls = spark.createDataFrame([("exchange", 3), ("deepseek", 0)], "step string, calls long")
    return ladder.run(*web_requests(spark, sf_dir), calls, jobs._folder(spark, "ladder"), cap=1200)


named("web_ladder", lambda s, d: long(climbed(s, d)[0], "position").select("req", "step", "position", "url_key"))
named("web_ladder_explain", lambda s, d: climbed(s, d)[1].select("req", "step", "ok", F.col("count").cast("long").alias("count"), "skipped", "cached", "cost_usd"))


@query
def scope_groups(spark, sf_dir):
    scopes = spark.createDataFrame([("videos", "vod", 0), ("people", "channel", 1), ("shop", "offer", 2)], "scope string, type string, ordinal int")
    return long(fed.scope_groups(vis.visible(docs_of(spark, sf_dir), Viewer()), scopes, 20), "position")


def code_rows(spark, sf_dir, *more):
    """Matches made of conversations, with more columns of the same rows: positions of two sources may be equal, so they are no key."""
    c = F.col
    return read(spark, sf_dir, "conversations").select(
        F.when(c("role") == "user", c("conv_id") * 1000 + c("turn")).otherwise(10_000_000 + c("conv_id") * 1000 + c("turn")).alias("position"), c("role").alias("source"),
        F.concat(F.when(c("conv_id") % 2 == 0, "R").otherwise("r"), (c("conv_id") % 20).cast("string")).alias("repo"), F.when(c("conv_id") % 5 != 0, F.concat(F.lit("c"), (c("conv_id") % 2).cast("string"))).alias("ref"),
        F.concat(F.lit("f"), (c("conv_id") % 7).cast("string")).alias("path"), F.when(c("conv_id") % 11 != 0, "link").alias("permalink"),
        (c("conv_id") % 100).alias("stars"), c("turn").alias("line"), F.when(c("conv_id") % 3 != 0, F.concat(F.lit("l"), (c("conv_id") % 4).cast("string"))).alias("licence"), F.when(c("turn") % 2 == 1, "py").alias("language"), c("conv_id").alias("last_commit"), *more)


@query
def code_lines(spark, sf_dir):
    """Files that several rows are about, their lines merged, and those around a match, one a row."""
    c = F.col
    line = lambda k: F.struct((c("turn") + k).cast("int").alias("number"), F.concat("role", F.lit("-"), c("conv_id"), F.lit(f"-{k}")).alias("text"), ((c("turn") + k + c("conv_id")) % 6 == 0).alias("match"))
    rows = code_rows(spark, sf_dir, F.array(*(line(k) for k in (0, 1, 5))).alias("lines"), c("turn").cast("int").alias("line_start"), (c("turn") + 5).cast("int").alias("line_end"))
    merged = fed.merged_lines(rows.withColumn("path", F.concat("path", F.lit("-"), c("last_commit") % 3)))
    near = fed.lines_around(merged)
    return near.select("repo", F.coalesce("ref", F.lit("")).alias("ref"), "path", "line_start", "line_end", F.inline("lines")).select("repo", "ref", "path", "line_start", "line_end", "number", "text", "match")


named("code_merge", lambda s, d: fed.code_merge(code_rows(s, d)).withColumn("sources", F.array_join("sources", ",")))
named("code_filters", lambda s, d: fed.code_filter(fed.code_merge(code_rows(s, d)), "PY", "R1", "L1").select("repo", "ref", "path"))


@query
def code_streams(spark, sf_dir):
    """Event-stream responses made of conversations, read as matches."""
    c = F.col
    match = F.to_json(F.array(F.struct(F.lit("content").alias("type"), F.concat(F.lit("r"), c("conv_id")).alias("repository"), F.concat(F.lit("f"), c("turn")).alias("path"), F.when(c("turn") % 4 != 3, "c1").alias("commit"), (c("conv_id") % 9).alias("repoStars"), F.array(F.struct(F.lit("x").alias("line"), c("turn").alias("lineNumber"))).alias("lineMatches"))))
    texts = read(spark, sf_dir, "conversations").select(F.concat(F.lit("event: progress\ndata: {}\n\nevent: matches\ndata: "), match, F.lit("\n\nevent: done\ndata: {}\n\n\nevent: matches\ndata: [{")).alias("text"))
    return fed.stream_matches(texts).select("repo", "path", "stars", F.col("lines")[0].cast("long").alias("line"))


@query
def code_grep(spark, sf_dir):
    c = F.col
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(c("turn") % 3 != 2, F.concat(F.lit("a/b"), c("conv_id"), F.lit(".py:"), c("turn"), F.lit(":x: y"))).otherwise(F.lit("binary file matches")).alias("line"))
    return fed.grep_rows(rows).select("conv_id", "turn", "path", F.col("number").cast("long").alias("number"), "text")


@query
def code_fragments(spark, sf_dir):
    """Where the third line of a text stands in it."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), "text", F.get(F.split("text", "\n"), F.lit(2)).alias("part")).where("part <> ''")
    return rows.select("rid", fed.fragment_lines(F.col("text"), F.col("part"))[0].cast("long").alias("line"))


named("code_repos", lambda s, d: fed.newest_repos(read(s, d, "part").select(F.col("p_name").alias("full_name"), (F.col("p_size") % 2 == 0).alias("private"), F.col("p_partkey").alias("pushed_at"))).select("full_name", "pushed_at"))
named("provider_scores", lambda s, d: fed.provider_rows(read(s, d, "conversations").select("conv_id", F.col("turn").alias("position"), F.lit(8).alias("n"))).select("conv_id", "position", "score"))
named("source_quota", lambda s, d: fed.quota(read(s, d, "events").select((F.col("user_id") % 4).alias("source"), (F.unix_millis(F.col("ts").cast("timestamp")) / 600).cast("long").alias("at"), F.col("event_id").alias("call_id")), 3).where("allowed").select("call_id"))
named("answer_costs", lambda s, d: fed.answer_costs(read(s, d, "events").select(F.col("user_id").alias("answer"), (F.col("event_type") != "error").alias("answered"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 7 / 4).alias("cost"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("ms"))))


@query
def model_usage(spark, sf_dir):
    """Tokens and cost of each answer's model calls; some receipts are missing or no numbers."""
    e = F.col("event_id")
    return fed.usage(read(spark, sf_dir, "events").select(F.col("user_id").alias("answer"), F.when(e % 4 != 0, (e % 900).cast("string")).otherwise("many").alias("tokens_in"), F.when(e % 3 != 0, e % 70).alias("tokens_out"), F.when(e % 5 != 0, e % 7 / 8).alias("cost_usd")))


@query
def provider_counters(spark, sf_dir):
    """Stored counters of the first half of the calls, with the second half added."""
    rows = read(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), F.col("event_type").alias("provider"), (F.col("user_id") % 3 != 0).alias("answered"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 50).alias("ms"), (F.col("event_id") % 8 / 4).alias("cost"))
    none = spark.createDataFrame([], "day date, provider string, calls long, answered long, ms double, cost double")
    return fed.provider_added(fed.provider_added(none, rows.where("event_id % 2 = 0")), rows.where("event_id % 2 = 1"))


@query
def trend_lifetimes(spark, sf_dir):
    """How many rows of each kind are still kept at the newest hour."""
    rows = beacons(spark, sf_dir)
    now = rows.agg(F.max("hour")).first()[0]
    kinds = {"trends": trending.hourly(rows), "visitors": rows.select("day", "query", "visitor").distinct(), "salts": rows.select("day").distinct(), "telemetry": rows}
    parts = [trending.living(df, kind, now).agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, df in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def snippet_html(spark, sf_dir):
    match = Match(("the",))
    return search.snippet(docs_of(spark, sf_dir), top(spark, sf_dir, match), match).select("rid", search.snippet_html(F.concat(F.lit("<i> & "), "snippet")).alias("html"))


@query
def web_filters(spark, sf_dir):
    """Web results of a site and of a time; undated ones stay."""
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 4 != 0, F.col("page_id") % 60).alias("day"))
    return rows.where(fed.fresh_enough(30, 59) & fed.on_site(host(F.col("url")), "example.com")).select("page_id")


@query
def code_context(spark, sf_dir):
    lines = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.array_contains(tokens(F.col("text")), "the").alias("match"))
    return fed.code_context(lines).select("file", "line").distinct()


@query
def provider_stats(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("provider"), F.col("value").alias("ms"), (F.col("user_id") % 3 != 0).alias("answered"))
    return fed.provider_stats(calls)


@query
def bench_metrics(spark, sf_dir):
    """Nearest-rank percentiles, hit rate and mean reciprocal rank of each run."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("value").alias("ms"), (F.col("user_id") % 12).alias("place"))
    exact = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY ms)")
    hit = F.when(F.col("place").between(1, 10), 1.0).otherwise(0.0)
    return rows.groupBy("run").agg(exact(0.5).alias("p50"), exact(0.95).alias("p95"), F.round(F.avg(hit), 6).alias("hit10"), F.round(F.avg(F.when(F.col("place") > 0, 1.0 / F.col("place")).otherwise(0.0)), 6).alias("mrr"))


@query
def offer_catalogue(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("offers"), F.countDistinct("l_suppkey").alias("sellers"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query
def source_health(spark, sf_dir):
    ok = F.when(F.col("event_type") == "view", True).when(F.col("event_type") == "error", False)
    rows = fed.failure_runs(read(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.struct("ts", "event_id").alias("at"), ok.alias("ok")))
    return rows.withColumn("enabled", F.col("source") % 11 != 0).withColumn("configured", F.col("source") % 7 != 0).select("source", fed.source_health().alias("health"))


@query
def context_packing(spark, sf_dir):
    """Ranked files of one code answer until the limits; of all documents a top-k leaves as many as can be packed."""
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), F.col("n_chars").alias("chars"))
    order = F.desc("chars"), F.asc("rid")
    return long(fed.packed(vector.ranked(files.orderBy(*order).limit(12), *order), 12, 60000).select("rid", "position"), "position")


@query
def saved_upsert(spark, sf_dir):
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.concat(F.lit("n"), (e % 9).cast("string")).alias("name"), F.concat(F.lit(" Q  "), (e % 40).cast("string"), F.lit(" ")).alias("q"), e.alias("at"))
    return saved.upsert(rows, 12)


@query
def query_cache(spark, sf_dir):
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(saved.cache_key(F.concat(F.lit("Q "), (e % 500).cast("string")), F.col("event_type")).alias("key"), e.alias("value"), (e + (e % 7) * 300).alias("expires_at"), e.alias("stored_at"))
    return saved.cache_get(rows, F.lit(900)).select("key", "value")


named("dashboard_totals", lambda s, d: saved.totals(vis.visible(docs_of(s, d), Viewer())))
named("session_queries", lambda s, d: saved.sessions(beacons(s, d)))


@query
def code_rank(spark, sf_dir):
    c = F.col
    rows = read(spark, sf_dir, "conversations").select(F.concat(F.lit("r"), c("conv_id").cast("string")).alias("repo"), F.concat(F.lit("f"), c("turn").cast("string")).alias("path"), (c("conv_id") % 100).alias("stars"), (c("conv_id") % 13).alias("last_commit"), F.array(F.coalesce("text", F.lit(""))).alias("matches"))
    return fed.code_rank(rows, "where is The the thered").select("repo", "path", "stars", "exact")


# documents at the door, queues and accounts
@query
def envelope_documents(spark, sf_dir):
    """Signed envelopes made of events: what becomes of each, and the document it holds."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "wiki.index_document.deleted").when(F.col("event_type") == "view", "wiki.page.viewed").otherwise("wiki.index_document.upserted")
    id_ = F.concat(F.lit("d"), e % 900)
    body = F.to_json(F.struct(e.cast("string").alias("event_id"), kind.alias("event_type"), F.lit(1).alias("version"), F.when(F.col("user_id") % 4 == 0, "shop").otherwise("wiki").alias("source"),
                              F.struct(F.lit("page").alias("type"), F.when(e % 10 == 3, "x").otherwise(id_).alias("id"), e.alias("revision")).alias("subject"), F.struct(F.lit("wiki").alias("owner"), F.lit("page").alias("type"), id_.alias("id"), F.concat(F.lit("T "), e).alias("title")).alias("payload")))
    rows = read(spark, sf_dir, "events").select(e, body.alias("body")).withColumn("signature", F.when(e % 17 == 0, "0").otherwise(hmac_sha256(F.col("body"), b"secret")))
    return ingest.envelopes(rows, b"secret", ["wiki"]).groupBy("outcome", "deleted").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum("revision").alias("revisions"), F.min("title").alias("title"))


named("signatures", lambda s, d: read(s, d, "conversations").select("conv_id", "turn", hmac_sha256(F.col("text"), b"k1").alias("signature")))


def with_sets(spark, sf_dir):
    """The documents with an acl of sets and a map of facets."""
    r = F.col("rid")
    acl = F.struct(F.array("subject", F.concat(F.lit("u"), r % 3), F.col("subject")).alias("subjects"), F.when(r % 4 != 0, F.array("grp")).alias("groups"), F.array("entitlement").alias("entitlements"))
    facets = F.create_map(F.lit("tag"), F.array(F.concat(F.lit("t"), r % 7), F.concat(F.lit("t"), r % 5)), F.lit("lang"), F.array("lang"))
    return docs_of(spark, sf_dir).withColumns({"acl": acl, "facets": facets})


named("acl_pairs", lambda s, d: vis.acl_pairs(with_sets(s, d)))
named("acl_sets_visible", lambda s, d: with_sets(s, d).where((F.col("exposure") == 1) & vis.acl_allows_sets(Viewer("u2", ("g1",), ("e1",)))).select("rid"))
named("facet_map_pairs", lambda s, d: vis.facet_map_pairs(with_sets(s, d)))


@query
def facet_bitmap_filter(spark, sf_dir):
    """Documents with one of two tags in one of two languages, from bitmaps."""
    docs = with_sets(spark, sf_dir)
    return facets.rids(facets.matching(facets.build(docs), {"tag": ["t1", "t2"], "lang": ["en", "de"]}))


@query
def facet_bitmap_counts(spark, sf_dir):
    """Facet counts of a search's result set, from bitmaps."""
    docs = with_sets(spark, sf_dir)
    found = search.search_set(docs, Match(("the",)), profile=FIXED)
    return facets.counts(facets.build(docs), found, ["tag", "lang", "none"])


@query
def facet_numbers(spark, sf_dir):
    """The first number among the values of a facet of each document."""
    r = F.col("rid")
    values = F.array(F.when(r % 3 == 0, "many").otherwise((r % 50).cast("string")), (r % 9 + 0.5).cast("string"), F.lit("-4"))
    docs = index_documents(spark, sf_dir).select("rid", F.create_map(F.lit("price"), values, F.lit("name"), F.array("owner")).alias("facets"))
    return facets.numbers(docs, ["price", "name"])


@query
def document_errors(spark, sf_dir):
    """Documents with planted faults, and what is said of each."""
    c = F.col
    docs = index_documents(spark, sf_dir).withColumns({"owner": F.when(c("rid") % 7 == 0, "Not Ok").otherwise(c("owner")), "revision": F.when(c("rid") % 11 == 0, -1).otherwise(c("revision")), "canonical_url": F.when(c("rid") % 13 == 0, "ftp://x").otherwise(c("canonical_url")), "title": F.when(c("rid") % 17 == 0, None).otherwise(c("title"))})
    return docs.withColumn("e", ingest.errors()).where(F.size("e") > 0).select("rid", F.array_join(F.transform("e", lambda x: F.concat(x["path"], F.lit(" "), x["message"])), ",").alias("errors"))


named("document_lookup", lambda s, d: index_documents(s, d).where("owner = 'src11' and type = 'vod' and id = '151'").select("rid", "revision"))
named("path_identity", lambda s, d: index_documents(s, d).select("rid", ingest.same_identity(("src11", "vod", "151")).alias("same")))


@query
def delete_requests(spark, sf_dir):
    """Tombstones of delete requests: the revision asked for, the stored one, or 0."""
    asked_ = read(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("key"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("revision")).distinct()
    return ingest.deletions(asked_, ingest.latest(revision_log(spark, sf_dir)))


def purge_queue(spark, sf_dir):
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(e.alias("seq"), (F.col("user_id") % 5).alias("zone"), F.when(e % 4 == 0, "done").otherwise("pending").alias("state"), (e * 7919 % 10007).alias("due_at"))


named("purge_due", lambda s, d: long(ingest.purge_batches(ingest.purge_due(purge_queue(s, d), 5000)), "batch").select("seq", "zone", "batch"))
named("purge_counts", lambda s, d: ingest.purge_counts(purge_queue(s, d), 5000))
named("owner_feed", lambda s, d: ingest.feed(read(s, d, "events").select(F.col("event_type").alias("owner"), F.col("event_id").alias("seq"), "user_id"), "click", 300, 50).select("seq", "user_id"))
named("removal_reasons", lambda s, d: docs_of(s, d).where("exposure < 3").select("rid", ingest.removal_reason().alias("reason")))
named("indexed_since", lambda s, d: vis.visible(docs_of(s, d), Viewer()).where("sort_at > '2024-10-01'").agg(F.count("*").alias("n")))
named("saved_due", lambda s, d: saved.due(read(s, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 31 % 997).alias("last_run_at"), (F.col("event_id") * 17 % 1009).alias("created_at")), 25).select("id"))
named("account_export", lambda s, d: saved.exported({"saved": saved.upsert(saved_rows(s, d), 12)}, "u7")["saved"].select("hash", "created_at"))
named("account_erase", lambda s, d: saved.erased(saved.upsert(saved_rows(s, d), 12), s.createDataFrame([("u7",), ("u9",)], "subject string")).groupBy("subject").agg(F.count("*").alias("n")))


def saved_rows(spark, sf_dir):
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("subject"), F.lit("n").alias("name"), F.concat(F.lit("q"), (e % 40).cast("string")).alias("q"), e.alias("at"))


@query
def outbox_relay(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 1000).alias("at"))
    return saved.relayed(rows, rows.where("id % 3 <> 0"), 2_000_000, 20, 500_000).select("id", "state")


@query
def cache_prune(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select((F.col("event_id") % 700).alias("key"), F.col("event_id").alias("value"), (F.col("event_id") + 4000).alias("expires_at"), F.col("event_id").alias("stored_at"))
    return saved.cache_put(rows.where("value < 6000"), rows.where("value >= 6000"), 12_800).select("key", "value")


@query
def saved_notify(spark, sf_dir):
    """One tick of saved searches: what is notified, and the watermarks after it."""
    e = F.col("event_id")
    saved_ = read(spark, sf_dir, "events").where("event_id < 60").select(e.alias("id"), F.when(e % 2 == 0, e * 100).alias("last_run_at"), (e * 50).alias("created_at"))
    matches = read(spark, sf_dir, "events").select((e % 60).alias("saved_id"), e.alias("rid"), e.alias("at"))
    sent, after = saved.notified(saved_, matches, spark.range(60).where("id % 7 = 0").withColumnRenamed("id", "saved_id"), 20_000)
    return after.join(sent.select(F.col("saved_id").alias("id"), "n", F.col("rids")[0].alias("first")), "id", "left").select("id", "last_run_at", "n", "first")


@query
def web_watch(spark, sf_dir):
    """One tick of web watches: baselines, news, nothing new."""
    e = F.col("event_id")
    found = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("watch")).agg(F.array_sort(F.collect_set(F.concat("event_type", F.lit("-"), (e % 7).cast("string")))).alias("urls"))
    watches = found.select("watch", F.when(F.col("watch") % 5 == 0, F.array().cast("array<string>")).when(F.col("watch") % 5 == 1, F.col("urls")).otherwise(F.filter("urls", lambda u: u < "e")).alias("seen"))
    return saved.watched(watches, found, 20).select("watch", "outcome", F.array_join("new", ",").alias("new"), F.size("seen_after").cast("long").alias("n_seen"))


named("guarded_casts", lambda s, d: read(s, d, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"), parse_time(F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("string")).when(F.col("event_id") % 3 == 1, F.lit("2024-05-01T10:00:00Z")).otherwise(F.lit("soon"))).alias("at")))
named("cleaned_texts", lambda s, d: read(s, d, "documents").select(F.col("doc_id").alias("rid"), F.sha2(clean_text(F.concat(F.lit(" \u0007"), "text", F.lit("\u0085 "))), 256).alias("hash")))
named("seen_urls", lambda s, d: read(s, d, "pages").select("page_id", saved.base64url(F.sha2("url", 256), 16).alias("seen_key")))


@query
def hybrid_rerank(spark, sf_dir):
    rows = search.search_set(docs_of(spark, sf_dir), Match(("the", "of")), profile=FIXED)
    order = (F.asc("rank"), F.desc("importance"), F.desc("recency"), F.asc("rid"))
    first = search.page(rows, 100)
    fused = vector.rrf(vector.ranked(first, *order), vector.ranked(nearest(spark, sf_dir), F.asc("distance"), F.asc("rid")))
    return long(vector.hybrid_rerank(fused, first).where("position <= 50").select("rid", "position"), "position")


SECRET = b"delivery secret"


def deliveries(spark, sf_dir):
    """The documents as a stream of signed deliveries: each upsert twice, an older revision after it, deletions, forged and invalid ones."""
    rows = table_stream(spark, sf_dir, "documents").selectExpr(*(f"{v} AS {k}" for k, v in FIELDS.items()))
    c = F.col
    at = lambda column: F.when(c(column).rlike("^[0-9]"), F.concat(column, F.lit("T00:00:00Z")))
    whole = F.struct(
        "owner", "type", "id", "revision", "visibility", F.when(c("canonical_url").isNotNull(), c("canonical_url")).alias("canonical_url"), F.when(c("rid") % 13 != 0, F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), F.substring(F.coalesce("body", F.lit("")), 1, 48000).alias("body"),
        F.struct("followers", c("duration").alias("duration_seconds"), "live").alias("facets"), c("lang").alias("language"), "publication_state", at("published_at").alias("published_at"), at("updated_at").alias("updated_at"),
        F.array(F.struct(F.lit("sources").alias("service"), F.lit("item").alias("type"), "id", "stub")).alias("provenance"), F.struct("decision").alias("indexability"))
    gone = F.struct("type", "id", "revision")

    def event(n, payload, kind="upserted", back=0):
        told = F.to_json(F.struct(F.struct(
            F.concat(F.lit("evt_"), F.lpad((c("rid") * 8 + n).cast("string"), 26, "0")).alias("event_id"), F.concat("owner", F.lit(f".index_document.{kind}")).alias("event_type"), c("owner").alias("source"),
            F.struct("type", "id", (c("revision") - back).alias("revision")).alias("subject"), payload.alias("payload")).alias("event")))
        return F.struct((c("rid") * 8 + n).alias("arrival"), told.alias("body"), F.lit(SECRET if n != 4 else b"forged").alias("key"))

    older = whole.withField("revision", c("revision") - 1)
    newer = whole.withField("title", F.lit("the of forged"))
    sent = F.array_compact(F.array(event(1, whole), event(1, whole), F.when(c("rid") % 7 == 0, event(2, older, back=1)), F.when(c("deleted"), event(3, gone, "deleted")), F.when(c("rid") % 11 == 0, event(4, newer))))
    flat = rows.select(F.explode(sent).alias("x")).select("x.*")
    t = CLOCK // 1000
    signed = lambda key: hmac_sha256(F.concat(F.lit(f"{t}."), "body"), key)
    return flat.select("arrival", F.lit(CLOCK).alias("received_at"), "body", F.concat(F.lit(f"t={t},v2="), F.when(c("key") == F.lit(SECRET), signed(SECRET)).otherwise(signed(b"forged"))).alias("signature"), F.lit(None).cast("string").alias("timestamp"))


def ingested(spark, sf_dir):
    accepted = read(spark, sf_dir, "documents").select(F.col("source").alias("owner"))
    return stream_ingest.start(deliveries(spark, sf_dir), jobs._folder(spark, "ingest"), [SECRET], accepted)


@query
def stream_index(spark, sf_dir):
    """Signed deliveries to documents to the segmented index, and a page of it, by the documents' own ids."""
    store = ingested(spark, sf_dir)
    rows = store.open().top(20, Match(("the", "of")), profile=FIXED)[0]
    found = spark.createDataFrame([tuple(r) for r in rows], "rank double, importance long, recency string, rid long")
    return found.join(store.documents().select("rid", F.col("id").cast("long").alias("id")), "rid").select("id", "rank", "importance", F.substring("recency", 1, 10).alias("recency"))


@query
def stream_documents(spark, sf_dir):
    """What the same job keeps of each document, and how many of its events came to what."""
    store = ingested(spark, sf_dir)
    kept = store.documents().select(F.col("id").cast("long").alias("id"), "revision", "deleted", "exposure")
    events = store.outcomes().groupBy(F.col("id").cast("long").alias("id")).agg(F.count("*").alias("events"), F.count_if(F.col("outcome") == "applied").alias("applied"), F.count_if(F.col("outcome") == "stale").alias("stale"), F.count_if(F.col("outcome").startswith("rejected")).alias("rejected"))
    return events.join(kept, "id", "left")


@query
def watch_stream(spark, sf_dir):
    """Saved queries over the stream of documents: what each is told, and its watermark after it."""
    rows = table_stream(spark, sf_dir, "documents").selectExpr(*(f"{v} AS {k}" for k, v in FIELDS.items()))
    changes = vis.with_exposure(rows).select("rid", (1000 + F.col("rid") % 400).alias("at"), F.col("body").alias("text"), "exposure", "visibility", F.array("subject").alias("subjects"))
    i = F.col("item_id")
    saved_ = read(spark, sf_dir, "benchmark").select(i.cast("string").alias("saved_id"), F.concat(F.lit("u"), i % 5).alias("subject"), F.slice(tokens(F.col("text")), 1, 3).alias("words"), (1000 + i % 300).alias("created_at"))
    watch = watching.Watch(spark, jobs._folder(spark, "watch"))
    watch.index(saved_, search.term_df(docs_of(spark, sf_dir)))
    watch.run(changes, lambda told: told.where("false").select("saved_id"))
    told = watch.notifications().select("saved_id", "n", F.col("rids")[0].alias("first"))
    return watch.watermarks().join(told, "saved_id", "left").select(F.col("saved_id").cast("long").alias("saved_id"), "watermark", "n", "first")


@query
def stream_beacons(spark, sf_dir):
    """Search beacons made of events: what was counted of each hour, site and query, and how many people searched it that day."""
    e = F.col("event_id")
    rows = table_stream(spark, sf_dir, "events")
    sent = rows.select(
        e, (F.lit(CLOCK) + e * 20_000).alias("at"), F.when(e % 19 == 0, F.lit("me@x.example")).otherwise(F.concat(F.lit(" Red  "), e % 23, F.lit("! "))).alias("q"), F.when(e % 3 == 0, F.lit("https://www.a.example/x")).alias("origin"),
        F.when(e % 7 == 0, F.lit("other.example")).otherwise(F.lit("b.example")).alias("site"), F.concat(F.lit("10.0.0."), F.col("user_id") % 60).alias("address"), F.lit("agent").alias("agent"), (e % 17 == 0).alias("opt_out"))
    store = beacon_job.start(sent, jobs._folder(spark, "beacons"), ["a.example", "b.example"])
    people = store.visitors().groupBy("day", "query").agg(F.count("*").alias("people"))
    return store.trends().withColumn("day", F.floor(F.col("hour") / 24)).join(people, ["day", "query"]).select("hour", "site", "query", "shown", "n", "people")


named("stream_trend_hourly", jobs.trend_hourly)
named("stream_inbox", jobs.inbox)
named("stream_revision_merge", jobs.revision_merge)
named("stream_visitors", jobs.visitors)
named("stream_rate_limit", jobs.rate_limit)
named("stream_percolate", jobs.percolation)
named("stream_exposure_feed", jobs.exposure_feed)
