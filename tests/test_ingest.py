"""Signed events to documents and index: signatures, refusals, order of revisions, replays at every point of loss."""

import hashlib
import hmac
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.operators import documents, search, segments
from quarry.schema import Filters, Match, Profile, Viewer
from quarry.streaming import ingest, keyed

NOW, KEY = 1_780_000_000_000, b"first secret"
USER = "usr_" + "0" * 25 + "1"
SHAPE = "arrival long, received_at long, body string, signature string, timestamp string"
PROFILE = Profile(now=NOW)


def event_id(n):
    return "evt_" + f"{n:026d}"


def doc(i, **more):
    return {"owner": "wiki", "type": "page", "id": f"p{i}", "revision": 1, "visibility": "public", "canonical_url": f"https://wiki.example/p/{i}", "title": f"Title word{i}", "summary": "a summary", "body": f"the body of {i}", "publication_state": "published", "published_at": "2026-01-02T03:04:05Z", "indexability": {"decision": "index"}} | more


def upsert(n, d, source="wiki", **envelope):
    return {"event_id": event_id(n), "event_type": f"{source}.index_document.upserted", "source": source, "subject": {"type": d.get("type"), "id": d.get("id"), "revision": d.get("revision")}, "payload": d} | envelope


def deletion(n, d, revision):
    return upsert(n, {"type": d["type"], "id": d["id"], "revision": revision}, event_type="wiki.index_document.deleted")


def delivery(arrival, event, key=KEY, at=NOW, t=None, signature=None, timestamp=None):
    body = json.dumps({"event": event}) if isinstance(event, dict) else event
    t = at // 1000 if t is None else t
    signed = signature or f"t={t},v2=" + hmac.new(key, f"{t}.{body}".encode(), hashlib.sha256).hexdigest()
    return (arrival, at, body, signed, timestamp)


def write(spark, folder, batches):
    """A file a batch, in order of time."""
    for i, rows in enumerate(batches):
        path = f"{folder}/.b{i}"
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(path)
        name = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        target = f"{folder}/in/{i:03d}.parquet"
        os.replace(f"{path}/{name}", target)
        os.utime(target, (1_000_000 + i, 1_000_000 + i))


def stream(spark, folder):
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(spark, folder, zones=None, name="job"):
    return ingest.start(stream(spark, folder), f"{folder}/{name}", [b"old", KEY], ["wiki", "news"], zones, ("/sitemap.xml",))


def hits(store, text, viewer=Viewer()):
    s = store.open()
    rids = [r.rid for r in s.top(50, Match(tuple(text.split())), viewer, profile=PROFILE)[0]] if s else []
    keys = {r.rid: (r.key, r.revision) for r in store.documents().collect()}
    return [keys[r] for r in rids]


def fold(events):
    """The rule, one by one."""
    state, out = {}, {}
    for n, key, revision, deleted, content in events:
        have = state.get(key)
        if have is None or revision > have[0] or revision == have[0] and deleted and not have[1]:
            state[key], out[n] = (revision, deleted, content), "applied"
        elif revision < have[0] or have[1] and not deleted:
            out[n] = "stale"
        else:
            out[n] = "unchanged" if content == have[2] else "conflict"
    return state, out


def test_cases(spark, tmp_path):
    """Signatures, refusals, duplicates, order, tombstones, restores; in two batches."""
    folder = str(tmp_path)
    a, b, secret = doc(1), doc(2, title="Order xiword v3 final", revision=3), doc(3, title="Private psiword", visibility="private", acl={"subjects": [USER, USER][:1]})
    first = [
        delivery(1, upsert(1, a)), delivery(2, upsert(1, a)), delivery(3, upsert(2, doc(9, title="forged")), key=b"wrong"), delivery(4, upsert(3, doc(9)), t=NOW // 1000 - 301),
        delivery(5, upsert(4, doc(9)), timestamp="5"), delivery(6, upsert(5, b)), delivery(7, upsert(6, b | {"revision": 1, "title": "Order xiword v1"})), delivery(8, upsert(7, b | {"revision": 2, "title": "Order xiword v2"})),
        delivery(9, upsert(8, b | {"title": "Order xiword another"})), delivery(10, upsert(9, b)), delivery(11, upsert(10, secret)), delivery(12, upsert(11, doc(4), event_type="wiki.page.viewed")),
        delivery(13, upsert(12, doc(5, owner="news"))), delivery(14, upsert(13, doc(5, owner="evil"), source="evil")), delivery(15, upsert(14, doc(6), subject={"type": "page", "id": "other", "revision": 1})),
        delivery(16, upsert(15, doc(7, title=5))), delivery(17, upsert(16, doc(7, extra=1))), delivery(18, upsert(17, {k: v for k, v in doc(7).items() if k != "title"})), delivery(19, "no json"), delivery(20, upsert(18, doc(8)) | {"event_id": "x"}),
        delivery(21, upsert(3, doc(10, title="an id that was forged before"))), delivery(22, upsert(20, doc(11, visibility="draft"))), delivery(23, upsert(21, doc(12), payload="text"))]
    second = [
        delivery(31, upsert(1, a)), delivery(32, deletion(30, b, 3)), delivery(33, upsert(31, b)), delivery(34, upsert(32, b | {"revision": 4, "title": "Order xiword back"})), delivery(35, deletion(33, doc(20), 4)),
        delivery(36, upsert(34, doc(20, revision=3))), delivery(37, deletion(35, a, 2)), delivery(38, upsert(36, secret | {"revision": 2, "visibility": "public"}))]
    write(spark, folder, [first, second])
    zones = spark.createDataFrame([("z1", "wiki.example")], "zone string, suffix string")
    store = run(spark, folder, zones)
    assert store.batches() == [0, 1]
    got = {r.event_id: r.outcome for r in store.outcomes().collect()}
    e = event_id
    want = {1: "applied", 3: "applied", 5: "applied", 6: "stale", 7: "stale", 8: "conflict", 9: "unchanged", 10: "applied", 11: "ignored", 12: "rejected:owner_mismatch", 13: "rejected:owner_not_accepted", 14: "rejected:subject_mismatch",
            15: "rejected:invalid_document", 16: "rejected:invalid_document", 17: "rejected:invalid_document", 20: "applied", 21: "rejected:subject_mismatch", 30: "applied", 31: "stale", 32: "applied", 33: "applied", 34: "stale", 35: "applied", 36: "applied"}
    assert got == {e(n): o for n, o in want.items()}
    details = {r.event_id: (r.code, r.detail) for r in store.rejections().collect()}
    assert details[e(15)] == ("invalid_document", "/title of another kind") and details[e(16)] == ("invalid_document", "/extra unknown") and details[e(17)] == ("invalid_document", "/title required")
    assert hits(store, "xiword") == [("wiki/page/p2", 4)] and hits(store, "word1") == [] and hits(store, "psiword") == [("wiki/page/p3", 2)]
    told = [(r.event, r.id, r.revision, r.reason, r.previous_exposure, r.exposure, r.canonical_url, r.reindexed) for r in store.announcements().orderBy("arrival", "event").collect()]
    url = "https://wiki.example/p/"
    assert told == [
        ("indexed", "p1", 1, None, None, "public_listed", url + "1", False), ("indexed", "p2", 3, None, None, "public_listed", url + "2", False), ("indexed", "p3", 1, None, None, "restricted", None, False),
        ("indexed", "p10", 1, None, None, "public_listed", url + "10", False), ("removed", "p2", 3, "deleted", "public_listed", "none", url + "2", None), ("indexed", "p2", 4, None, None, "public_listed", url + "2", True),
        ("removed", "p1", 2, "deleted", "public_listed", "none", url + "1", None), ("indexed", "p3", 2, None, None, "public_listed", url + "3", True)]
    assert sorted((r.url, r.zone, r.state) for r in store.purges().collect()) == [("https://wiki.example/p/1", "z1", "pending"), ("https://wiki.example/p/2", "z1", "pending"), ("https://wiki.example/sitemap.xml", "z1", "pending")]
    tomb = {r.key: (r.revision, r.deleted) for r in store.documents().where("deleted").collect()}
    assert tomb == {"wiki/page/p20": (4, True), "wiki/page/p1": (2, True)}
    # before the second batch the private document was its subject's alone
    old = store.index().open(0)
    assert len(old.top(5, Match(("psiword",)), Viewer(USER), profile=PROFILE)[0]) == 1 and not old.top(5, Match(("psiword",)), profile=PROFILE)[0]


def many(seed, batches=3, n=60):
    rng, arrival, out, events = random.Random(seed), 0, [], []
    for _ in range(batches):
        rows = []
        for _ in range(n):
            arrival += 1
            i, revision, gone = rng.randrange(15), rng.randrange(1, 6), rng.random() < 0.2
            d = doc(i, revision=revision, title=rng.choice(["alpha one", "alpha two", "beta"]), visibility=rng.choice(["public", "public", "unlisted", "draft"]))
            content = None if gone else json.dumps(d)
            e = deletion(arrival, d, revision) if gone else upsert(arrival, d)
            rows += [delivery(arrival, e)] * rng.choice([1, 1, 2])
            events.append((event_id(arrival), f"wiki/page/p{i}", revision, gone, content))
        out.append(rows)
    return out, events


def check(store, events):
    state, outcomes = fold(events)
    assert {r.event_id: r.outcome for r in store.outcomes().collect()} == outcomes
    rows = store.documents().collect()
    assert {r.key: (r.revision, r.deleted) for r in rows} == {k: v[:2] for k, v in state.items()}
    for r in rows:
        if not r.deleted:
            assert json.loads(r.doc)["title"] == json.loads(state[r.key][2])["title"]
    now = store.searchable()
    want = search.page(search.search_set(now, Match(("alpha",)), profile=PROFILE), 50).select(*search.ORDER).collect()
    assert store.open().top(50, Match(("alpha",)), profile=PROFILE)[0] == want


def test_outcomes_are_the_fold(spark, tmp_path):
    batches, events = many(3)
    write(spark, str(tmp_path), batches)
    check(run(spark, str(tmp_path)), events)


@pytest.mark.parametrize("point", ["outcomes", "index", "commit"])
def test_lost_at_any_point(spark, tmp_path, monkeypatch, point):
    """A run that is lost in its second batch, before or after any write; the next run gives what no loss gives."""
    folder = str(tmp_path)
    batches, events = many(5, 2, 30)
    write(spark, folder, batches)
    armed = {"on": True}

    def fail(*a):
        raise RuntimeError("lost")

    if point == "index":
        true = segments.SegmentedIndex.apply
        monkeypatch.setattr(segments.SegmentedIndex, "apply", lambda self, df, n: (true(self, df, n), fail() if n == 1 and armed["on"] else None))
    elif point == "commit":
        true = ingest.commit
        monkeypatch.setattr(ingest, "commit", lambda s, f, n, c: fail() if n == 1 and armed["on"] else true(s, f, n, c))
    else:
        from pyspark.sql import DataFrameWriter

        true = DataFrameWriter.parquet

        def parquet(self, path, *a, **k):
            out = true(self, path, *a, **k)
            if armed["on"] and path.endswith(f"/{point}/batch=1"):
                fail()
            return out

        monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    with pytest.raises(Exception, match="lost"):
        run(spark, folder)
    store = ingest.Store(spark, f"{folder}/job")
    assert store.batches() == [0]
    check(store, [e for e in events if int(e[0][4:]) <= 30])  # a reader sees the first batch, and all of it
    armed["on"] = False
    check(run(spark, folder), events)


def test_state_follows_the_batch(spark, tmp_path):
    """A small batch after a large one writes little state, and settings of the session are what they were."""
    folder = str(tmp_path)
    write(spark, folder, [[delivery(i, upsert(i, doc(i))) for i in range(1, 1500)], [delivery(9000, upsert(9000, doc(5, revision=2)))]])
    had = {k: spark.conf.get(k, None) for k in keyed.STORE}
    run(spark, folder)
    assert {k: spark.conf.get(k, None) for k in keyed.STORE} == had
    size = {}
    for root, _, files in os.walk(f"{folder}/job/checkpoint/state"):
        for f in files:
            version = f.split(".")[0].split("_")[0]
            if version.isdigit() and not f.startswith("."):
                size[int(version)] = size.get(int(version), 0) + os.path.getsize(f"{root}/{f}")
    assert size[2] < size[1] / 5


def test_problems(spark):
    """Every part of the schema, one fault at a time."""
    good = doc(1, acl={"subjects": [USER], "groups": ["role:admin"], "entitlements": ["vip.plan:x"]}, facets={"tag": ["a", "b"], "n": 5, "live": True, "price": 1.5, "s": "x"}, provenance=[{"service": "sources", "type": "item", "id": "1", "stub": False, "url": "https://a.example/", "retrieved_at": "2026-01-01T00:00:00Z"}])
    faults = [
        ({"owner": "Not Ok"}, "/owner"), ({"type": "A"}, "/type"), ({"id": "-x"}, "/id"), ({"revision": -1}, "/revision"), ({"visibility": "some"}, "/visibility"), ({"publication_state": "new"}, "/publication_state"),
        ({"title": "x" * 501}, "/title"), ({"summary": "x" * 4001}, "/summary"), ({"body": "x" * 48001}, "/body"), ({"canonical_url": "ftp://x"}, "/canonical_url"), ({"language": "english!"}, "/language"), ({"authorship": "cat"}, "/authorship"),
        ({"published_at": "2026-01-02"}, "/published_at"), ({"updated_at": "soon"}, "/updated_at"), ({"acl": {"subjects": ["me"]}}, "/acl/subjects"), ({"acl": {"groups": ["No"]}}, "/acl/groups"), ({"acl": {"entitlements": ["a", "a"]}}, "/acl/entitlements"),
        ({"facets": {"Bad": "x"}}, "/facets"), ({"facets": {"k": "x" * 201}}, "/facets"), ({"facets": {f"k{i}": 1 for i in range(21)}}, "/facets"), ({"provenance": [{"service": "s"}]}, "/provenance"), ({"provenance": [{"service": "sources", "type": "item", "id": "1", "url": "x"}]}, "/provenance"),
        ({"indexability": {"decision": "maybe"}}, "/indexability/decision"), ({"indexability": {"decision": "index", "reasons": ["No"]}}, "/indexability/reasons"), ({"title": 5}, "/title"), ({"facets": [1]}, "/facets"), ({"more": 1}, "/more")]
    rows = [(0, json.dumps(good)), (1, json.dumps({"owner": "wiki", "type": "page", "id": "1", "revision": 3, "deleted": True})), (2, "[1]"), *((10 + i, json.dumps(good | f)) for i, (f, _) in enumerate(faults))]
    df = spark.createDataFrame(rows, "n long, payload string").withColumn("d", documents.parsed(F.col("payload")))
    got = {r.n: [x.path for x in r.e] for r in df.select("n", F.concat(documents.misshapen(F.col("payload")), documents.problems("d")).alias("e")).collect()}
    assert got[0] == [] and got[1] == [] and got[2][0] == "/"
    for i, (_, path) in enumerate(faults):
        assert path in got[10 + i], (faults[i], got[10 + i])


def test_facets_and_sets(spark):
    """Facet values of every kind are texts; the first that reads as a number counts; acl sets decide who sees what."""
    rows = [
        (1, json.dumps(doc(1, facets={"tag": ["b", "a", "b"], "followers": ["x", "9", "10"], "live": True, "price": 1.5}))), (2, json.dumps(doc(2, facets={"followers": 7, "live": False}))), (3, json.dumps(doc(3, facets={"followers": ["-1", "1e3"]}))),
        (4, json.dumps(doc(4, visibility="members", acl={"groups": ["role:a"]}, facets={"tag": ["a"]}))), (5, json.dumps(doc(5, visibility="private", acl={"subjects": [USER], "groups": ["role:a"]})))]
    held = spark.createDataFrame(rows, "rid long, payload string").withColumn("d", documents.parsed(F.col("payload"))).select("rid", documents.normalised("d").alias("doc"))
    out = documents.derived(held).cache()
    assert {r.rid: (r.followers, r.live) for r in out.collect()} == {1: (10, True), 2: (7, False), 3: (0, False), 4: (0, False), 5: (0, False)}
    assert {(r.key, r.value, r["count"]) for r in search.facet_counts(out, ["tag", "price"]).collect()} == {("tag", "a", 2), ("tag", "b", 1), ("price", "1.5", 1)}
    assert {r.rid for r in search.narrowed(out, Filters(facets=(("tag", ("a", "z")), ("price", ("1.5",))))).collect()} == {1}
    found = lambda v: {r.rid for r in search.search_set(out, Match(("the",)), v, profile=PROFILE).collect()}
    assert found(Viewer()) == {1, 2, 3} and found(Viewer("u", ("role:a",))) == {1, 2, 3, 4} and found(Viewer(USER)) == {1, 2, 3, 5}


def test_all_owners_are_accepted(spark, tmp_path):
    """However many sources the documents have, each may send: none is cut from the list."""
    n = 1030
    rows = [(i, f"Title {i}. Summary {i}. the text of {i}", "en", f"source-{i}", 30) for i in range(1, n + 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    store = queries.ingested(spark, str(tmp_path))
    found = {r.outcome: r.n for r in store.outcomes().groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert "rejected:owner_not_accepted" not in found and found["applied"] == sum((i % 13 != 0) + (i % 37 == 0) for i in range(1, n + 1))


def test_keys_share_groups(spark, tmp_path, monkeypatch):
    """A call of the state step takes the rows of many keys, and each still meets its own state and no other."""
    monkeypatch.setattr(keyed, "GROUPS", 3)
    batches, events = many(9)
    write(spark, str(tmp_path), batches)
    check(run(spark, str(tmp_path)), events)


def test_a_payload_is_parsed_once(spark):
    plan = spark.createDataFrame([("{}",)], "payload string").select(documents.parsed(F.col("payload")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 1


def test_the_index_reads_stored_rows(spark, tmp_path, monkeypatch):
    """The documents of a batch are parsed once for all tables of its segment, and are let go after it."""
    seen, true = [], segments.SegmentedIndex.apply
    monkeypatch.setattr(segments.SegmentedIndex, "apply", lambda self, df, n: (seen.append((df, df.storageLevel.useDisk)), true(self, df, n)))
    write(spark, str(tmp_path), many(4, 1, 20)[0])
    run(spark, str(tmp_path))
    assert [stored for _, stored in seen] == [True] and not seen[0][0].storageLevel.useDisk
