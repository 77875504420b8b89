"""Revision-ordered merge, receipts, rejections, exposure changes and purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import clean_text, hmac_sha256, host
from quarry.schema import ID, LANGUAGE, MAX_BODY, MAX_SUMMARY, MAX_TITLE, MAX_URL, OWNER, TYPE


def errors() -> Column:
    """What is wrong with a document, as (path, message), in the order of the fields; a tombstone needs an identity and a revision alone."""
    c = F.col
    live = ~F.coalesce(c("deleted"), F.lit(False))
    checks = [
        (~F.coalesce(c("owner").rlike(OWNER), F.lit(False)), "/owner", "malformed"), (~F.coalesce(c("type").rlike(TYPE), F.lit(False)), "/type", "malformed"), (~F.coalesce(c("id").rlike(ID), F.lit(False)), "/id", "malformed"),
        (~F.coalesce(c("revision").between(0, (1 << 53) - 1), F.lit(False)), "/revision", "out of range"),
        (live & c("title").isNull(), "/title", "required"), (live & (F.char_length("title") > MAX_TITLE), "/title", "too long"), (live & (F.char_length("summary") > MAX_SUMMARY), "/summary", "too long"), (live & (F.char_length("body") > MAX_BODY), "/body", "too long"),
        (live & ((F.char_length("canonical_url") > MAX_URL) | ~c("canonical_url").rlike("^https?://")), "/canonical_url", "malformed"),
        (live & ~F.coalesce(c("visibility").isin("public", "unlisted", "members", "private", "draft"), F.lit(False)), "/visibility", "not allowed"),
        (live & ~F.coalesce(c("publication_state").isin("published", "unpublished"), F.lit(False)), "/publication_state", "not allowed"),
        (live & ~F.coalesce(c("decision").isin("index", "noindex"), F.lit(False)), "/indexability/decision", "not allowed"), (live & ~c("lang").rlike(LANGUAGE), "/language", "malformed")]
    return F.slice(F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(said).alias("message"))) for bad, path, said in checks))), 1, 20)


def same_identity(path: tuple[str, str, str]) -> Column:
    """Whether a body's identity, where it has one, is the path's."""
    return F.col("owner").eqNullSafe(path[0]) & F.col("type").eqNullSafe(path[1]) & F.col("id").eqNullSafe(path[2])


def content_hash(facets: list[tuple[str, str]]) -> Column:
    """sha256 of the canonical form: JSON with sorted keys, nulls kept, texts without control characters, sets sorted. facets: (key, column), sorted."""
    c, text = F.col, lambda x: F.nullif(F.col(x), F.lit(""))
    tomb = F.struct(F.lit(True).alias("deleted"), "id", "owner", "revision", "type")
    acl = F.struct(F.array("entitlement").alias("entitlements"), F.array("grp").alias("groups"), F.array("subject").alias("subjects"))
    whole = F.struct(
        acl.alias("acl"), clean_text(c("body")).alias("body"), text("canonical_url").alias("canonical_url"), F.lit(False).alias("deleted"), F.struct(*(c(col).alias(k) for k, col in facets)).alias("facets"), "id",
        F.struct("decision").alias("indexability"), text("lang").alias("language"), "owner", "publication_state", "revision", clean_text(c("summary")).alias("summary"), clean_text(c("title")).alias("title"), "type", "visibility")
    keep = {"ignoreNullFields": "false"}
    return F.sha2(F.when(c("deleted"), F.to_json(tomb, keep)).otherwise(F.to_json(whole, keep)), 256)


def deletions(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Delete requests (key, revision or null) -> tombstones: the revision given, else the stored one, else 0."""
    have = stored.select("key", F.col("revision").alias("_have"))
    return requests.join(have, "key", "left").select("key", F.coalesce("revision", "_have", F.lit(0)).cast("long").alias("revision"), F.lit(True).alias("deleted"))


def outcomes(log: DataFrame) -> DataFrame:
    """Adds outcome to (arrival, key, revision, deleted, content): what a sequential fold by key would decide.

    The stored pair (revision, deleted) is the running maximum, so what an event meets is a framed maximum, and the content
    stored for a pair is that of its first arrival.
    """
    by_key = Window.partitionBy("key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    by_pair = Window.partitionBy("key", "revision", "deleted").orderBy("arrival")
    pair = F.struct("revision", "deleted")
    rows = log.withColumn("_prev", F.max(pair).over(by_key)).withColumn("_first", F.first("content").over(by_pair))
    outcome = (
        F.when(F.col("_prev").isNull() | (F.col("_prev") < pair), "applied")
        .when((F.col("revision") < F.col("_prev.revision")) | (F.col("_prev.deleted") & ~F.col("deleted")), "stale")
        .when(F.col("content") == F.col("_first"), "unchanged").otherwise("conflict"))
    return rows.withColumn("outcome", outcome).drop("_prev", "_first")


def latest(log: DataFrame) -> DataFrame:
    """The stored state: per key the highest revision, a tombstone over a live row, then the first arrival."""
    best = F.min_by(F.struct("revision", "deleted", "content"), F.struct(-F.col("revision"), (~F.col("deleted")).cast("int"), "arrival"))
    return log.groupBy("key").agg(best.alias("x")).select("key", "x.*")


def inbox(events: DataFrame, receipts: DataFrame | None = None) -> DataFrame:
    """Each event once: those without a receipt, first arrival of an event_id."""
    rows = events.join(receipts.select("event_id"), "event_id", "left_anti") if receipts is not None else events
    return rows.groupBy("event_id").agg(F.min_by(F.struct(*(c for c in events.columns if c != "event_id")), "arrival").alias("x")).select("event_id", "x.*")


def envelope_outcome() -> Column:
    """What becomes of an envelope: ignored, rejected with a reason, or accepted."""
    c = F.col
    kind = F.regexp_extract("event_type", r"^([a-z][a-z0-9-]*)\.index_document\.(upserted|deleted)$", 1)
    return (
        F.when(kind == "", "ignored").when(kind != c("source"), "owner_mismatch").when(~c("accepted"), "owner_not_accepted")
        .when((c("subject_type") != c("type")) | (c("subject_id") != c("id")), "subject_mismatch")
        .when(~(c("owner").rlike(OWNER) & c("type").rlike(TYPE) & c("id").rlike(ID)) | (c("revision") < 0), "invalid_document").otherwise("accepted"))


#: What an envelope holds; the payload's own fields are read where the event is one of a document.
ENVELOPE = "event_id string, event_type string, version int, source string, subject struct<type:string,id:string,revision:long>, payload struct<owner:string,type:string,id:string,revision:long,title:string,visibility:string,publication_state:string>"


def envelopes(events: DataFrame, key: bytes, accepted: list[str]) -> DataFrame:
    """Signed envelopes (body, signature) -> (event_id, outcome, owner, type, id, revision, deleted, title).

    A body whose signature is wrong, or that is no envelope, is refused unread; a deletion takes its identity and revision alone.
    """
    good = F.lower("signature").eqNullSafe(hmac_sha256(F.col("body"), key))
    rows = events.select(good.alias("good"), F.from_json("body", ENVELOPE).alias("e")).select("good", "e.*")
    flat = rows.select(
        "good", "event_id", "event_type", "source", F.col("source").isin(accepted).alias("accepted"), F.col("subject.type").alias("subject_type"), F.col("subject.id").alias("subject_id"), F.col("subject.revision").alias("subject_revision"),
        F.col("payload.owner").alias("owner"), F.col("payload.type").alias("type"), F.col("payload.id").alias("id"), F.coalesce("payload.revision", "subject.revision").alias("revision"), F.col("payload.title").alias("title"))
    outcome = F.when(~F.col("good"), "bad_signature").when(F.col("event_id").isNull() | F.col("event_type").isNull(), "malformed").otherwise(envelope_outcome())
    deleted = F.col("event_type").endswith(".deleted")
    kept = lambda c: F.when(F.col("outcome") == "accepted", F.col(c))
    return flat.withColumn("outcome", outcome).withColumn("deleted", deleted).select(F.when(F.col("good"), F.col("event_id")).alias("event_id"), "outcome", *(kept(c).alias(c) for c in ("owner", "type", "id", "revision", "deleted")), F.when(~F.col("deleted"), kept("title")).alias("title"))


def removal_reason() -> Column:
    return F.when(F.col("deleted"), "deleted").when(F.col("visibility") == "draft", "draft").when(F.col("publication_state") != "published", "not_published").when(F.col("visibility") != "public", "visibility_changed").otherwise("noindex")


def exposure_changes(versions: DataFrame) -> DataFrame:
    """Applied versions (key, revision, exposure) -> events: removed where exposure fell, indexed where it is above none."""
    w = Window.partitionBy("key").orderBy("revision")
    rows = versions.withColumn("previous", F.coalesce(F.lag("exposure").over(w), F.lit(0)))
    removed = rows.where("exposure < previous").select("key", "revision", F.lit("removed").alias("event"), "previous", "exposure")
    indexed = rows.where("exposure > 0").select("key", "revision", F.lit("indexed").alias("event"), "previous", "exposure")
    return removed.unionByName(indexed)


def purge_urls(urls: DataFrame, zones: DataFrame, related: list[str]) -> DataFrame:
    """(url) x zones (zone, suffix) -> (url, zone, state): the page and its related paths, once per zone; longest suffix wins.

    Hosts are exploded into their suffixes and equi-joined, so a zone list of any size is a hash join.
    """
    page = F.regexp_replace("url", "#.*$", "")
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    every = urls.where("url is not null").select(F.explode(F.array_distinct(F.concat(F.array(page), *[F.array(F.concat(origin, F.lit(p))) for p in related]))).alias("url")).distinct()
    parts = F.split(host(F.col("url")), r"\.")
    suffixes = every.select("url", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"))
    best = suffixes.join(zones, "suffix").groupBy("url").agg(F.max_by("zone", F.struct(F.char_length("suffix"), "zone")).alias("zone"))
    return every.join(best, "url", "left").select("url", "zone", F.when(F.col("zone").isNull(), "skipped").otherwise("pending").alias("state"))


# Seconds to wait after each failed attempt; the eighth failure is final.
BACKOFF = (2, 10, 60, 300, 900, 1800, 3600)


def purge_due(queue: DataFrame, now: int, most: int = 200) -> DataFrame:
    """Pending entries whose time has come, oldest first."""
    return queue.where((F.col("state") == "pending") & (F.col("due_at") <= now)).orderBy("seq").limit(most)


def purge_batches(due: DataFrame, most: int = 30) -> DataFrame:
    """Adds batch: at most so many URLs of a zone go in one request."""
    return due.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("zone").orderBy("seq")) - 1) / most).cast("int"))


def purge_counts(queue: DataFrame, now: int) -> DataFrame:
    """(state, n, due): how many are in each state, and how many of them are due."""
    return queue.groupBy("state").agg(F.count("*").alias("n"), F.count_if((F.col("state") == "pending") & (F.col("due_at") <= now)).alias("due"))


def feed(rows: DataFrame, owner: str, after: int, most: int) -> DataFrame:
    """An owner's removals or rejections behind a sequence number; one more than asked for says whether there are more."""
    return rows.where((F.col("owner") == owner) & (F.col("seq") > after)).orderBy("seq").limit(most + 1)


def purge_step(rows: DataFrame) -> DataFrame:
    """(url, attempts, batch, status) after a response -> next state and delay in seconds (null status: network error)."""
    retry = F.col("status").isNull() | F.col("status").isin(408, 429) | (F.col("status") >= 500)
    tries = F.col("attempts") + 1
    ok = F.col("status").between(200, 299)
    state = F.when(ok, "done").when(retry & (tries >= 8), "failed").when(retry, "pending").when(F.col("batch") > 1, "isolate").otherwise("failed")
    delay = F.when(~F.coalesce(ok, F.lit(False)) & retry & (tries < 8), F.element_at(F.array(*(F.lit(x) for x in BACKOFF)), F.least(tries, F.lit(7)).cast("int")))
    return rows.select("url", tries.alias("attempts"), state.alias("state"), delay.alias("delay"))
