"""Signed events in, documents and a searchable index out, as one running job.

Envelopes are verified, seen once by their id (state that never expires: a delivery may come again after any time), read, checked and
normalised without shuffling; then a key's rows meet its state (keyed.py). Each batch writes, under its number, what it
brought: outcomes, refusals, announcements, purges, the documents as they are now, and a segment of the index. A batch counts
when its commit is written, last of all; readers see committed batches alone. A batch that runs again, after a loss anywhere,
meets the same state and writes the same rows over, so effects and receipts are one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import hmac_sha256
from quarry.operators import documents, ingest
from quarry.operators.segments import SegmentedIndex, commit, versions

from . import keyed
from .jobs import run_batches

# How far a signature's time may be from the delivery's; the form of event types and ids.
TOLERANCE_S = 300
EVENT_TYPE, EVENT_ID = r"^([a-z][a-z0-9-]{1,39})\.index_document\.(upserted|deleted)$", r"^evt_[0-9A-HJKMNP-TV-Z]{26}$"
#: What a refusal keeps of the identity that the payload gives.
CLIP_TYPE, CLIP_ID, CLIP_DETAIL = 40, 128, 1000
EXPOSURES = ("none", "restricted", "public_unlisted", "public_listed")
ENVELOPE = "event_id string, event_type string, source string, subject struct<type:string,id:string,revision:long>, payload string"


def verified(body: Column, header: Column, timestamp: Column, received_at: Column, keys: list[bytes]) -> Column:
    """Whether a header `t=<seconds>,v2=<hex>...` signs `<t>.<body>` with one of the keys, and t is near the delivery (ms) and what the timestamp header says."""
    parts = F.transform(F.split(header, ","), lambda p: F.trim(p))
    times = F.filter(parts, lambda p: p.startswith("t="))
    given = F.transform(F.filter(parts, lambda p: p.startswith("v2=")), lambda p: F.substring(p, 4, 1 << 20))
    t = F.substring(F.get(times, F.lit(0)), 3, 1 << 20)
    shaped = (F.size(times) == 1) & t.rlike(r"^\d{1,12}$") & (F.size(given) > 0) & F.forall(parts, lambda p: p.contains("="))
    near = F.abs(received_at / 1000 - t.try_cast("long")) <= TOLERANCE_S
    same = timestamp.isNull() | (F.trim(timestamp) == t)
    signed = [F.array_contains(given, hmac_sha256(F.concat(t, F.lit("."), body), k)) for k in keys]
    any_ = signed[0] if signed else F.lit(False)
    for s in signed[1:]:
        any_ = any_ | s
    return F.coalesce(shaped & near & same & any_, F.lit(False))


def received(deliveries: DataFrame, keys: list[bytes]) -> DataFrame:
    """Deliveries (arrival, received_at, body, signature, timestamp) that are verified -> (arrival, event_id, event), those that have an event id.

    Unsigned or forged deliveries, and those without an event id, leave no trace, as they may not claim an id.
    """
    good = deliveries.where(verified(F.col("body"), F.col("signature"), F.col("timestamp"), F.col("received_at"), keys))
    rows = good.select("arrival", F.get_json_object("body", "$.event").alias("event")).select("arrival", F.from_json("event", "event_id string")["event_id"].alias("event_id"), "event")
    return rows.where(F.coalesce(F.col("event_id").rlike(EVENT_ID), F.lit(False)))


def read(events: DataFrame, accepted: list[str] | DataFrame) -> DataFrame:
    """Events as received() gives them -> one row each with its outcome so far; accepted: owners, as a list or as rows (owner), each once.

    (arrival, event_id, event_type, outcome or null where the document is to be merged, detail, key, owner, type, id, revision, deleted,
    hash, doc as JSON).
    """
    rows = events.select("arrival", F.from_json("event", ENVELOPE).alias("e"))
    if isinstance(accepted, DataFrame):
        may = accepted.select(F.col("owner").alias("_owner"))
        rows = rows.join(may, F.col("e.source") == F.col("_owner"), "left").select("arrival", "e", F.col("_owner").isNotNull().alias("may"))
    else:
        rows = rows.withColumn("may", F.coalesce(F.col("e.source").isin(accepted), F.lit(False)))
    kind = F.regexp_extract("e.event_type", EVENT_TYPE, 1)
    gone = F.col("e.event_type").endswith(".deleted")
    told = documents.parsed(F.coalesce("e.payload", F.lit("{}")))
    rows = rows.select("arrival", "e", "may", kind.alias("kind"), gone.alias("gone"), told.alias("told"), documents.misshapen(F.coalesce("e.payload", F.lit("{}"))).alias("shape"))
    rows = rows.withColumn("doc", F.when(F.col("gone"), _tombstone("told")).otherwise(F.col("told")))
    rows = rows.withColumn("doc", F.col("doc").withField("owner", F.col("e.source")))
    errors = F.concat(F.when(F.col("gone"), F.array().cast("array<struct<path:string,message:string>>")).otherwise(F.col("shape")), documents.problems("doc"))
    c = F.col
    other = lambda a, b: ~F.coalesce(a == b, F.lit(False))
    outcome = (
        F.when(F.coalesce(c("kind"), F.lit("")) == "", "ignored").when(other(c("kind"), c("e.source")), "rejected:owner_mismatch").when(~c("may"), "rejected:owner_not_accepted")
        .when(c("told.owner").isNotNull() & (c("told.owner") != c("e.source")), "rejected:owner_mismatch")
        .when(other(c("e.subject.type"), c("doc.type")) | other(c("e.subject.id"), c("doc.id")) | (c("e.subject.revision") != c("doc.revision")), "rejected:subject_mismatch")
        .when(F.size(errors) > 0, "rejected:invalid_document"))
    detail = F.when(outcome == "rejected:invalid_document", F.substring(F.array_join(F.transform(errors, lambda x: F.concat(x["path"], F.lit(" "), x["message"])), "; "), 1, CLIP_DETAIL))
    rows = rows.withColumns({"outcome": outcome, "detail": detail}).withColumn("doc", F.when(F.col("outcome").isNull(), documents.normalised("doc")))
    key = F.concat_ws("/", "doc.owner", "doc.type", "doc.id")
    return rows.select(
        "arrival", F.col("e.event_id").alias("event_id"), F.col("e.event_type").alias("event_type"), "outcome", "detail", F.when(F.col("outcome").isNull(), key).otherwise(F.concat(F.lit("event:"), "e.event_id")).alias("key"),
        F.coalesce("doc.owner", "e.source").alias("owner"), F.substring(F.coalesce("doc.type", "told.type"), 1, CLIP_TYPE).alias("type"), F.substring(F.coalesce("doc.id", "told.id"), 1, CLIP_ID).alias("id"), F.coalesce("doc.revision", "told.revision").alias("revision"),
        F.coalesce("doc.deleted", F.lit(False)).alias("deleted"), F.col("outcome").isNotNull().alias("skip"), F.when(F.col("outcome").isNull(), documents.hashed("doc")).alias("hash"), F.when(F.col("outcome").isNull(), F.to_json("doc")).alias("doc"))


def _tombstone(told: str) -> Column:
    """A document that holds an identity, a revision, and that it is deleted."""
    own = lambda f: F.lit(True) if f.name == "deleted" else F.col(f"{told}.{f.name}") if f.name in ("type", "id", "revision") else F.lit(None)
    return F.struct(*(own(f).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(documents.DOCUMENT).fields))


def merged(rows: DataFrame) -> DataFrame:
    """A batch's rows with their key's state before it -> the same with the outcome that taking them one by one would give, and rid.

    What a row meets is the greater of the stored pair and the greatest pair of the rows before it; the text that a pair was stored
    with is the state's, or that of the pair's first row.
    """
    pair, had = F.struct("revision", "deleted"), F.when(F.col("had_revision").isNotNull(), F.struct(F.col("had_revision").alias("revision"), F.col("had_deleted").alias("deleted")))
    todo = rows.where("not skip")
    by_key = Window.partitionBy("key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    by_pair = Window.partitionBy("key", "revision", "deleted").orderBy("arrival")
    todo = todo.withColumn("_had", had).withColumn("_prev", F.greatest("_had", F.max(pair).over(by_key))).withColumn("_first", F.when(F.col("_had") == pair, F.col("had_hash")).otherwise(F.first("hash").over(by_pair)))
    outcome = (
        F.when(F.col("_prev").isNull() | (F.col("_prev") < pair), "applied")
        .when((F.col("revision") < F.col("_prev.revision")) | (F.col("_prev.deleted") & ~F.col("deleted")), "stale")
        .when(F.col("hash") == F.col("_first"), "unchanged").otherwise("conflict"))
    todo = todo.withColumn("outcome", outcome).withColumn("rid", F.coalesce("had_rid", F.min("arrival").over(Window.partitionBy("key")))).drop("_had", "_prev", "_first")
    return todo.unionByName(rows.where("skip").withColumn("rid", F.lit(None).cast("long")))


def announced(applied: DataFrame) -> DataFrame:
    """Applied rows with exposure and had_exposure, ... -> events, one or two a row: removed where exposure fell, indexed where it is above none."""
    w = Window.partitionBy("key").orderBy("arrival")
    known = lambda c: F.coalesce(F.lag(c).over(w), F.when(F.row_number().over(w) == 1, F.col(f"had_{c}")))
    rows = applied.withColumns({"previous": F.coalesce(known("exposure"), F.lit(0)), "_url": known("canonical_url"), "_seen": known("visibility"), "reindexed": (F.row_number().over(w) > 1) | F.col("had_revision").isNotNull()})
    rows = rows.withColumn("_draft", F.get_json_object("doc", "$.visibility") == "draft").withColumn("_state", F.get_json_object("doc", "$.publication_state"))
    reason = F.when(F.col("deleted"), "deleted").when(F.col("_draft"), "draft").when(~F.col("_state").eqNullSafe("published"), "not_published").when(F.col("reindexed") & ~F.col("_seen").eqNullSafe(F.col("visibility")), "visibility_changed").otherwise("noindex")
    level = lambda c: F.element_at(F.array(*map(F.lit, EXPOSURES)), F.col(c) + 1)
    columns = ["arrival", "rid", "owner", "type", "id", "revision"]
    gone = rows.where("exposure < previous").select(*columns, F.lit("removed").alias("event"), reason.alias("reason"), level("previous").alias("previous_exposure"), level("exposure").alias("exposure"), F.when(F.col("previous") >= 2, F.col("_url")).alias("canonical_url"), F.lit(None).cast("boolean").alias("reindexed"))
    here = rows.where("exposure > 0 and not deleted").select(*columns, F.lit("indexed").alias("event"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("previous_exposure"), level("exposure").alias("exposure"), F.when(F.col("exposure") >= 2, F.col("canonical_url")).alias("canonical_url"), "reindexed")
    return gone.unionByName(here)


@dataclass
class Store:
    """What the job has committed, in a folder."""

    spark: SparkSession
    folder: str

    def batches(self) -> list[int]:
        return versions(self.spark, f"{self.folder}/commits")

    def _read(self, name: str) -> DataFrame | None:
        paths = [f"{self.folder}/{name}/batch={n}" for n in self.batches()]
        parts = [self.spark.read.parquet(p).withColumn("batch", F.lit(n)) for n, p in zip(self.batches(), paths, strict=True)]
        out = parts[0] if parts else None
        for df in parts[1:]:
            out = out.unionByName(df)
        return out

    def outcomes(self) -> DataFrame:
        """(arrival, event_id, outcome, ...) of every event that was taken."""
        return self._read("outcomes")

    def rejections(self) -> DataFrame:
        return self.outcomes().where(F.col("outcome").startswith("rejected:")).select("arrival", "event_id", "event_type", "owner", "type", "id", "revision", F.expr("substring(outcome, 10)").alias("code"), "detail")

    def announcements(self) -> DataFrame:
        return self._read("announcements")

    def purges(self) -> DataFrame:
        return self._read("purges")

    def documents(self) -> DataFrame:
        """The last committed row of each key, tombstones too: rid, key, revision, deleted, hash, doc (JSON)."""
        rows = self._read("documents")
        return rows.groupBy("key").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "key")), "batch").alias("x")).select("key", "x.*")

    def searchable(self) -> DataFrame:
        """The documents as search takes them."""
        return searched(self.documents())

    def index(self) -> SegmentedIndex:
        return SegmentedIndex(self.spark, f"{self.folder}/index")

    def open(self):
        """The index as of the last committed batch."""
        done = self.batches()
        return self.index().open(done[-1]) if done else None


def searched(rows: DataFrame) -> DataFrame:
    """Rows (rid, doc as JSON) with every column that search reads."""
    held = rows.withColumn("_d", F.from_json("doc", documents.DOCUMENT)).select("rid", documents.normalised("_d").alias("doc"))
    return documents.derived(held)


def start(deliveries: DataFrame, folder: str, keys: list[bytes], accepted: list[str] | DataFrame, zones: DataFrame | None = None, related: tuple[str, ...] = (), every: str | None = None) -> Store:
    """Runs the job over a stream of deliveries until what is there is done, or again and again; started again it goes on where it was.

    accepted: the owners that may send, as a list or, however many, as rows (owner).
    """
    spark = deliveries.sparkSession
    store = Store(spark, folder)
    if isinstance(accepted, DataFrame):  # found once, not in each batch; as a stored table its size is known, and it is broadcast only where it is small
        accepted.select("owner").where("owner is not null").distinct().write.mode("overwrite").parquet(f"{folder}/accepted")
        accepted = spark.read.parquet(f"{folder}/accepted")
    exposed = _exposed(read(received(deliveries, keys).dropDuplicates(["event_id"]), accepted))  # an event is parsed and checked once, in the tasks that it is dealt to
    stream = keyed.before(exposed, "key", ["hash", "exposure", "visibility", "canonical_url"])

    def handle(batch: DataFrame, n: int) -> None:
        place = lambda name: f"{folder}/{name}/batch={n}"
        batch.write.mode("overwrite").parquet(place("log"))  # the state is read once; all that follows reads this
        merged(spark.read.parquet(place("log"))).write.mode("overwrite").parquet(place("outcomes"))
        taken = spark.read.parquet(place("outcomes"))
        applied = taken.where("outcome = 'applied'")
        announced(applied).write.mode("overwrite").parquet(place("announcements"))
        w = Window.partitionBy("key").orderBy(F.desc("revision"), F.desc("deleted"))
        now = applied.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("key", "rid", "owner", "type", "id", "revision", "deleted", "hash", "exposure", "doc", "event_id")
        now.write.mode("overwrite").parquet(place("documents"))
        if zones is not None:
            gone = spark.read.parquet(place("announcements")).where("event = 'removed' and canonical_url is not null").select(F.col("canonical_url").alias("url"))
            urls = ingest.purge_urls(gone, zones, list(related))
            waiting = [m for m in store.batches() if m < n]
            if waiting:  # one pending entry for each zone and URL
                queued = spark.read.parquet(*(f"{folder}/purges/batch={m}" for m in waiting)).where("state = 'pending'").select("url", "zone")
                urls = urls.where("state <> 'pending'").unionByName(urls.where("state = 'pending'").join(queued, ["url", "zone"], "left_anti"))
            urls.write.mode("overwrite").parquet(place("purges"))
        rows = searched(spark.read.parquet(place("documents"))).persist(StorageLevel.DISK_ONLY)  # the index reads them more than once
        try:
            store.index().apply(rows, n)
        finally:
            rows.unpersist()
        commit(spark, f"{folder}/commits", n, {"batch": n})

    with keyed.rocksdb(spark):
        run_batches(stream, folder, handle, every)
    return store


def _exposed(rows: DataFrame) -> DataFrame:
    """Adds exposure, visibility and canonical_url of the document, row by row."""
    held = rows.withColumn("_d", F.from_json("doc", documents.DOCUMENT)).select(*(F.col(c).alias(f"_row_{c}") for c in rows.columns), documents.normalised("_d").alias("doc"))
    exposure = F.when(~F.col("_row_skip"), F.col("exposure")).alias("exposure")
    return documents.derived(held).select(*(F.col(f"_row_{c}").alias(c) for c in rows.columns), exposure, "visibility", "canonical_url")
