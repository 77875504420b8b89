"""Saved searches, the query cache, and what the start page counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import clean


def base64url(hex_digest: Column, length: int | None = None) -> Column:
    text = F.translate(F.base64(F.unhex(hex_digest)), "+/=\r\n", "-_")
    return F.substring(text, 1, length) if length else text


def query_hash(*parts: Column) -> Column:
    """Identity of a saved query: its normalised text and filters."""
    return base64url(F.sha2(F.concat_ws("\u0001", *(F.lower(clean(p)) for p in parts)), 256), 22)


def upsert(rows: DataFrame, limit: int = 50) -> DataFrame:
    """(subject, name, q, at) in any order -> one row for each subject and query: first time, last name; the oldest `limit`."""
    keyed = rows.withColumn("hash", query_hash(F.col("q")))
    one = keyed.groupBy("subject", "hash").agg(F.min("at").alias("created_at"), F.max_by("name", F.struct("at", "name")).alias("name"))
    w = Window.partitionBy("subject").orderBy("created_at", "hash")
    return one.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def advanced(saved: DataFrame, runs: DataFrame) -> DataFrame:
    """Watermarks after runs (id, at): they never go back."""
    last = runs.groupBy("id").agg(F.max("at").alias("at"))
    return saved.join(last, "id", "left").withColumn("last_run_at", F.greatest(F.coalesce("last_run_at", F.lit(0)), F.coalesce("at", F.lit(0)))).drop("at")


def due(saved: DataFrame, most: int) -> DataFrame:
    """Those that have waited longest."""
    return saved.orderBy(F.coalesce("last_run_at", "created_at"), "id").limit(most)


def cache_key(*parts: Column) -> Column:
    return base64url(F.sha2(F.concat_ws("\u0001", *(F.lower(clean(p)) for p in parts)), 256))


def cache_get(cache: DataFrame, now: Column | int) -> DataFrame:
    """The newest entry of each key, if it has not expired."""
    newest = cache.groupBy("key").agg(F.max_by(F.struct("value", "expires_at"), "stored_at").alias("x")).select("key", "x.*")
    return newest.where(F.col("expires_at") > now)


def totals(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.countDistinct("owner").alias("owners"), F.countDistinct("type").alias("kinds"))


def sessions(beacons: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Searches of a visitor without a longer pause (an extension; also usable on a stream)."""
    return beacons.groupBy("visitor", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("visitor", F.unix_timestamp("w.start").alias("start"), "n")


def cache_put(cache: DataFrame, fresh: DataFrame, now: int) -> DataFrame:
    """The cache after answers are put in: one entry a key, the last stored, expired ones pruned."""
    every = cache.unionByName(fresh)
    return every.groupBy("key").agg(F.max_by(F.struct("value", "expires_at", "stored_at"), "stored_at").alias("x")).select("key", "x.*").where(F.col("expires_at") > now)


def exported(tables: dict[str, DataFrame], subject: str) -> dict[str, DataFrame]:
    """What is kept of a person: their rows of each table, latest first."""
    return {name: t.where(F.col("subject") == subject).orderBy(F.desc("created_at")) for name, t in tables.items()}


def erased(table: DataFrame, subjects: DataFrame) -> DataFrame:
    """A table without the rows of people whose accounts are deleted."""
    return table.join(subjects.select("subject").distinct(), "subject", "left_anti")


def relayed(outbox: DataFrame, acknowledged: DataFrame, now: int, most: int = 100, keep_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """(id, state, at): what an outbox sends next (send), and what it forgets (prune): entries acknowledged and old enough."""
    done = outbox.join(acknowledged.select("id").withColumn("_ok", F.lit(True)), "id", "left")
    send = done.where("_ok is null").orderBy("id").limit(most).select("id", F.lit("send").alias("state"), "at")
    return send.unionByName(done.where(F.col("_ok") & (F.col("at") <= now - keep_ms)).select("id", F.lit("prune").alias("state"), "at"))


def notified(saved: DataFrame, matches: DataFrame, failed: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """One tick of continuous queries: (notifications (saved_id, n, rids), saved with new watermarks).

    Matches count when they are newer than the query's watermark; one notification a query and tick; a query whose push failed
    keeps its watermark, so the same matches are found again.
    """
    fresh = matches.join(saved.select(F.col("id").alias("saved_id"), F.coalesce("last_run_at", "created_at").alias("_since")), "saved_id").where(F.col("at") > F.col("_since"))
    once = fresh.select("saved_id", "rid").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("saved_id").orderBy("rid"))).where("_n <= 50")  # ranked before they are gathered
    sent = fresh.groupBy("saved_id").agg(F.count("*").alias("n")).join(once.groupBy("saved_id").agg(F.array_sort(F.collect_list("rid")).alias("rids")), "saved_id")
    runs = saved.join(failed.select(F.col("saved_id").alias("id")), "id", "left_anti").select("id", F.lit(at).cast("long").alias("at"))
    return sent.join(failed.select("saved_id"), "saved_id", "left_anti"), advanced(saved, runs)


def watched(watches: DataFrame, found: DataFrame, most: int = 300) -> DataFrame:
    """One tick of web watches: (watch, outcome, new, seen_after). The first tick with results is the baseline and notifies nothing."""
    rows = watches.select("watch", "seen").join(found.select("watch", "urls"), "watch", "left").withColumn("urls", F.array_distinct(F.coalesce("urls", F.array().cast("array<string>"))))
    fresh = F.array_except("urls", "seen")
    outcome = F.when(F.size("seen") == 0, "baseline").when(F.size(fresh) > 0, "notified").otherwise("unchanged")
    return rows.select("watch", outcome.alias("outcome"), F.when(F.size("seen") > 0, fresh).otherwise(F.array().cast("array<string>")).alias("new"), F.slice(F.concat(fresh, "seen"), 1, most).alias("seen_after"))
