"""Continuous queries over a stream of changed documents: an index of saved queries, watermarks and pending matches as kept state.

Saved queries are indexed by their rarest word, in a folder; a batch of changed documents meets that index, and what a query's
subject may see and has not been told of is one notification a query and batch. The watermark of a query moves when its
notification was taken; if it was not, the query keeps its watermark and its matches are kept with it and told next time. A
batch that runs again, after a loss before or after the push, tells the same under the same tick, so that a receiver that
knows (saved_id, tick) takes it once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import federation
from quarry.schema import LISTED, RESTRICTED

from .jobs import Latest, complete, run_batches

MOST_RIDS, MOST_SEEN = 50, 300
MATCH = "saved_id string, rid long, at long"
WATERMARK = "key string, watermark long"
SEEN = "key string, seen array<string>, at long"


class Watch:
    """Saved searches (saved_id, subject, words, created_at) over changed documents (rid, at, text, exposure, visibility, subjects)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.state = Latest(spark, f"{self.folder}/watermarks")

    def index(self, saved: DataFrame, df: DataFrame) -> None:
        """Writes the index of saved queries; df (term, df) of the documents there are."""
        rows = federation.percolation_index(saved, df).join(saved.select("saved_id", "subject", "created_at"), "saved_id")
        rows.repartitionByRange("term").sortWithinPartitions("term", "saved_id").write.mode("overwrite").parquet(f"{self.folder}/index")

    def pending(self, before: int) -> DataFrame:
        done = [n for n in complete(self.spark, f"{self.folder}/pending") if n < before]
        return self.spark.read.schema(MATCH).parquet(f"{self.folder}/pending/batch={done[-1]}") if done else self.spark.createDataFrame([], MATCH)

    def tick(self, changes: DataFrame, n: int, push: Callable[[DataFrame], DataFrame]) -> None:
        """One batch. push (notifications: saved_id, subject, tick, n, rids) -> (saved_id) of those that were not taken."""
        spark, place = self.spark, lambda name: f"{self.folder}/{name}/batch={n}"
        saved = spark.read.parquet(f"{self.folder}/index")
        known = self.state.read(WATERMARK, n).withColumnRenamed("key", "saved_id")
        since = saved.select("saved_id", "subject", "created_at").join(known, "saved_id", "left").select("saved_id", "subject", F.coalesce("watermark", "created_at").alias("since"))
        held = federation.held_words(changes, saved.select(F.explode("words").alias("word")))
        found = federation.met(saved.select("term", "saved_id", "words"), held)
        rows = found.join(changes.select("rid", "at", "exposure", "visibility", "subjects"), "rid").join(since, "saved_id")
        may = (F.col("exposure") == LISTED) | ((F.col("exposure") == RESTRICTED) & F.coalesce(F.array_contains("subjects", F.col("subject")), F.lit(False)))
        fresh = rows.where(may & (F.col("at") > F.col("since"))).select("saved_id", "rid", "at")
        kept = self.pending(n).join(changes.select("rid"), "rid", "left_anti").join(saved.select("saved_id"), "saved_id", "left_semi")  # a document that came again is judged as it is now
        fresh.unionByName(kept.select("saved_id", "rid", "at")).write.mode("overwrite").parquet(place("matches"))
        matches = spark.read.schema(MATCH).parquet(place("matches"))
        first = matches.withColumn("_n", F.row_number().over(Window.partitionBy("saved_id").orderBy(F.desc("at"), "rid"))).where(F.col("_n") <= MOST_RIDS)  # ranked before they are gathered
        listed = first.groupBy("saved_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "rid"))), lambda x: x["rid"]).alias("rids"))
        told = matches.groupBy("saved_id").agg(F.count("*").alias("n")).join(listed, "saved_id").join(since.select("saved_id", "subject"), "saved_id")
        told.select("saved_id", "subject", F.lit(n).alias("tick"), "n", "rids").write.mode("overwrite").parquet(place("notifications"))
        failed = push(spark.read.parquet(place("notifications"))).select("saved_id").distinct()
        failed.write.mode("overwrite").parquet(place("failed"))
        failed = spark.read.schema("saved_id string").parquet(place("failed"))
        matches.join(failed, "saved_id", "left_semi").write.mode("overwrite").parquet(place("pending"))
        now = changes.agg(F.max("at")).first()[0]
        moved = since.join(failed, "saved_id", "left_anti").where(F.lit(now) > F.col("since")) if now is not None else since.where("false")
        self.state.write(moved.select(F.col("saved_id").alias("key"), F.lit(now).cast("long").alias("watermark")), n)

    def watermarks(self) -> DataFrame:
        return self.state.read(WATERMARK).withColumnRenamed("key", "saved_id")

    def notifications(self) -> DataFrame:
        done = complete(self.spark, f"{self.folder}/watermarks")
        return self.spark.read.parquet(*(f"{self.folder}/notifications/batch={n}" for n in done))

    def run(self, changes: DataFrame, push: Callable[[DataFrame], DataFrame], every: str | None = None) -> None:
        run_batches(changes, self.folder, lambda batch, n: self.tick(batch, n, push), every)


class WebWatch:
    """Web watches and what each has seen: the first run with results is a baseline, later ones tell what is new; a failed run changes nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.state = spark, Latest(spark, f"{folder.rstrip('/')}/seen")
        self.folder = folder.rstrip("/")

    def due(self, watches: DataFrame, now: int, every: int, most: int) -> DataFrame:
        """The watches (watch) whose last run is old enough, those that have waited longest first."""
        last = self.state.read(SEEN).select(F.col("key").alias("watch"), F.col("at").alias("_at"))
        return watches.join(last, "watch", "left").where(F.coalesce(F.col("_at") <= now - every, F.lit(True))).orderBy(F.coalesce("_at", F.lit(0)), "watch").limit(most).drop("_at")

    def tick(self, found: DataFrame, n: int, now: int, push: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """found (watch, urls, failed): a run's results, and whether a step failed -> (watch, outcome, new), written as tick n.

        push (watch, tick, new) -> (watch) of those that were not taken: they keep what they had seen and are due again.
        """
        have = self.state.read(SEEN, n).select(F.col("key").alias("watch"), "seen")
        rows = found.join(have, "watch", "left").withColumns({"urls": F.array_distinct(F.coalesce("urls", F.array().cast("array<string>"))), "seen": F.coalesce("seen", F.array().cast("array<string>"))})
        fresh = F.array_except("urls", "seen")
        outcome = F.when((F.size("urls") == 0) & F.col("failed"), "failed").when(F.size("seen") == 0, "baseline").when(F.size(fresh) > 0, "notified").otherwise("unchanged")
        rows.select("watch", outcome.alias("outcome"), F.when(outcome == "notified", fresh).otherwise(F.array().cast("array<string>")).alias("new"), F.slice(F.concat(fresh, "seen"), 1, MOST_SEEN).alias("after")).write.mode("overwrite").parquet(f"{self.folder}/runs/batch={n}")
        runs = self.spark.read.parquet(f"{self.folder}/runs/batch={n}")
        failed = push(runs.where("outcome = 'notified'").select("watch", F.lit(n).alias("tick"), "new")).select("watch").distinct()
        failed.write.mode("overwrite").parquet(f"{self.folder}/failed/batch={n}")
        failed = self.spark.read.schema("watch string").parquet(f"{self.folder}/failed/batch={n}")
        done = runs.where("outcome <> 'failed'").join(failed, "watch", "left_anti")
        self.state.write(done.select(F.col("watch").alias("key"), F.col("after").alias("seen"), F.lit(now).cast("long").alias("at")), n)
        return runs.join(failed.withColumn("_f", F.lit(True)), "watch", "left").select("watch", F.when(F.col("_f"), "failed").otherwise(F.col("outcome")).alias("outcome"), "new")
