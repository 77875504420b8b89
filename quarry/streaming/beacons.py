"""Search beacons in, hourly counts and the people of a day out, in one running job.

A beacon is counted unless its sender opted out, its text may not count (personal, banned, too long), its site is none of ours, or
its visitor has searched too often in the last minute. A visitor is a hash with the salt of the day; a salt is made when its day
begins and deleted a day later, so nothing links two days, and what comes later than that is not counted. Texts that may
not count, addresses and agents are written nowhere.

A batch writes its counts, its people and the windows that are open, under its number; a batch that runs again, after a loss, writes
the same. Every `every` batches what is still kept is written as one base, which stands for all batches before it, and their
folders go: the sinks hold what their lifetimes allow.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import trending

from .jobs import complete, run_batches

HOUR, DAY, PER_WINDOW, SECONDS = 3_600_000, 86_400_000, 20, 60
TRENDS = "hour long, site string, query string, shown string, n long"
VISITORS = "day long, query string, visitor string"
OPEN = "visitor string, until long, n long"


def outcome(sites: list[str], banned: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """(why a beacon is not counted or null, its shown form, its site)."""
    shown, site = trending.shown_query(F.col("q"), banned), trending.site_of(F.col("origin"), F.col("site"), sites)
    why = F.when(F.coalesce("opt_out", F.lit(False)), "opted_out").when(shown.isNull(), "not_counted").when(site.isNull(), "unknown_site")
    return why, shown, site


@dataclass
class Store:
    """What the job keeps, in a folder."""

    spark: SparkSession
    folder: str

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def clock(self, before: int | None = None) -> int | None:
        """The newest time of a beacon (of the batches before one)."""
        done = [n for n in complete(self.spark, f"{self.folder}/clock") if before is None or n < before]
        return self.spark.read.parquet(f"{self.folder}/clock/batch={done[-1]}").first()[0] if done else None

    def salts(self, days: list[int], now_day: int) -> DataFrame:
        """(day, salt) of days that are still kept, made where they are new."""
        for day in days:
            if day >= now_day - trending.LIFETIMES["salts"] and day not in complete(self.spark, f"{self.folder}/salts", "day"):
                self.spark.createDataFrame([(secrets.token_urlsafe(24),)], "salt string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/salts/day={day}")
        have = [d for d in complete(self.spark, f"{self.folder}/salts", "day") if d >= now_day - trending.LIFETIMES["salts"]]
        rows = [(d, self.spark.read.parquet(f"{self.folder}/salts/day={d}").first().salt) for d in have if d in days]  # two days at most
        return self.spark.createDataFrame(rows, "day long, salt string")

    def _kept(self, name: str, schema: str) -> DataFrame:
        done, base = complete(self.spark, f"{self.folder}/{name}"), complete(self.spark, f"{self.folder}/{name}", "base")
        paths = [f"{self.folder}/{name}/base={base[-1]}"] if base else []
        paths += [f"{self.folder}/{name}/batch={n}" for n in done if not base or n > base[-1]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def trends(self) -> DataFrame:
        """(hour, site, query, shown, n) that are still kept."""
        rows = self._kept("trends", TRENDS).groupBy("hour", "site", "query").agg(F.max("shown").alias("shown"), F.sum("n").alias("n"))
        now = self.clock()
        return trending.living(rows, "trends", now // HOUR) if now is not None else rows

    def visitors(self) -> DataFrame:
        """(day, query, visitor) that are still kept, each once."""
        rows, now = self._kept("visitors", VISITORS).distinct(), self.clock()
        return trending.living(rows, "visitors", now // HOUR) if now is not None else rows

    def rising(self, site: str | None = None, limit: int = 10, least_people: int = 5) -> DataFrame:
        return trending.rising_counts(self.trends(), self.visitors(), (self.clock() or 0) // HOUR, site, least_people, limit)

    def opened(self, before: int) -> DataFrame:
        done = [n for n in complete(self.spark, f"{self.folder}/windows") if n < before]
        return self.spark.read.schema(OPEN).parquet(f"{self.folder}/windows/batch={done[-1]}") if done else self.spark.createDataFrame([], OPEN)

    def compact(self, n: int) -> None:
        """A base of all that is kept, as of batch n; what it stands for goes, and so do salts that have had their time."""
        now = self.clock()
        for name, rows in (("trends", self.trends()), ("visitors", self.visitors())):
            rows.coalesce(max(1, rows.rdd.getNumPartitions() // 4)).write.mode("overwrite").parquet(f"{self.folder}/{name}/base={n}")
            for kind, upto in (("batch", n + 1), ("base", n)):
                for old in complete(self.spark, f"{self.folder}/{name}", kind):
                    if old < upto:
                        self._delete(f"{self.folder}/{name}/{kind}={old}")
        for day in complete(self.spark, f"{self.folder}/salts", "day"):
            if day < now // DAY - trending.LIFETIMES["salts"]:
                self._delete(f"{self.folder}/salts/day={day}")


def start(sent: DataFrame, folder: str, sites: list[str], banned: tuple[str, ...] = (), compact_every: int = 20, every: str | None = None) -> Store:
    """Runs the job over a stream of beacons (event_id, at in ms, q, origin, site, address, agent, opt_out)."""
    spark = sent.sparkSession
    store = Store(spark, folder.rstrip("/"))
    why, shown, site = outcome(sites, banned)
    rows = sent.select("event_id", "at", why.alias("why"), shown.alias("shown"), site.alias("where"), "address", "agent").withColumns({"day": F.floor(F.col("at") / DAY), "hour": F.floor(F.col("at") / HOUR)})

    def handle(batch: DataFrame, n: int) -> None:
        place = lambda name: f"{store.folder}/{name}/batch={n}"
        good = batch.where("why is null")
        newest = batch.agg(F.max("at")).first()[0]
        had = store.clock(n)
        now = max(x for x in (newest, had, 0) if x is not None)
        days = [r.day for r in good.where(F.col("day") >= now // DAY - trending.LIFETIMES["salts"]).select("day").distinct().collect()]  # two at most, and those that are to come
        salted = good.join(F.broadcast(store.salts(days, now // DAY)), "day")  # a row a day; beacons of days whose salt is gone find none
        known = salted.select("event_id", "hour", "day", F.col("where").alias("site"), "shown", (F.col("at") * 1000).alias("us"), trending.visitor_hash(F.col("salt"), F.col("address"), F.col("agent")).alias("visitor"))
        allowed = trending.limited(known, PER_WINDOW, SECONDS, store.opened(n)).select("event_id", "us", "allowed", "until", F.col("n").alias("count"))
        known.join(allowed, ["event_id", "us"]).withColumn("query", F.lower("shown")).write.mode("overwrite").parquet(place("seen"))
        seen = spark.read.parquet(place("seen"))
        counted = seen.where("allowed")
        counted.groupBy("hour", "site", "query").agg(F.max("shown").alias("shown"), F.count("*").alias("n")).write.mode("overwrite").parquet(place("trends"))
        counted.select("day", "query", "visitor").distinct().write.mode("overwrite").parquet(place("visitors"))
        left = seen.groupBy("visitor").agg(F.max(F.struct("until", F.col("count").alias("n"))).alias("w")).select("visitor", "w.*")
        carried = store.opened(n).join(left.select("visitor"), "visitor", "left_anti")
        left.unionByName(carried).where(F.col("until") > now * 1000).write.mode("overwrite").parquet(place("windows"))
        spark.createDataFrame([(now,)], "now long").coalesce(1).write.mode("overwrite").parquet(place("clock"))
        store._delete(place("seen"))  # no beacon is kept
        if n % compact_every == compact_every - 1:
            store.compact(n)

    run_batches(rows, store.folder, handle, every)
    return store
