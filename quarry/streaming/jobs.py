"""Structured Streaming forms of the continuous operators; each gives what its batch form gives on the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.federation import percolate
from quarry.operators.trending import limited
from quarry.sources.adapter import beacons, events_as_beacons, table_stream

from . import keyed


def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; only where it is unset on one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _trigger(every: str | None) -> dict:
    """All that is there and then stop, or again and again."""
    return {"processingTime": every} if every else {"availableNow": True}


def _run(stream: DataFrame, folder: str, mode: str = "append", every: str | None = None) -> str:
    out = f"{folder}/out"
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(**_trigger(every)).start(out).awaitTermination()
    return out


def run_batches(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None], every: str | None = None) -> None:
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint").trigger(**_trigger(every)).start().awaitTermination()


def complete(spark: SparkSession, folder: str, kind: str = "batch") -> list[int]:
    """Numbers of the complete folders of a kind in a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found or [])


class Latest:
    """The rows that batches brought, in a shared folder: a batch writes its own under its number, the last one of a key counts.

    A folder counts when it is complete, so a batch that is run again, after a driver or a sink was lost, writes the same over. When
    a base is written, it stands for all batches up to it. Nothing is kept on the driver.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = 20):
        self.spark, self.folder, self.every = spark, folder.rstrip("/"), every

    def read(self, schema, before: int | None = None) -> DataFrame:
        """The last row of each key (before a batch)."""
        within = [n for n in complete(self.spark, self.folder) if before is None or n < before]
        base = max((n for n in complete(self.spark, self.folder, "base") if before is None or n < before), default=None)
        parts = [("base", base)] * (base is not None) + [("batch", n) for n in within if base is None or n > base]
        rows = None
        for kind, n in parts:
            one = self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}={n}").withColumn("_batch", F.lit(n))
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        last = rows.groupBy("key").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("key", "_batch"))), "_batch").alias("x"))
        return last.select("key", "x.*")

    def write(self, rows: DataFrame, n: int) -> None:
        """A batch's rows; each `every` batches a base of all of them."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={n}")
        if n % self.every == self.every - 1:
            self.read(rows.schema, n + 1).write.mode("overwrite").parquet(f"{self.folder}/base={n}")

    def merge(self, batch: DataFrame, key: str, n: int, combine: Callable[[DataFrame], DataFrame]) -> None:
        """Writes batch n from its rows and what their keys held before it, without the state store: for a batch that is brought in by hand."""
        old = self.read(batch.schema, n).join(batch.select(key).distinct(), key, "left_semi")
        self.write(combine(old.select(batch.columns).unionByName(batch)), n)


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared(spark)}/quarry-stream/{name}-{uuid.uuid4().hex}"


def trend_hourly(spark: SparkSession, sf_dir: str, folder: str | None = None, every: str | None = None) -> DataFrame:
    """Tumbling hours; the sink holds partial counts of each batch, summed on reading, so no state and no watermark is needed."""
    folder = folder or _folder(spark, "trend")

    def handle(batch: DataFrame, n: int) -> None:
        batch.groupBy("hour", "site", "query").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    run_batches(events_as_beacons(event_stream(spark, sf_dir)), folder, handle, every)
    return spark.read.parquet(f"{folder}/out").groupBy("hour", "site", "query").agg(F.sum("n").alias("n"))


def inbox(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Exactly-once ingest: an event is kept once, however late it is delivered again: its id is a receipt that doesn't expire."""
    events = event_stream(spark, sf_dir)
    once = events.unionByName(events).select("event_id", "event_type").dropDuplicates(["event_id"])
    with keyed.rocksdb(spark):
        return spark.read.parquet(_run(once, folder or _folder(spark, "inbox")))


def visitors(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Distinct people of each day and query; who was seen is forgotten after two days."""
    once = events_as_beacons(event_stream(spark, sf_dir)).withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["day", "query", "visitor"])
    out = _run(once.select("day", "query", "visitor"), folder or _folder(spark, "visitors"))
    return spark.read.parquet(out).groupBy("day", "query").agg(F.count("*").alias("people"))


def rate_limit(spark: SparkSession, sf_dir: str, folder: str | None = None, per_window: int = 5, seconds: int = 6 * 3600, every: str | None = None) -> DataFrame:
    """The searches a visitor group is allowed, in windows that its first search opens.

    A batch meets the windows that the batches before it left open and writes those it leaves; closed ones are not carried on, so
    what is kept follows the visitors of one window. A batch that runs again meets the same windows.
    """
    folder = folder or _folder(spark, "limit")

    def handle(batch: DataFrame, n: int) -> None:
        before = [m for m in complete(spark, f"{folder}/windows") if m < n]
        opened = spark.read.parquet(f"{folder}/windows/batch={before[-1]}") if before else spark.createDataFrame([], "visitor string, until long, n long")
        rows = batch.select(F.col("who").alias("visitor"), "event_id", "us")
        limited(rows, per_window, seconds, opened).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        done = spark.read.parquet(f"{folder}/out/batch={n}")
        now = done.agg(F.max("us")).first()[0] or 0
        left = done.groupBy("visitor").agg(F.max(F.struct("until", "n")).alias("w")).select("visitor", "w.*").unionByName(opened.join(done.select("visitor").distinct(), "visitor", "left_anti"))
        left.where(F.col("until") > now).write.mode("overwrite").parquet(f"{folder}/windows/batch={n}")

    beacons_ = events_as_beacons(event_stream(spark, sf_dir)).select((F.col("visitor") % 3).alias("who"), "event_id", F.unix_micros("ts").alias("us"))
    run_batches(beacons_, folder, handle, every)
    allowed = spark.read.parquet(f"{folder}/out").where("allowed").select("event_id")
    return beacons(spark, sf_dir).join(allowed, "event_id", "left_semi").select("visitor", "event_id")


def percolation(spark: SparkSession, sf_dir: str, folder: str | None = None, every: str | None = None) -> DataFrame:
    """Saved queries over a stream of documents: each batch is percolated once; a batch that is run again writes the same."""
    folder = folder or _folder(spark, "percolate")
    saved = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("saved_id"), F.slice(tokens(F.col("text")), 1, 3).alias("words"))
    docs = table_stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), "text")

    def handle(batch: DataFrame, n: int) -> None:
        percolate(saved, batch).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    run_batches(docs, folder, handle, every)
    return spark.read.parquet(f"{folder}/out").select("saved_id", "rid")


def _latest(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("revision"), F.desc("deleted"), "arrival")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_into(log: DataFrame, folder: str, every: str | None = None) -> Latest:
    """Latest document of each key by the revision rule, tombstones kept, and the exposure changes of each batch.

    log: a stream of (arrival, key, revision, deleted, content). What a key held is keyed state (keyed.py), so a batch reads and
    writes the keys it brings and no others. Started again on the same folder it goes on where it was.
    """
    spark = log.sparkSession
    state = Latest(spark, f"{folder}/state")
    level = lambda deleted, content: F.when(F.col(deleted), 0).when(F.col(content) == "view", 1).otherwise(3)

    def handle(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch={n}")  # the state is read once
        best = _latest(spark.read.parquet(f"{folder}/log/batch={n}"))
        new = best.where("had_revision is null or struct(revision, deleted) > struct(had_revision, had_deleted)")
        state.write(new.select(*log.columns), n)
        rows = new.where("had_revision is null or revision > had_revision").select(
            "key", "revision", F.when(F.col("had_revision").isNull(), 0).otherwise(level("had_deleted", "had_content")).alias("previous"), level("deleted", "content").alias("exposure"))
        events = rows.where("exposure < previous").withColumn("event", F.lit("removed")).unionByName(rows.where("exposure > 0").withColumn("event", F.lit("indexed")))
        events.write.mode("overwrite").parquet(f"{folder}/events/batch={n}")

    with keyed.rocksdb(spark):
        run_batches(keyed.before(log.withColumn("skip", F.lit(False)), "key", ["content"]), folder, handle, every)
    return state


def _log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("arrival"), (F.col("event_id") % 300).alias("key"), (F.floor(F.col("event_id") / 1500) + F.col("event_id") % 3).alias("revision"),
        (F.col("event_type") == "error").alias("deleted"), F.when(F.col("event_type") == "error", "tombstone").otherwise(F.col("event_type")).alias("content"))


def revision_merge(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    log = _log(event_stream(spark, sf_dir))
    return merge_into(log, folder or _folder(spark, "merge")).read(log.schema).select("key", "revision", "deleted", "content")


def exposure_feed(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The change events that the merge writes beside its state."""
    folder = folder or _folder(spark, "feed")
    merge_into(_log(event_stream(spark, sf_dir)), folder)
    return spark.read.parquet(f"{folder}/events").select("key", "revision", "event", "previous", "exposure")


class Periodic:
    """Work that is done again and again (name, every in ms): what is due is known by when each was last done, which is kept in a folder.

    A task that fails stays due; one that has never run is due at once. Runs are numbered, so a run that is lost is done again.
    """

    def __init__(self, spark: SparkSession, folder: str, every: dict[str, int]):
        self.spark, self.every, self.folder = spark, every, folder.rstrip("/")
        self.state = Latest(spark, self.folder)

    def due(self, now: int, before: int | None = None) -> list[str]:
        """Names that are due, those that have waited longest first."""
        last = {r.key: r.at for r in self.state.read("key string, at long", before).collect()}  # a row a task
        return sorted((n for n, e in self.every.items() if n not in last or last[n] + e <= now), key=lambda n: (last.get(n, -1), n))

    def run(self, n: int, now: int, actions: dict[str, Callable[[], None]]) -> dict[str, str]:
        """Does what is due and writes when it was done; {name: done, or what went wrong}."""
        said = {}
        for name in self.due(now, n):
            try:
                actions[name]()
                said[name] = "done"
            except Exception as e:  # one task's failure is no other's
                said[name] = f"failed: {e}"
        done = [(name, now) for name, x in said.items() if x == "done"]
        self.state.write(self.spark.createDataFrame(done, "key string, at long"), n)
        return said
