"""The stored index kept in segments: each batch of changes is a segment, a manifest says which count, and full tiers are merged.

A segment holds what index.store writes of the changed documents that are still to be found, and a bitmap of every rid that the batch
touched, found or not. A row of a segment is alive as long as no later segment touches its rid, so a change rewrites nothing:
put and remove are one small segment. Manifests are numbered by batch and count when their folder is complete; a batch that runs
again starts from the manifest before it and writes the same one over.

When a tier has FANOUT segments, they (neighbours in time) are merged: their living rows and their bitmaps, or no bitmap if nothing is
older. So a document is rewritten once a tier, and a search reads at most FANOUT - 1 segments of each.

repair() compares documents and index by rid and a digest of what is indexed, and applies what differs as one more batch: nothing
else is touched.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schema import LISTED, RESTRICTED

from . import index

FANOUT, TABLES = 4, ("postings", "records", "blocks", "tops", "touched")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete folders v=N in a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/v=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(x.getPath().getParent().getName().removeprefix("v=")) for x in found or [])


def commit(spark: SparkSession, folder: str, version: int, content: dict) -> None:
    """A manifest: its folder counts once it is complete."""
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/v={version}")


def manifest(spark: SparkSession, folder: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/v={version}").first().value)


def bitmaps(rids: DataFrame) -> DataFrame:
    """(bucket, bits): 32,768 rids a row."""
    return rids.groupBy(F.bitmap_bucket_number("rid").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("rid")).alias("bits"))


def in_bitmap(rid: str = "rid", bits: str = "bits"):
    """Whether a rid's bit is set; its bucket's row is beside it, or null."""
    at = F.bitmap_bit_position(F.col(rid))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position({rid}) % 8 as int))")) != 0, F.lit(False))


class SegmentedIndex:
    """An index in a folder, changed by batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def segments(self, upto: int | None = None) -> list[dict]:
        """The segments that count, oldest first, as of a batch (the last one)."""
        done = [v for v in versions(self.spark, f"{self.folder}/manifest") if upto is None or v <= upto]
        return manifest(self.spark, f"{self.folder}/manifest", done[-1])["segments"] if done else []

    def _table(self, segment: dict, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/segments/{segment['id']}/{name}")

    def _dead(self, segments: list[dict]) -> DataFrame | None:
        """(segment, bucket, bits): for each segment the rids that later ones touch."""
        later = [self._table(s, "touched").select(F.explode(F.array(*(F.lit(g) for g in range(i)))).alias("segment"), "bucket", "bits") for i, s in enumerate(segments) if i and s["touched"]]
        if not later:
            return None
        every = later[0]
        for df in later[1:]:
            every = every.unionByName(df)
        return every.groupBy("segment", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _rows(self, segments: list[dict], name: str, alive: bool = True) -> DataFrame | None:
        """A table's rows of some segments; alive: those that no later one of them touches."""
        parts = [self._table(s, name).withColumn("segment", F.lit(i)) for i, s in enumerate(segments) if s["rows"]]
        if not parts:
            return None
        every = parts[0]
        for df in parts[1:]:
            every = every.unionByName(df, allowMissingColumns=True)
        dead = self._dead(segments) if alive else None
        if dead is not None:
            beside = every.withColumn("bucket", F.bitmap_bucket_number("rid")).join(dead, ["segment", "bucket"], "left")
            every = beside.where(~in_bitmap()).drop("bucket", "bits")
        return every.drop("segment")

    def open(self, upto: int | None = None) -> index.Stored | None:
        """The index as of a batch, as searches take it; none before there is one. Blocks of dead rows only make bounds wider."""
        return self._opened(self.segments(upto))

    def _opened(self, segments: list[dict]) -> index.Stored | None:
        postings, records, blocks, tops = (self._rows(segments, n, n in ("postings", "records")) for n in TABLES[:4])
        if postings is None:
            return None
        tops = tops.groupBy("audience", "block").agg(F.min("shortest").alias("shortest"), F.max("newest").alias("newest"), F.bool_or("undated").alias("undated"))
        return index.Stored(postings, records, blocks, tops)

    def apply(self, changed: DataFrame, batch: int) -> None:
        """Puts and removes: changed documents (rid, exposure, ...) as they are now, one row a rid; what isn't listed or restricted goes."""
        segments, name = self.segments(batch - 1), f"{batch}"
        path = f"{self.folder}/segments/{name}"
        rows = changed.withColumn("digest", digest(changed))
        found = rows.where(F.col("exposure").isin(LISTED, RESTRICTED)).count()
        if found:
            index.store(rows, path)
        bitmaps(changed.select("rid")).write.mode("overwrite").parquet(f"{path}/touched")
        segments = [*segments, {"id": name, "tier": 0, "rows": found, "touched": True}]
        tier = 0
        while len(same := [s for s in segments if s["tier"] == tier]) >= FANOUT:
            segments = self._merge(segments, same, f"{batch}-{tier + 1}", tier + 1)
            tier += 1
        commit(self.spark, f"{self.folder}/manifest", batch, {"segments": segments})

    def _merge(self, segments: list[dict], same: list[dict], name: str, tier: int) -> list[dict]:
        """The segments with those of one tier, which are neighbours, as one of the next tier."""
        at, path = segments.index(same[0]), f"{self.folder}/segments/{name}"
        whole = self._opened(same)
        rows = whole.records.count() if whole else 0
        if rows:
            index.write(whole.postings, whole.records, path)
        if at:
            every = self._table(same[0], "touched")
            for s in same[1:]:
                every = every.unionByName(self._table(s, "touched"))
            every.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).write.mode("overwrite").parquet(f"{path}/touched")
        return [*segments[:at], {"id": name, "tier": tier, "rows": rows, "touched": bool(at)}, *segments[at + len(same) :]]

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes segments that none of the last manifests names; returns them."""
        done = versions(self.spark, f"{self.folder}/manifest")[-keep:]
        used = {s["id"] for v in done for s in manifest(self.spark, f"{self.folder}/manifest", v)["segments"]}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/segments/*")
        system = path.getFileSystem(conf)
        gone = [x.getPath() for x in system.globStatus(path) or [] if x.getPath().getName() not in used]
        for p in gone:
            system.delete(p, True)
        return sorted(p.getName() for p in gone)

    def differences(self, docs: DataFrame) -> DataFrame:
        """(rid, state): what the index lacks (missing), holds of an older text (stale), or holds though it should not (extra)."""
        want = docs.where(F.col("exposure").isin(LISTED, RESTRICTED)).select("rid", digest(docs).alias("want"))
        stored = self.open()
        have = stored.records.select("rid", F.col("digest").alias("have")) if stored else self.spark.createDataFrame([], "rid long, have long")
        state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "stale")
        return want.join(have, "rid", "full_outer").select("rid", state.alias("state")).where("state is not null")

    def repair(self, docs: DataFrame, batch: int) -> dict[str, int]:
        """Applies what differs as a batch; how many rows of each kind there were. Without differences nothing is written."""
        found = self.differences(docs).checkpoint()
        counts = {r.state: r["n"] for r in found.groupBy("state").agg(F.count("*").alias("n")).collect()}
        if counts:
            changed = docs.join(found.where("state <> 'extra'").select("rid"), "rid", "left_semi")
            extra = found.where("state = 'extra'").select("rid").withColumn("exposure", F.lit(0))
            self.apply(changed.unionByName(extra, allowMissingColumns=True), batch)
        return counts


def digest(docs: DataFrame):
    """Of what is indexed of a document: all its columns but numbers of deliveries."""
    return F.xxhash64(*(F.to_json(c) if str(docs.schema[c].dataType).startswith(("Map", "Struct", "Array")) else F.col(c) for c in sorted(docs.columns) if c not in ("digest", "arrival", "event_id")))
