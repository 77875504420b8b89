"""The generated tables read as what the engine works on: index documents, beacons, a revision log.

The expressions are plain SQL that Spark and the oracle read alike; they are data, not operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {
    "rid": "doc_id",
    "owner": "source",
    "type": "CASE doc_id % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'vod' WHEN 2 THEN 'channel' WHEN 3 THEN 'offer' ELSE 'page' END",
    "id": "CAST(doc_id AS STRING)",
    "revision": "1 + doc_id % 4",
    "deleted": "doc_id % 37 = 0",
    "title": "substr(trim(split_part(text, '.', 1)), 1, 120)",
    "summary": "substr(trim(split_part(text, '.', 2)), 1, 400)",
    "body": "text",
    "visibility": "CASE WHEN doc_id % 53 = 0 THEN 'draft' WHEN doc_id % 10 <= 6 THEN 'public' WHEN doc_id % 10 = 7 THEN 'unlisted' WHEN doc_id % 10 = 8 THEN 'members' ELSE 'private' END",
    "publication_state": "CASE WHEN doc_id % 41 = 0 THEN 'unpublished' ELSE 'published' END",
    "canonical_url": "CASE WHEN doc_id % 29 = 0 THEN NULL ELSE concat('https://', source, '.example/d/', CAST(doc_id AS STRING)) END",
    "stub": "doc_id % 31 = 0",
    "decision": "CASE WHEN doc_id % 43 = 0 THEN 'noindex' ELSE 'index' END",
    "subject": "concat('u', CAST(doc_id % 5 AS STRING))",
    "grp": "concat('g', CAST(doc_id % 3 AS STRING))",
    "entitlement": "concat('e', CAST(doc_id % 2 AS STRING))",
    "followers": "doc_id * 37 % 5000",
    "duration": "doc_id * 61 % 7200",
    "live": "doc_id % 11 = 0",
    "size_bucket": "CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 5000 THEN 'medium' ELSE 'large' END",
    "lang": "lang",
    "published_at": "CASE WHEN doc_id % 23 = 0 OR doc_id % 19 = 0 THEN NULL WHEN doc_id % 47 = 0 THEN 'soon' ELSE CAST(DATE '2024-01-01' + CAST(doc_id % 400 AS INT) AS STRING) END",
    "updated_at": "CASE WHEN doc_id % 23 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(doc_id % 400 + doc_id % 7 AS INT) AS STRING) END",
    "sort_at": "CASE WHEN doc_id % 23 = 0 THEN '' ELSE CAST(DATE '2024-01-01' + CAST(doc_id % 400 + doc_id % 7 AS INT) AS STRING) END",
}
#: The clock of the registered queries, 2025-01-01 in ms: the engine itself takes any.
CLOCK = 1735689600000


def fields_sql() -> str:
    return ", ".join(f"{v} AS {k}" for k, v in FIELDS.items())


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of parts: the source takes a lone file only by a pattern."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*(f"{v} AS {k}" for k, v in FIELDS.items()))


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hour, day, site, query, visitor): searches read from events."""
    return events_as_beacons(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events_as_beacons(events: DataFrame) -> DataFrame:
    hour = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 3600)  # whatever the session's zone
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), hour.alias("hour"), F.floor(hour / 24).alias("day"), F.col("event_type").alias("site"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("query"), F.concat(F.when(F.col("event_id") % 3 == 0, "k").otherwise("K"), F.get_json_object("props", "$.k")).alias("shown"), F.col("user_id").alias("visitor"))


def revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arrival, key, revision, deleted, content) read from events."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("arrival"), (F.col("event_id") % 300).alias("key"), (F.floor(F.col("event_id") / 1500) + F.col("event_id") % 3).alias("revision"),
        (F.col("event_type") == "error").alias("deleted"), F.when(F.col("event_type") == "error", "tombstone").otherwise(F.col("event_type")).alias("content"))
