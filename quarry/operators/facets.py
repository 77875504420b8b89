"""Facets of an open map as bitmaps: filters and counts without the rows.

For each key and value there is a row for every 32,768 rids that hold it, with a bit a document (Spark's bitmap aggregates, added
up before they are shuffled, so a value that every document has is as many rows as there are buckets). A filter is the
union of a key's values and the intersection of its keys; a count is the bits that a value shares with a result's bitmap.
The facets themselves are read when the bitmaps are built, and never by a search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .documents import facet_number
from .segments import bitmaps, in_bitmap
from .visibility import facet_map_pairs

BUCKET = 1 << 15


def build(docs: DataFrame) -> DataFrame:
    """(key, value, bucket, bits) of the facets of documents that anyone may see, whatever keys there are."""
    pairs = facet_map_pairs(docs)
    return pairs.groupBy("key", "value", F.bitmap_bucket_number("rid").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("rid")).alias("bits"))


def numbers(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(rid, key, number): the first value of a key that reads as a number, in the order of texts."""
    each = F.array(*(F.struct(F.lit(k).alias("key"), facet_number(k).alias("number")) for k in keys))
    return docs.select("rid", F.inline(each)).where("number is not null")


def matching(index: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """(bucket, bits) of the documents that have all keys, each with one of its values."""
    per_key = [index.where((F.col("key") == k) & F.col("value").isin(values)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")) for k, values in wanted.items()]
    if not per_key:
        raise ValueError("a filter has a key")
    rows = reduce(DataFrame.unionByName, per_key)
    both = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return both.where((F.col("n") == len(per_key)) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")


def within(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows whose rid is in a bitmap."""
    beside = rows.withColumn("_bucket", F.bitmap_bucket_number("rid")).join(found.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")), "_bucket")
    return beside.where(in_bitmap(bits="_bits")).drop("_bucket", "_bits")


def rids(found: DataFrame) -> DataFrame:
    """(rid): a bitmap as rows."""
    byte = lambda i: F.conv(F.hex(F.substring(F.col("bits"), i + 1, F.lit(1))), 16, 10).cast("int")
    each = found.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(BUCKET // 8 - 1))).alias("i")).select("bucket", "i", byte(F.col("i")).alias("byte")).where("byte > 0")
    bits = each.select("bucket", "i", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b")).where("shiftright(byte, b) & 1 = 1")
    at = (F.col("i") * 8 + F.col("b")).cast("long")
    return bits.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BUCKET + at + 1).otherwise(F.col("bucket") * BUCKET - at).alias("rid"))


def counts(index: DataFrame, result: DataFrame, keys: list[str], per_key: int = 20) -> DataFrame:
    """(key, value, count) over a result set (rid): the most frequent values of each key, ties by value."""
    here = bitmaps(result.select("rid"))
    rows = index.where(F.col("key").isin(keys)).join(here.withColumnRenamed("bits", "here"), "bucket")
    both = rows.select("key", "value", "bucket", F.explode(F.array("bits", "here")).alias("bits")).groupBy("key", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    every = both.groupBy("key", "value").agg(F.sum("n").alias("count")).where(F.col("count") > 0)
    w = Window.partitionBy("key").orderBy(F.desc("count"), "value")
    return every.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_key).drop("_n")
