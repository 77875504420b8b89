"""Cosine neighbours, reciprocal-rank fusion and the order after fusion."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine_distance(column: str, query: list[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(column, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double")))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return 1 - dot / (norm * length)


def knn(embeddings: DataFrame, query: list[float], k: int = 100, floor: float | None = None, id_column: str = "vec_id") -> DataFrame:
    """(rid, distance) of the k nearest, ties by rid; floor drops what is further away."""
    rows = embeddings.select(F.col(id_column).alias("rid"), F.round(cosine_distance("embedding", query), 6).alias("distance"))
    rows = rows.where(F.col("distance") <= floor) if floor is not None else rows
    return rows.orderBy("distance", "rid").limit(k)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Position of each row of one bounded list (at most 100 candidates a side)."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def rrf(keyword: DataFrame, vector: DataFrame, k: int = 60) -> DataFrame:
    """Two lists (rid, position) -> (rid, score, keyword_rank, vector_rank), best first by the fused score."""
    a, b = keyword.select("rid", F.col("position").alias("keyword_rank")), vector.select("rid", F.col("position").alias("vector_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return a.join(b, "rid", "full_outer").select("rid", F.round(part("keyword_rank") + part("vector_rank"), 9).alias("score"), "keyword_rank", "vector_rank")



def fused_order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("keyword_rank"), F.asc_nulls_last("vector_rank"), F.asc("rid")]


def embedding_pending(docs: DataFrame, stored: DataFrame, model: str, dim: int) -> DataFrame:
    """Documents without a current embedding: missing, other content, other model or dimension."""
    kept = stored.where((F.col("model") == model) & (F.col("dim") == dim)).select("rid", "content_hash")
    return docs.join(kept, ["rid", "content_hash"], "left_anti")


def embedding_text(most: int = 2000) -> Column:
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.substring(F.concat_ws("\n", part("title"), part("summary"), part("body")), 1, most)


def batches(rows: DataFrame, most: int, key: str = "rid") -> DataFrame:
    """Adds batch: consecutive keys in groups of at most `most`, numbered from 0 within each range partition, so nothing meets in one task."""
    spread = rows.repartitionByRange(key).sortWithinPartitions(key)
    return spread.withColumn("part", F.spark_partition_id()).withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1) / most))


def right_dimension(fresh: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(embeddings that can be stored, those that can't): only vectors of the model's dimension are."""
    right = F.coalesce(F.size("embedding") == dim, F.lit(False))
    return fresh.where(right), fresh.where(~right)


def embedding_upsert(stored: DataFrame, fresh: DataFrame, live: DataFrame) -> DataFrame:
    """Stored embeddings after a batch: the fresh one of each rid and model wins, those of documents gone are dropped."""
    keys = ["rid", "model"]
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh).join(live.select("rid"), "rid", "left_semi")


# Ms to wait after each failed call for embeddings; texts in a call.
EMBED_BACKOFF, EMBED_BATCH = (2000, 10000, 60000, 300000, 900000, 1800000, 3600000), 32


@dataclass(frozen=True)
class EmbedClock:
    """What an embedder keeps between ticks: its minute and what was embedded in it, failures in a row, and when it may try again."""

    began: int = 0
    used: int = 0
    failures: int = 0
    next_try: int = 0


def embed_tick(pending: DataFrame, clock: EmbedClock, now: int, per_minute: int = 120) -> tuple[DataFrame, EmbedClock]:
    """(what may be embedded now: the first pending rids that the minute allows, with their call, clock after it); nothing while it waits."""
    clock = replace(clock, began=now, used=0) if now - clock.began >= 60_000 else clock
    left = max(0, per_minute - clock.used) if now >= clock.next_try else 0
    rows = pending.orderBy("rid").limit(left)
    numbered = rows.withColumn("call", F.floor((F.row_number().over(Window.orderBy("rid")) - 1) / EMBED_BATCH).cast("int"))  # at most per_minute rows
    return numbered, replace(clock, used=clock.used + min(left, numbered.count()))


def embed_done(clock: EmbedClock, ok: bool, now: int) -> EmbedClock:
    """The clock after a call: an answer clears failures, each failure in a row waits longer."""
    if ok:
        return replace(clock, failures=0, next_try=0)
    return replace(clock, failures=clock.failures + 1, next_try=now + EMBED_BACKOFF[min(clock.failures, len(EMBED_BACKOFF) - 1)])


def deals_tier(last_word: str, words: Column) -> Column:
    """Head-noun match of a product: a token equals the word, begins with it, or (four letters or more) begins it."""
    w = F.lit(last_word)
    return F.when(F.exists(words, lambda t: (t == w) | t.startswith(w) | ((F.char_length(t) >= 4) & w.startswith(t))), 0)


def deals_order(fused: DataFrame, words: Column, match_words: tuple[str, ...]) -> DataFrame:
    """A fused list with product words: head-noun matches first, then keyword hits, then the rest, each in fused order."""
    tier = F.coalesce(deals_tier(match_words[-1], words), F.when(F.col("keyword_rank").isNotNull(), 1).otherwise(2))
    return fused.withColumn("tier", tier).orderBy("tier", *fused_order())


def reranked(fused: DataFrame, parts: DataFrame, match) -> DataFrame:
    """A fused list with its documents and rank parts -> (rid, position, keyword_rank, vector_rank) in the order after fusion.

    Cover, tier, an answer where a question asks, title words, thin ones last, then the fused order; one of each owner and title.
    """
    from .search import dedupe_key, thin

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    answer = (F.col("type") == "article").cast("int") if match.question else F.lit(0)
    words = zero("title_words") if len(match.words) > 1 else F.lit(0)
    rows = ranked(fused, *fused_order()).withColumnRenamed("position", "fused").join(parts, "rid", "left")
    rows = ranked(rows, F.desc(zero("cover")), F.desc(zero("tier")), F.desc(answer), F.desc(words), (thin() < 0).cast("int").asc(), F.asc("fused"))
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(dedupe_key()).orderBy("position"))).where("_n = 1")
    return one.select("rid", "keyword_rank", "vector_rank", F.row_number().over(Window.orderBy("position")).alias("position"))


def hybrid_rerank(fused: DataFrame, parts: DataFrame) -> DataFrame:
    """A fused list joined to its rank parts, in the order after fusion; rows that only vectors found have no parts."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = ranked(fused, *fused_order()).join(parts.select("rid", "cover", "tier", "title_words"), "rid", "left")
    return ranked(rows.withColumnRenamed("position", "fused"), F.desc(zero(F.col("cover"))), F.desc(zero(F.col("tier"))), F.desc(zero(F.col("title_words"))), F.asc("fused"))
