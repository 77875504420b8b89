"""The web ladder over many requests: one plan a step, in which a step runs only for requests that are not yet satisfied.

Requests are rows (req, q, limit, depth, freshness, site, signed_in, seq). The first step is the own index; the others are providers,
each free or paid, whose recorded answers are joined to the requests that may call them. A request stops at `enough` results unless
it asks for all steps (deep); a cached answer serves anyone who is not satisfied; a paid step needs a signed-in caller and a call
left under the day's cap, which the earliest requests take. Every step gives each request one explain row.

A request's row carries how many results it has, so a step is one join with the answers and one window by (request, URL key) over
its results and those found before. Each step's results are written before the next one reads them. Nothing is collected: the cap is
a bounded top of the calls in order.

What grows with the requests is dealt by request into tasks of about REQUESTS_A_TASK requests each, and joined by merging: files of
such rows are so small that Spark would else broadcast millions of them, or put them into as few tasks as there are cores. The cache
is left to Spark, as it doesn't grow with the requests; a paid step's calls, at most the cap, are broadcast to their answers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import parse_time, url_key

from .saved import cache_key

# What a search of each depth asks of the paid provider: its depth, the most it may cost, the time it gets.
PLANS = {"standard": ("fast", 0.003, 20000), "deep": ("standard", 0.012, 45000)}
FRESH_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
ENOUGH, MOST_ANSWERS, MOST_CHARS = 3, 20, 500
REQUESTS_A_TASK = 200_000
RESULT = "array<struct<url:string,title:string,published:string>>"
FOUND = "req long, step int, place long, url string, url_key string, title string, published string"


@dataclass(frozen=True)
class Step:
    """A provider step: its name, whether its calls are paid, and a step whose answer makes this one needless in a deep search."""

    name: str
    paid: bool
    unless: str | None = None


STEPS = (Step("exchange", True), Step("deepseek", True, unless="exchange"), Step("wikipedia", False))


def asks(requests: DataFrame, now: int) -> DataFrame:
    """What the paid provider is asked for each request: (req, q, depth, limit, max_cost_usd, timeout_ms, include_domains, freshness, since)."""
    host = F.regexp_replace(F.lower("site"), r"^www\.", "")
    plan = lambda i: F.when(F.col("depth") == "deep", PLANS["deep"][i]).otherwise(PLANS["standard"][i])
    week = F.lit((now - 7 * 86_400_000) // 86_400_000).cast("int")
    return requests.select(
        "req", F.substring("q", 1, MOST_CHARS).alias("q"), plan(0).alias("depth"), F.least(F.greatest(F.lit(1), "limit"), F.lit(MOST_ANSWERS)).alias("limit"), plan(1).alias("max_cost_usd"), plan(2).alias("timeout_ms"),
        F.when(host.rlike(r"^[a-z0-9.-]+\.[a-z]{2,63}$"), F.array(host)).otherwise(F.array().cast("array<string>")).alias("include_domains"),
        F.when(F.col("freshness").isin("day", "month", "year"), F.col("freshness")).alias("freshness"), F.when(F.col("freshness") == "week", F.date_from_unix_date(week).cast("string")).alias("since"))


def step_key(step: str) -> Column:
    """Under what an answer is cached: the query, the step, freshness and site."""
    return cache_key(F.col("q"), F.lit("web"), F.lit(step), F.col("freshness"), F.coalesce("site", F.lit("")))


def run(requests: DataFrame, own: DataFrame, answers: DataFrame, cache: DataFrame, calls: DataFrame, folder: str, cap: int, web: bool = True, configured: str | None = None, steps: tuple[Step, ...] = STEPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, explain, fresh cache entries) of all requests.

    own (req, position, url, title, published): what the own index found. answers (req, step, ok, cost_usd, ms, results): what a call
    of a step by a request comes to. cache (key, results): living entries. calls (step, calls): calls made today. configured: why
    the providers can't be asked at all, or none.
    """
    spark = requests.sparkSession
    parts = max(1, math.ceil(requests.count() / REQUESTS_A_TASK))
    if parts > 1:  # Spark raises fewer parts of a join to its own number, and would deal rows twice
        parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "req")

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        """Both sides are dealt."""
        return left.join(right.hint("merge"), "req", "left")

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return dealt(rows.select("req")).groupBy("req").agg(F.count("*").alias(name))

    def listed(rows: DataFrame) -> DataFrame:
        return rows.select("req", "limit", F.posexplode("results").alias("position", "r")).select("req", "limit", "position", "r.url", "r.title", "r.published")

    def with_key(rows: DataFrame) -> DataFrame:
        return rows.withColumn("url_key", url_key(F.col("url"))).where("url_key <> ''").withColumn("old", F.lit(False))

    def new(keyed: DataFrame, n: int) -> DataFrame:
        """Rows (req, limit, position, url, title, published, url_key, old), dealt: those with a URL that their request doesn't have yet (old), each once."""
        w = Window.partitionBy("req", "url_key").orderBy(F.desc("old"), "position")
        fresh = keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").where("not old")
        return fresh.select("req", F.lit(n).alias("step"), F.col("position").cast("long").alias("place"), "url", "url_key", "title", "published", "limit")

    first = dealt(own).join(dealt(requests.select("req", "limit")).hint("merge"), "req").withColumn("_n", F.row_number().over(Window.partitionBy("req").orderBy("position"))).where("_n <= limit")
    merged = kept(new(with_key(first), 0), "found-0")
    state = kept(joined(dealt(requests), counted(merged, "n")).withColumn("n", F.coalesce("n", F.lit(0))), "state-0")
    cache = kept(cache.select("key", F.col("results").alias("held")), "cache")
    explain = state.select("req", F.lit(0).alias("at"), F.lit("open_index").alias("step"), F.lit(True).alias("ok"), F.col("n").alias("count"), F.lit(None).cast("string").alias("skipped"), F.lit(False).alias("cached"), F.lit(0.0).alias("cost_usd"))
    entries = []
    for i, step in enumerate(steps, 1):
        had = calls.where(F.col("step") == step.name).agg(F.coalesce(F.sum("calls"), F.lit(0))).first()[0]
        rows = state.withColumn("key", step_key(step.name)).join(cache, "key", "left")
        needless = F.col(f"told_{step.unless}") if f"told_{step.unless}" in state.columns else F.lit(False)
        deep, enough = F.col("depth") == "deep", F.col("n") >= F.least("limit", F.lit(ENOUGH))
        why = (
            F.when(needless & deep, f"{step.unless} asked it already").when(enough & ~deep, "earlier steps answered").when(F.col("held").isNotNull(), "cached").when(F.col("depth") == "quick", "quick search reads indexes only")
            .when(F.lit(step.paid) & ~F.col("signed_in"), "paid providers need a signed-in person").when(F.lit(not web), "web search is off").when(F.lit(configured is not None), configured or ""))
        gate = kept(rows.withColumn("why", why), f"gate-{i}")
        asked = gate.where("why is null")
        if step.paid:
            asked = asked.orderBy("seq").limit(max(0, cap - had))  # the day's calls go to the earliest requests
        asked = kept(asked.select("req", "key", "limit"), f"asked-{i}")
        told = answers.where(F.col("step") == step.name).select("req", "ok", "cost_usd", "results")
        if step.paid:
            told = told.join(F.broadcast(asked.select("req")), "req", "left_semi")  # at most the cap
        got = joined(dealt(asked), dealt(told))
        got = kept(got.select("req", "key", "limit", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.when(F.col("ok"), F.slice("results", F.lit(1), F.col("limit"))).otherwise(F.array().cast(RESULT)).alias("results")), f"got-{i}")
        held = gate.where("why = 'cached'").select("req", "limit", F.col("held").alias("results"))
        known = merged.select("req", "url_key", F.lit(True).alias("old"))
        added = kept(new(dealt(with_key(listed(got).unionByName(listed(held))).unionByName(known, allowMissingColumns=True)), i), f"found-{i}")
        said = joined(joined(dealt(gate.drop("key", "held")), dealt(got.select("req", "ok", "cost_usd", F.size("results").alias("size")))), counted(added, "added"))
        cached = F.coalesce(F.col("why") == "cached", F.lit(False))
        called = F.col("ok").isNotNull()
        count = F.when(cached, F.coalesce("added", F.lit(0))).when(F.coalesce("ok", F.lit(False)), F.col("size")).otherwise(0).cast("long")
        said = kept(said.withColumns({
            "n": F.col("n") + F.coalesce("added", F.lit(0)), "ok": cached | F.coalesce("ok", F.lit(False)), "count": count,
            "skipped": F.when(cached | called, F.lit(None)).otherwise(F.coalesce("why", F.lit("daily cap reached"))), "cached": cached, "cost_usd": F.coalesce("cost_usd", F.lit(0.0))}).drop("why", "size", "added"), f"state-{i}")
        explain = explain.unionByName(said.select("req", F.lit(i).alias("at"), F.lit(step.name).alias("step"), "ok", "count", "skipped", "cached", "cost_usd"))
        state = said.withColumn(f"told_{step.name}", F.col("ok") & (F.col("count") > 0)).drop("ok", "count", "skipped", "cached", "cost_usd")
        merged = merged.unionByName(added)
        entries.append(got.where("ok").select("key", "results").groupBy("key").agg(F.any_value("results").alias("results")))
    fresh = entries[0]
    for df in entries[1:]:
        fresh = fresh.unionByName(df)
    w = Window.partitionBy("req").orderBy("step", "place")
    results = dealt(merged).withColumn("position", F.row_number().over(w)).where(F.col("position") <= F.col("limit")).drop("limit", "place")
    return results, explain, fresh


def narrowed(results: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """What a request's freshness and site leave of its results; results without a date stay, a site holds its subdomains too."""
    days = F.element_at(F.create_map(*(F.lit(x) for pair in FRESH_DAYS.items() for x in pair)), F.col("freshness"))
    at = parse_time(F.col("published"))
    rows = results.join(requests.select("req", "freshness", "site"), "req")
    host = F.lower(F.regexp_extract("url", r"(?i)^https?://([^/:?#]+)", 1))
    site = F.regexp_replace(F.lower("site"), r"^www\.", "")
    return rows.where(F.coalesce(at >= F.lit(now) - days * 86_400_000, F.lit(True))).where(F.col("site").isNull() | (host == site) | host.endswith(F.concat(F.lit("."), site))).drop("freshness", "site")
