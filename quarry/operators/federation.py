"""Scopes, web results, code search and saved searches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import host, tokens, url_key


def url_union(steps: list[DataFrame]) -> DataFrame:
    """Results of ladder steps (url, ...), first step and position wins for each URL key; results without a URL are left out."""
    rows = None
    for i, df in enumerate(steps):
        one = df.withColumn("step", F.lit(i)).withColumn("url_key", url_key(F.col("url")))
        rows = one if rows is None else rows.unionByName(one)
    w = Window.partitionBy("url_key").orderBy("step", "position")
    return rows.where("url_key <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fresh_enough(days: int, now_day: int) -> Column:
    """Undated results stay."""
    return F.col("day").isNull() | (F.col("day") >= now_day - days)


def on_site(host_column: Column, site: str) -> Column:
    return (host_column == site) | host_column.endswith("." + site)


def scope_groups(docs: DataFrame, scopes: DataFrame, most: int) -> DataFrame:
    """Verticals: scopes (scope, type, ordinal) joined to documents, at most so many each, in request order."""
    w = Window.partitionBy("scope").orderBy(F.desc("sort_at"), "rid")
    return docs.join(scopes, "type").withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("scope", "ordinal", "position", "rid")


def shelves(docs: DataFrame, read: int = 12, keep: int = 4) -> DataFrame:
    """Newest documents of each owner: so many read, those with a real title kept, the first few shown."""
    w = Window.partitionBy("owner").orderBy(F.desc("sort_at"), F.desc("rid"))
    newest = docs.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= read) & (F.char_length("title") > 3))
    return newest.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).select("owner", "place", "rid")


def code_merge(rows: DataFrame) -> DataFrame:
    """Rows (position, source, repo, ref, path, permalink, line, ...) of several sources, in source order, for one file at one commit.

    Most stars, last commit, the first licence and language there is, the range of the lines; rows without a repo, path or link go.
    """
    whole = rows.where("repo <> '' and path <> '' and permalink <> ''")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("position")))
    sources = F.array_sort(F.collect_set(F.struct("place", "source")))
    place = F.min("position").over(Window.partitionBy(F.lower("repo"), F.coalesce("ref", F.lit("")), "path", "source"))
    return whole.withColumn("place", place).groupBy(F.lower("repo").alias("key"), F.coalesce("ref", F.lit("")).alias("ref"), "path").agg(
        F.min_by("repo", "position").alias("repo"), F.max(F.coalesce("stars", F.lit(0))).alias("stars"), F.max("last_commit").alias("last_commit"), first("licence").alias("licence"), first("language").alias("language"),
        F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.countDistinct("line").alias("n_lines"), F.transform(sources, lambda x: x["source"]).alias("sources")).drop("key")


LINES = "array<struct<number:int,text:string,match:boolean>>"


def merged_lines(rows: DataFrame) -> DataFrame:
    """Rows (position, source, repo, ref, path, permalink, lines, line_start, line_end, ...) of several sources -> one row a file at one commit.

    Of lines with one number the first source's text stays, and they match if any source says so; they come in order. A file that
    one row alone is about keeps its lines as they are. The range is that of the lines, where there are any, else what the rows say.
    Lines are merged by (file, number), so a file that all sources name is no array until it is whole.
    """
    whole = rows.where("repo <> '' and path <> '' and permalink <> ''").withColumns({"key": F.lower("repo"), "at": F.coalesce("ref", F.lit("")), "lines": F.coalesce("lines", F.array().cast(LINES))})
    file = ["key", "at", "path"]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("position")))
    of = whole.groupBy(*file).agg(
        F.count("*").alias("n"), F.min_by("repo", "position").alias("repo"), F.min_by("ref", "position").alias("ref"), F.max(F.coalesce("stars", F.lit(0))).alias("stars"), F.max("last_commit").alias("last_commit"), first("licence").alias("licence"), first("language").alias("language"),
        first("line_start").alias("_start"), F.max(F.when(F.col("line_start").isNotNull(), F.col("line_end"))).alias("_end"), F.min_by("line_end", "position").alias("_first_end"), F.min_by("lines", "position").alias("own"))
    sources = whole.groupBy(*file, "source").agg(F.min("position").alias("place")).groupBy(*file).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]).alias("sources"))
    each = whole.select(*file, "position", F.posexplode("lines").alias("index", "line")).where("line.number is not null")
    one = each.groupBy(*file, F.col("line.number").alias("number")).agg(F.min_by("line.text", F.struct("position", "index")).alias("text"), F.bool_or(F.coalesce("line.match", F.lit(False))).alias("match"))
    lines = one.groupBy(*file).agg(F.array_sort(F.collect_list(F.struct("number", "text", "match"))).alias("lines"))
    out = of.join(sources, file).join(lines, file, "left").withColumn("lines", F.when(F.col("n") == 1, F.col("own")).otherwise(F.coalesce("lines", F.array().cast(LINES))))
    some = F.size("lines") > 0
    return out.select(
        "repo", "ref", "path", "stars", "last_commit", "licence", "language", "sources", "lines",
        F.when(some, F.get("lines", F.lit(0))["number"]).otherwise(F.col("_start")).alias("line_start"), F.when(some, F.element_at("lines", -1)["number"]).otherwise(F.greatest("_end", "_first_end")).alias("line_end"))


def lines_around(merged: DataFrame, around: int = 2, most: int = 120) -> DataFrame:
    """Merged rows with the lines within so many of a match, whichever source it is from; the first `most` of each file."""
    near = F.filter("lines", lambda x: F.exists("lines", lambda m: m["match"] & (F.abs(m["number"] - x["number"]) <= around)))
    return merged.withColumn("lines", F.slice(near, 1, most))


def code_filter(rows: DataFrame, lang: str | None = None, repo: str | None = None, licence: str | None = None) -> DataFrame:
    """Filters on merged rows, whatever the sources made of them; case doesn't count, repo is a part of the name."""
    for column, wanted in (("language", lang), ("licence", licence)):
        rows = rows.where(F.lower(F.coalesce(column, F.lit(""))) == wanted.lower()) if wanted else rows
    return rows.where(F.lower("repo").contains(repo.lower())) if repo else rows


def code_context(lines: DataFrame, around: int = 2, most: int = 120) -> DataFrame:
    """Lines (file, line, text, match) within so many lines of a match, the first `most` of each file."""
    w = Window.partitionBy("file").orderBy("line")
    near = lines.withColumn("near", F.max(F.col("match").cast("int")).over(w.rangeBetween(-around, around))).where("near = 1").drop("near")
    return near.withColumn("_n", F.dense_rank().over(w)).where(F.col("_n") <= most).drop("_n")


def packed(files: DataFrame, most_files: int, most_chars: int) -> DataFrame:
    """Ranked files (position, chars) of one answer until either limit; the first always; files without a place or text are passed over."""
    w = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = files.where("position is not null and chars > 0").withColumn("total", F.sum("chars").over(w)).withColumn("n", F.row_number().over(Window.orderBy("position")))
    return rows.where((F.col("n") == 1) | ((F.col("n") <= most_files) & (F.col("total") <= most_chars)))


def failure_runs(calls: DataFrame) -> DataFrame:
    """(source, at, ok: true, false, or null for neither) -> (source, consecutive, succeeded): failures since the last success.

    The last success of each source is an aggregate, joined back to the calls: no source's calls are sorted or held together.
    """
    last = calls.groupBy(F.col("source").alias("_source")).agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("_ok_at"))
    since = calls.join(last, F.col("source").eqNullSafe(F.col("_source")))
    return since.groupBy("source").agg(F.count_if(~F.col("ok") & (F.col("_ok_at").isNull() | (F.col("at") > F.col("_ok_at")))).alias("consecutive"), F.coalesce(F.bool_or("ok"), F.lit(False)).alias("succeeded"))


def source_health() -> Column:
    """Health by the run of failures since the last success: down from three on."""
    c = F.col
    return F.when(~c("enabled"), "off").when(~c("configured"), "unconfigured").when(c("consecutive") >= 3, "down").when(c("consecutive") > 0, "degraded").when(c("succeeded"), "ok").otherwise("unknown")


def provider_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("day", "provider").agg(F.count("*").alias("calls"), F.round(F.sum("ms") / F.count("*"), 6).alias("latency_ms_mean"), F.round(F.count_if("answered") / F.count("*"), 6).alias("answered_rate"))


def provider_added(stored: DataFrame, calls: DataFrame) -> DataFrame:
    """Stored counters (day, provider, calls, answered, ms, cost) after calls (day, provider, answered, ms, cost) are added to them."""
    new = calls.select("day", "provider", F.lit(1).cast("long").alias("calls"), F.col("answered").cast("long").alias("answered"), F.coalesce(F.col("ms").cast("double"), F.lit(0.0)).alias("ms"), F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost"))
    both = stored.select("day", "provider", "calls", "answered", "ms", "cost").unionByName(new)
    return both.groupBy("day", "provider").agg(F.sum("calls").alias("calls"), F.sum("answered").alias("answered"), F.round(F.sum("ms"), 6).alias("ms"), F.round(F.sum("cost"), 6).alias("cost"))


def percolation_index(saved: DataFrame, df: DataFrame) -> DataFrame:
    """Saved queries (saved_id, words) by their rarest word: (term, saved_id, words). df (term, df): how many documents hold a word; none: none."""
    wanted = saved.select("saved_id", F.array_distinct("words").alias("words")).where(F.size("words") > 0)
    rows = wanted.select("saved_id", "words", F.explode("words").alias("term")).join(df, "term", "left")
    return rows.groupBy("saved_id", "words").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term")).select("term", "saved_id", "words")


def held_words(delta: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, term): which of the wanted words (word) each new document (rid, text) has; dealt by rid, once for all that read it."""
    terms = delta.select("rid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return terms.join(wanted.select(F.col("word").alias("term")).distinct(), "term", "left_semi").repartition("rid")


def met(index: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (saved_id, rid) of a percolation index and documents' words: those that have all of a query's words.

    Queries meet documents by their rarest word; the other words of a pair are counted there, so no text and no array of words is
    sent anywhere, and a frequent word pairs nothing.
    """
    pairs = held.join(index, "term").select("saved_id", "rid", F.size("words").alias("size"), F.explode("words").alias("term"))
    return pairs.join(held, ["rid", "term"]).groupBy("saved_id", "rid").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("n = size").select("saved_id", "rid")


def percolate(saved: DataFrame, delta: DataFrame) -> DataFrame:
    """Saved queries (saved_id, words) x new documents (rid, text): pairs where the document has all words; the rarest word is that of the delta."""
    held = held_words(delta, saved.select(F.explode("words").alias("word")))
    return met(percolation_index(saved, held.groupBy("term").agg(F.count("*").alias("df"))), held)


def unseen(found: DataFrame, most: int = 300) -> DataFrame:
    """(watch, urls, seen) -> what is new, and the seen list after: newest first, bounded."""
    fresh = F.array_except("urls", "seen")
    return found.select("watch", fresh.alias("new"), F.slice(F.array_distinct(F.concat("urls", "seen")), 1, most).alias("seen_after"))


# Words that look like identifiers and are none.
NOT_IDENTIFIERS = ("function", "const", "let", "var", "return", "class", "import", "export", "from", "async", "await", "this", "that", "with", "where", "when", "what", "which", "into", "using", "the", "and", "for", "not")


def identifier_of(q: str) -> str | None:
    """The longest word of a query that can be an identifier, the first of equally long ones."""
    words = [w for w in q.split() if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", w) and len(w) >= 3 and w.lower() not in NOT_IDENTIFIERS]
    return max(words, key=len, default=None)


def code_rank(rows: DataFrame, q: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Merged code rows (matches: the matching lines): the query's identifier as written first, then stars, recency, repo, path."""
    name = identifier_of(q)
    exact = F.exists("matches", lambda t: t.rlike(rf"(^|[^A-Za-z0-9_$]){re.escape(name)}([^A-Za-z0-9_$]|$)")).cast("int") if name else F.lit(0)
    return rows.withColumn("exact", exact).orderBy(F.desc("exact"), F.desc("stars"), F.desc("last_commit"), "repo", "path").offset(offset).limit(limit)


def stream_blocks(text: Column) -> Column:
    """An event stream's text -> its blocks as (event, data); blocks without either go."""
    lines = lambda block, tag: F.filter(F.split(block, "\n"), lambda x: x.startswith(tag))
    value = lambda x, tag: F.regexp_replace(F.substring(x, len(tag) + 1, 1 << 30), r"^\s+", "")
    blocks = F.transform(F.split(text, "\n\n+"), lambda b: F.struct(F.trim(value(F.element_at(lines(b, "event:"), -1), "event:")).alias("event"), F.array_join(F.transform(lines(b, "data:"), lambda x: value(x, "data:")), "\n").alias("data")))
    return F.filter(blocks, lambda x: x["event"].isNotNull() & (x["data"] != ""))


#: What a code stream's matches hold; line numbers there count from 0.
MATCHES = "array<struct<type:string,repository:string,path:string,commit:string,repoStars:long,language:string,lineMatches:array<struct<line:string,lineNumber:int>>>>"


def stream_matches(responses: DataFrame, most: int = 50) -> DataFrame:
    """Event-stream responses (text) -> content matches (repo, ref, path, stars, language, lines from 1), at most so many of one response."""
    events = responses.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.posexplode(stream_blocks(F.col("text"))).alias("_at", "e")).where("e.event = 'matches'")
    found = events.select("_row", "_at", F.posexplode(F.from_json("e.data", MATCHES)).alias("_n", "m")).where("m.type = 'content' and m.repository <> '' and m.path <> '' and m.commit <> ''")
    w = Window.partitionBy("_row").orderBy("_at", "_n")
    kept = found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    numbers = F.array_distinct(F.transform(F.filter("m.lineMatches", lambda x: x["lineNumber"].isNotNull()), lambda x: x["lineNumber"] + 1))
    return kept.select(F.col("m.repository").alias("repo"), F.col("m.commit").alias("ref"), F.col("m.path").alias("path"), F.coalesce("m.repoStars", F.lit(0)).alias("stars"), F.col("m.language").alias("language"), numbers.alias("lines"))


def grep_rows(results: DataFrame) -> DataFrame:
    """Rows (line) of `path:line:text` -> (path, number, text); what isn't one goes."""
    part = lambda i: F.regexp_extract("line", r"(?s)^([^:]+):([0-9]+):(.*)$", i)
    return results.where(F.col("line").rlike(r"(?s)^[^:]+:[0-9]+:")).select("*", part(1).alias("path"), part(2).cast("int").alias("number"), part(3).alias("text"))


def newest_repos(repos: DataFrame, most: int = 20) -> DataFrame:
    """The public repositories that a fan-out asks: newest pushed first."""
    return repos.where("not private").orderBy(F.desc("pushed_at"), "full_name").limit(most)


def fragment_lines(blob: Column, fragment: Column) -> Column:
    """The line numbers (from 1) that a fragment covers in its file, empty where it isn't there."""
    at = F.position(fragment, blob)
    first = F.size(F.split(F.substring(blob, F.lit(1), F.greatest(at - 1, F.lit(0))), "\n"))
    return F.when(at > 0, F.sequence(first, first + F.size(F.split(fragment, "\n")) - 1)).otherwise(F.array().cast("array<int>"))


def provider_rows(rows: DataFrame) -> DataFrame:
    """A web provider's sources (position from 0 of n) with their score: 1 - position / n."""
    return rows.withColumn("score", F.round(1 - F.col("position") / F.greatest(F.lit(1), F.col("n")), 6))


def quota(calls: DataFrame, per_minute: int) -> DataFrame:
    """(source, at in ms): which calls a source's calendar minutes allow, in order."""
    w = Window.partitionBy("source", F.floor(F.col("at") / 60000)).orderBy("at", "call_id")
    return calls.withColumn("allowed", F.row_number().over(w) <= per_minute)


def usage(runs: DataFrame) -> DataFrame:
    """What the model calls of each answer used: tokens in and out and their cost; calls without a receipt, or with one that is no number, add nothing."""
    number = lambda c, kind: F.sum(F.coalesce(F.col(c).cast("string").try_cast(kind), F.lit(0).cast(kind)))
    return runs.groupBy("answer").agg(number("tokens_in", "long").alias("tokens_in"), number("tokens_out", "long").alias("tokens_out"), F.round(number("cost_usd", "double"), 6).alias("cost_usd"))


def answer_costs(steps: DataFrame) -> DataFrame:
    """What each answer cost and took, over its steps; steps without a receipt count nothing."""
    return steps.groupBy("answer").agg(F.count("*").alias("steps"), F.count_if("answered").alias("answered"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost"), F.max(F.coalesce("ms", F.lit(0.0))).alias("slowest"))
