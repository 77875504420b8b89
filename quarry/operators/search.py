"""Inverted index, ranking, paging, facets, suggestions and snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import clean, folded, tokens
from quarry.schema import LISTED, NONE, RESTRICTED, Filters, Match, Profile, Sites, Viewer

from .visibility import FACETS, acl_allows, facet_pairs, visible

TITLE, SUMMARY, BODY = 3, 2, 1


def postings(docs: DataFrame) -> DataFrame:
    """(rid, audience, field, term, tf) of listed and restricted documents."""
    fields = F.array(*(F.struct(F.lit(code).alias("field"), tokens(F.col(name)).alias("words")) for code, name in ((TITLE, "title"), (SUMMARY, "summary"), (BODY, "body"))))
    rows = docs.where("exposure in (1, 3)").select("rid", F.col("exposure").alias("audience"), F.inline(fields))
    return rows.select("rid", "audience", "field", F.explode("words").alias("term")).groupBy("rid", "audience", "field", "term").agg(F.count("*").alias("tf"))


def term_df(docs: DataFrame, most: int = 1000) -> DataFrame:
    """(term, df): listed documents that hold a term, counted up to a bound."""
    words = F.array_distinct(tokens(F.concat_ws(" ", "title", "summary", "body")))
    return docs.where(F.col("exposure") == LISTED).select(F.explode(words).alias("term")).groupBy("term").agg(F.least(F.count("*"), F.lit(most)).alias("df"))


def word_weight(df) -> Column:
    return F.round(F.log(1 + F.lit(10000.0) / (1 + df)), 2)


def reconcile(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(audience, n_documents, n_indexed, rebuild): whether the index has as many documents as it should."""
    want = docs.where("exposure in (1, 3)").groupBy(F.col("exposure").alias("audience")).agg(F.count("*").alias("n_documents"))
    have = index.groupBy("audience").agg(F.countDistinct("rid").alias("n_indexed"))
    return want.join(have, "audience", "full_outer").select("audience", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_indexed", F.lit(0)).alias("n_indexed")).withColumn("rebuild", F.col("n_documents") != F.col("n_indexed"))


DAY = 86_400_000.0


def freshness(profile: Profile = Profile(), at: str = "fresh_at") -> Column:
    """What relevance is multiplied by: by age in days at the profile's clock; a future date is today, no date 1."""
    age = F.greatest(F.lit(0.0), (F.lit(profile.clock()) - F.col(at)) / DAY)
    return F.when(F.col(at).isNull(), 1.0).otherwise(1 + profile.freshness * F.pow(F.lit(2.0), -age / profile.half_life_days))


def importance() -> Column:
    return F.when(F.col("type") == "channel", F.when(F.col("live"), 1_000_000).otherwise(0) + F.least(F.col("followers"), F.lit(999_999))).when(F.col("type") == "vod", F.least(F.col("duration"), F.lit(999_999))).otherwise(0).cast("long")


def thin(profile: Profile = Profile()) -> Column:
    bare = (F.col("type") != "channel") & (F.char_length("title") <= 24) & (F.char_length("summary") <= 80)
    return F.when(bare | (F.col("title") == ""), profile.thin).otherwise(0.0)


def dedupe_key() -> Column:
    return F.concat_ws("\u0001", F.lower("owner"), F.lower(clean(F.col("title"))))


def _hits(word: str, prefix: bool):
    return (lambda t: t.startswith(word)) if prefix else (lambda t: t == F.lit(word))


NAMES = {TITLE: "title", SUMMARY: "summary", BODY: "body"}


def site_hosts(match: Match, sites: Sites | None) -> list[str]:
    """Hosts that a query names: with the network's word and another one; at most twelve."""
    if not sites or sites.brand not in match.words:
        return []
    known = dict(sites.aliases)
    hosts = [h for w in match.words if w != sites.brand and len(w) > 1 for h in known.get(w, (sites.template.format(word=w, brand=sites.brand),))]
    return list(dict.fromkeys(hosts))[:12]


def on_sites(hosts: list[str], sites: Sites | None) -> Column:
    """Whether the document's URL is on one of the hosts, on a subdomain, or the help site's page of one."""
    if not hosts:
        return F.lit(False)
    any_ = "|".join(re.escape(h) for h in hosts)
    pattern = rf"(?i)^https?://([a-z0-9-]+\.)*({any_})(/|$)"
    if sites.help_host:
        pattern += rf"|^https?://([a-z0-9-]+\.)*{re.escape(sites.help_host)}/a/({any_})(/|$)"
    return F.coalesce(F.col("canonical_url").rlike(pattern), F.lit(False))


def site_only(match: Match, sites: Sites | None) -> bool:
    """A two-word query that names a site: the site's own records are candidates whatever their text."""
    return bool(sites) and match.field is None and len(match.words) == 2 and sites.brand in match.words


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a generator of one row, so that what is computed here is computed once and not copied into each filter and rank that reads it."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def counted(docs: DataFrame, match: Match) -> DataFrame:
    """Adds doc_len and, for word i and field c, n{i}_{c}: how often it is there. A scan; a stored index has the same (index.py)."""
    out = _once(docs, **{f"t{code}": tokens(F.col(name)) for code, name in NAMES.items()})
    cells = {f"n{i}_{c}": F.size(F.filter(f"t{c}", _hits(word, match.prefix and i == len(match.words) - 1))) for i, word in enumerate(match.words) for c in NAMES}
    return _once(out, doc_len=F.size("t3") + F.size("t2") + F.size("t1"), **cells).drop("t1", "t2", "t3")


def rank_parts(rows: DataFrame, match: Match, weights: dict[str, float] | None = None, profile: Profile = Profile(), sites: Sites | None = None) -> DataFrame:
    """Counted rows that match, with the parts of their rank: tier, title_words, cover, relevance."""
    codes = [match.field] if match.field else list(NAMES)
    n = range(len(match.words))
    here = {i: F.greatest(*(F.when(F.col(f"n{i}_{c}") > 0, c).otherwise(0) for c in codes), F.lit(0)) for i in n}
    total = lambda cols: sum(cols[1:], cols[0])
    if match.any:
        test = total([F.col(f"n{i}_{c}") for i in n for c in codes]) > 0
    else:
        test = F.lit(True)
        for i in n:
            test = test & (total([F.col(f"n{i}_{c}") for c in codes]) > 0)
    site = on_sites(site_hosts(match, sites), sites)
    if site_only(match, sites):
        test = test | site
    field_weight = {TITLE: profile.title, SUMMARY: profile.summary, BODY: profile.body}
    raw = total([field_weight[c] * F.log(1.0 + F.col(f"n{i}_{c}")) for i in n for c in NAMES])
    factor = lambda i: F.when(F.col(f"n{i}_3") > 0, profile.cover[0]).when(F.col(f"n{i}_2") > 0, profile.cover[1]).when(F.col(f"n{i}_1") > 0, profile.cover[2]).otherwise(0.0)
    cover = F.round(total([F.lit(float(weights[w])) * factor(i) for i, w in enumerate(match.words)]), 1) if weights else F.lit(0.0)
    titles = F.least(F.lit(4), total([F.when(F.col(f"n{i}_3") > 0, 1).otherwise(0) for i in n])) if len(match.words) > 1 else F.lit(0)
    tier = F.greatest(*here.values(), F.lit(0)) + F.when(site, 10).otherwise(0)
    relevance = 1 - F.exp(-raw / (1 + F.log(1.0 + F.col("doc_len"))))
    if profile.boilerplate:
        empty = (F.col("type") == "channel") & total([F.col(f"n{i}_3") for i in n]).eqNullSafe(0) & F.col("summary").rlike(profile.boilerplate)
        relevance = F.when(empty, 0.0).otherwise(relevance)
    keep = rows.where(test).withColumn("tier", tier).withColumn("title_words", titles).withColumn("cover", cover).withColumn("relevance", relevance)
    return keep.drop(*(f"n{i}_{c}" for i in n for c in NAMES))


def matched(docs: DataFrame, match: Match, weights: dict[str, float] | None = None, profile: Profile = Profile(), sites: Sites | None = None) -> DataFrame:
    """Documents that match, with the parts of their rank, from their texts: a filter over the scan and no shuffle."""
    return rank_parts(counted(docs, match), match, weights, profile, sites)


def narrowed(docs: DataFrame, filters: Filters) -> DataFrame:
    """Owner, type, language, documents indexed after a time, facets, and what names a subject as theirs."""
    for column, wanted in (("owner", filters.owner), ("type", filters.type), ("lang", filters.language)):
        docs = docs.where(F.col(column) == wanted) if wanted is not None else docs
    docs = docs.where(F.col("sort_at") > filters.since) if filters.since is not None else docs
    docs = docs.where(F.col("subject") == filters.subject) if filters.subject is not None else docs
    return facet_filter(docs, {k: list(v) for k, v in filters.facets}) if filters.facets else docs


def weights_of(docs: DataFrame, match: Match, most: int = 1000) -> dict[str, float]:
    """The weight of each of a query's words by how many listed documents hold it; a word's count stops at the bound."""
    listed = _once(docs.where(F.col("exposure") == LISTED).select("title", "summary", "body"), t=tokens(F.concat_ws(" ", "title", "summary", "body")))
    hit = lambda i, word: F.exists("t", _hits(word, True)) if match.prefix and i == len(match.words) - 1 else F.array_contains("t", word)
    held = listed.agg(*(F.least(F.count_if(hit(i, w)), F.lit(most)).alias(f"n{i}") for i, w in enumerate(match.words)))  # one pass, a count a word
    row = held.select(*(word_weight(F.col(f"n{i}")).alias(f"w{i}") for i in range(len(match.words)))).first()
    return {w: row[f"w{i}"] for i, w in enumerate(match.words)}


def scored(rows: DataFrame, match: Match, profile: Profile = Profile()) -> DataFrame:
    """Adds rank (small is good), importance and recency."""
    answer = F.when((F.col("type") == profile.answer_type), profile.answer).otherwise(0.0) if match.question else F.lit(0.0)
    rank = -(F.col("cover") * 10000 + F.col("tier") * 100 + answer + F.col("title_words") * 10 + F.col("relevance") * freshness(profile) + thin(profile))
    return rows.withColumn("rank", F.round(rank, 6)).withColumn("importance", importance()).withColumn("recency", F.col("sort_at") if profile.freshness else F.lit(""))


ORDER = ("rank", "importance", "recency", "rid")


def deduplicated(rows: DataFrame) -> DataFrame:
    """One document of each owner and title: the best ranked."""
    w = Window.partitionBy(dedupe_key()).orderBy("rank", F.desc("importance"), F.desc("recency"), "rid")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def search_set(docs: DataFrame, match: Match, viewer: Viewer = Viewer(), weights: dict[str, float] | None = None, profile: Profile = Profile(), sites: Sites | None = None) -> DataFrame:
    """Visible, matching, ranked, deduplicated: what pages, facets and counts are taken from. Long texts don't ride along."""
    return deduplicated(scored(matched(visible(docs, viewer), match, weights, profile, sites), match, profile).drop("body", "summary"))


def after(rank: float, importance_: int, recency: str, rid: int) -> Column:
    """Rows behind a page's last one, in the four-key order."""
    c = F.col
    return (c("rank") > rank) | ((c("rank") == rank) & ((c("importance") < importance_) | ((c("importance") == importance_) & ((c("recency") < recency) | ((c("recency") == recency) & (c("rid") > rid))))))


def page(rows: DataFrame, limit: int = 20, key: tuple | None = None) -> DataFrame:
    rows = rows.where(after(*key)) if key else rows
    return rows.orderBy("rank", F.desc("importance"), F.desc("recency"), "rid").limit(limit)


def browse(docs: DataFrame, viewer: Viewer = Viewer(), limit: int = 20, key: tuple | None = None) -> DataFrame:
    """Newest first; key: (sort_at, rid) of the last row seen."""
    rows = visible(docs, viewer)
    if key:
        rows = rows.where((F.col("sort_at") < key[0]) | ((F.col("sort_at") == key[0]) & (F.col("rid") < key[1])))
    return rows.orderBy(F.desc("sort_at"), F.desc("rid")).limit(limit)


def facet_filter(docs: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """All keys, any of a key's values; a key that no document has matches nothing. A map of facets is read, where there is one."""
    if "facets" in docs.columns:
        for key, values in wanted.items():
            held = F.arrays_overlap(F.element_at("facets", key), F.array(*map(F.lit, values))) if values else F.lit(False)
            docs = docs.where(F.coalesce(held, F.lit(False)) & (F.col("exposure") > NONE))
        return docs
    columns = dict(FACETS)
    for key, values in wanted.items():
        docs = docs.where(F.col(columns[key]).cast("string").isin(values) & (F.col("exposure") > NONE)) if key in columns else docs.where("false")
    return docs


def facet_counts(rows: DataFrame, keys: list[str], per_key: int = 20) -> DataFrame:
    """(key, value, count) over a result set, whose rows hold their facets: one pass for all keys."""
    n = facet_pairs(rows).where(F.col("key").isin(keys)).groupBy("key", "value").agg(F.count("*").alias("count"))
    w = Window.partitionBy("key").orderBy(F.desc("count"), "value")
    return n.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_key).drop("_n")


MARK_OPEN, MARK_CLOSE = "\u0001", "\u0002"


def snippet(docs: DataFrame, rows: DataFrame, match: Match, before: int = 4, most: int = 16) -> DataFrame:
    """(rid, snippet): up to 16 words around the first hit in summary and body, else the title; hits between marks.

    Texts are fetched for the rows of a page alone.
    """
    page_docs = docs.join(F.broadcast(rows.select("rid")), "rid")
    bare = lambda w: F.regexp_replace(folded(w), r"[^\p{L}\p{N}]", "")
    hit = lambda w: (bare(w).isin(*match.words) | bare(w).startswith(match.words[-1])) if match.prefix else bare(w).isin(*match.words)
    text, title = (F.split(clean(x), " ") for x in (F.concat_ws(" ", "summary", "body"), F.col("title")))
    words = F.when(F.exists(text, hit), text).otherwise(title)
    found = page_docs.select("rid", words.alias("words")).withColumn("at", F.array_position(F.transform("words", hit), True).cast("int"))
    shown = F.transform(F.slice("words", F.greatest(F.lit(1), F.col("at") - before), F.lit(most)), lambda w: F.when(hit(w), F.concat(F.lit(MARK_OPEN), w, F.lit(MARK_CLOSE))).otherwise(w))
    return found.select("rid", F.array_join(shown, " ").alias("snippet"))


def repeats_title(snippet_: Column, title: Column) -> Column:
    """Whether half of a snippet's words of two characters or more, or more of them, are the title's; one without such words says nothing either."""
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{MARK_OPEN}{MARK_CLOSE}]", "")), r"[^\p{L}\p{N}$.]+"), lambda w: F.char_length(w) > 1)
    own = words(title)
    shared = F.size(F.filter(words(snippet_), lambda w: F.array_contains(own, w)))
    return (F.size(words(snippet_)) == 0) | (2 * shared >= F.size(words(snippet_)))


def snippet_html(snippet_: Column) -> Column:
    """A snippet for a page: its text escaped, its hits between mark elements."""
    text = snippet_
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.replace(F.replace(text, F.lit(MARK_OPEN), F.lit("<mark>")), F.lit(MARK_CLOSE), F.lit("</mark>"))


def projected(docs: DataFrame) -> DataFrame:
    """What a viewer gets of a document: never its keys, its hash or its owner's internals."""
    return docs.select("rid", "owner", "type", "id", "revision", "visibility", "title", F.nullif(F.col("summary"), F.lit("")).alias("summary"), "canonical_url", "lang", "sort_at", (F.col("index_decision") == "index").alias("indexable"))
