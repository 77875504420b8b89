"""Whole index documents: read from JSON, checked against the schema, normalised, hashed, and what is derived of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clean_text, parse_time
from quarry.schema import DOCUMENT, FACET_KEY, ID, LANGUAGE, LISTED, MAX_BODY, MAX_SUMMARY, MAX_TITLE, MAX_URL, NONE, OWNER, RESTRICTED, TYPE, UNLISTED

# Patterns and limits of a document's parts.
SUBJECT, KEY, REASON = r"^(usr|gst)_[0-9A-HJKMNP-TV-Z]{26}$", r"^[a-z][a-z0-9_.:-]{0,127}$", r"^[a-z][a-z0-9_]{1,63}$"
DATE_TIME = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
VISIBILITIES = ("public", "unlisted", "members", "private", "draft")
STATES = ("draft", "scheduled", "published", "unpublished", "retracted", "archived")
AUTHORSHIP = ("human", "ai_assisted", "ai_generated", "imported")
MOST_ERRORS, MOST_REVISION = 20, (1 << 53) - 1


def parsed(payload: Column) -> Column:
    """A document struct of its JSON text; null where that is no object. Facet values become lists of texts, whatever they were."""
    raw = F.try_parse_json(payload)
    doc = F.from_json(payload, DOCUMENT.replace("facets map<string,array<string>>", "facets string"))
    facets = F.try_variant_get(raw, "$.facets", "map<string, variant>")
    lists = F.transform_values(facets, lambda _, v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>")).otherwise(F.array(F.try_variant_get(v, "$", "string"))))
    whole = F.get(F.transform(F.array(doc), lambda d: d.withField("facets", lists)), F.lit(0))  # of a variable, so that the text is parsed once and not for each field
    return F.when(F.try_variant_get(raw, "$", "map<string, variant>").isNotNull(), whole)


# What each part of a payload is in JSON.
KINDS = {"owner": "STRING", "type": "STRING", "id": "STRING", "revision": "BIGINT", "deleted": "BOOLEAN", "visibility": "STRING", "acl": "OBJECT", "canonical_url": "STRING", "title": "STRING", "summary": "STRING", "body": "STRING", "facets": "OBJECT", "language": "STRING", "authorship": "STRING", "provenance": "ARRAY", "publication_state": "STRING", "published_at": "STRING", "updated_at": "STRING", "indexability": "OBJECT"}
MAY_BE_NULL = ("published_at", "updated_at")


def misshapen(payload: Column) -> Column:
    """Parts of a payload that the schema doesn't know or that are of another kind, as (path, message); a payload that is no object is one."""
    top = F.try_variant_get(F.try_parse_json(payload), "$", "map<string, variant>")
    known = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    kinds = F.map_entries(F.transform_values(top, lambda _, v: F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), "^[A-Z]+", 0)))
    wrong = F.filter(kinds, lambda e: ~F.coalesce((F.element_at(known, e["key"]) == e["value"]) | (e["key"].isin(*MAY_BE_NULL) & (e["value"] == "VOID")), F.lit(False)))
    said = lambda e: F.struct(F.concat(F.lit("/"), e["key"]).alias("path"), F.when(F.array_contains(F.map_keys(known), e["key"]), "of another kind").otherwise("unknown").alias("message"))
    none = F.array(F.struct(F.lit("/").alias("path"), F.lit("not an object").alias("message")))
    return F.when(top.isNull(), none).otherwise(F.transform(F.array_sort(wrong), said))


def problems(doc: str) -> Column:
    """What is wrong with a document struct, as (path, message), at most 20; a tombstone needs an identity and a revision alone."""
    c = lambda name: F.col(f"{doc}.{name}")
    none = F.array().cast("array<string>")
    live = ~F.coalesce(c("deleted"), F.lit(False))
    not_like = lambda name, pattern: c(name).isNotNull() & ~c(name).rlike(pattern)
    not_in = lambda name, values: c(name).isNotNull() & ~c(name).isin(*values)
    long = lambda name, most: F.char_length(c(name)) > most
    some = lambda name, bad: F.exists(F.coalesce(c(name), none), lambda x: x.isNull() | bad(x))
    twice = lambda name: F.size(F.array_distinct(F.coalesce(c(name), none))) != F.size(F.coalesce(c(name), none))
    prov = lambda bad: F.coalesce(F.exists(c("provenance"), bad), F.lit(False))
    keys, values = F.coalesce(F.map_keys(c("facets")), none), F.coalesce(F.map_values(c("facets")), F.array().cast("array<array<string>>"))
    checks = [
        (~F.coalesce(c("owner").rlike(OWNER), F.lit(False)), "/owner", "malformed"), (~F.coalesce(c("type").rlike(TYPE), F.lit(False)), "/type", "malformed"), (~F.coalesce(c("id").rlike(ID), F.lit(False)), "/id", "malformed"),
        (~F.coalesce(c("revision").between(0, MOST_REVISION), F.lit(False)), "/revision", "out of range"),
        (live & (c("visibility").isNull() | not_in("visibility", VISIBILITIES)), "/visibility", "not allowed"),
        (live & (c("publication_state").isNull() | not_in("publication_state", STATES)), "/publication_state", "not allowed"),
        (live & c("title").isNull(), "/title", "required"), (live & c("indexability.decision").isNull(), "/indexability/decision", "required"), (live & not_in("indexability.decision", ("index", "noindex")), "/indexability/decision", "not allowed"),
        (live & long("title", MAX_TITLE), "/title", "too long"), (live & long("summary", MAX_SUMMARY), "/summary", "too long"), (live & long("body", MAX_BODY), "/body", "too long"),
        (live & (long("canonical_url", MAX_URL) | not_like("canonical_url", r"^https?://\S+$")), "/canonical_url", "malformed"), (live & not_like("language", LANGUAGE), "/language", "malformed"), (live & not_in("authorship", AUTHORSHIP), "/authorship", "not allowed"),
        (live & not_like("published_at", DATE_TIME), "/published_at", "no date-time"), (live & not_like("updated_at", DATE_TIME), "/updated_at", "no date-time"),
        (live & some("acl.subjects", lambda x: ~x.rlike(SUBJECT)), "/acl/subjects", "malformed"), (live & some("acl.groups", lambda x: ~x.rlike(KEY)), "/acl/groups", "malformed"), (live & some("acl.entitlements", lambda x: ~x.rlike(KEY)), "/acl/entitlements", "malformed"),
        *((live & (twice(f"acl.{n}") | (F.size(c(f"acl.{n}")) > most)), f"/acl/{n}", "too many or repeated") for n, most in (("subjects", 200), ("groups", 100), ("entitlements", 100))),
        (live & ((F.size(keys) > 20) | F.exists(keys, lambda k: ~k.rlike(FACET_KEY))), "/facets", "malformed keys"),
        (live & F.exists(values, lambda v: v.isNull() | (F.size(v) > 50) | F.exists(v, lambda x: x.isNull() | (F.char_length(x) > 200))), "/facets", "malformed values"),
        (live & (F.size(c("provenance")) > 50), "/provenance", "too many"),
        (live & prov(lambda p: ~F.coalesce(p["service"].rlike(OWNER) & p["type"].rlike(TYPE) & F.char_length(p["id"]).between(1, 128), F.lit(False))), "/provenance", "malformed identity"),
        (live & prov(lambda p: (p["revision"] < 0) | (F.char_length(p["label"]) > 200) | (F.char_length(p["url"]) > MAX_URL) | ~p["url"].rlike("^https?://") | ~p["retrieved_at"].rlike(DATE_TIME)), "/provenance", "malformed"),
        (live & (some("indexability.reasons", lambda x: ~x.rlike(REASON)) | twice("indexability.reasons") | (F.size(c("indexability.reasons")) > 20)), "/indexability/reasons", "malformed")]
    return F.slice(F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(said).alias("message"))) for bad, path, said in checks))), 1, MOST_ERRORS)


def normalised(doc: str) -> Column:
    """A valid document as it is kept: texts clean, sets sorted, empty ones null; of a tombstone the identity alone."""
    c = lambda name: F.col(f"{doc}.{name}")
    live = ~F.coalesce(c("deleted"), F.lit(False))
    strings = F.array().cast("array<string>")
    set_ = lambda name: F.array_sort(F.array_distinct(F.coalesce(c(name), strings)))
    kept = lambda x, name: F.when(live, x).alias(name)
    acl = F.struct(set_("acl.subjects").alias("subjects"), set_("acl.groups").alias("groups"), set_("acl.entitlements").alias("entitlements"))
    facets = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(c("facets"), F.create_map().cast("map<string,array<string>>")))))
    return F.struct(
        c("owner").alias("owner"), c("type").alias("type"), c("id").alias("id"), c("revision").alias("revision"), F.coalesce(c("deleted"), F.lit(False)).alias("deleted"),
        kept(c("visibility"), "visibility"), kept(acl, "acl"), kept(F.nullif(c("canonical_url"), F.lit("")), "canonical_url"), *(kept(clean_text(c(n)), n) for n in ("title", "summary", "body")), kept(facets, "facets"),
        *(kept(F.nullif(c(n), F.lit("")), n) for n in ("language", "authorship")), kept(c("provenance"), "provenance"), kept(c("publication_state"), "publication_state"), *(kept(F.nullif(c(n), F.lit("")), n) for n in ("published_at", "updated_at")),
        kept(F.struct(c("indexability.decision").alias("decision"), set_("indexability.reasons").alias("reasons")), "indexability"))


def hashed(doc: str) -> Column:
    """sha256 over every kept field of a normalised document: equal for equal documents."""
    return F.sha2(F.to_json(F.col(doc), {"ignoreNullFields": "false"}), 256)


def facet_number(key: str, facets: str = "facets") -> Column:
    """The first value, in the order of texts, of a facet that reads as a number; null where there is none."""
    return F.array_min(F.filter(F.element_at(facets, key), lambda v: v.rlike(r"^[0-9]+([.][0-9]+)?$"))).cast("double")


def has_facet(key: str, value: str, facets: str = "facets") -> Column:
    return F.coalesce(F.array_contains(F.element_at(facets, key), value), F.lit(False))


def derived(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """Rows with a normalised document -> the columns that search reads: its fields, reasons, exposure, times, and the numbers that rank."""
    c = F.col
    out = rows.select(*(x for x in rows.columns if x != doc), f"{doc}.*")
    strings = F.array().cast("array<string>")
    stub = F.coalesce(F.exists("provenance", lambda p: F.coalesce(p["stub"], F.lit(False))), F.lit(False))
    held = [
        (c("visibility") == "draft", "draft"), (c("visibility") == "private", "private"), (c("visibility") == "members", "members_only"), (c("visibility") == "unlisted", "unlisted"),
        (~c("publication_state").eqNullSafe("published"), "not_published"), (stub, "stub_provider"), ((c("visibility") == "public") & c("canonical_url").isNull(), "missing_canonical_url")]
    found = F.array_compact(F.array(*(F.when(cond, name) for cond, name in held)))
    found = F.when(c("deleted"), F.array(F.lit("deleted"))).otherwise(F.array_sort(F.array_distinct(F.concat(found, F.coalesce(c("indexability.reasons"), strings)))))
    says = F.coalesce(c("indexability.decision") == "index", F.lit(False))
    out = out.withColumn("reasons", found).withColumn("reasons", F.when(~says & (F.size("reasons") == 0), F.array(F.lit("owner_decision"))).otherwise(c("reasons")))
    out = out.withColumn("index_decision", F.when(says & (F.size("reasons") == 0), "index").otherwise("noindex"))
    exposure = F.when(c("deleted") | (c("visibility") == "draft") | ~c("publication_state").eqNullSafe("published"), NONE).when(c("visibility") != "public", RESTRICTED).when(c("index_decision") == "index", LISTED).otherwise(UNLISTED)
    number = lambda key: F.coalesce(facet_number(key), F.lit(0.0)).cast("long")
    return out.withColumns({
        "exposure": exposure, "fresh_at": parse_time(F.coalesce("published_at", "updated_at")), "sort_at": F.coalesce("updated_at", "published_at", F.lit("")), "lang": c("language"),
        "live": has_facet("live", "true"), "followers": number("followers"), "duration": number("duration_seconds")}).fillna("", ["title", "summary", "body"])
