"""Indexability, exposure and who sees what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import parse_time
from quarry.schema import LISTED, NONE, RESTRICTED, UNLISTED, Viewer


def reasons() -> Column:
    """Sorted set of why a document is not indexed."""
    c = F.col
    held = [
        (c("visibility") == "draft", "draft"), (c("visibility") == "private", "private"), (c("visibility") == "members", "members_only"), (c("visibility") == "unlisted", "unlisted"),
        (c("publication_state") != "published", "not_published"), (c("stub"), "stub_provider"), (c("canonical_url").isNull(), "missing_canonical_url"),
    ]
    found = F.array_sort(F.array_compact(F.array(*(F.when(cond, name) for cond, name in held))))
    found = F.when(c("deleted"), F.array(F.lit("deleted"))).otherwise(found)
    return F.when((c("decision") != "index") & (F.size(found) == 0), F.array(F.lit("owner_decision"))).otherwise(found)


def with_exposure(docs: DataFrame) -> DataFrame:
    """Adds reasons, index_decision, exposure and fresh_at: the ms of published_at, else of updated_at; null where that is no time."""
    c = F.col
    out = docs.withColumn("fresh_at", parse_time(F.coalesce("published_at", "updated_at"))).withColumn("reasons", reasons()).withColumn("index_decision", F.when((c("decision") == "index") & (F.size("reasons") == 0), "index").otherwise("noindex"))
    return out.withColumn(
        "exposure",
        F.when(c("deleted") | (c("visibility") == "draft") | (c("publication_state") != "published"), NONE).when(c("visibility") != "public", RESTRICTED).when(c("index_decision") == "index", LISTED).otherwise(UNLISTED))


def acl_keys(docs: DataFrame) -> DataFrame:
    """(rid, kind, value) of restricted documents."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(v).alias("value")) for k, v in (("s", "subject"), ("g", "grp"), ("e", "entitlement"))))
    return docs.where(F.col("exposure") == RESTRICTED).select("rid", F.inline(pairs))


def acl_pairs(docs: DataFrame) -> DataFrame:
    """(rid, kind, value) from an acl of sets (subjects, groups, entitlements), of restricted documents; each value once."""

    def of(kind: str, name: str) -> Column:
        return F.transform(F.array_distinct(F.coalesce(F.col(f"acl.{name}"), F.array().cast("array<string>"))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    pairs = F.concat(of("s", "subjects"), of("g", "groups"), of("e", "entitlements"))
    return docs.where(F.col("exposure") == RESTRICTED).select("rid", F.inline(pairs))


def acl_allows_sets(viewer: Viewer) -> Column:
    """acl_allows() for an acl of sets."""
    if viewer.subject is None:
        return F.lit(False)
    holds = lambda c, values: F.coalesce(F.arrays_overlap(F.col(f"acl.{c}"), F.array(*map(F.lit, values))), F.lit(False)) if values else F.lit(False)
    named = holds("subjects", (viewer.subject,))
    return F.when(F.col("visibility") == "private", named).otherwise(named | holds("groups", viewer.groups) | holds("entitlements", viewer.entitlements))


def facet_map_pairs(docs: DataFrame) -> DataFrame:
    """(rid, key, value) from a map of facets with lists of texts, of documents that anyone may see; each value of a key once."""
    entries = docs.where(F.col("exposure") > NONE).select("rid", F.explode("facets").alias("key", "values"))
    return entries.select("rid", "key", F.explode(F.array_distinct("values")).alias("value")).where("value is not null")


#: The facets of a document and where they stand in its row.
FACETS = (("lang", "lang"), ("size", "size_bucket"), ("followers", "followers"), ("duration_seconds", "duration"), ("live", "live"), ("type", "type"))


def facet_pairs(docs: DataFrame) -> DataFrame:
    """(rid, key, value) of documents that anyone may see; values as text. Documents with a map of facets are read by that, others by the columns of FACETS."""
    if "facets" in docs.columns:
        return facet_map_pairs(docs)
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(v).cast("string").alias("value")) for k, v in FACETS))
    return docs.where(F.col("exposure") > NONE).select("rid", F.inline(pairs)).where("value is not null")


def acl_allows(viewer: Viewer, docs: DataFrame | None = None) -> Column:
    """private: the subject alone; members and unlisted: subject, a group or an entitlement; nobody: none. Documents with an acl of sets are read by that."""
    if docs is not None and "acl" in docs.columns:
        return acl_allows_sets(viewer)
    if viewer.subject is None:
        return F.lit(False)
    named = F.col("subject") == viewer.subject
    return F.when(F.col("visibility") == "private", named).otherwise(named | F.col("grp").isin(*viewer.groups) | F.col("entitlement").isin(*viewer.entitlements))


def visible(docs: DataFrame, viewer: Viewer) -> DataFrame:
    """The documents a viewer finds in lists; applied before any ranking or window."""
    listed = F.col("exposure") == LISTED
    return docs.where(listed if viewer.subject is None else listed | ((F.col("exposure") == RESTRICTED) & acl_allows(viewer, docs)))


def can_view(viewer: Viewer, docs: DataFrame | None = None) -> Column:
    """By exact id: public ones to all; unlisted ones to any signed-in subject; else as in lists."""
    signed = F.lit(viewer.subject is not None)
    return (F.col("exposure") >= UNLISTED) | ((F.col("exposure") == RESTRICTED) & ((signed & (F.col("visibility") == "unlisted")) | acl_allows(viewer, docs)))
