"""The stored inverted index: postings by term, the records they point to, and searches that read no text.

Postings are partitioned by audience, dealt out by term and stretches of rids and sorted by term, so a query reads the pages of its
words; records are partitioned by audience and sorted by rid. What search.py ranks from counted texts is ranked here from the
same counts, so both give the same rows.

Beside the postings lie their blocks: for each term and 64 consecutive rids one row with a bit a document for each field the term is
in, and the greatest counts there; and for each block its shortest document and newest date. Bit operations on a query's rows say
which documents of a block match and in how many titles, so a block's best possible rank is nearly exact without a posting being
read. A page takes the blocks of the best bounds first; the last rank it finds there is a threshold, and only blocks that can reach it
are read (Stored.top). Bounds hold under filters, viewers and deletions, which only take documents away.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import tokens
from quarry.schema import LISTED, RESTRICTED, Filters, Match, Profile, Sites, Viewer

from . import search
from .visibility import acl_allows

BITS, FIRST, MOST_BLOCKS = 6, 64, 2048
#: Of postings, so many words a task; rids (as bits) of a term, and of records, that lie in one task.
PART, CHUNK, CHUNK_RECORDS = 1 << 20, 14, 10


def _pieces(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """build(), with the words of each document counted where it is read; a rid that comes twice has its rows apart."""
    held = docs.where(F.col("exposure").isin(LISTED, RESTRICTED)).withColumn("audience", F.col("exposure"))
    codes = list(search.NAMES)
    words = held.select("rid", "audience", *(tokens(F.col(name)).alias(f"w{code}") for code, name in search.NAMES.items()))
    out = T.StructType([words.schema["rid"], words.schema["audience"], T.StructField("term", T.StringType()), *(T.StructField(f"n{c}", T.LongType()) for c in codes)])

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for part in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                lists = [part.column(f"w{c}") for c in codes]
                flat = [x.flatten() for x in lists]
                terms = pa.concat_arrays(flat).dictionary_encode()
                n = max(1, len(terms.dictionary))
                rows = np.concatenate([np.repeat(np.arange(len(x)), x.value_lengths().fill_null(0).to_numpy()) for x in lists])
                cells, at = np.unique(rows * n + terms.indices.to_numpy(), return_inverse=True)
                field = np.repeat(np.arange(len(codes)), [len(x) for x in flat])
                counts = np.bincount(at * len(codes) + field, minlength=len(cells) * len(codes)).reshape(-1, len(codes))
                of = pa.array(cells // n)
                yield pa.RecordBatch.from_arrays([part.column("rid").take(of), part.column("audience").take(of), terms.dictionary.take(pa.array(cells % n)), *(pa.array(counts[:, i], pa.int64()) for i in range(len(codes)))], out.names)

    doc_len = F.size(tokens(F.col("title"))) + F.size(tokens(F.col("summary"))) + F.size(tokens(F.col("body")))
    return words.mapInArrow(count, out), held.withColumn("doc_len", doc_len).drop("body")


def _sums() -> list[Column]:
    return [F.sum(f"n{c}").alias(f"n{c}") for c in search.NAMES]


def build(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings (rid, audience, term, n3, n2, n1), records) of listed and restricted documents."""
    pieces, records = _pieces(docs)
    return pieces.groupBy("rid", "audience", "term").agg(*_sums()), records


def store(docs: DataFrame, path: str, files: int | None = None) -> None:
    """Writes the index whole; the folder is a version, to be switched to when it is complete."""
    chars = docs.agg(F.sum(F.length("body"))).first()[0] or 0
    write(*_pieces(docs), path, files or _files(docs.sparkSession, chars // 6))


def _files(spark: SparkSession, words: int) -> int:
    """So many tasks that none sorts more than some PART words, however large the table is."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(words / PART))


def write(postings: DataFrame, records: DataFrame, path: str, files: int | None = None) -> None:
    """Postings and records, and their blocks, in the order that searches prune by.

    Postings are dealt out once, by term and CHUNK rids, so that a word of every document is many tasks and a block is in one: blocks
    are made where the postings lie, which are kept on the executors' disks until both are written.
    """
    spark = postings.sparkSession
    n = files or _files(spark, records.agg(F.sum("doc_len")).first()[0] or 0)

    def put(df: DataFrame, name: str, *order: str) -> None:
        df.sortWithinPartitions("audience", *order).write.mode("overwrite").partitionBy("audience").parquet(f"{path}/{name}")

    chunk = F.shiftright(F.col("rid"), CHUNK).alias("chunk")
    dealt = postings.select("*", chunk).repartition(n, "audience", "term", "chunk").groupBy("audience", "term", "chunk", "rid").agg(*_sums())
    dealt = dealt.sortWithinPartitions("audience", "term", "rid").persist(StorageLevel.DISK_ONLY)
    try:
        put(dealt.select("rid", "audience", "term", *(f"n{c}" for c in search.NAMES)), "postings", "term", "rid")
        put(blocks(dealt, "chunk").drop("chunk"), "blocks", "term", "block")
    finally:
        dealt.unpersist()
    put(records.repartition(n, "audience", F.shiftright(F.col("rid"), CHUNK_RECORDS)), "records", "rid")
    put(tops(spark.read.parquet(f"{path}/records")).coalesce(n), "tops", "block")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/records")


def block_of(rid: str = "rid") -> Column:
    return F.shiftright(F.col(rid), BITS)


def blocks(postings: DataFrame, *dealt: str) -> DataFrame:
    """(audience, term, block, b3, b2, b1, m3, m2, m1): a bit a document that has the term in a field, and the greatest counts."""
    bit = F.expr(f"shiftleft(1L, cast(rid & {(1 << BITS) - 1} as int))")
    cells = [c for f in search.NAMES for c in (F.bit_or(F.when(F.col(f"n{f}") > 0, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{f}"), F.max(f"n{f}").alias(f"m{f}"))]
    return postings.groupBy("audience", "term", *dealt, block_of().alias("block")).agg(*cells)


def tops(records: DataFrame) -> DataFrame:
    """(audience, block, shortest, newest, undated) of each block's documents."""
    return records.groupBy("audience", block_of().alias("block")).agg(F.min("doc_len").alias("shortest"), F.max("fresh_at").alias("newest"), F.bool_or(F.col("fresh_at").isNull()).alias("undated"))


def bounds(blocks_: DataFrame, tops_: DataFrame, match: Match, viewer: Viewer = Viewer(), weights: dict[str, float] | None = None, profile: Profile = Profile(), sites: Sites | None = None) -> DataFrame:
    """(audience, block, bound): no document of the block that matches has a higher -rank; blocks without one are left out."""
    n, codes = range(len(match.words)), [match.field] if match.field else list(search.NAMES)
    audiences = [LISTED] if viewer.subject is None else [LISTED, RESTRICTED]
    zero = F.lit(0).cast("long")
    any_ = reduce(Column.__or__, [_term(match, i) for i in n])
    cells = [c for i in n for f in search.NAMES for c in (F.bit_or(F.when(_term(match, i), F.col(f"b{f}")).otherwise(zero)).alias(f"b{i}_{f}"), F.sum(F.when(_term(match, i), F.col(f"m{f}")).otherwise(zero)).alias(f"m{i}_{f}"))]
    rows = blocks_.where(F.col("audience").isin(audiences) & any_).groupBy("audience", "block").agg(*cells)
    bits = lambda a, b: a.bitwiseOR(b)
    has = [reduce(bits, [F.col(f"b{i}_{f}") for f in codes]) for i in n]
    rows = rows.withColumn("hit", reduce(bits if match.any else (lambda a, b: a.bitwiseAND(b)), has)).where("hit <> 0")
    in_field = lambda f: reduce(bits, [F.col(f"b{i}_{f}") for i in n]).bitwiseAND(F.col("hit")) != 0
    tier = F.greatest(*(F.when(in_field(f), f).otherwise(0) for f in codes), F.lit(0))
    titles = F.lit(0)
    if len(match.words) > 1:
        level = [F.lit(-1).cast("long")] + [zero] * 4  # level[j]: documents with the word in j titles or more
        for i in n:
            level = [level[0]] + [level[j].bitwiseOR(level[j - 1].bitwiseAND(F.col(f"b{i}_3"))) for j in range(1, 5)]
            rows = rows.withColumns({f"_l{i}_{j}": level[j] for j in range(1, 5)})
            level = [level[0]] + [F.col(f"_l{i}_{j}") for j in range(1, 5)]
        titles = F.greatest(F.lit(0), *(F.when(level[j].bitwiseAND(F.col("hit")) != 0, j).otherwise(0) for j in range(1, 5)))
    field_weight = {search.TITLE: profile.title, search.SUMMARY: profile.summary, search.BODY: profile.body}
    raw = reduce(Column.__add__, [field_weight[f] * F.log(1.0 + F.col(f"m{i}_{f}")) for i in n for f in search.NAMES])
    relevance = 1 - F.exp(-raw / (1 + F.log(1.0 + F.col("shortest"))))
    newest = search.freshness(profile, "newest")
    fresh = F.when(F.col("undated"), F.greatest(F.lit(1.0), newest)).otherwise(newest)
    best = lambda i: F.greatest(*(F.when(F.col(f"m{i}_{f}") > 0, profile.cover[3 - f]).otherwise(0.0) for f in search.NAMES), F.lit(0.0))
    cover = F.round(reduce(Column.__add__, [F.lit(float(weights[w])) * best(i) for i, w in enumerate(match.words)]), 1) if weights else F.lit(0.0)
    site = 10 if search.site_hosts(match, sites) else 0
    bound = cover * 10000 + (tier + site) * 100 + (profile.answer if match.question else 0.0) + titles * 10 + relevance * fresh + max(0.0, profile.thin)
    return rows.join(tops_, ["audience", "block"]).select("audience", "block", bound.alias("bound"))


@dataclass
class Stored:
    """An index in a folder; top() reads of it what a page needs."""

    postings: DataFrame
    records: DataFrame
    blocks: DataFrame
    tops: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Stored:
        return cls(*load(spark, path), spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/tops"))

    def within(self, chosen: DataFrame | list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
        """Postings and records of some blocks: few as a filter that reaches the files, many by a join."""
        if isinstance(chosen, list):
            held = sorted({b for _, b in chosen})
            inside = reduce(Column.__or__, [F.col("rid").between(a << BITS, ((b + 1) << BITS) - 1) for a, b in _ranges(held)]) & block_of().isin(held)
            return self.postings.where(inside), self.records.where(inside)
        both = lambda df: df.withColumn("block", block_of()).join(chosen.select("audience", "block"), ["audience", "block"], "left_semi").drop("block")
        return both(self.postings), both(self.records)

    def top(self, limit: int, match: Match, viewer: Viewer = Viewer(), filters: Filters = Filters(), key: tuple | None = None, weights: dict[str, float] | None = None, profile: Profile = Profile(), sites: Sites | None = None) -> tuple[list, int | None]:
        """(the rows that search.page gives of the whole ranked set, how many blocks were read; none: all postings of the words).

        Blocks are taken best bound first, FIRST of them, then four times as many, until the last row that is found is better
        than the next block can be. A duplicate's better copy in a block that was left out would be worse than that row too, so
        the rows are whole. Where more than MOST_BLOCKS are needed, those that reach the threshold are joined, not listed. Where
        a query names a site, records without its words are candidates too, which no block holds: then all is read.
        """
        full = lambda postings, records: search.page(search_set(postings, records, match, viewer, weights, profile, sites, filters), limit, key).select(*search.ORDER).collect()
        if search.site_only(match, sites):
            return full(self.postings, self.records), None
        bound = bounds(self.blocks, self.tops, match, viewer, weights, profile, sites)
        best = bound.orderBy(F.desc("bound"), "audience", "block").limit(MOST_BLOCKS + 1).collect()
        n, rows = FIRST, []
        while best:
            rows = full(*self.within([(r.audience, r.block) for r in best[: min(n, MOST_BLOCKS)]]))
            if n >= len(best) and len(best) <= MOST_BLOCKS or len(rows) == limit and n < len(best) and -rows[-1]["rank"] > best[n].bound + 2e-6:
                return rows, min(n, len(best))
            if n >= MOST_BLOCKS:
                break
            n = min(4 * n, MOST_BLOCKS)
        if not best:
            return [], 0
        if len(rows) == limit:
            floor = -rows[-1]["rank"]
            rows = full(*self.within(bound.where(F.col("bound") >= floor - 2e-6)))
            if len(rows) == limit and -rows[-1]["rank"] >= floor:
                return rows, bound.where(F.col("bound") >= floor - 2e-6).count()
        return full(self.postings, self.records), None


def _ranges(numbers: list[int], most: int = 32) -> list[tuple[int, int]]:
    """At most so many ranges that cover ascending numbers, cut at the widest gaps: what the files are pruned by."""
    cuts = sorted(sorted(range(1, len(numbers)), key=lambda i: numbers[i - 1] - numbers[i])[: most - 1])
    return [(numbers[a], numbers[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True)]


def merged(postings: DataFrame, records: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put and remove: the index after documents changed (with their new exposure); those no longer listed or restricted go."""
    ids = changed.select("rid").distinct()
    more, rows = build(changed)
    return postings.join(ids, "rid", "left_anti").unionByName(more), records.join(ids, "rid", "left_anti").unionByName(rows.select(records.columns))


def _term(match: Match, i: int):
    word = match.words[i]
    return F.col("term").startswith(word) if match.prefix and i == len(match.words) - 1 else F.col("term") == word


def weights_of(postings: DataFrame, match: Match, most: int = 1000) -> dict[str, float]:
    """Weights of a query's words by their bounded number of listed documents."""
    every = None
    for i, word in enumerate(match.words):
        held = postings.where((F.col("audience") == LISTED) & _term(match, i)).select("rid")
        held = held.distinct() if match.prefix and i == len(match.words) - 1 else held
        one = held.limit(most).agg(F.count("*").alias("df")).select(F.lit(word).alias("word"), search.word_weight(F.col("df")).alias("w"))
        every = one if every is None else every.unionByName(one)
    return {r.word: r.w for r in every.collect()}


def counted(postings: DataFrame, records: DataFrame, match: Match, viewer: Viewer = Viewer(), filters: Filters = Filters(), sites: Sites | None = None) -> DataFrame:
    """Visible records that hold one of the words (or are on a site the query names), with counts as search.counted() gives."""
    audiences = [LISTED] if viewer.subject is None else [LISTED, RESTRICTED]
    any_ = _term(match, 0)
    for i in range(1, len(match.words)):
        any_ = any_ | _term(match, i)
    cells = [F.sum(F.when(_term(match, i), F.col(f"n{c}")).otherwise(0)).alias(f"n{i}_{c}") for i in range(len(match.words)) for c in search.NAMES]
    hits = postings.where(F.col("audience").isin(audiences) & any_).groupBy("rid").agg(*cells)
    rows = records.where(F.col("audience").isin(audiences))
    if viewer.subject is not None:
        rows = rows.where((F.col("exposure") == LISTED) | acl_allows(viewer, rows))
    rows = search.narrowed(rows, filters)
    if search.site_only(match, sites):
        joined = rows.join(hits, "rid", "left").where(F.col("n0_3").isNotNull() | search.on_sites(search.site_hosts(match, sites), sites))
        return joined.fillna(0, [f"n{i}_{c}" for i in range(len(match.words)) for c in search.NAMES])
    return rows.join(hits, "rid")


def search_set(postings: DataFrame, records: DataFrame, match: Match, viewer: Viewer = Viewer(), weights: dict[str, float] | None = None, profile: Profile = Profile(), sites: Sites | None = None, filters: Filters = Filters()) -> DataFrame:
    """What search.search_set() gives, from the stored index."""
    rows = search.rank_parts(counted(postings, records, match, viewer, filters, sites), match, weights, profile, sites)
    return search.deduplicated(search.scored(rows, match, profile).drop("summary"))
