"""Benchmark decontamination with spaced seeds.

Words are runs of letters, digits and non-ASCII bytes, A-Z as a-z. A seed is a fixed mask over consecutive words; the
words under its zeros are ignored, so a substituted word there does not hide the passage. Seeds of test items and of
documents are joined on their hashes; each hit names a diagonal (document offset minus item offset), along which the whole
item is compared: any stretch of at least `least` words (the whole item, if that is shorter) of which the share `similar`
is equal is an overlap, wherever the substituted words are. Both sides count repeats once: a diagonal is verified once.

A seed that comes again and again (junk of one word, or of a few in turn) would meet itself quadratically. So its places, in the
item and in the document, are held as progressions, place + k * step, and two progressions of one step give their diagonals as a
progression too: as many as both have places, not the product. Diagonals of one item and document are verified longest
first, a few and then four times as many, and those that can neither lengthen the longest overlap nor begin before the first
one are done without being compared.

The masks lose no overlap of 13 words and 80 %: each placement of substitutions that the rule allows leaves one of them
whole. A stretch of 26 words or more has one of half its length that is as similar, so 13 to 25 words were tried out, all
placements, and 5 to 12 words for the masks of SHORT; items of 1 to 4 words allow none and are sought by all their words.
With a smaller `least` or `similar` than these, masks can miss overlaps.

The test set is read in blocks of at most BLOCK bytes, which are broadcast one at a time: what the driver and a worker hold is
bounded whatever the size of the test set. One block's result is one pass over the documents; with several, the documents are
written once with a number, each block's pass writes the numbers and overlaps of the rows it found, and those meet the rows in the end.
No text is shuffled.

Defined cases: null text is empty and clean; items without a word are not searched; repeated items are reported under each
of their ids; empty tables give clean documents or no rows; extra columns are ignored. Every row of docs gives one row of
its own result, also with a null or repeated doc_id and with several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import ship, stored

LONG = ("1111011", "1110100011", "11000011011", "1110111")
SHORT = ("1111", "11011", "11101", "10111")
#: (mask, least words and most words of the items it serves)
MASKS = (*((m, 13, 1 << 62) for m in LONG), *((m, 5, 12) for m in SHORT), *(("1" * n, n, n) for n in range(1, 5)))
BLOCK, TABLE, COMPARED = 8 << 20, 1 << 20, 1 << 20
FOUND = "items array<long>, overlap long, first_word long"


def _seeds(h: np.ndarray, at: np.ndarray, mask: str) -> np.ndarray:
    out = np.zeros(len(at), K.U)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = K.mix(out * K.U(0x9E3779B97F4A7C15) + h[at + i])
    return out


class Items:
    """Test items of one block: word hashes and seeds in sorted arrays."""

    def __init__(self, ids: list, texts: list):
        raw, off = K.buffers(pa.array(texts, pa.large_string()))
        raw = K.LOWER[raw]
        start, end, row = K.words(raw, off, K.MARK)
        self.ids = np.array([-1 if x is None else x for x in ids], np.int64)
        self.h = K.word_hashes(raw, start, end)
        self.off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids)))]) if len(ids) else np.zeros(1, np.int64)
        self.known = np.zeros(TABLE, dtype=bool)
        self.known[(self.h & K.U(TABLE - 1)).astype(np.int64)] = True
        self.seeds = []
        size = np.diff(self.off)
        for mask, fewest, most in MASKS:
            at = np.arange(max(0, len(self.h) - len(mask) + 1))
            at = at[(row[at] == row[at + len(mask) - 1]) & (size[row[at]] >= fewest) & (size[row[at]] <= most)] if len(at) else at
            self.seeds.append(progressions(_seeds(self.h, at, mask), row[at], at))

    def hits(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Distinct (item, diagonal, document row) of the seeds that documents and items share."""
        known = self.known[(h & K.U(TABLE - 1)).astype(np.int64)]
        found = []
        for (mask, _, _), (value, item, place, step, times) in zip(MASKS, self.seeds, strict=True):
            n = len(h) - len(mask) + 1
            if n <= 0 or not len(value):
                continue
            ok = row[:n] == row[len(mask) - 1 :]
            for i, bit in enumerate(mask):
                if bit == "1":
                    ok &= known[i : n + i]
            spot = np.flatnonzero(ok)
            seed = _seeds(h, spot, mask)
            use = value[np.minimum(np.searchsorted(value, seed), len(value) - 1)] == seed
            seed, of, spot, stride, often = progressions(seed[use], row[spot[use]], spot[use])
            lo, hi = np.searchsorted(value, seed, "left"), np.searchsorted(value, seed, "right")
            many = hi - lo
            if not len(spot):
                continue
            which = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            doc = np.repeat(np.arange(len(spot)), many)
            found.append(_diagonals(item[which], place[which], step[which], times[which], of[doc], spot[doc], stride[doc], often[doc]))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def progressions(value: np.ndarray, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places by value and group as progressions (value, group, first place, step, places), in order of value; a single place has step 0."""
    order = np.lexsort((place, group, value))
    value, group, place = value[order], group[order], place[order]
    n = len(place)
    if not n:
        return value, group, place, place, place
    same = np.zeros(n, dtype=bool)
    same[1:] = (value[1:] == value[:-1]) & (group[1:] == group[:-1])
    gap = np.zeros(n, np.int64)
    gap[1:] = np.where(same[1:], place[1:] - place[:-1], 0)
    new = ~same
    # a place goes on in a progression if its gap is the one before it, and else begins one; a second place fixes the step
    runs = np.flatnonzero(np.concatenate([[True], (gap[1:] != gap[:-1]) | ~same[1:]]))
    size, step = np.diff(np.append(runs, n)), gap[runs]
    lone = step == 0  # the first place of a value and group, or one that stands alone
    first, times = place[runs] - np.where(lone, 0, step), size + np.where(lone, 0, 1)
    after = np.zeros(len(runs), dtype=bool)
    after[1:] = lone[:-1] & ~lone[1:]
    keep = ~lone.copy()
    follows = np.zeros(len(runs), dtype=bool)
    follows[:-1] = after[1:]
    keep |= lone & ~follows  # a first place with a progression behind it is that progression's
    return value[runs][keep], group[runs][keep], first[keep], np.where(lone, 0, step)[keep], times[keep]


def _diagonals(item, place, step, times, row, spot, stride, often) -> np.ndarray:
    """Distinct (item, diagonal, document row) of pairs of progressions."""
    one = (step == stride) | (times == 1) | (often == 1)  # the diagonals are a progression too
    gap = np.maximum(step, stride)
    low = spot - place - (times - 1) * step
    out, count = [], times + often - 1
    for part in _bounded(np.flatnonzero(one), count):
        each = count[part]
        k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        out.append(np.unique(np.stack([np.repeat(item[part], each), np.repeat(low[part], each) + k * np.repeat(gap[part], each), np.repeat(row[part], each)], axis=1), axis=0))
    count = times * often
    for part in _bounded(np.flatnonzero(~one), count):
        each = count[part]
        k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        inner = np.repeat(often[part], each)
        at = np.repeat(spot[part], each) + k % inner * np.repeat(stride[part], each) - np.repeat(place[part], each) - k // inner * np.repeat(step[part], each)
        out.append(np.unique(np.stack([np.repeat(item[part], each), at, np.repeat(row[part], each)], axis=1), axis=0))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def _bounded(which: np.ndarray, size: np.ndarray, most: int | None = None) -> list[np.ndarray]:
    """Numbers in parts whose sizes sum to about `most`."""
    if not len(which):
        return []
    piece = (np.cumsum(size[which]) - 1) // (most or COMPARED)
    return np.split(which, np.flatnonzero(np.diff(piece)) + 1)


def longest_stretch(same: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """(start, words) of the longest stretch, then the first, of which the share num / den at least is equal."""
    total = np.concatenate([[0], np.cumsum(np.where(same, den - num, -num))])
    begin = np.searchsorted(-np.minimum.accumulate(total), -total)  # the first place whose sum is no higher
    words = np.arange(len(total)) - begin
    end = int(np.argmax(words))
    return int(begin[end]), int(words[end])


def _found(items: Items, raw: np.ndarray, off: np.ndarray, least: int, similar: float) -> dict[int, list]:
    """Verified overlaps (words, item, first word) of each row that has one, less the unequal words at their ends."""
    raw = K.LOWER[raw]
    start, end, row = K.words(raw, off, K.MARK)
    h = K.word_hashes(raw, start, end)
    first = np.searchsorted(row, np.arange(len(off)))
    share = Fraction(similar).limit_denominator(1000)
    hits = items.hits(h, row)
    item, diagonal, of = hits.T
    a, b = items.off[item], items.off[item + 1]
    lo, hi = np.maximum(first[of], a + diagonal), np.minimum(first[of + 1], b + diagonal)
    need, size, begins = np.minimum(least, b - a), hi - lo, lo - first[of]
    found: dict[int, list] = {}
    # by item and document, the longest diagonal first, then the one that begins first
    order = np.lexsort((begins, -size, item, of))
    new = np.concatenate([[True], (item[order][1:] != item[order][:-1]) | (of[order][1:] != of[order][:-1])]) if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    top, soon = np.zeros(int(new.sum()), np.int64), np.full(int(new.sum()), np.iinfo(np.int64).max)
    todo, share_of = order[size[order] >= need[order]], 4
    while len(todo):
        cut = np.flatnonzero(np.concatenate([[True], group[todo][1:] != group[todo][:-1]]))
        inside = np.arange(len(todo)) - np.repeat(cut, np.diff(np.append(cut, len(todo))))
        for part in _bounded(todo[inside < share_of], size):
            edge = np.concatenate([[0], np.cumsum(size[part])])
            at = np.arange(edge[-1]) + np.repeat(lo[part] - edge[:-1], size[part])
            same = h[at] == items.h[at - np.repeat(diagonal[part], size[part])]
            enough = K.run_sums(same.astype(np.int64), edge) * share.denominator >= share.numerator * need[part]
            for n in np.flatnonzero(enough).tolist():
                k, one = part[n], same[edge[n] : edge[n + 1]]
                begin, words = longest_stretch(one, share.numerator, share.denominator)
                if words >= need[k]:
                    equal = begin + np.flatnonzero(one[begin : begin + words])
                    overlap, at_word = int(equal[-1] - equal[0]) + 1, int(begins[k] + equal[0])
                    found.setdefault(int(of[k]), []).append((overlap, int(items.ids[item[k]]), at_word))
                    top[group[k]], soon[group[k]] = max(top[group[k]], overlap), min(soon[group[k]], at_word)
        todo = todo[inside >= share_of]
        todo = todo[(size[todo] > top[group[todo]]) | (begins[todo] < soon[group[todo]])]  # the others can change nothing
        share_of *= 4
    return found


NUMBERED = f"row long, {FOUND}"


def _scan(shared, least: int, similar: float, key: str, some: bool):
    """(key, text) -> (key, items, overlap, first word) of all rows, or of some: those with an overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in K.texts(batch, "text"):
                found = _found(shared.value, raw, off, least, similar)
                rows = sorted(found) if some else range(j - i)
                every = [found.get(r, []) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(rows, pa.int64())), pa.array([sorted({x[1] for x in f}) for f in every], pa.list_(pa.int64())),
                     pa.array([max(f)[0] if f else 0 for f in every], pa.int64()), pa.array([min(x[2] for x in f) if f else None for f in every], pa.int64())],
                    [key, "items", "overlap", "first_word"])

    return run


def _clean(shared, at: int, least: int, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in K.texts(batch, batch.schema.names[at]):
                found = _found(shared.value, raw, off, least, similar)
                yield batch.slice(i, j - i).filter(pa.array([r not in found for r in range(j - i)], pa.bool_()))

    return run


def _item_blocks(benchmark: DataFrame) -> tuple[int, Iterator]:
    """How many blocks the test set has, and their broadcasts, each of at most about BLOCK bytes and gone before the next."""
    spark = benchmark.sparkSession
    ship(spark)
    test = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))

    def each():
        for b in range(blocks):
            rows = (test if blocks == 1 else test.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)).collect()
            shared = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows]))
            yield shared
            if blocks > 1:
                shared.destroy()

    return blocks, each()


def _found_rows(rows: DataFrame, blocks: Iterator, least: int, similar: float) -> DataFrame:
    """Rows (row, text) -> (row, items, overlap, first_word) of those in which a block finds something, each row once."""
    parts = [stored(rows.select("row", "text").mapInArrow(_scan(shared, least, similar, "row", True), NUMBERED), "overlaps") for shared in blocks]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("overlap").alias("overlap"), F.min("first_word").alias("first_word"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: int = 13, similar: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, in which no test item is found."""
    n, blocks = _item_blocks(benchmark)
    if n == 1:
        return docs.mapInArrow(_clean(next(blocks), docs.columns.index("text"), least, similar), docs.schema)
    rows = stored(docs.withColumn("quarry:row", F.monotonically_increasing_id()), "numbered")
    found = _found_rows(rows.select(F.col("quarry:row").alias("row"), "text"), blocks, least, similar)
    return rows.join(found.select(F.col("row").alias("quarry:row")), "quarry:row", "left_anti").select(docs.columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 13, similar: float = 0.8) -> DataFrame:
    """documents, benchmark -> (doc_id, contaminated, items, overlap, first_word), one row per row of docs.

    items: ids of the test items found; overlap: words of the longest verified overlap, from its first to its last equal word;
    first_word: where the first begins.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, blocks = _item_blocks(benchmark)
    if n == 1:
        out = rows.mapInArrow(_scan(next(blocks), least, similar, "doc_id", False), f"doc_id long, {FOUND}")
    else:
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        out = rows.select("row", "doc_id").join(_found_rows(rows, blocks, least, similar), "row", "left").withColumns({"items": F.coalesce("items", F.array().cast("array<long>")), "overlap": F.coalesce("overlap", F.lit(0).cast("long"))})
    return out.select("doc_id", (F.col("overlap") > 0).alias("contaminated"), "items", "overlap", "first_word")
