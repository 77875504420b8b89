"""N-gram Jaccard self-join with connected classes: count-vector R-trees inside exact pigeonhole blocks.

A document is the set of its distinct k-word shingles. Two documents link when den * |A and B| >= num * |A or B|.

1. Blocks. For sizes a <= b of a linking pair at most D = floor((a + b)(den - num)/(den + num)) shingles differ, so when
   the shingles are hashed into m = D + 1 + e groups, e + 1 groups at least are the same in both. A document's keys are the
   contents of its groups, for the scheme of its own size class and of the class below.
2. A document of which fewer than e + 1 keys (empty groups counted) come in another set has no partner and drops out: a passage that
   thousands of documents hold fills a few groups of each on its own, and e is a quarter of D. What is left and shares keys, directly
   or through others, forms a cluster (star edges to the smallest id of a key, then components): the only place where its
   members' partners can be. Exact copies meet by a key of the whole set and count as one. This loses nothing.
3. Clusters are cut, in order of set size, into blocks of bounded weight; blocks meet only where sizes allow a link.
   So one huge cluster is many tasks, and no task holds more than two blocks.
4. In a task an R-tree over group-count vectors (boxes packed bottom-up) bounds the overlap of a query with a box or a
   point by the summed minima of the coordinates; what survives is counted exactly. Pairs already connected are skipped,
   so a group of near copies yields a spanning set of links, not all pairs.
5. Links and exact copies go to components once more.

Defined cases: null or blank text has no shingles and no links. A document with fewer than k words is one shingle.
Repeated doc_ids are one document (their rows link at once, the larger set counts); rows with null doc_id are left out.
Extra columns are ignored. Hashes are 48 bits within a pair, so a wrong count has odds below 1e-9 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import partitions, ship, stored
from .components import components

#: Coordinates of a count vector, entries of an R-tree node, and shingles in one block of a cluster.
GROUPS, FANOUT, WEIGHT = 64, 16, 1_000_000
#: A row of a key has in n a negative number: of its bits below, the tag of its set, how many shared keys the set needs, its scheme.
TAG, LEAST = 31, 30


class Schemes:
    """Size classes and, for each, the number of groups that the pigeonhole argument needs."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low, self.groups, self.spare = num, den, [1], [], []

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        while self.low[-1] <= n or len(self.groups) < len(self.low):
            lo = self.low[-1]
            hi = max(lo + 1, -(-lo * self.den // self.num))
            a = hi - 1
            d = (a + a * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
            spare = 0
            if d:
                # a document with up to `spare` empty groups still has a shared group that is not empty
                spare = max(1, math.ceil((d + 1) * math.exp(-lo / (d + 1)) * 1.5) + 1) if lo / (d + 1) > 2 else 1
                spare = max(spare, d // 4)
            self.groups.append(d + 1 + spare)
            self.spare.append(spare)
            self.low.append(hi)
            if lo > n:
                break
        return np.array(self.low), np.array(self.groups), np.array(self.spare)


def block_keys(sets: np.ndarray, off: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, rows, needs): the group contents by which each set can meet its partners; of a set and scheme at least so many are shared with each of them. needs: 2 * that + scheme."""
    n = np.diff(off)
    if not len(sets):
        return np.zeros(0, K.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, groups, spare = schemes.upto(int(n.max()))
    own = np.searchsorted(low, n, side="right") - 1
    mixed = K.mix(sets)
    keys, rows, needs = [], [], []
    for down in (0, 1):
        scheme = own - down
        some = np.flatnonzero((n > 0) & (scheme >= 0))
        if not len(some):
            continue
        m = np.where((n > 0) & (scheme >= 0), groups[np.maximum(scheme, 0)], 0)
        base = np.cumsum(m) - m
        take = np.repeat((n > 0) & (scheme >= 0), n)
        row = np.repeat(np.arange(len(n)), n)[take]
        cell = base[row] + ((mixed[take] >> K.U(20)) % m[row].astype(K.U)).astype(np.int64)
        total = np.zeros(int(m.sum()), K.U)
        np.add.at(total, cell, K.mix(mixed[take] ^ K.U(0xA5A5A5A5A5A5A5A5)))
        count = np.bincount(cell, minlength=len(total))
        of = np.repeat(np.arange(len(n)), m)
        empty = K.run_sums((count == 0).astype(np.int64), np.concatenate([base, [len(total)]]))
        spared = spare[np.maximum(scheme, 0)]
        whole = empty > spared  # then empty groups are keys like others
        use = (count > 0) | whole[of]
        at = np.arange(len(total)) - np.repeat(base, m)
        keys.append(K.mix(total + K.mix((scheme[of] * 1_000_003 + at).astype(K.U)))[use])
        rows.append(of[use])
        needs.append((2 * np.where(whole, spared + 1, spared + 1 - empty) + down)[of[use]])
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(needs)


def _emit(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes, seen = Schemes(num, den), set()  # seen: sets of this task, so that copies send no keys again
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, raw, off in K.texts(batch, "text"):
                sets, at = K.shingle_sets(raw, off, k)
                n = np.diff(at)
                whole = K.mix(K.run_sums(K.mix(sets), at) ^ n.astype(K.U))
                first = np.zeros(j - i, dtype=bool)
                for x, h in enumerate(whole.tolist()):
                    if n[x] and h not in seen:
                        seen.add(h)
                        first[x] = True
                keys, rows, needs = block_keys(sets, at, schemes)
                use = first[rows]
                keys, rows, needs = keys[use], rows[use], needs[use]
                code = ~(((whole[rows] >> K.U(64 - TAG)).astype(np.int64) << (LEAST + 1)) + needs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([whole, keys]).view(np.int64)), pa.array(np.concatenate([ids[i:j], ids[i:j][rows]])), pa.array(np.concatenate([n.astype(np.int64), code]))], ["key", "doc_id", "n"]
                )

    return run


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key, kind, n, doc_id -> of whole sets a star edge each (doc, first doc, n); of keys that several sets have, (doc, key, n) of each set's first doc."""

    def out(a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    head = None  # the last whole set's key and first doc
    last = None  # the last key, its last n, and its only row as long as it has one set
    for batch in batches:
        key, doc, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(key):
            continue
        whole = n >= 0
        k, d, m = key[whole], doc[whole], n[whole]
        if len(k):
            new = np.ones(len(k), dtype=bool)
            new[1:] = k[1:] != k[:-1]
            to = d[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
            if head and k[0] == head[0]:
                to[: np.flatnonzero(new)[1] if new.sum() > 1 else len(k)] = head[1]
            head = (k[-1], to[-1])
            got = np.unique(np.stack([d, np.where(m == 0, d, to), m], axis=1), axis=0)  # empty sets are linked with nothing
            yield out(got[:, 0], got[:, 1], got[:, 2])
        k, d, m = key[~whole], doc[~whole], n[~whole]
        if not len(k):
            continue
        if last and k[0] == last[0]:  # the key goes on: its last row stands before these
            k, d, m = np.append(last[0], k), np.append(last[2], d), np.append(last[1], m)
            before = last[3]
        else:
            before = False
        first = np.ones(len(k), dtype=bool)
        first[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        k, d, m = k[first], d[first], m[first]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(begin, len(k)))
        use = np.repeat(size > 1, size)
        if before:  # told already that it is shared: its later sets are, its last row is out
            use[: size[0]] = True
            use[0] = False
        last = (k[-1], m[-1], d[-1], bool(size[-1] > 1 or (before and len(size) == 1)))
        yield out(d[use], k[use], m[use])


class RTree:
    """Boxes over count vectors, packed bottom-up; all levels are arrays."""

    def __init__(self, points: np.ndarray):
        by = np.argsort(points @ np.linspace(1, 2, points.shape[1]), kind="stable") if len(points) else np.zeros(0, np.int64)
        self.order, self.levels, top = by, [], points[by]
        while True:
            self.levels.append(top)
            if len(top) <= FANOUT:
                break
            top = np.maximum.reduceat(top, np.arange(0, len(top), FANOUT))
        self.levels.reverse()

    def over(self, q: np.ndarray, least: float) -> np.ndarray:
        """Points p with sum(min(p, q)) >= least. A box counts by the upper corner, whose minima bound those of all inside."""
        at = np.arange(len(self.levels[0]))
        for depth, level in enumerate(self.levels):
            at = at[np.minimum(level[at], q).sum(axis=1, dtype=np.int64) >= least]
            if depth + 1 < len(self.levels):
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth + 1])]
        return self.order[at]


def linked_pairs(sets: np.ndarray, off: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning set of the links between rows; with two sides only links across are needed.

    The counts and the decision are exact in integers: den * overlap >= num * (a + b - overlap).
    """
    n = np.diff(off)
    rows = len(n)
    row = np.repeat(np.arange(rows), n)
    points = np.zeros((rows, GROUPS), np.int32)
    np.add.at(points, (row, (K.mix(sets) & K.U(GROUPS - 1)).astype(np.int64)), 1)
    ids = np.unique(sets, return_inverse=True)[1]
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.int8)
    tree, label, out = RTree(points), np.arange(rows), []
    two = side.any() and not side.all()
    for q in range(rows):
        if not n[q]:
            continue
        near = tree.over(points[q], num * n[q] / (num + den))  # overlap >= t (a + b) / (1 + t) with b >= 0
        near = near[(near > q) & (label[near] != label[q])]
        if two:
            near = near[side[near] != side[q]]
        a, b = n[q], n[near]
        bound = np.minimum(points[near], points[q]).sum(axis=1, dtype=np.int64)
        near = near[(den + num) * bound >= num * (a + b)]
        if not len(near):
            continue
        mark[ids[off[q] : off[q + 1]]] = 1
        size = n[near]
        first = np.cumsum(size) - size
        at = np.repeat(off[near] - first, size) + np.arange(int(size.sum()))
        same = np.add.reduceat(mark[ids[at]].astype(np.int64), first)
        mark[ids[off[q] : off[q + 1]]] = 0
        for x in near[(den + num) * same >= num * (n[q] + size)]:
            if label[x] != label[q]:
                label[label == label[x]] = label[q]
                out.append((q, int(x)))
    return out


def _grid(k: int, num: int, den: int):
    def solve(rows: list[tuple[int, str, bool]]) -> list[tuple[int, int]]:
        text = pa.array([r[1] for r in rows], pa.large_string())
        raw, off = K.buffers(text)
        sets, at = [], [0]
        for i, j in K.chunks(off):
            s, o = K.shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
            sets.append(s)
            at.extend((o[1:] + at[-1]).tolist())
        got = linked_pairs(np.concatenate(sets), np.array(at), np.array([r[2] for r in rows]), num, den)
        return [(rows[x][0], rows[y][0]) for x, y in got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            task, doc, text, second = (batch.column(i) for i in range(4))
            for t, d, x, s in zip(task.to_pylist(), doc.to_pylist(), text.to_pylist(), second.to_pylist(), strict=True):
                if t != now:
                    if len(rows) > 1:
                        yield out(solve(rows))
                    now, rows = t, []
                rows.append((d, x or "", s))
        if len(rows) > 1:
            yield out(solve(rows))

    return run


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """documents -> (doc_id, n_shingles, component_id): see the module's docstring. k words, similarity num/den."""
    spark = docs.sparkSession
    ship(spark)
    parts = partitions(spark)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.mapInArrow(_emit(k, num, den), "key long, doc_id long, n long")
    order = rows.repartition(parts, "key").sortWithinPartitions("key", (F.col("n") < 0), "n", "doc_id")
    stars = stored(order.mapInArrow(_link, "a long, b long, n long"), "stars")
    whole = stars.where("n >= 0").groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), "b")).alias("rep"), F.max("n").alias("n"))
    copies = stars.where("n >= 0 and a <> b").select("a", "b")
    shared = stars.where("n < 0").select("a", F.col("b").alias("key"), "n")
    need = F.shiftright(F.bitwise_not(F.col("n")).bitwiseAND(F.lit((1 << (LEAST + 1)) - 1)), 1)
    able = shared.groupBy("a", "n").agg(F.count("*").alias("have")).where(F.col("have") >= need).select("a", "n")
    able = stored(shared.join(able, ["a", "n"], "left_semi").select("a", "key"), "able")
    heads = able.groupBy("key").agg(F.min("a").alias("b"))
    met = able.join(heads, "key").where("a <> b").select("a", "b").distinct()
    clusters = components(met.unionByName(copies), "clusters")
    # members: one document of each set, in clusters that hold more than one set
    members = clusters.join(whole.where("a = rep and n > 0").select(F.col("a").alias("id"), "n"), "id").select(F.col("id").alias("doc_id"), "component", "n")
    weight = F.sum("n").over(Window.partitionBy("component").orderBy("n", "doc_id"))
    size = F.count("*").over(Window.partitionBy("component"))
    members = stored(members.withColumn("block", F.floor(weight / F.lit(WEIGHT)).cast("int")).withColumn("size", size).where("size > 1"), "members")
    stats = members.groupBy("component", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    left, right = (stats.select("component", *(F.col(c).alias(p + c) for c in ("block", "lo", "hi"))) for p in "lr")
    grid = left.join(right, "component").where((F.col("lblock") <= F.col("rblock")) & (F.col("rlo") * num <= F.col("lhi") * den)).select("component", "lblock", "rblock")
    task = F.xxhash64("component", "lblock", "rblock").alias("task")
    cells = grid.select("component", task, F.explode(F.when(F.col("lblock") == F.col("rblock"), F.array(F.struct(F.col("lblock").alias("block"), F.lit(False).alias("second")))).otherwise(F.array(F.struct(F.col("lblock").alias("block"), F.lit(False).alias("second")), F.struct(F.col("rblock").alias("block"), F.lit(True).alias("second"))))).alias("x")).select("component", "task", "x.*")
    placed = members.join(cells, ["component", "block"]).select("doc_id", "task", "second", "n")
    work = texts.join(placed, "doc_id").select("task", "doc_id", "text", "second").repartition(parts, "task").sortWithinPartitions("task", "second", "doc_id")
    links = work.mapInArrow(_grid(k, num, den), "a long, b long")
    labels = components(stored(links.unionByName(copies), "links"), "labels")
    return whole.join(labels.withColumnRenamed("id", "a"), "a", "left").select(
        F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", F.col("a")).alias("component_id"))
