"""Jaccard join, suffix dedup and top-k against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import kernel as K
from quarry.llm.components import components
from quarry.llm.jaccard_join import jaccard_components
from quarry.llm.mtree import top_k
from quarry.llm.suffix_dedup import rewritten, suffix_dedup

DOCS = "doc_id long, text string, key string, n long, a string"  # key, n and a clash with names inside


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((i * 3, " ".join(t).title() if i % 5 == 0 else "\n".join(t)))
    return [*out, (1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "a a a a a a"), (1006, "a a a a a a a"), (1007, "w1 " * 5000), (1008, "W1 " * 5000)]


def shingles(text, k):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    lo, hi = sorted((find(a), find(b)))
                    root[hi] = lo
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, k, num):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows] + [(None, "one", None, None, None)], DOCS)
    got = {tuple(r) for r in jaccard_components(df, k, num, 100).collect()}
    assert got == brute_components(rows, k, num, 100)


def test_jaccard_blocks_of_one_cluster(spark, monkeypatch):
    """A cluster cut into many blocks gives the same classes."""
    import quarry.llm.jaccard_join as J

    monkeypatch.setattr(J, "WEIGHT", 150)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in J.jaccard_components(df, 3, 90, 100).collect()} == brute_components(rows, 3, 90, 100)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert jaccard_components(docs).count() == 0
    assert suffix_dedup(docs).count() == 0
    assert rewritten(docs).columns == docs.columns
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (20, 1), (3, 2)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (20, 1), (7, 7), (8, 7), (9, 7)}


def brute_dedup(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(w)
        rest = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out[i] = (len(b), sum(cover), sum(1 for p in range(len(b)) if cover[p] and not (p and cover[p - 1])), hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(spark, hot):
    rng = random.Random(2)
    letters = "abcdefgh é"
    passage = ["".join(rng.choice(letters) for _ in range(n)) for n in (99, 100, 101, 230, 700)]
    rows = []
    for i in range(40):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t = t[:at] + rng.choice(passage) + t[at:]
        rows.append((i, t))
    rows += [(50, None), (51, ""), (52, "x" * 5000), (53, "x" * 150), (54, "ab" * 300), (55, rows[3][1])]
    df = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, hot_over=hot).collect()}
    assert got == brute_dedup(rows)


@pytest.mark.parametrize("hot", [20_000, 1])
@pytest.mark.parametrize("tasks", [1, 8])
def test_suffix_dedup_repeated_rows(spark, hot, tasks):
    """A row that stands twice is one document; two texts of one doc_id are two."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, common = text(230), text(300)
    twin, later = text(400) + common, text(50) + common + text(60)
    one, other = text(150) + shared + text(70), text(20) + shared + text(90)
    rows = [(1, twin), (1, twin), (2, later), (3, one), (3, other), (3, other), (4, twin), (4, twin), (None, twin)]
    df = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], DOCS).repartition(tasks)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup(df, hot_over=hot).collect())
    want = [(0, 700, 0), (1, 700, 0), (1, 700, 0), (2, 410, 300), (4, 700, 700), (4, 700, 700)]
    assert [r for r in got if r[0] != 3] == want
    # of the two texts of doc_id 3 one keeps the passage
    assert [r for r in got if r[0] == 3] in ([(3, 340, 0), (3, 340, 0), (3, 450, 230)], [(3, 340, 230), (3, 340, 230), (3, 450, 0)])
    texts = sorted((r.doc_id, r.text) for r in rewritten(df.where("doc_id < 4")).collect())
    assert [t for i, t in texts if i == 1] == [twin, twin]
    assert [t for i, t in texts if i == 2] == [later.replace(common, "")]
    cut = lambda t: t.replace(shared, "")
    assert [t for i, t in texts if i == 3] in (sorted([cut(one), other, other]), sorted([one, cut(other), cut(other)]))


def test_rewritten_keeps_columns(spark):
    p = "lorem ipsum dolor sit amet " * 8
    df = spark.createDataFrame([(1, "first " + p, "en", "s", 1), (2, "second " + p + "end", "en", None, None), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in rewritten(df).collect()}
    # doc 1 repeats itself (the phrase has a period of 27), doc 2 repeats doc 1
    want = brute_dedup([(r.doc_id, r.text) for r in df.collect()])
    for i, r in out.items():
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == want[i][3]
        assert r.text is None or r.n_chars == len(r.text)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8)) * rng.uniform(0.1, 2, size=(300, 1))
    v[40:60] = v[40]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, [1.0, 2.0]), (1250, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, score int")
    ints = np.floor(256 * v).astype(np.int64)
    want = set()
    for q in range(0, 300, 50):
        best = sorted((-int(ints[q] @ ints[i]), i) for i in range(300) if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in top_k(df).collect()} == want


def test_top_k_cells(spark, monkeypatch):
    import quarry.llm.mtree as M

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)]) for i in range(400)], "vec_id long, embedding array<double>")
    one = {tuple(r) for r in M.top_k(df, every=5).collect()}
    monkeypatch.setattr(M, "SHARD", 60)
    monkeypatch.setattr(M, "QUERIES", 20)
    assert {tuple(r) for r in M.top_k(df, every=5).collect()} == one
    assert df.where(F.col("vec_id") < 0).count() == 0


def test_top_k_asks_few_trees(spark, monkeypatch):
    """Far groups of vectors: a query's second pass leaves out the trees whose ball can't hold a better one; repeated ids and copies count once."""
    import quarry.llm.mtree as M

    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(8)[i % 8] * 40 + rng.normal(size=8)).tolist()) for i in range(1600)] + [(5, [0.0] * 8), (7000, [40.0] + [0.0] * 7)] + [(8000 + i, [0.0, 41.0] + [0.0] * 6) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked, true = [], M._route

    def route(pivots, shards, radius, factor, first, blocks):
        asked.append(sum(shards.values()))
        return true(pivots, shards, radius, factor, first, blocks)

    opened = spark.sparkContext.accumulator(0)
    ask = M._ask

    def counted(folder, k):
        inner = ask(folder, k)

        def run(key, rows):
            opened.add(rows.num_rows)
            return inner(key, rows)

        return run

    monkeypatch.setattr(M, "_route", route)
    monkeypatch.setattr(M, "_ask", counted)
    got = {tuple(r) for r in M.top_k(df, every=100, shard_rows=50, most_pivots=64).collect()}
    ints = {}
    for i, v in rows:
        w = tuple(int(np.floor(256 * x)) for x in v)
        ints[i] = min(ints.get(i, w), w)
    table, ids = np.array([ints[i] for i in sorted(ints)]), sorted(ints)
    want = set()
    for q in (i for i in ids if i % 100 == 0):
        score = table @ np.array(ints[q])
        best = sorted((-int(s), i) for s, i in zip(score, ids, strict=True) if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    queries = len({q for q, *_ in want})
    assert opened.value < queries * max(asked) / 2


@pytest.mark.parametrize("scale", [1, 10**6])
def test_top_k_opens_a_node_once_for_all_queries(tmp_path, monkeypatch, scale):
    """Vectors without groups, where no ball can be ruled out: the nodes opened are those of the tree, not the tree's for each query."""
    import pyarrow as pa

    import quarry.llm.mtree as M

    rng = np.random.default_rng(6)
    ints = np.floor(256 * rng.normal(size=(3000, 16))).astype(np.int64) * scale
    ints[100:130] = ints[100]  # ties go to the smaller id
    ids, top = rng.permutation(3000) + 10, float((ints.astype(np.float64) ** 2).sum(axis=1).max())
    wide = lambda x, last: pa.array(np.column_stack([x, last]).astype(np.float64).tolist(), pa.list_(pa.float64()))
    last = np.sqrt(np.maximum(0.0, top - (ints.astype(np.float64) ** 2).sum(axis=1)))
    key, folder = tuple(pa.scalar(x, pa.int32()) for x in (0, 0, 17)), f"file://{tmp_path}/trees"
    M._plant(folder, top)(key, pa.table({"vec_id": pa.array(ids), "v": wide(ints, last), "away": np.zeros(3000)}))
    opened, pop = [], M.heapq.heappop
    monkeypatch.setattr(M.heapq, "heappop", lambda queue: opened.append(1) or pop(queue))
    rows = [*range(95, 135), *range(2000, 2060)]
    queries = pa.table({"query_id": pa.array(ids[rows]), "v": wide(ints[rows], np.zeros(len(rows))), "bound": np.full(len(rows), np.inf)})
    got = {}
    for q, i, s in zip(*(M._ask(folder, 5)((*key[:2], pa.scalar(0), key[2]), queries)[c].to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
        got.setdefault(q, []).append((-s, i))
    scores = ints[rows] @ ints.T
    assert got == {int(ids[r]): sorted((-int(s), int(i)) for s, i in zip(line, ids, strict=True) if i != ids[r])[:5] for r, line in zip(rows, scores, strict=True)}
    assert len(opened) < 3000
