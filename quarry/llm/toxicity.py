"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give document scores and offsets.

Training uses at most MOST_TOXIC + MOST_CLEAN labelled documents (those with the smallest hashes of their doc_id) and of
each kind at most MOST_BYTES of text, whole texts. The table labels documents, not words, so the labels are taken as weak:
in a clean document no word is toxic, in a toxic one at least one is. The field maximises the likelihood of that. For a toxic
document it is 1 - P(no word is toxic), so its constrained expectations are the free ones over that number, less the path
without toxic words; no word is labelled beforehand. The field has two states, transitions, a bias, and weights for a
word's form, its first 4, 5 and 6 bytes, its last 4, and the forms beside it, hashed into FEATURES weights; they begin at
shrunk log ratios of how often toxic and clean documents hold them, and are fitted by EPOCHS of adaptive gradient steps.

Forward-backward is exact over every word of a text. The words of many texts are one chain of 2 x 2 matrices, cut into
lanes that are multiplied side by side; the matrix of a text's first word forgets what stood before. A document's score is a
logistic function of the largest marginal and of the expected number of toxic words, fitted on a quarter of the sample
that the field isn't trained on. Its odds are those of a sample of two clean documents for each toxic one, as a full sample is;
where toxic labels are fewer, they are raised to that, so that what a score means doesn't hang on how many labels there are.

Defined cases: null, empty and blank texts score as a text without toxic words; without toxic or without clean labels all
scores are 0; null doc_ids are scored, held_out false; null labels are not used; a doc_id that repeats in labels is toxic if
one of its rows says so, one that repeats in documents trains with one of its texts; extra columns are ignored. Labels,
lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import crc32_mod, give_back, ship, stored

MOST_TOXIC, MOST_CLEAN, MOST_BYTES, FEATURES, EPOCHS, BATCH, LANE, STEP = 1500, 3000, 16 << 20, 1 << 18, 10, 100, 64, 300
OUT = "doc_id long, held_out boolean, score double, predicted int, n_toxic long, spans array<struct<start:int,end:int,p:double>>"


def _features(raw: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(words, 7): places in the table of weights of the form, the first 4, 5 and 6 bytes and the last 4 (of longer words), and the forms before and after; FEATURES where there is none."""
    out = np.full((len(start), 7), FEATURES, np.int32)
    if not len(start):
        return out

    def put(column: int, some, h: np.ndarray) -> None:
        out[some, column] = (K.mix(h + K.U(column + 1)) >> K.U(46)).astype(np.int32)

    form = K.word_hashes(raw, start, end)
    put(0, slice(None), form)
    for k in (4, 5, 6):
        some = np.flatnonzero(end - start > k)
        put(k - 3, some, K.word_hashes(raw, start[some], start[some] + k))
    some = np.flatnonzero(end - start > 4)
    put(4, some, K.word_hashes(raw, end[some] - 4, end[some]))
    same = np.flatnonzero(row[1:] == row[:-1])
    put(5, same + 1, form[same])
    put(6, same, form[same + 1])
    return out


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, off = K.buffers(pa.array(texts, pa.large_string()))
    raw = K.LOWER[raw]
    return raw, off, *K.words(raw, off, K.MARK)


def chain(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact forward-backward over chains end to end; first: where one begins (the first word does).

    e scores state 1 of each word, trans the steps. Returns the marginal of state 1, the log normaliser that each word adds,
    and (words, 2, 2) the probability of each step into a word (0 for first ones).
    """
    n = len(e)
    lanes = -(-n // LANE)
    x, start = np.full(lanes * LANE, 1e-9), np.ones(lanes * LANE, dtype=bool)
    x[:n], start[:n] = np.exp(np.clip(e, -20, 20)), first
    x, start = np.ascontiguousarray(x.reshape(lanes, LANE).T), np.ascontiguousarray(start.reshape(lanes, LANE).T)
    t = np.exp(np.clip(trans, -20, 20))
    # m[i][j]: step from i to j and the score of j
    m = [[np.where(start, 1.0, t[i, 0]), np.where(start, 1.0, t[i, 1]) * x] for i in (0, 1)]
    p = [[np.ones(lanes), np.zeros(lanes)], [np.zeros(lanes), np.ones(lanes)]]
    for s in range(LANE):
        p = [[a * m[0][0][s] + b * m[1][0][s], a * m[0][1][s] + b * m[1][1][s]] for a, b in p]
        if s % 8 == 7:
            scale = p[0][0] + p[0][1] + p[1][0] + p[1][1]
            p = [[a / scale, b / scale] for a, b in p]
    product = np.stack([p[0][0], p[0][1], p[1][0], p[1][1]], axis=1).tolist()
    into, a, b = [], 0.5, 0.5
    for w, y, z, v in product:
        into.append((a, b))
        a, b = a * w + b * z, a * y + b * v
        total = a + b
        a, b = a / total, b / total
    out, a, b = [], 0.5, 0.5
    for w, y, z, v in reversed(product):
        out.append((a, b))
        a, b = w * a + y * b, z * a + v * b
        total = a + b
        a, b = a / total, b / total
    alpha, scale = np.empty((LANE + 1, 2, lanes)), np.empty((LANE, lanes))
    alpha[0] = np.array(into).T
    for s in range(LANE):
        a, b = alpha[s]
        c, d = a * m[0][0][s] + b * m[1][0][s], a * m[0][1][s] + b * m[1][1][s]
        scale[s] = c + d
        alpha[s + 1] = c / scale[s], d / scale[s]
    beta = np.array(out[::-1]).T
    marginal, steps = np.empty((LANE, lanes)), np.empty((2, 2, LANE, lanes))
    for s in range(LANE - 1, -1, -1):
        one = alpha[s + 1, 1] * beta[1]
        marginal[s] = one / (alpha[s + 1, 0] * beta[0] + one)
        for i in (0, 1):
            for j in (0, 1):
                steps[i, j, s] = alpha[s, i] * m[i][j][s] * beta[j]
        steps[:, :, s] /= steps[:, :, s].sum(axis=(0, 1))
        c, d = m[0][0][s] * beta[0] + m[0][1][s] * beta[1], m[1][0][s] * beta[0] + m[1][1][s] * beta[1]
        beta = np.stack([c / (c + d), d / (c + d)])
    steps[:, :, start] = 0
    flat = lambda v: np.moveaxis(v, -2, -1).reshape(*v.shape[:-2], -1)[..., :n]
    return flat(marginal), np.log(flat(scale)), np.moveaxis(flat(steps), -1, 0)


class Field:
    """The fitted field: hashed weights, bias, transitions, and the document-level logistic weights."""

    def __init__(self, toxic: list[str], clean: list[str]):
        self.weights, self.bias, self.trans, self.doc = np.zeros(FEATURES + 1, np.float32), -5.0, np.zeros((2, 2)), np.array([-30.0, 0.0, 0.0])
        self.noise = 0.02
        if not toxic or not clean:
            return
        texts, label = [*toxic, *clean], np.repeat([1, 0], [len(toxic), len(clean)])
        size = np.concatenate([np.bincount(_tokens(texts[i : i + STEP])[4], minlength=len(texts[i : i + STEP])) for i in range(0, len(texts), STEP)])
        feats, at = np.empty((int(size.sum()), 7), np.int32), 0
        for i in range(0, len(texts), STEP):
            raw, _, start, end, row = _tokens(texts[i : i + STEP])
            feats[at : at + len(start)] = _features(raw, start, end, row)
            at += len(start)
        begin = np.cumsum(size) - size
        rng = np.random.default_rng(7)
        order = rng.permutation(len(texts))
        train, check = (order, order) if len(order) < 20 else (order[len(order) // 4 :], order[: len(order) // 4])
        train = train[size[train] > 0]
        self._begin(feats, begin, size, train, label)
        self._fit(feats, begin, size, train, label, rng)
        pooled = []
        for i in range(0, len(check), BATCH):
            some = check[i : i + BATCH]
            marginal = self._marginals(self._gather(feats, begin, size, some), size[some])
            pooled.append(np.column_stack(self._pooled(marginal, np.concatenate([[0], np.cumsum(size[some])]))))
        self._fit_doc(np.concatenate(pooled), label[check].astype(float))

    @staticmethod
    def _gather(feats: np.ndarray, begin: np.ndarray, size: np.ndarray, docs: np.ndarray) -> np.ndarray:
        many = size[docs]
        return feats[np.repeat(begin[docs] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]

    def _begin(self, feats, begin, size, docs, label) -> None:
        """Shrunk log ratios of the shares of toxic and clean documents that hold a feature."""
        held = []
        for kind in (1, 0):
            count = np.zeros(FEATURES + 1)
            for d in docs[label[docs] == kind]:
                count[np.unique(feats[begin[d] : begin[d] + size[d]])] += 1
            held.append((count, (count + 0.5) / ((label[docs] == kind).sum() + 1)))
        self.weights = np.where(held[0][0] + held[1][0] > 2, 0.4 * np.clip(np.log(held[0][1] / held[1][1]), -2, 4), 0).astype(np.float32)
        self.weights[FEATURES] = 0

    def _fit(self, feats, begin, size, docs, label, rng) -> None:
        past = [np.full(FEATURES + 1, 1e-6), 1e-6, np.full((2, 2), 1e-6)]
        for _ in range(EPOCHS):
            docs, wrong = rng.permutation(docs), []
            for i in range(0, len(docs), BATCH):
                some = docs[i : i + BATCH]
                rows, many, y = self._gather(feats, begin, size, some), size[some], label[some]
                first = np.zeros(len(rows), dtype=bool)
                at = np.cumsum(many) - many
                first[at] = True
                p, norm, steps = chain(self.bias + self.weights[rows].sum(axis=1), first, self.trans)
                # P(no toxic word): the path of zeros scores its steps alone
                none = np.exp(np.minimum((many - 1) * self.trans[0, 0] - np.add.reduceat(norm, at), 0))
                some_, no = np.clip(1 - none, 1e-6, 1), np.clip(none, 1e-6, 1)
                right = np.where(y == 1, some_ / (some_ + self.noise / (1 - self.noise) * no), no / (no + self.noise / (1 - self.noise) * some_))
                any_ = np.where(y == 1, right, 1 - right)  # that a word is toxic, given the label
                wrong.append(1 - right)
                over = any_ * np.minimum(none / some_, 50.0) - (1 - any_)  # constrained less free, over free
                each = p * np.repeat(over, many)
                moved = np.add.reduceat(steps, at) * over[:, None, None]
                moved[:, 0, 0] += (1 - any_ - any_ * np.minimum(none / some_, 50.0)) * (many - 1)
                grads = [np.bincount(rows.ravel(), np.repeat(each, rows.shape[1]), FEATURES + 1) / len(some) - 2e-5 * self.weights, each.sum() / len(some), moved.sum(axis=0) / len(some)]
                grads[0][FEATURES] = 0
                for k, g in enumerate(grads):
                    past[k] = past[k] + g * g
                self.weights = (self.weights + 0.1 * grads[0] / np.sqrt(past[0])).astype(np.float32)
                self.bias = float(self.bias + 0.1 * grads[1] / np.sqrt(past[1]))
                self.trans = np.clip(self.trans + 0.02 * grads[2] / np.sqrt(past[2]), -4, 4)
            self.noise = float(np.clip(np.concatenate(wrong).mean(), 0.005, 0.2))

    def _fit_doc(self, x: np.ndarray, y: np.ndarray) -> None:
        w = np.array([0.0, 1.0, 0.5])
        a = np.column_stack([np.ones(len(x)), x])
        for _ in range(50):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + 1e-5 * np.eye(3)
            w = np.clip(w + np.clip(np.linalg.solve(h, a.T @ (y - p) / len(y) - 1e-5 * w), -2, 2), -25, 25)
        self.doc = w + np.array([np.log(max(1.0, (y == 0).sum() * MOST_TOXIC / MOST_CLEAN / max(1, (y == 1).sum()))), 0.0, 0.0])

    @staticmethod
    def _pooled(p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the log odds of the largest marginal, and the log of one and the expected number of toxic words."""
        some = np.flatnonzero(np.diff(at))
        top, total = np.full(len(at) - 1, 1e-4), np.zeros(len(at) - 1)
        if len(some):
            top[some], total[some] = np.clip(np.maximum.reduceat(p, at[some]), 1e-4, 1 - 1e-4), np.log1p(np.add.reduceat(p, at[some]))
        return np.log(top / (1 - top)), total

    def _marginals(self, feats: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(feats):
            return np.zeros(0)
        first = np.zeros(len(feats), dtype=bool)
        first[(np.cumsum(size) - size)[size > 0]] = True
        e = self.weights[feats[:, 0]] + np.float32(self.bias)
        for c in range(1, feats.shape[1]):
            e += self.weights[feats[:, c]]
        return chain(e, first, self.trans)[0]

    def tag(self, raw, off, start, end, row) -> tuple[np.ndarray, np.ndarray]:
        """The marginal of each word, and n + 1 offsets of the rows' words."""
        size = np.bincount(row, minlength=len(off) - 1)
        return self._marginals(_features(raw, start, end, row), size), np.concatenate([[0], np.cumsum(size)])

    def scores(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The score of each row from the marginals of its words."""
        if self.doc[0] <= -30:
            return np.zeros(len(at) - 1)
        top, total = self._pooled(p, at)
        return 1 / (1 + np.exp(-np.clip(self.doc[0] + self.doc[1] * top + self.doc[2] * total, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """Fits the field on labelled documents outside the held-out fold; see the module's docstring for the bounds."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc32_mod("doc_id", 5) != 0))
    marked = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    ids = None  # bounded, so they are broadcast and no text is shuffled but the sample's
    for label, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        some = marked.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(most)
        ids = some if ids is None else ids.unionByName(some)
    sample = stored(texts.join(F.broadcast(ids), "doc_id").groupBy("toxic", "h", "doc_id").agg(F.max("text").alias("text")), "sample")
    keep: dict = {0: [], 1: []}
    held = {0: 0, 1: 0}
    for r in sample.select("toxic", "doc_id", F.octet_length("text").alias("n")).orderBy("h", "doc_id").collect():
        held[r.toxic] += r.n
        if held[r.toxic] <= MOST_BYTES:
            keep[r.toxic].append(r.doc_id)
    text = {r.doc_id: r.text for r in sample.where(F.col("doc_id").isin(keep[0] + keep[1])).select("doc_id", "text").collect()} if keep[0] and keep[1] else {}
    field = Field(*([text[i] for i in sorted(keep[k]) if i in text] for k in (1, 0)))
    del text
    give_back()
    return field


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared.value
        for batch in batches:
            for i, j, raw, off in K.texts(batch, "text"):
                low = K.LOWER[raw]
                start, end, row = K.words(low, off, K.MARK)
                p, at = field.tag(low, off, start, end, row)
                score, hit = field.scores(p, at), np.flatnonzero(p >= 0.5)
                spans = [pa.array((start[hit] - off[row[hit]]).astype(np.int32)), pa.array((end[hit] - off[row[hit]]).astype(np.int32)), pa.array(p[hit])]
                many = np.bincount(row[hit], minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(many),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.StructArray.from_arrays(spans, ["start", "end", "p"]))],
                    ["doc_id", "held_out", "score", "predicted", "n_toxic", "spans"])

    return run


def toxicity(docs: DataFrame, field: Field) -> DataFrame:
    """documents -> (doc_id, held_out, score, predicted, n_toxic, spans); spans: offending byte ranges with marginals."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(_scores(shared), OUT)


def _clean(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared.value
        for batch in batches:
            for i, j, raw, off in K.texts(batch, batch.schema.names[at]):
                low = K.LOWER[raw]
                yield batch.slice(i, j - i).filter(pa.array(field.scores(*field.tag(low, off, *K.words(low, off, K.MARK))) < 0.5))

    return run


def clean_documents(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of docs, all columns, that the field does not reject."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(field), docs.columns.index("text")), docs.schema)
