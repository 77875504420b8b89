"""Language identification with interpolated Kneser-Ney character models.

Words are runs of letters, lower case; each is read with a beginning and an end mark, so that an n-gram never crosses a
word. Counting covers all training rows: words are counted a language in each task, summed by (language, word), and cut
into n-grams of the highest order (and the shorter ones that start a word); lower orders count distinct left neighbours,
by one grouping an order. Discounts come from counts of counts. The tables are stored for each language and order as
sorted hashes with log probabilities and log back-off weights. All n-grams are kept: their number is bounded by the
letters that the training texts hold (to the power of ORDER), not by the texts; a run of letters of any length is read
whole, in steps of STRIDE positions.

A text is scored by its distinct words: cross-entropy in bits a character for each language, the lowest wins; ties go to
the smaller name. The score is the winner's share of exp(-cross-entropy x length), with length held to EVIDENCE characters.
Rejection (reject=True, and a model fitted so) gives `und` where the winner's cross-entropy is above mean + 4 deviations of
CALIBRATION training texts of that language, chosen by id before any text is read; without it only texts without a
letter, or null, are `und`.

Defined cases: null text, or text without letters: und, score 0; no labelled training rows: und, score 0; null doc_ids are
scored, not held out; null lang is not learned from; repeated rows count as often as they come; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import crc32_mod, partitions, ship, stored

ORDER, EVIDENCE, CALIBRATION, STRIDE = 4, 60, 400, 1000
BEGIN, END = "\x02", "\x03"


def words_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-case letter runs of each row, dictionary-encoded, and n + 1 offsets. Empty strings stand between runs."""
    lists = pc.split_pattern_regex(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), r"[^\p{L}]+")
    off = lists.offsets.to_numpy()
    return lists.values.slice(off[0], off[-1] - off[0]).cast(pa.large_string()).dictionary_encode(), off - off[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for i, j in K.chunks(K.buffers(batch.column(1))[1], 8 << 20):
            words, off = words_of(batch.column(1).slice(i, j - i))
            names = words.dictionary.to_pylist()
            lang = np.repeat(langs.indices.to_numpy()[i:j], np.diff(off)).astype(np.int64)
            key, n = np.unique(lang * max(1, len(names)) + words.indices.to_numpy(), return_counts=True)
            at = key % max(1, len(names))
            keep = np.array([len(names[x]) > 0 for x in at], dtype=bool)
            key, n, at = key[keep], n[keep], at[keep]
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // max(1, len(names)))), words.dictionary.take(pa.array(at)).cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "word", "n"])


def gram_tables(train: DataFrame) -> DataFrame:
    """(lang, text) -> (lang, k, gram, n) for orders 1 to ORDER: raw counts at the top and at word starts, else left neighbours."""
    spark = train.sparkSession
    counts = train.select("lang", "text").mapInArrow(_count, "lang string, word string, n long")
    words = counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # from each STRIDE positions of the marked word, with the ORDER - 1 characters before them
    marked = words.select("lang", "n", F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("word")).withColumn("at", F.explode(F.expr(f"sequence(2, char_length(word), {STRIDE})")))
    strides = marked.select("lang", "n", F.expr(f"substring(word, greatest(1, at - {ORDER} + 1), {STRIDE} + least(at, {ORDER}) - 1)").alias("word"), F.expr(f"least(at, {ORDER})").alias("first"))
    grams = strides.select("lang", "n", F.explode(F.expr(f"transform(sequence(first, char_length(word)), e -> substring(word, greatest(1, e - {ORDER} + 1), least(e, {ORDER})))")).alias("gram"))
    now = stored(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("k", F.char_length("gram")), "grams")
    out, above = now, now
    for k in range(ORDER - 1, 0, -1):
        fewer = above.where(F.col("k") == k + 1).groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")).select("lang", "gram", "n", F.lit(k).alias("k"))
        out = out.unionByName(fewer)
        above = now.where(F.col("k") == k).unionByName(fewer) if k > 1 else fewer
    return out


def gram_hash(points: np.ndarray) -> np.ndarray:
    """Hashes of rows of code points, all of one length."""
    h = np.full(len(points), points.shape[1], K.U)
    for c in range(points.shape[1]):
        h = h * K.U(0x100000001B3) + points[:, c].astype(K.U) + K.U(1)
    return K.mix(h)


def _points(grams: list[str], k: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, k)


class Model:
    """langs, and for each language and order: sorted hashes, log2 probabilities; for contexts: sorted hashes, log2 back-off."""

    def __init__(self, table: pa.Table):
        self.langs = sorted({x for x in table["lang"].unique().to_pylist() if x is not None})
        self.grams: list[list] = []
        self.backs: list[list] = []
        self.cut: dict = {}
        lang = table["lang"].combine_chunks()
        alphabet = set()
        for name in self.langs:
            one = table.filter(pc.and_(pc.equal(lang, name), pc.equal(table["k"], 1)))
            alphabet.update(one["gram"].to_pylist())
        self.floor = -np.log2(len(alphabet) + 1)
        for name in self.langs:
            part = table.filter(pc.equal(lang, name))
            self._fit(part, len(alphabet) + 1)

    def _fit(self, part: pa.Table, letters: int) -> None:
        grams, backs, below = [], [], None
        for k in range(1, ORDER + 1):
            one = part.filter(pc.equal(part["k"], k))
            if not one.num_rows:
                grams.append((np.zeros(0, K.U), np.zeros(0, np.float32)))
                backs.append((np.zeros(0, K.U), np.zeros(0, np.float32)))
                continue
            n = one["n"].to_numpy().astype(np.float64)
            points = _points(one["gram"].to_pylist(), k)
            own, context = gram_hash(points), gram_hash(points[:, :-1]) if k > 1 else np.zeros(len(n), K.U)
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
            value, place = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(place, n), np.bincount(place)
            back = discount * kinds / total
            if k == 1:
                lower = np.full(len(n), 1 / letters)
            else:
                suffix = gram_hash(points[:, 1:])
                at = np.minimum(np.searchsorted(below[0], suffix), len(below[0]) - 1)
                lower = np.where(below[0][at] == suffix, below[1][at], 1 / letters)
            p = np.maximum(n - discount, 0) / total[place] + back[place] * lower
            order = np.argsort(own)
            below = (own[order], p[order])
            grams.append((own[order], np.log2(p[order]).astype(np.float32)))
            backs.append((value, np.log2(back).astype(np.float32)))
        self.grams.append(grams)
        self.backs.append(backs)

    def bits(self, words: list[str]) -> np.ndarray:
        """(words, languages): minus log2 of each word's probability, end mark included."""
        out = np.zeros((len(words), len(self.langs)), np.float64)
        if not words:
            return out
        text = "".join(BEGIN + w + END for w in words)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in words]) + 2
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size - 1)
        at = np.arange(len(word)) + word + 1  # the predicted characters: all but the first of each word
        reach = at - first[word]
        hashes, contexts = {}, {}
        for k in range(1, ORDER + 1):
            some = np.flatnonzero(reach >= k - 1)
            block = points[at[some][:, None] + np.arange(-k + 1, 1)]
            hashes[k] = np.zeros(len(at), K.U)
            contexts[k] = np.zeros(len(at), K.U)
            hashes[k][some] = gram_hash(block)
            if k > 1:
                contexts[k][some] = gram_hash(block[:, :-1])
        for i in range(len(self.langs)):
            total = np.zeros(len(at))
            open_ = np.arange(len(at))
            for k in range(ORDER, 0, -1):
                able = open_[reach[open_] >= k - 1]
                rest = open_[reach[open_] < k - 1]
                keys, value = self.grams[i][k - 1]
                if len(keys) and len(able):
                    spot = np.minimum(np.searchsorted(keys, hashes[k][able]), len(keys) - 1)
                    hit = keys[spot] == hashes[k][able]
                    total[able[hit]] += value[spot[hit]]
                    able = able[~hit]
                    ckeys, cvalue = self.backs[i][k - 1]
                    spot = np.minimum(np.searchsorted(ckeys, contexts[k][able]), len(ckeys) - 1)
                    known = ckeys[spot] == contexts[k][able]
                    total[able[known]] += cvalue[spot[known]]
                open_ = np.concatenate([rest, able])
            total[open_] += self.floor
            out[:, i] = -np.bincount(word, total, len(words))
        return out


def fit(docs: DataFrame, reject: bool = False) -> Model | None:
    """Learns from all rows outside the held-out fold that have text and lang; reject: also the cut-offs of rejection."""
    spark = docs.sparkSession
    ship(spark)
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod("doc_id", 4) != 2))
    table = stored(gram_tables(train), "tables").select("lang", "k", "gram", "n").coalesce(partitions(spark)).toArrow()
    if not table.num_rows:
        return None
    model = Model(table)
    if reject:
        keys = train.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
        ids = None  # a top-k of ids for each language, so that texts are read for these alone
        for name in model.langs:
            some = keys.where(F.col("lang") == name).orderBy("h", "doc_id").limit(CALIBRATION)
            ids = some if ids is None else ids.unionByName(some)
        rows = train.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").select("lang", "text").toArrow()
        bits = _entropy(model, rows["text"].combine_chunks(), {})[0]
        for i, name in enumerate(model.langs):
            own = bits[np.array([x == name for x in rows["lang"].to_pylist()]), i]
            own = own[np.isfinite(own)]
            model.cut[name] = float(own.mean() + 4 * own.std()) if len(own) > 1 else np.inf
    return model


def _entropy(model: Model, column: pa.Array, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bits a character for each row and language, nan without letters; characters of each row)."""
    words, off = words_of(column)
    names = words.dictionary.to_pylist()
    new = [w for w in names if w and w not in known]
    for i in range(0, len(new), 50_000):
        for w, b in zip(new[i : i + 50_000], model.bits(new[i : i + 50_000]), strict=True):
            known[w] = b
    none = np.zeros(len(model.langs))
    table = np.array([known[w] if w else none for w in names]).reshape(len(names), len(model.langs))
    size = np.array([len(w) + 1 if w else 0 for w in names], np.int64)
    codes = words.indices.to_numpy()
    n = K.run_sums(size[codes], off) if len(codes) else np.zeros(len(off) - 1, np.int64)
    bits = np.column_stack([K.run_sums(table[codes, i], off) if len(codes) else np.zeros(len(off) - 1) for i in range(len(model.langs))])
    return np.where(n[:, None] > 0, bits / np.maximum(n, 1)[:, None], np.nan), n


def _identify(shared, reject: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        known: dict = {}
        for batch in batches:
            for i, j in K.chunks(K.buffers(batch.column(2))[1], 8 << 20):
                if len(known) > 300_000:
                    known = {}
                bits, n = _entropy(model, batch.column(2).slice(i, j - i), known)
                lang, score = [], []
                for b, m in zip(bits, n, strict=True):
                    if not m:
                        lang.append("und")
                        score.append(0.0)
                        continue
                    best = int(np.argmin(b))
                    share = 1 / np.exp(-(b - b[best]) * np.log(2) * min(int(m), EVIDENCE)).sum()
                    out = reject and b[best] > model.cut.get(model.langs[best], np.inf)
                    lang.append("und" if out else model.langs[best])
                    score.append(0.0 if out else float(share))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, reject: bool = False) -> DataFrame:
    """documents -> (doc_id, held_out, lang_pred, score), one row per row of docs."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_identify(spark.sparkContext.broadcast(model), reject), "doc_id long, held_out boolean, lang_pred string, score double")
