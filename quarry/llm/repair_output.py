"""Token-id output: per-shard Re-Pair grammars in binary files with random access.

Documents are range-partitioned by doc_id, encoded, and written in segments of at most SEGMENT ids (one document at
least). In a segment, frequent pairs of neighbouring symbols are repeatedly replaced by new symbols, until no pair comes
LEAST times without overlaps. Pairs are counted once, in CELLS hash cells; a round takes all pairs of LEAST or more, the
more frequent first where two overlap, and then corrects the cells and counts at the changed places only. A cell stands
for the pair that it holds first; when a round finds nothing, the pairs left in full cells are counted exactly. No pair
holds the end id, so no symbol reaches across documents and each document is a range of symbols. A file holds the ids
that occur, the rules, the rules' expansion lengths, the documents' ids, token and symbol offsets, and the symbols; one
document is decoded from a range read of its symbols.

File (little endian): b"RPR2", u32 counts of ids, rules and documents, bytes a symbol, end id; then the ids in ascending
order (u32; symbol i is the i-th, symbol ids + i the i-th rule), rules (2 x u32), expansion lengths (u32), doc_ids (i64),
null flags (u8), token starts (i64, one more), symbol starts (i64, one more), symbols.

Where the tokenizer is one that splits at spaces, line ends and between letters and marks (checked when it is loaded: see
cuts()), distinct runs between these are encoded with the library once a worker, up to a bound on what it keeps, and
looked up; other tokenizers get whole texts.

Defined cases: null text is empty: the end id alone; rows with null doc_id come first; repeated doc_ids keep one row each,
in the order of their texts; an empty table gives no files. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROOMY, fresh_path, partitions, ship, stored
from .files import read_file, read_ranges, write_file

SEGMENT, LEAST, CELLS, FEW = 3_000_000, 16, 1 << 20, 400_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


#: Words that a normalizer of NFC and lower case leaves as they are but for their case, and a splitter leaves whole.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00fe\u00ff]+")


def cuts(tok) -> bool:
    """Whether runs between spaces, line ends and letter-mark borders can be encoded apart, by the tokenizer itself on samples."""
    for text in ("one, two;three\nfour  (five) six7 8. caf\u00e9's #tag", "a.b!c?d:e&f*g%h$i#j,k ;l", " \n a\u4f60\u597d b\U0001f600"):
        runs = [r for r in re.sub(r"([a-zA-Z])([.,#$%&*!?;:])", r"\1 \2", text.replace("\n", " ")).split(" ") if r]
        if tok.encode(text, add_special_tokens=False).ids != [i for r in runs for i in tok.encode(r, add_special_tokens=False).ids]:
            return False
    return True


class Encoder:
    """Ids of texts; runs between spaces and line ends are kept up to a bound and then forgotten.

    PLAIN words go to the library's BPE model without its normalizer and splitter, which cost more than the model, if that
    gives the same ids for every letter and for SAMPLE words.
    """

    def __init__(self, path: str, most: int = 800_000):
        self.tok, self.most = tokenizer(path), most
        self.model, self.cut = self.tok.model, cuts(self.tok)
        from tokenizers import pre_tokenizers

        bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0x41, 0x100) if PLAIN.fullmatch(chr(c))]
        self.letter = {ord(c): bytes_.pre_tokenize_str(c.lower())[0][0] for c in letters}
        sample = [*letters, *(a + b + a for a, b in zip(letters, letters[7:], strict=False)), "internationalization", "Stra\u00dfe", "\u00c9cole", "the", "ni\u00f1os", "x" * 300]
        self.plain = self.cut and all(self._bare(w) == self.tok.encode(w, add_special_tokens=False).ids for w in sample)
        self.forget()

    def _bare(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.translate(self.letter))]

    def forget(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.large_string()), array("I"), array("Q", [0])

    def _learn(self, words: pa.Array) -> None:
        plain = pc.match_substring_regex(words, f"^{PLAIN.pattern}$") if self.plain else pa.array(np.zeros(len(words), bool))
        for w in words.filter(plain).to_pylist():
            self.ids.extend(self._bare(w))
            self.ends.append(len(self.ids))
        rest = words.filter(pc.invert(plain)).to_pylist()
        for i in range(0, len(rest), 5000):
            for e in self.tok.encode_batch_fast(rest[i : i + 5000], add_special_tokens=False):
                self.ids.extend(e.ids)
                self.ends.append(len(self.ids))
        self.known = pa.concat_arrays([self.known, words.filter(plain), words.filter(pc.invert(plain))])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and n + 1 offsets."""
        if not self.cut:
            got = [e.ids for e in self.tok.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)])
        text = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), "\n", " ")
        text = pc.replace_substring_regex(text, r"([a-zA-Z])([.,#$%&*!?;:])", r"\1 \2")  # a pretoken ends there anyway
        lists = pc.split_pattern(text, " ")
        off = lists.offsets.to_numpy()
        coded = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        del text, lists
        words = coded.dictionary
        if len(self.known) > self.most:
            self.forget()
        place = pc.index_in(words, value_set=self.known)
        if place.null_count:
            self._learn(words.filter(pc.is_null(place)))
            place = pc.index_in(words, value_set=self.known)
        flat, ends = np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32), np.frombuffer(self.ends, np.uint64).astype(np.int64)
        at = place.to_numpy().astype(np.int64)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        first, many = ends[at], ends[at + 1] - ends[at]
        total = np.concatenate([[0], np.cumsum(many)])
        out = flat[np.repeat(first - total[:-1], many) + np.arange(total[-1])].copy()
        return out, total[off - off[0]]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def _cells(left: np.ndarray, right: np.ndarray, end: int) -> np.ndarray:
    """The hash cell of each pair; 0, which is never taken, for pairs with the end."""
    cell = (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> np.uint32(12)
    cell[(left == end) | (right == end)] = 0
    return cell


def _apart(near: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which matches, in order of their places, stay, so that none overlap: the lower rank, of equal ones every second. near: overlaps the next."""
    worse = np.diff(rank)
    keep = np.ones(len(rank), dtype=bool)
    keep[1:] &= ~(near & (worse > 0))
    keep[:-1] &= ~(near & (worse < 0))
    same = near & (worse == 0)
    if same.any():
        place = np.arange(len(rank))
        start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), place, 0))
        keep &= (place - start) % 2 == 0
    return keep


class Sequence:
    """The symbols as a linked list over the places of the ids, with the cell of each pair and the count of each cell.

    After the first rounds few places change, so what a round does there follows these and not the length (FEW).
    """

    def __init__(self, seq: np.ndarray, end: int):
        self.seq, self.end, n = seq.astype(np.uint32), end, len(seq)
        self.next, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.cell = np.zeros(n, np.uint32)  # 0: dead, last, or with the end
        self.cell[:-1] = _cells(self.seq[:-1], self.seq[1:], end)
        self.count = np.bincount(self.cell, minlength=CELLS).astype(np.int32)
        self.count[0] = 0
        self.live = np.ones(n, dtype=bool)
        self.open = np.arange(n - 1, dtype=np.int32)  # the places whose pairs may come LEAST times

    def by_cell(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, ranks, pairs) of pairs in cells of LEAST or more; rank 0 is the most frequent cell, whose first pair it takes."""
        some = np.flatnonzero(self.count >= LEAST)
        mark = np.full(CELLS, -1, np.int32)
        mark[some[np.argsort(-self.count[some], kind="stable")]] = np.arange(len(some), dtype=np.int32)
        rank = mark[self.cell if len(self.open) == len(self.cell) - 1 else self.cell[self.open]][: len(self.open)]
        use = rank >= 0
        self.open, rank = self.open[use], rank[use]
        head = np.zeros(len(some), np.int32)
        head[rank[::-1]] = self.open[::-1]
        left, right = self.seq[self.open], self.seq[self.next[self.open]]
        a, b = self.seq[head], self.seq[np.minimum(self.next[head], len(self.seq) - 1)]
        same = (left == a[rank]) & (right == b[rank])
        return self.open[same], rank[same], np.stack([a, b], axis=1)

    def by_pair(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, with the pairs of full cells counted by themselves."""
        at = self.open
        key, rank, n = np.unique(self.seq[at].astype(np.uint64) << np.uint64(32) | self.seq[self.next[at]], return_inverse=True, return_counts=True)
        order = np.empty(len(key), np.int32)
        order[np.argsort(-n, kind="stable")] = np.arange(len(key))
        pairs = np.empty((len(key), 2), np.uint32)
        pairs[order] = np.stack([key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)], axis=1)
        use = n[rank] >= LEAST
        return at[use], order[rank[use]], pairs

    def _places(self, *parts: np.ndarray) -> np.ndarray:
        """The distinct places from 0 of all parts, ascending."""
        if sum(map(len, parts)) < FEW:
            out = np.sort(np.concatenate(parts), kind="stable")
            new = out >= 0
            new[1:] &= out[1:] != out[:-1]
            return out[new]
        mask = np.zeros(len(self.seq) + 1, dtype=bool)  # -1 is the spare place
        for x in parts:
            mask[x] = True
        return np.flatnonzero(mask[:-1]).astype(np.int32)

    def _tally(self, at: np.ndarray, by: int) -> None:
        cell = self.cell[at]
        if len(cell) < FEW:
            np.add.at(self.count, cell, np.int32(by))
        else:
            self.count += by * np.bincount(cell, minlength=CELLS).astype(np.int32)
        self.count[0] = 0

    def replace(self, at: np.ndarray, new: np.ndarray) -> None:
        """Puts the symbols new for the pairs at these places, which don't overlap."""
        second = self.next[at]
        self._tally(self._places(at, second, self.before[at]), -1)
        after = self.next[second]
        self.seq[at], self.next[at], self.cell[second], self.live[second] = new, after, 0, False
        inside = after < len(self.seq)
        self.before[after[inside]] = at[inside]
        fresh = self._places(at, self.before[at])
        follow = self.next[fresh]
        last = follow >= len(self.seq)
        cell = _cells(self.seq[fresh], self.seq[np.minimum(follow, len(self.seq) - 1)], self.end)
        cell[last] = 0
        self.cell[fresh] = cell
        self._tally(fresh, 1)
        self.open = self._places(self.open, fresh)
        self.open = self.open[self.cell[self.open] > 0]

    def symbols(self) -> np.ndarray:
        return self.seq[self.live]


def repair(seq: np.ndarray, first_rule: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules (n, 2)): symbol first_rule + i stands for the pair rules[i]."""
    rules, total = [np.zeros((0, 2), np.uint32)], 0
    if len(seq) < 2:
        return seq.astype(np.uint32), rules[0]
    state = Sequence(seq, end)
    while True:
        for find in (state.by_cell, state.by_pair):
            at, rank, pairs = find()
            if len(at):
                keep = _apart(state.next[at[:-1]] == at[1:], rank)
                at, rank = at[keep], rank[keep]
                good = np.bincount(rank, minlength=len(pairs)) >= LEAST
                at, rank = at[good[rank]], rank[good[rank]]
            if len(at):
                break
        else:
            return state.symbols(), np.concatenate(rules)
        rules.append(pairs[good])
        state.replace(at, (first_rule + total + (np.cumsum(good) - 1)[rank]).astype(np.uint32))
        total += len(rules[-1])


def _generations(rules: np.ndarray, first_rule: int) -> Iterator[tuple[int, int]]:
    """Ranges of rules that are made of symbols before the range alone."""
    top, i = rules.max(axis=1, initial=0).astype(np.int64) - first_rule, 0
    while i < len(rules):
        later = top[i:] >= i
        j = i + int(np.argmax(later)) if later.any() else len(rules)
        yield i, j
        i = j


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    out = np.concatenate([np.ones(first_rule, np.uint32), np.zeros(len(rules), np.uint32)])
    for a, b in _generations(rules, first_rule):
        out[first_rule + a : first_rule + b] = out[rules[a:b]].sum(axis=1)
    return out[first_rule:]


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of flat end to end."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Symbols back to ids: every rule is written out once, a generation at a time, then gathered."""
    size = np.concatenate([np.ones(len(alphabet), np.int64), lengths.astype(np.int64)])
    start = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint32)
    flat[: len(alphabet)] = alphabet
    for a, b in _generations(rules, len(alphabet)):
        parts = rules[a:b].ravel()
        one = _gather(flat, start[parts], size[parts])
        at = start[len(alphabet) + a]
        flat[at : at + len(one)] = one
    return _gather(flat, start[seq], size[seq])


HEAD = struct.Struct("<4sIIIII")


def pack(doc_ids: list, ids: np.ndarray, starts: np.ndarray, end: int) -> bytes:
    alphabet = np.flatnonzero(np.bincount(ids))
    number = np.zeros(int(alphabet[-1]) + 1, np.uint32)
    number[alphabet] = np.arange(len(alphabet))
    seq, rules = repair(number[ids], len(alphabet), int(number[end]))
    lengths = expansion_lengths(rules, len(alphabet))
    size = np.concatenate([np.ones(len(alphabet), np.int64), lengths])[seq]
    symbol = np.searchsorted(np.concatenate([[0], np.cumsum(size)]), starts)
    width = 2 if len(alphabet) + len(rules) <= 1 << 16 else 3
    symbols = seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([HEAD.pack(b"RPR2", len(alphabet), len(rules), len(doc_ids), width, end), alphabet.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), starts.astype("<i8").tobytes(), symbol.astype("<i8").tobytes(), symbols])


class Segment:
    """A file's directory, read from its bytes or its first bytes."""

    def __init__(self, data: bytes):
        magic, n_ids, n_rules, n_docs, self.width, self.end = HEAD.unpack_from(data)
        if magic != b"RPR2":
            raise ValueError("not a token file")
        at = HEAD.size

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.alphabet = take("<u4", n_ids)
        self.rules, self.lengths = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        self.doc_ids, self.null = take("<i8", n_docs), take("u1", n_docs)
        self.starts, self.symbol, self.body = take("<i8", n_docs + 1), take("<i8", n_docs + 1), at

    @staticmethod
    def directory_bytes(head: bytes) -> int:
        _, n_ids, n_rules, n_docs, *_ = HEAD.unpack_from(head)
        return HEAD.size + 4 * n_ids + 12 * n_rules + 9 * n_docs + 16 * (n_docs + 1)

    def symbols(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8).reshape(-1, self.width)
        out = np.zeros((len(raw), 4), np.uint8)
        out[:, : self.width] = raw
        return out.view("<u4").ravel()

    def expand(self, data: bytes) -> np.ndarray:
        return expand(self.symbols(data), self.rules, self.lengths, self.alphabet)


def read_document(uri: str, n: int) -> np.ndarray:
    """Ids of the n-th document of a file, from three range reads."""
    (head,) = read_ranges(uri, [(0, HEAD.size)])
    (data,) = read_ranges(uri, [(0, Segment.directory_bytes(head))])
    seg = Segment(data)
    a, b = int(seg.symbol[n]), int(seg.symbol[n + 1])
    (part,) = read_ranges(uri, [(seg.body + a * seg.width, (b - a) * seg.width)])
    return seg.expand(part)


def _write(folder: str, path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, part = encoder(path), TaskContext.get().partitionId(), 0
        docs, held, n = [], [], 0

        def flush():
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            uri = f"{folder}/{shard:06d}-{part:06d}-{uuid.uuid4().hex}.rpr"  # a repeated task writes files of its own
            data = pack(docs, np.concatenate(held), starts, end)
            write_file(uri, data)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([uri]), pa.array([int(starts[-1])]), pa.array([len(docs)]), pa.array([len(data)])], ["shard", "part", "uri", "n_ids", "n_docs", "n_bytes"])

        for batch in batches:
            size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(size, size[i] + (16 << 20), side="right")) - 1)
                ids, off = encode(batch.column(1).slice(i, j - i))
                for r, doc in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    one = np.append(ids[off[r] : off[r + 1]], np.uint32(end)).astype(np.uint32)
                    if held and n + len(one) > SEGMENT:
                        yield flush()
                        docs, held, n, part = [], [], 0, part + 1
                    docs.append(doc)
                    held.append(one)
                    n += len(one)
                i = j
        if held:
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = read_file(uri)
            seg = Segment(data)
            ids, starts = seg.expand(data[seg.body :]).astype("<u4"), seg.starts
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(seg.doc_ids, mask=seg.null.astype(bool)), pa.array(before + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Writes the token files; returns their manifest (shard, part, uri, n_ids, n_docs, n_bytes, before), itself stored."""
    spark = docs.sparkSession
    ship(spark, ROOMY)
    folder = fresh_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    files = stored(rows.mapInArrow(_write(folder, path, end), "shard int, part int, uri string, n_ids long, n_docs long, n_bytes long"), "manifest")
    # ids before a file: those of earlier shards (one row a shard in this window) and of earlier parts of its shard
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    inner = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_ids")
    return files.withColumn("inner", inner).join(shards, "shard").select("shard", "part", "uri", "n_ids", "n_docs", "n_bytes", (F.col("base") + F.col("inner")).alias("before"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Manifest -> (doc_id, start, n_tokens, ids_crc32) from the files."""
    spark = manifest.sparkSession
    return manifest.select("uri", "before").repartition(partitions(spark, 24), "uri").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
