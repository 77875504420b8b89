"""SentencePiece encoding and decoding as a relational lattice, exact for BPE piece models.

Encoding. Words (a run of U+2581 and what follows) never share a piece, so distinct words (cut further
between ASCII characters that no piece holds side by side) are encoded once. Substrings
of at most the longest piece's length are made by an equi-join of the words' lengths to the spans of that length (the
explode), and equi-joined to the piece table; the edges are grouped by word, and a fold over them (Spark's higher-order
aggregate) picks the path. In a BPE model that path is not the one with the highest sum of scores, so the fold is not
Viterbi's maximum: it takes the edges in order of rank, then start, and keeps the borders still open as the bits of a
number; an edge is taken, and closes the border inside, if it stands on two symbols just then. One pass is enough where no
piece is made from a piece of a higher rank (Model.packs tells; else, or where ranks are shared, words are replayed): then
no merge makes an earlier one possible. This gives the library's own ids. viterbi() is the fold for unigram models, where
the path is the highest sum of scores.

Words longer than LONG or with several leading spaces are encoded by replaying the merges in Python, in the block's task,
as are all words of a model that doesn't pack. Characters without a piece become byte pieces.

Documents are cut into blocks of about BLOCK bytes inside a task and written as codes into the block's word list, in a
file of the shared folder named by its task and place; words go to the lattice with their blocks and codes, ids come back to the
block, which is then read. So neither text nor codes are shuffled, a frequent word is sent once a block, and a task holds
one block. A word is grouped within the blocks of SHARE tasks, so that the list of its places stays bounded however
frequent it is. The piece table (the model's vocabulary, a fixed number of rows) and the spans are broadcast.

Rows are sorted by word once, the first of each word takes part in the joins, and these keep the order, so with
spark.sql.execution.replaceHashWithSortAgg (set by encode) the grouping reads its rows in order, without a hash table.

Defined cases: null text counts as empty and has no pieces; null or repeated doc_ids are kept row by row; U+2581 in a text
is a space, as in the library; a model that is no BPE model is refused; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, partitions, ship
from .files import read_file, write_file
from .kernel import buffers

LONG, BLOCK, SHARE, WORDS, MARK, RAW = 48, 12 << 20, 1024, 60_000, "▁", "\x01"


#: Model types in a model's file.
UNIGRAM, BPE = 1, 2


def model_kind(data: bytes) -> int:
    """The model type in a model file's trainer settings."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(data)
    return proto.trainer_spec.model_type


class Model:
    """Pieces of a SentencePiece BPE model: ranks (0 merges first), the derivation of each piece, byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            kind = model_kind(f.read())
        if kind != BPE:
            raise ValueError("this model's pieces aren't merged in order of rank; viterbi() is the fold for unigram models")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.GetPieceSize()
        self.pieces = [sp.IdToPiece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.IsByte(i)}
        plain = [i for i in range(n) if not (sp.IsByte(i) or sp.IsControl(i) or sp.IsUnknown(i) or sp.IsUnused(i))]
        self.id = {self.pieces[i]: i for i in plain}
        order = sorted(plain, key=lambda i: (-sp.GetScore(i), i))
        self.rank, last, rank = {}, None, -1
        for i in order:  # equal scores have equal ranks: the leftmost merges first
            if sp.GetScore(i) != last:
                rank, last = rank + 1, sp.GetScore(i)
            self.rank[self.pieces[i]] = rank
        self.longest = max(map(len, self.id))
        self.unknown = sp.unk_id()
        words = [p for p in self.id if len(p) > 1 and p.strip(MARK)]
        #: the id of each rank, and of each character (-1: none)
        self.by_rank, self.by_char = np.zeros(max(self.rank.values()) + 1, np.int64), np.full(0x110000, -1, np.int64)
        self.by_rank[[self.rank[p] for p in words]] = [self.id[p] for p in words]
        self.by_char[[ord(p) for p in self.id if len(p) == 1]] = [self.id[p] for p in self.id if len(p) == 1]
        #: whether one pass of the fold is exact: ranks of their own, that fit a packed edge, and above those of the parts
        self.packs = len({self.rank[p] for p in words}) == len(words) and len(self.by_rank) <= 1 << 15 and all(self._rises(p) for p in words)
        #: ASCII characters that stand side by side in some piece
        self.pairs = np.zeros((128, 128), dtype=bool)
        for p in self.id:
            for a, b in zip(p, p[1:], strict=False):
                if a < "\x80" and b < "\x80":
                    self.pairs[ord(a), ord(b)] = True

    def merges(self, word: str) -> list[tuple[int, int, tuple | None]]:
        """Replays the merges of a word: its symbols as (start, end, derivation)."""
        n = len(word)
        left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        tree: list = [None] * n
        alive = [True] * n
        heap: list = []

        def offer(i):
            j = right[i]
            if j < n and (r := self.rank.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, j, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, ei, ej = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and right[i] == j and end[i] == ei and end[j] == ej):
                continue
            tree[i] = ((i, end[i], tree[i]), (j, end[j], tree[j]))
            end[i], right[i], alive[j] = end[j], right[j], False
            if right[i] < n:
                left[right[i]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append((i, end[i], tree[i]))
            i = right[i]
        return out

    def encode_word(self, word: str) -> list[int]:
        out: list[int] = []
        for a, b, _ in self.merges(word):
            out += [self.id[word[a:b]]] if word[a:b] in self.id else self.fallback(word[a:b])
        return out

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[x] for x in char.encode()] if self.bytes else [self.unknown]

    def _rises(self, piece: str) -> bool:
        """Whether the merges that make a piece come in order of rank, or don't make it."""
        got = self.merges(piece)
        stack = [(got[0], len(self.by_rank))] if len(got) == 1 else []
        while stack:
            (a, b, parts), above = stack.pop()
            if parts:
                rank = self.rank[piece[a:b]]
                if rank >= above:
                    return False
                stack += [(x, rank) for x in parts]
        return True

    def rows(self) -> pa.Table:
        """(piece, rank) of the pieces of two characters or more that an encoding can hold."""
        out = [p for p in self.id if len(p) > 1 and p.strip(MARK) and len(self.merges(p)) == 1]
        return pa.table({"piece": pa.array(out, pa.string()), "rank": pa.array([self.rank[p] for p in out], pa.int32())})


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def split_words(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Keys of the words of all rows, dictionary-encoded, and n + 1 offsets. A key w is the word MARK + w; RAW + w is w itself."""
    text = column.cast(pa.large_string()).fill_null("")
    n = len(text)
    odd = np.zeros(n, dtype=bool)
    for what in ("  ", MARK, RAW):
        odd |= pc.match_substring(text, what).to_numpy(zero_copy_only=False)
    odd |= pc.starts_with(text, " ").to_numpy(zero_copy_only=False) | pc.ends_with(text, " ").to_numpy(zero_copy_only=False)
    odd |= pc.match_substring(text, " \n").to_numpy(zero_copy_only=False)
    odd |= pc.equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pc.replace_substring(text, "\n", f" {RAW}\n {RAW}"), " ")
    if odd.any():
        rows = [None] * n
        for r in np.flatnonzero(odd):
            rows[r] = _keys(text[int(r)].as_py())
        pieces, sizes = [], np.zeros(n, np.int64)
        values, off = lists.values, lists.offsets.to_numpy()
        at = 0
        while at < n:
            if odd[at]:
                pieces.append(pa.array(rows[at], pa.large_string()))
                sizes[at] = len(rows[at])
                at += 1
            else:
                stop = at
                while stop < n and not odd[stop]:
                    stop += 1
                pieces.append(values.slice(off[at], off[stop] - off[at]).cast(pa.large_string()))
                sizes[at:stop] = np.diff(off[at : stop + 1])
                at = stop
        return pa.concat_arrays(pieces).dictionary_encode(), np.concatenate([[0], np.cumsum(sizes)])
    off = lists.offsets.to_numpy()
    return lists.values.slice(off[0], off[-1] - off[0]).cast(pa.large_string()).dictionary_encode(), off - off[0]


def _keys(text: str) -> list[str]:
    """The words of one text, whatever its spaces."""
    out: list[str] = []
    if not text:
        return out
    text, word = MARK + text.replace(" ", MARK), ""
    for i, c in enumerate(text):
        if c == "\n" or (c == MARK and i and text[i - 1] != MARK) or (i and text[i - 1] == "\n"):
            if word:
                out.append(word)
            word = ""
        word += c
    out.append(word)
    return [w[1:] if w[0] == MARK and not w.startswith(MARK + RAW) else RAW + w for w in out]


def cut_words(keys: pa.Array, m: Model) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of the keys, cut between ASCII characters that no piece holds side by side (no merge crosses there)."""
    keys = keys.cast(pa.large_string())
    raw = pc.starts_with(keys, RAW)
    words = pc.if_else(raw, pc.utf8_slice_codeunits(keys, 1), pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), keys, pa.scalar("", pa.large_string())))
    data, off = buffers(words)
    start = np.zeros(len(data) + 1, dtype=bool)
    start[off] = True
    a, b = data[:-1], data[1:]
    start[1:-1] |= (a < 128) & (b < 128) & ~m.pairs[a & 127, b & 127]
    at = np.flatnonzero(start)
    if not len(data):
        at = np.zeros(1, np.int64)
    parts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
    return parts.dictionary_encode(), np.searchsorted(at, off)


def _blocks(batches: Iterator[pa.RecordBatch], m: Model, block: int = 0) -> Iterator[tuple[int, pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Blocks of a task's rows: (id, rows, words, codes, offsets). Ids count on from block: tasks begin far apart, so equal blocks of two tasks stay two."""
    for batch in batches:
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, size[i] + BLOCK, side="right")) - 1)
            part = batch.slice(i, j - i)
            coded, off = split_words(part.column(1))
            cuts, first = cut_words(coded.dictionary, m)
            flat, many = cuts.indices.to_numpy().astype(np.uint32), np.diff(first)
            codes = coded.indices.to_numpy()
            each = many[codes] if len(codes) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(each)])
            out = flat[np.repeat(first[codes] - ends[:-1], each) + np.arange(ends[-1])] if len(codes) else flat
            words, at = cuts.dictionary, ends[off]
            del coded, cuts, flat, many, codes, each, ends
            yield block, part, words, out, at
            del words, out
            pa.default_memory_pool().release_unused()
            i, block = j, block + 1


def _odd(words: pa.Array, m: Model) -> np.ndarray:
    """Words that the fold isn't for."""
    if not m.packs:
        return np.ones(len(words), dtype=bool)
    return pc.or_(pc.greater(pc.utf8_length(words), LONG), pc.starts_with(words, MARK * 2)).to_numpy(zero_copy_only=False)


HEAD = struct.Struct("<QQQQ")


def _packed(part: pa.RecordBatch, codes: np.ndarray, off: np.ndarray, odd: np.ndarray, ids: list[list[int]]) -> bytes:
    """A block's file: doc_ids, codes of its documents, and the ids of the words that the fold isn't for."""
    import zstandard

    doc = part.column(0)
    flat = np.array([y for x in ids for y in x], "<u4")
    head = HEAD.pack(part.num_rows, len(codes), len(odd), len(flat))
    # the codes as planes of bytes: the higher ones compress well
    columns = (doc.fill_null(0).to_numpy().astype("<i8"), doc.is_null().to_numpy(zero_copy_only=False).astype("u1"), off.astype("<i8"), np.ascontiguousarray(codes.astype("<u4").view("u1").reshape(-1, 4).T), odd.astype("<u4"), np.array([len(x) for x in ids], "<u4"), flat)
    return zstandard.ZstdCompressor(level=5).compress(b"".join([head, *(c.tobytes() for c in columns)]))


def _unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    docs, codes, odd, flat = HEAD.unpack_from(raw)
    out, at = [], HEAD.size
    for kind, n in (("<i8", docs), ("u1", docs), ("<i8", docs + 1), ("u1", 4 * codes), ("<u4", odd), ("<u4", odd), ("<u4", flat)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    out[3] = np.ascontiguousarray(out[3].reshape(4, -1).T).view("<u4").ravel()
    return out


def _send(path: str, folder: str):
    """Writes each block's file and sends its words, and one word more that stands for the block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, task = model(path), TaskContext.get().partitionId()
        share = task // SHARE
        for block, part, words, codes, off in _blocks(batches, m, task << 24):
            flag = _odd(words, m)
            odd, code = np.flatnonzero(flag), np.flatnonzero(~flag)
            uri = f"{folder}/{block:016x}"
            write_file(f"{uri}-{uuid.uuid4().hex}", _packed(part, codes, off, odd, [m.encode_word(w) for w in words.take(pa.array(odd)).to_pylist()]), uri)
            sent = pa.concat_arrays([words.take(pa.array(code)).cast(pa.string()), pa.array([f"{block:x}"])])
            yield pa.RecordBatch.from_arrays([sent, pa.array(np.full(len(sent), block)), pa.array(np.append(code, -1).astype(np.int32)), pa.array(np.full(len(sent), share, np.int32))], ["word", "block", "code", "share"])

    return run


def _bundle(code: np.ndarray, size: np.ndarray, flat: np.ndarray) -> bytes:
    """Ascending codes and the ids of their words, in one piece."""
    import zstandard

    wide = "<u4" if len(flat) and flat.max() >= 1 << 16 else "<u2"
    data = b"".join([np.array([len(code), len(flat)], "<u4").tobytes(), np.diff(code, prepend=0).astype("<i4").tobytes(), size.astype("u1").tobytes(), flat.astype(wide).tobytes()])
    return zstandard.ZstdCompressor(level=5).compress(data)


def _unbundle(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    rest = len(data) - 8 - 5 * n
    return np.cumsum(np.frombuffer(data, "<i4", n, 8)), np.frombuffer(data, "u1", n, 8 + 4 * n).astype(np.int64), np.frombuffer(data, "<u2" if rest == 2 * m else "<u4", m, 8 + 5 * n)


def _ids(ranks: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word's path has, and the ids end to end; characters without a piece become byte pieces."""
    size, rank = pc.list_value_length(ranks).to_numpy(zero_copy_only=False).astype(np.int64), ranks.flatten().to_numpy()
    out = np.where(rank < 0, m.by_char[np.maximum(-1 - rank, 0)], m.by_rank[np.maximum(rank, 0)])
    bare = np.flatnonzero(out < 0)
    if not len(bare):
        return size, out
    back = [m.fallback(chr(-1 - int(x))) for x in rank[bare]]
    many = np.ones(len(rank), np.int64)
    many[bare] = [len(x) for x in back]
    out = np.repeat(out, many)
    first = np.cumsum(many) - many
    for i, x in zip(bare, back, strict=True):
        out[first[i] : first[i] + len(x)] = x
    return np.add.reduceat(many, np.cumsum(size) - size), out


def _bundles(path: str):
    """(places, ranks) of words -> (block, bundle): each block's words of up to WORDS of a task in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, words = model(path), [], 0
        for batch in batches:
            places = batch.column(0)
            size, flat = _ids(batch.column(1), m)
            row = np.repeat(np.arange(len(places)), pc.list_value_length(places).to_numpy(zero_copy_only=False))
            at = places.flatten()
            held.append((row, at.field(0).to_numpy(), at.field(1).to_numpy(), size, flat))
            words += batch.num_rows
            if words > WORDS:
                yield _bundled(held)
                held, words = [], 0
        if held:
            yield _bundled(held)

    return run


def _bundled(held: list[tuple]) -> pa.RecordBatch:
    before = np.cumsum([0, *(len(h[3]) for h in held)])
    row, block, code, size, flat = (np.concatenate([h[c] + before[i] if not c else h[c] for i, h in enumerate(held)]) for c in range(5))
    first, order = np.cumsum(size) - size, np.lexsort((code, block))
    row, code, block = row[order], code[order], block[order]
    many = size[row]
    pick = flat[np.repeat(first[row] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    cut = np.concatenate([np.flatnonzero(np.diff(block, prepend=~block[:1])), [len(block)]])
    at = np.concatenate([[0], np.cumsum(many)])
    out = [_bundle(code[a:b], many[a:b], pick[at[a] : at[b]]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), pa.array(out, pa.binary())], ["block", "bundle"])


def _assemble(folder: str):
    def run(key, bundles):
        """One block: its file and the ids of its words -> ids of the documents."""
        block = int(key[0].as_py())
        doc, null, off, codes, odd, odd_size, odd_flat = _unpacked(read_file(f"{folder}/{block:016x}"))
        got = [(c[c >= 0], n[c >= 0], f[np.repeat(c >= 0, n)]) for c, n, f in (_unbundle(x.as_py()) for x in bundles["bundle"])] + [(odd, odd_size.astype(np.int64), odd_flat)]
        code, many = np.concatenate([g[0] for g in got]).astype(np.int64), np.concatenate([g[1] for g in got])
        flat = np.concatenate([g[2].astype(np.int32) for g in got])
        del got
        top = int(codes.max()) + 1 if len(codes) else 0
        size, start = np.full(max(top, int(code.max()) + 1 if len(code) else 0), -1), np.zeros(max(top, int(code.max()) + 1 if len(code) else 0), np.int64)
        size[code], start[code] = many, np.cumsum(many) - many
        if len(codes) and (size[codes] < 0).any():
            raise ValueError(f"block {block} has codes without words")
        each = size[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        if ends[-1] >= 1 << 31:
            raise ValueError("a block of more than 2^31 ids")
        out = flat[np.repeat(start[codes] - ends[:-1], each) + np.arange(int(ends[-1]))]
        ids = pa.ListArray.from_arrays(pa.array(ends[off].astype(np.int32)), pa.array(out))
        return pa.table({"doc_id": pa.array(doc, mask=null.astype(bool)), "ids": ids})

    return run


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(model(path).rows())


def spans(spark: SparkSession, longest: int, most: int = LONG) -> DataFrame:
    """(n, s, k): the substrings of two to longest characters of a word of n, and (0, 1), which stands for the word."""
    rows = spark.range(1, most + 1).select(F.col("id").cast("int").alias("n"), F.explode(F.expr("sequence(0, cast(id as int) - 1)")).alias("s"))
    rows = rows.select("n", "s", F.explode(F.expr(f"sequence(1, least({longest}, n - s))")).alias("k"))
    return rows.where("k > 1 or s = 0")


def edges(places: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, share, block, code) -> each row, and for one row of each word and share one more for each substring that is a piece: explode and equi-join."""
    first = F.row_number().over(Window.partitionBy("word", "share").orderBy("word")) == 1
    length = places.withColumn("length", F.when(first, F.char_length("word")))
    rows = length.join(F.broadcast(spans(places.sparkSession, longest)), F.col("length") == F.col("n"), "left").withColumn("part", F.expr("substring(word, s + 1, k)")).withColumn("h", F.xxhash64("part"))
    # joined by a hash, which is quick to look up; the texts are compared after it
    found = rows.join(F.broadcast(pieces.select(F.xxhash64("piece").alias("h"), "piece", "rank")), "h", "left")
    return found.withColumn("hit", F.expr("k > 1 and part = piece")).where("hit or k is null or k = 1")


#: The fold. An edge is rank (15 bits), start (6), end (6); b has bit i set while i is a border between symbols.
_INNER = "shiftleft(1L, x & 63) - shiftleft(2L, shiftright(x, 6) & 63)"
_ENDS = "(shiftleft(1L, x & 63) | shiftleft(1L, shiftright(x, 6) & 63))"
_FOLD = f"aggregate(edges, shiftleft(2L, n) - 1, (b, x) -> CASE WHEN (b & {_ENDS}) = {_ENDS} AND bit_count(b & ({_INNER})) = 1 THEN b & ~({_INNER}) ELSE b END)"
#: Symbols as start (6 bits) and, in 22 bits, the rank or 2^21 + the code point of a single character.
_TAKEN = f"transform(filter(edges, x -> (b & {_ENDS}) = {_ENDS} AND (b & ({_INNER})) = 0), x -> shiftleft(shiftright(x, 6) & 63, 22) | shiftright(x, 12))"
_SINGLE = "transform(filter(sequence(0, n - 1), i -> (shiftright(b, i) & 3) = 3), i -> shiftleft(i, 22) | 2097152 | ascii(substring(word, i + 1, 1)))"


def lattice(places: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, share, block, code), words of 1 to LONG characters -> (places, ranks), a row for each word and share. No Python on this path.

    A character that is a symbol of its own comes as -1 - its code point.
    """
    edge, place = F.expr("CASE WHEN hit THEN shiftleft(rank, 12) | shiftleft(s, 6) | (s + k) END"), F.expr("CASE WHEN k IS NULL OR k = 1 THEN struct(block, code) END")
    grouped = edges(places, pieces, longest).select("word", "share", edge.alias("edge"), place.alias("place")).groupBy("word", "share").agg(F.sort_array(F.collect_list("edge")).alias("edges"), F.collect_list("place").alias("places"))
    folded = grouped.select("word", "places", "edges", F.char_length("word").alias("n")).withColumn("b", F.expr(_FOLD))
    return folded.select("places", F.expr(f"transform(array_sort(concat({_TAKEN}, {_SINGLE})), y -> CASE WHEN y & 2097152 = 0 THEN y & 2097151 ELSE -1 - (y & 2097151) END)").alias("ranks"))


def viterbi(words: DataFrame, pieces: DataFrame, longest: int, unknown: float = -1e4) -> DataFrame:
    """(word) and the (piece, score) of a unigram model -> (word, pieces), the segmentation of the highest sum of scores.

    The same lattice with the fold for unigram models: edges in order of their end, the best way into each position. A
    character without a piece scores unknown. Of equal sums the one whose last piece starts earliest is taken, and so on.
    """
    spark = words.sparkSession
    singles = spans(spark, longest).where("k > 1").unionByName(spark.range(1, LONG + 1).select(F.col("id").cast("int").alias("n"), F.explode(F.expr("sequence(0, cast(id as int) - 1)")).alias("s"), F.lit(1).alias("k")))
    rows = words.select("word").distinct().join(F.broadcast(singles), F.char_length("word") == F.col("n")).withColumn("piece", F.expr("substring(word, s + 1, k)"))
    found = rows.join(F.broadcast(pieces), "piece", "left").where("k = 1 or score is not null")
    edge = F.struct((F.col("s") + F.col("k")).alias("e"), "s", F.coalesce("score", F.lit(unknown)).cast("double").alias("score"))
    grouped = found.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    best = """aggregate(edges, array(named_struct('sum', 0D, 's', 0)), (acc, x) -> CASE
      WHEN size(acc) <= x.e THEN array_append(acc, named_struct('sum', acc[x.s].sum + x.score, 's', x.s))
      WHEN acc[x.s].sum + x.score > acc[x.e].sum THEN concat(slice(acc, 1, x.e), array(named_struct('sum', acc[x.s].sum + x.score, 's', x.s))) ELSE acc END)"""
    back = "aggregate(sequence(char_length(word), 1, -1), named_struct('at', char_length(word), 'out', filter(array(word), x -> false)), (t, i) -> CASE WHEN i = t.at THEN named_struct('at', best[i].s, 'out', array_append(t.out, substring(word, best[i].s + 1, i - best[i].s))) ELSE t END, t -> reverse(t.out))"
    return grouped.withColumn("best", F.expr(best)).select("word", F.expr(back).alias("pieces"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """documents -> (doc_id, ids), one row per row of docs; ids: the library's encoding with the model at path."""
    spark = docs.sparkSession
    ship(spark)
    m, folder, parts = model(path), fresh_path(spark, "blocks"), partitions(spark)
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = texts.mapInArrow(_send(path, folder), "word string, block long, code int, share int").repartition(parts, "word", "share")
    ids = lattice(places, piece_table(spark, path), m.longest).mapInArrow(_bundles(path), "block long, bundle binary")
    return ids.repartition(parts, "block").groupBy("block").applyInArrow(_assemble(folder), "doc_id long, ids array<int>")


def decode_ids(m: Model, ids: list[int]) -> str:
    """Pieces back to text: byte pieces join into UTF-8, U+2581 is a space, the first space is the encoder's own."""
    byte = {i: b for b, i in m.bytes.items()}
    data = b"".join(bytes([byte[i]]) if i in byte else m.pieces[i].encode() for i in ids)
    text = data.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        byte = {i: b for b, i in m.bytes.items()}
        table = [bytes([byte[i]]) if i in byte else p.encode() for i, p in enumerate(m.pieces)]
        flat, size = np.frombuffer(b"".join(table), np.uint8), np.array([len(x) for x in table])
        first = np.cumsum(size) - size
        for batch in batches:
            out = []
            for ids in batch.column(1):
                x = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)
                many = size[x]
                at = np.repeat(first[x] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                text = flat[at].tobytes().decode("utf-8", "replace").replace(MARK, " ")
                out.append(text[1:] if text.startswith(" ") else text)
            crc = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) if x.is_valid else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(crc, pa.int64())], ["doc_id", "ids", "text", "ids_crc32"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, text, ids_crc32)."""
    ship(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, ids array<int>, text string, ids_crc32 long")
