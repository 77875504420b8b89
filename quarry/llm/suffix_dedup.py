"""Removes every byte that an earlier copy of the same 100-byte string already covers: bucket-pointer refinement at scale.

A suffix array of all positions would need many times the input. What decides is only which 100-byte windows are equal,
so the refinement runs on those windows that can have a twin:

1. Blocks. Each task writes its rows, in order of doc_id, as files of about BLOCK bytes to the shared folder. Text is never
   shuffled; later steps send what they found to the block, and one task reads its file.
2. Anchors. Of the 69 q-grams (q = 32) in a window, the leftmost with the least hash is its anchor. It depends on the
   window's bytes alone, so equal windows have equal anchors at the same offset. One byte in about 35 is an anchor. A block
   sends each of its anchors once, however many of its documents hold it.
3. An anchor seen once in all documents cannot belong to a repeated window: those windows are settled. For the others the
   block sends the bytes around them (at most 168) to the anchor's bucket. It sends the same surroundings once: of later
   ones it already knows that all their windows are repeats.
4. Bucket-pointer refinement. The first buckets are those of the q-grams at all positions sent. Each round sorts by the
   bucket identifiers found at a later offset and writes the refined identifiers back, so that the next round reads them
   there and the depth doubles: 32, 64, and the identifiers of 64 at offset 36 give 100. Windows alone in a bucket drop out.
   After the last round a bucket is one 100-byte string; all but its first window (smaller doc_id, then earlier start) are
   repeats.
5. Anchors in more than HOT documents send each window by its own hash instead of by the anchor, so a passage that a
   third of all rows share is many small buckets, and every block sends each of its windows once.

Identifiers are 64-bit hashes of what they stand for. Strings are judged on the input. Matches never cross documents.
Defined cases: null text is empty; texts under 100 bytes lose nothing; a row with null doc_id is returned with nothing
removed and is not a source either. A document is a doc_id and its text (told by `part`, a hash of it): rows that repeat
both count as one document, each returned with its result; texts that share a doc_id are documents of their own, ordered
by their hashes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import fresh_path, partitions, ship, stored
from .files import read_file, write_file

Q, BLOCK, SEGMENT, WINDOWS, HOT = 32, 8 << 20, 1 << 20, 400_000, 20_000


def qgrams(raw: np.ndarray) -> np.ndarray:
    """Hash of the Q = 32 bytes from each position, by doubling: the identifiers of q-gram buckets."""
    h, mult, step = raw.astype(K.U) + K.U(1), K.U(0x100000001B3), 1
    while step < Q:
        h = h[:-step] * mult + h[step:] if len(h) > step else np.zeros(0, K.U)
        mult, step = mult * mult, step * 2
    return K.mix(h)


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum or maximum) over x[i : i + width] for each i that has so many."""
    step = 1
    while step * 2 <= width:
        x = of(x[:-step], x[step:])
        step *= 2
    return of(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def windows(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h, m, valid, anchor): q-gram hashes, the least hash of each window, whether it lies in one row, and what is an anchor."""
    width = length - Q + 1
    if len(raw) < length:
        return (np.zeros(0, K.U),) * 2 + (np.zeros(0, bool),) * 2
    h = qgrams(raw)
    m = _sliding(h, width, np.minimum)
    size = np.diff(off)
    # starts of a row of n bytes that hold a whole window: the first n - length + 1
    edge = np.zeros(len(raw) + 1, np.int8)
    some = size >= length
    np.add.at(edge, off[:-1][some], 1)
    np.add.at(edge, (off[1:] - length + 1)[some], -1)
    valid = np.cumsum(edge[: len(m)], dtype=np.int8) > 0
    padded = np.concatenate([np.zeros(width - 1, K.U), np.where(valid, m, K.U(0)), np.zeros(width - 1, K.U)])
    anchor = h == _sliding(padded, width, np.maximum)[: len(h)]
    return h, m, valid, anchor & (h > 0)


def _pieces(raw: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes before, bytes, offsets): chunks; a very long row in overlapping pieces, so that memory stays bounded."""
    for i, j in K.chunks(off, SEGMENT):
        n = off[j] - off[i]
        if j == i + 1 and n > SEGMENT:
            for a in range(0, int(n) - length + 1, SEGMENT):
                b = min(int(n), a + SEGMENT + length - 1)
                yield i, a, raw[off[i] + a : off[i] + b], np.array([0, b - a])
        else:
            yield i, 0, raw[off[i] : off[j]], off[i : j + 1] - off[i]


def _uri(folder: str, block: int) -> str:
    return f"{folder}/{block:016x}"


def _write_block(folder: str, block: int, rows: pa.Table) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows)
    write_file(f"{_uri(folder, block)}-{uuid.uuid4().hex}", sink.getvalue(), _uri(folder, block))


def _read_block(folder: str, block: int) -> pa.Table:
    return pa.ipc.open_file(pa.BufferReader(read_file(_uri(folder, block)))).read_all()


def _documents(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(doc_id, part, text) of a block's documents that can hold a window, without repeated rows, in the block's order."""
    use = pc.and_(pc.is_valid(rows["quarry:doc"]), pc.greater_equal(pc.fill_null(pc.binary_length(rows["text"]), 0), length))
    some = rows.select(["quarry:doc", "quarry:part", "text"]).filter(use).combine_chunks()
    doc, part = (some[c].to_numpy() for c in ("quarry:doc", "quarry:part"))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
    some = some.filter(pa.array(new))
    return doc[new], part[new], some["text"].combine_chunks() if some.num_rows else pa.array([], pa.string())


def _blocks(folder: str, text: int, length: int):
    """Writes blocks; sends (h, block, docs, many): each anchor of a block once, and a row without docs for the block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))])
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(size, size[i] + BLOCK, side="right")) - 1)
                rows = pa.Table.from_batches([batch.slice(i, j - i)])
                rows = rows.take(pc.sort_indices(rows, [("quarry:doc", "ascending"), ("quarry:part", "ascending")]))
                _write_block(folder, block, rows)
                found = [np.zeros((0, 2), K.U)]
                for a, _, piece, at in _pieces(*K.buffers(_documents(rows, length)[2]), length):
                    h, _, _, anchor = windows(piece, at, length)
                    spots = np.flatnonzero(anchor)
                    found.append(np.stack([h[spots], (a + np.searchsorted(at, spots, side="right") - 1).astype(K.U)], axis=1))
                both = np.concatenate(found)
                both = both[np.lexsort((both[:, 1], both[:, 0]))]
                new = np.ones(len(both), dtype=bool)
                new[1:] = both[1:, 0] != both[:-1, 0]
                first = np.flatnonzero(new)
                other = np.concatenate([[0], np.cumsum((both[1:] != both[:-1]).any(axis=1))]) if len(both) else first
                docs = np.add.reduceat(np.diff(other, prepend=-1) > 0, first, dtype=np.int64) if len(first) else first
                many = np.diff(np.append(first, len(both))) > docs
                mark = int(K.mix(np.array([block], K.U)).view(np.int64)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(both[first, 0].view(np.int64), mark)), pa.array(np.full(len(first) + 1, block)), pa.array(np.append(docs, 0)), pa.array(np.append(many, False))], ["h", "block", "docs", "many"])
                i, block = j, block + 1

    return run


def _repeated(hot_over: int):
    """Rows in order of h -> (h, block, hot) of those whose h comes in two documents or more, or many times, hot: in more than hot_over; rows for blocks pass, hot null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out():
            h, block, docs, many = (np.concatenate(c) for c in zip(*held, strict=True))
            cut = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            total, size = np.add.reduceat(docs, cut), np.diff(np.append(cut, len(h)))
            often = np.repeat((total > 1) | np.logical_or.reduceat(many, cut), size)
            hot, use = np.repeat(total > hot_over, size), often & (docs > 0)
            return pa.RecordBatch.from_arrays([pa.array(h[use]), pa.array(block[use]), pa.array(hot[use])], ["h", "block", "hot"])

        for batch in batches:
            h, block, docs, many = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            own = docs == 0
            yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(block[own]), pa.nulls(int(own.sum()), pa.bool_())], ["h", "block", "hot"])
            cut = np.flatnonzero(h != h[-1])
            stop = int(cut[-1]) + 1 if len(cut) else 0  # the last run may go on
            if stop:
                held.append((h[:stop], block[:stop], docs[:stop], many[:stop]))
                yield out()
                held = []
            held.append((h[stop:], block[stop:], docs[stop:], many[stop:]))
        if held:
            yield out()

    return run


SENT = "key long, doc_id long, part long, start long, end long, block long, bytes binary"


def _range_hash(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of ranges of Q bytes or more, from the q-gram hashes of their places."""
    out = size.astype(K.U)
    for step in range(0, int(size.max()) if len(size) else 0, Q):
        out = K.mix(out * K.U(0x9E3779B97F4A7C15) + h[start + np.minimum(step, size - Q)])
    return out


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The ranges of raw as a binary array."""
    off = np.concatenate([[0], np.cumsum(size)])
    data = raw[np.repeat(start - off[:-1], size) + np.arange(int(off[-1]))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _new(mark: np.ndarray, seen: set) -> np.ndarray:
    """Which marks are the first of their kind, here and in seen, which learns them."""
    value, first = np.unique(mark, return_index=True)
    fresh = np.array([x not in seen for x in value.tolist()], dtype=bool)
    seen.update(value[fresh].tolist())
    out = np.zeros(len(mark), dtype=bool)
    out[first[fresh]] = True
    return out


def _surroundings(folder: str, length: int):
    """One block with its repeated anchors -> bytes for the buckets, and runs already known to repeat (bytes null)."""

    def run(key, flagged):
        block = int(key[0].as_py())
        doc, part, texts = _documents(_read_block(folder, block), length)
        raw, off = K.buffers(texts)
        listed, hot = flagged["h"].to_numpy().view(K.U), flagged["hot"].to_numpy(zero_copy_only=False)
        order = np.argsort(listed)
        listed, hot, seen, out = listed[order], hot[order], set(), []

        def add(key, row, base, start, size, piece, fresh):
            place = doc[row], part[row], start + base, start + size + base
            for use, data in ((fresh, True), (~fresh, False)):
                if use.any():
                    n = int(use.sum())
                    out.append([(key if data else place[0])[use].astype(np.int64), *(c[use] for c in place), np.full(n, block), _gather(piece, start[use], size[use]) if data else pa.nulls(n, pa.binary())])

        for i, before, piece, at in _pieces(raw, off, length):
            h, m, valid, anchor = windows(piece, at, length)
            spots = np.flatnonzero(anchor)
            if not len(spots):
                continue
            # windows with one anchor stand side by side: the anchor changes where the least hash does, or where it leaves
            begins = valid.copy()
            begins[1:] &= ~valid[:-1] | (m[1:] != m[:-1]) | (h[: len(m) - 1] == m[:-1])
            ends = valid.copy()
            ends[:-1] &= begins[1:] | ~valid[1:]
            lo, hi = np.flatnonzero(begins), np.flatnonzero(ends)
            nxt = np.searchsorted(spots, lo)
            while True:  # the first anchor from the start on that has the windows' least hash
                bad = np.flatnonzero(h[spots[nxt]] != m[lo])
                if not len(bad):
                    break
                nxt[bad] += 1
            who, of = spots[nxt], np.searchsorted(at, lo, side="right") - 1
            place = np.minimum(np.searchsorted(listed, h[who]), len(listed) - 1)
            use = listed[place] == h[who]
            lo, hi, who, of, warm = lo[use], hi[use], who[use], of[use], hot[place[use]]
            size = hi - lo + length
            fresh = _new(K.mix(_range_hash(h, lo, size) + (who - lo).astype(K.U)), seen)
            base = before - at[of]
            some = ~warm | ~fresh  # hot surroundings that are not known go window by window
            add(h[who[some]].view(np.int64), i + of[some], base[some], lo[some], size[some], piece, fresh[some])
            some = np.flatnonzero(~some)
            each = hi[some] - lo[some] + 1
            one = np.repeat(lo[some] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            size = np.full(len(one), length)
            mark = _range_hash(h, one, size)
            add(mark.view(np.int64), np.repeat(i + of[some], each), np.repeat(base[some], each), one, size, piece, _new(mark, seen))
        names, kinds = ("key", "doc_id", "part", "start", "end", "block", "bytes"), (*[pa.int64()] * 6, pa.binary())
        return pa.table({n: pa.chunked_array([pa.array(o[c], t) if c < 6 else o[c] for o in out], t) for c, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return run


def refine(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, first) of the windows that are in a row twice or in another row too; first: the number, in this result, of the first such window.

    Bucket-pointer refinement: buckets of q-grams first; each round reads the identifiers that the round before wrote at a
    later offset. Rows are in order; a window's bucket has its windows in that order.
    """
    bucket, depth = qgrams(raw), Q
    size = np.diff(off) - length + 1
    row = np.repeat(np.arange(len(size)), size)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = off[:-1][row] + inner
    first = np.zeros(0, np.int64)
    while len(at):
        step = min(depth, length - depth)
        last = depth + step == length
        if last:
            value = K.mix(bucket[at] * K.U(0x9E3779B97F4A7C15) + bucket[at + step])
        else:  # all positions get their refined identifier, since the next round reads it at other offsets
            bucket = K.mix(bucket[:-step] * K.U(0x9E3779B97F4A7C15) + bucket[step:])
            value = bucket[at]
        order = np.argsort(value)
        ordered = value[order]
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        many = np.diff(np.append(begin, len(order)))
        keep = np.empty(len(order), dtype=bool)
        keep[order] = np.repeat(many > 1, many)
        if last:
            head = np.empty(len(order), np.int64)
            head[order] = np.repeat(np.minimum.reduceat(order, begin), many)
            first = (np.cumsum(keep) - 1)[head[keep]]
        at, row, inner = at[keep], row[keep], inner[keep]
        depth += step
        if last:
            break
    return row, inner, first


def _refined(length: int):
    names = ["block", "doc_id", "part", "start", "end"]

    def out(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def found(rows: pa.Table) -> pa.RecordBatch:
        doc, part, start, block = (rows[c].to_numpy() for c in ("doc_id", "part", "start", "block"))
        row, inner, first = refine(*K.buffers(rows["bytes"]), length)
        place = start[row] + inner
        again = (doc[row] != doc[row[first]]) | (part[row] != part[row[first]]) | (place != place[first])  # not the first window, nor that of a repeated row
        row, inner = row[again], inner[again]
        if not len(row):
            return out(*[[]] * 5)
        cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1)]))
        end = np.append(cut[1:], len(row)) - 1
        return out(block[row[cut]], doc[row[cut]], part[row[cut]], start[row[cut]] + inner[cut], start[row[cut]] + inner[end] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows_held = [], 0
        for batch in batches:
            known = batch.filter(pc.is_null(batch.column("bytes")))
            if known.num_rows:
                yield out(*(known.column(c) for c in names))
            sent = batch.filter(pc.is_valid(batch.column("bytes")))
            i = 0
            while i < sent.num_rows:
                key = sent.column("key").to_numpy()
                total = np.cumsum(pc.binary_length(sent.column("bytes")).to_numpy() - (length - 1))
                # up to WINDOWS windows, and then to the end of a key
                j = int(np.searchsorted(total, (total[i - 1] if i else 0) + WINDOWS - windows_held)) + 1
                j = min(j, sent.num_rows)
                more = np.flatnonzero(key[j:] != key[j - 1])
                end = j + int(more[0]) if len(more) else sent.num_rows
                held.append(sent.slice(i, end - i))
                windows_held += int(total[end - 1] - (total[i - 1] if i else 0))
                if len(more) and windows_held >= WINDOWS:
                    yield found(pa.Table.from_batches(held))
                    held, windows_held = [], 0
                elif windows_held >= WINDOWS:  # the key may go on in the next batch
                    same = np.flatnonzero(key[i:end] != key[end - 1])
                    if len(same):
                        stop = i + int(same[-1]) + 1
                        held[-1] = sent.slice(i, stop - i)
                        yield found(pa.Table.from_batches(held))
                        held, windows_held = [sent.slice(stop, end - stop)], int(total[end - 1] - total[stop - 1])
                i = end
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def _merged(found) -> list[list[int]]:
    """Maximal runs."""
    out: list = []
    for a, b in sorted(found or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _rest(data: bytes, spans: list[list[int]]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(data)], strict=True))


def _spans(rows: pa.Table, runs: pa.Table) -> list[list[list[int]]]:
    """Removed byte ranges of each row of a block."""
    found: dict = {}
    for doc, part, a, b in zip(*(runs[c].to_pylist() for c in ("doc_id", "part", "start", "end")), strict=True):
        if doc is not None:
            found.setdefault((doc, part), []).append((a, b))
    return [_merged(found.get(x)) for x in zip(rows["quarry:doc"].to_pylist(), rows["quarry:part"].to_pylist(), strict=True)]


def _finish(folder: str):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]

    def run(key, runs):
        rows, out = _read_block(folder, int(key[0].as_py())), []
        for doc, text, spans in zip(rows["quarry:doc"].to_pylist(), rows["text"].to_pylist(), _spans(rows, runs), strict=True):
            data = (text or "").encode()
            rest = _rest(data, spans)
            out.append((doc, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _rewrite(folder: str, names: list[str]):
    def run(key, runs):
        rows = _read_block(folder, int(key[0].as_py()))
        text = [x if not spans else _rest(x.encode(), spans).decode("utf-8", "ignore") for x, spans in zip(rows["text"].to_pylist(), _spans(rows, runs), strict=True)]
        cols = {n: rows[n] for n in names}
        cols["text"] = pa.array(text, pa.string())
        if "n_chars" in names:
            cols["n_chars"] = pa.array([x if t is None else len(t) for t, x in zip(text, rows["n_chars"].to_pylist(), strict=True)], rows["n_chars"].type)
        return pa.table(cols)

    return run


def repeated_runs(docs: DataFrame, folder: str, length: int = 100, hot_over: int = HOT) -> DataFrame:
    """documents -> (block, doc_id, part, start, end): byte ranges that repeated strings cover, and one row without a range for each block written to folder."""
    spark = docs.sparkSession
    ship(spark)
    parts = partitions(spark)
    rows = docs.withColumns({"quarry:doc": F.col("doc_id").cast("long"), "quarry:part": F.xxhash64("text")})
    anchors = rows.mapInArrow(_blocks(folder, docs.columns.index("text"), length), "h long, block long, docs long, many boolean")
    twice = stored(anchors.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_repeated(hot_over), "h long, block long, hot boolean"), "anchors")
    sent = twice.where("hot is not null").repartition(parts, "block").groupBy("block").applyInArrow(_surroundings(folder, length), SENT)
    found = sent.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "part", "start").mapInArrow(_refined(length), "block long, doc_id long, part long, start long, end long")
    none = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "part", "start", "end")]
    return stored(found, "repeats").unionByName(twice.where("hot is null").select("block", *none)).repartition(parts, "block")


def suffix_dedup(docs: DataFrame, length: int = 100, hot_over: int = HOT) -> DataFrame:
    """documents -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row per row of docs. spans: removed byte ranges."""
    folder = fresh_path(docs.sparkSession, "texts")
    runs = repeated_runs(docs.select("doc_id", "text"), folder, length, hot_over)
    return runs.groupBy("block").applyInArrow(_finish(folder), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def rewritten(docs: DataFrame, length: int = 100) -> DataFrame:
    """The rows of docs, all columns, with text less its repeated runs (a character that loses a byte goes) and n_chars to match."""
    folder = fresh_path(docs.sparkSession, "texts")
    return repeated_runs(docs, folder, length).groupBy("block").applyInArrow(_rewrite(folder, docs.columns), docs.schema)
