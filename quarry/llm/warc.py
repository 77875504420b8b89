"""WARC archives with a two-level capture index.

Writing. Equal payloads (SHA-1 and length) of at least LEAST bytes keep one response, that of the largest page_id; the
others are revisit records that refer to it. The choice is one grouped maximum joined back, so a payload that a third of
all pages share is pre-aggregated and its join partition may be split. Tasks write archives of gzip members, one a record.

Index. Entries (reversed-host key, page_id, archive, offset, length) are range-partitioned and sorted; each shard writes
blocks of BLOCK lines as gzip members; the sparse directory has the first key of each block. A lookup binary-searches the
directory, reads one block by range, binary-searches it, and reads the record by range.

Defined cases: null html is an empty payload; null or malformed URLs have the key "" or what can be parsed; null page_ids
are archived, never chosen as a response that others refer to while another page has the payload, and revisit like others;
repeated rows with the largest page_id are all responses; extra columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, partitions, ship, stored
from .files import read_ranges, write_file

LEAST, ARCHIVE, BLOCK = 1000, 64 << 20, 2000
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query: com,example,www)/path?query, in lower-case host."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return (url or "").strip()
    if not host:
        return (url or "").strip()
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _name(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record, not compressed. A revisit holds the HTTP header alone, with the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers (lower-case names), HTTP headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return {"fields": fields, "http": inner, "payload": payload}


def _page(value: str | None):
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _archive(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts, size, raw, rows = TaskContext.get().partitionId(), [], 0, 0, []

        def flush():
            uri = f"{folder}/pages-{task:06d}-{uuid.uuid4().hex}.warc.gz"
            write_file(uri, b"".join(parts))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array([uri] * len(rows)), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["key", "page_id", "uri", "offset", "length"])

        for batch in batches:
            page, url, html, digest, refers = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                payload = (html[i].as_py() or "").encode()
                plain = record(page[i].as_py(), url[i].as_py(), payload, digest[i].as_py(), refers[i].as_py(), date)
                data = gzip.compress(plain, 5, mtime=0)
                rows.append((url_key(url[i].as_py()), page[i].as_py(), size, len(data)))
                parts.append(data)
                size, raw = size + len(data), raw + len(plain)
                if size >= ARCHIVE:
                    yield flush()
                    parts, size, raw, rows = [], 0, 0, []
        if rows:
            yield flush()

    return run


def _blocks(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        uri = f"{folder}/index-{task:06d}-{uuid.uuid4().hex}.cdx.gz"
        blocks, held, firsts = [], [], []

        def close():
            blocks.append(gzip.compress("\n".join("\t".join(x) for x in held).encode(), 6, mtime=0))
            firsts.append((held[0][0], len(held)))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append([str(x if x is not None else "").replace("\t", "%09").replace("\n", "%0A") for x in row])
                if len(held) == most:
                    close()
                    held = []
        if held:
            close()
        if blocks:
            write_file(uri, b"".join(blocks))
            size = [len(b) for b in blocks]
            start = np.cumsum(size) - size
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in firsts]), pa.array([task] * len(size), pa.int32()), pa.array(np.arange(len(size), dtype=np.int64)), pa.array([uri] * len(size)), pa.array(start.astype(np.int64)), pa.array(size, pa.int64()), pa.array([f[1] for f in firsts], pa.int64())], ["first_key", "shard", "block", "uri", "offset", "length", "lines"])

    return run


def _lines(data: bytes) -> list[tuple]:
    out = []
    for line in zlib.decompress(data, 31).decode().split("\n"):
        key, page, uri, offset, length = line.split("\t")
        out.append((key, int(page) if page else None, uri, int(offset), int(length)))
    return out


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", block: int = BLOCK) -> DataFrame:
    """Writes archives and index; returns the sparse block directory (first_key, shard, block, uri, offset, length, lines), stored."""
    spark = pages.sparkSession
    ship(spark)
    folder = fresh_path(spark, "warc")
    text = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text.alias("html"), F.sha1(text).alias("digest"), F.octet_length(text).cast("long").alias("n"))
    best = rows.where(F.col("n") >= LEAST).groupBy("digest", "n").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1 and response is not null").drop("copies")
    # small payloads never revisit: each has a key of its own, so that the many equal ones (empty pages) do not meet
    best, own = best.withColumnRenamed("digest", "match"), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    typed = rows.withColumn("match", F.when(F.col("n") >= LEAST, F.col("digest")).otherwise(own)).join(best, ["match", "n"], "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))
    entries = stored(typed.mapInArrow(_archive(folder, date), "key string, page_id long, uri string, offset long, length long"), "captures")
    order = entries.repartitionByRange(partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id")
    return stored(order.mapInArrow(_blocks(folder, block), "first_key string, shard int, block long, uri string, offset long, length long, lines long"), "directory")


def _read_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            (data,) = read_ranges(uri, [(offset, length)])
            cols = list(zip(*_lines(data), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "uri", "offset", "length"])


def _describe(page_url_data: tuple) -> tuple:
    import hashlib

    got = parse(zlib.decompress(page_url_data, 31))
    f = got["fields"]
    kind = f["warc-type"]
    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and hashlib.sha1(got["payload"]).hexdigest() != digest:
        raise ValueError(f"payload of {f['warc-record-id']} doesn't match its digest")
    size = len(got["payload"]) if kind == "response" else int(got["http"]["content-length"])
    return _page(f["warc-record-id"]), f.get("warc-target-uri"), size, digest, kind, _page(f.get("warc-refers-to"))


def _read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        uri, offset, length = (batch.column(i).to_pylist() for i in range(3))
        cut = [i for i in range(len(uri)) if not i or uri[i] != uri[i - 1]] + [len(uri)]
        for a, b in zip(cut, cut[1:], strict=False):
            rows = [_describe(data) for data in read_ranges(uri[a], zip(offset[a:b], length[a:b], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(directory: DataFrame) -> DataFrame:
    """Reads every record back through the index: directory -> blocks -> range reads in order of archive and offset."""
    spark = directory.sparkSession
    ship(spark)
    entries = directory.select("uri", "offset", "length").repartition(partitions(spark, 24)).mapInArrow(_read_index, "key string, page_id long, uri string, offset long, length long")
    # about 4 MB of one archive to a task, so that a large archive is several tasks
    place = entries.repartition(partitions(spark), "uri", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("uri", "offset")
    return place.select("uri", "offset", "length").mapInArrow(_read_records, RECORD)


class Index:
    """Lookups of single URLs. It holds a block in STEP of each shard of the directory; the blocks between are read when asked for."""

    def __init__(self, directory: DataFrame, step: int = 256):
        self.directory = directory
        self.rows = directory.where(F.col("block") % step == 0).orderBy("shard", "block").select("first_key", "shard", "block").collect()
        self.first = [r[0] for r in self.rows]

    def _blocks(self, key: str) -> list:
        """Blocks that may hold the key, in order: by binary search over the sparse keys, then over those of one stretch."""
        lo, hi = max(0, bisect.bisect_left(self.first, key) - 1), bisect.bisect_right(self.first, key)
        if not self.rows:
            return []
        first, after = self.rows[lo], self.rows[hi] if hi < len(self.rows) else None
        stretch = self.directory.where((F.col("shard") > first["shard"]) | (F.col("shard") == first["shard"]) & (F.col("block") >= first["block"]))
        if after:
            stretch = stretch.where((F.col("shard") < after["shard"]) | (F.col("shard") == after["shard"]) & (F.col("block") < after["block"]))
        rows = stretch.where(F.col("first_key") <= key).orderBy("shard", "block").select("first_key", "uri", "offset", "length").collect()
        return rows[max(0, bisect.bisect_left([r[0] for r in rows], key) - 1) :]

    def lookup(self, url: str) -> list[dict]:
        """Records of a URL, in order of page_id."""
        key, out = url_key(url), []
        for block in self._blocks(key):
            (data,) = read_ranges(block["uri"], [(block["offset"], block["length"])])
            lines = _lines(data)
            i = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while i < len(lines) and lines[i][0] == key:
                (got,) = read_ranges(lines[i][2], [lines[i][3:5]])
                out.append(parse(zlib.decompress(got, 31)))
                i += 1
        return out
