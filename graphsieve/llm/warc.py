"""WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import math
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, batched, parts_of, small, table

CRLF = b"\r\n"
DATE = "2000-01-01T00:00:00Z"
BLOCK_LINES = 512
FILE_BYTES = 1 << 30
ENTRY = ("key", "file", "offset", "length")


def capture_key(url: str | None, page_id: int | None) -> str:
    """The URL with its host reversed (``com,example,www)/path``), then the page: keys of one URL stay together and apart."""
    return f"{surt(url)} {'-' if page_id is None else f'{page_id:020d}'}"


def surt(url: str | None) -> str:
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, path = (parts.hostname or "").lower(), (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        return "!" + "".join(url.split())
    return ",".join(reversed(host.split("."))) + ")" + "".join(path.split())


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.blake2b(f'{page_id}/{digest}/{copy}'.encode(), digest_size=16).digest())}>"


def encode(url: str | None, page_id: int | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record as a gzip member of its own.  A revisit has the response's HTTP header, with the full length, and no payload."""
    digest = digest_of(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest, int(revisit))),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else json.dumps(url)[1:-1]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("Refers-To-Page", None if refers_to is None or not revisit else str(refers_to)),
        ("Page", None if page_id is None else str(page_id)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}".encode() + CRLF for k, v in head if v is not None) + CRLF + block + CRLF + CRLF
    return gzip.compress(raw, 4, mtime=0)


def decode(member: bytes) -> dict:
    """The fields of a record; the payload's digest is made anew where there is a payload, and must agree."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    fields = dict(x.decode().split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != b"WARC/1.1" or rest[len(block) :] != CRLF + CRLF:
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(CRLF + CRLF)
    size = int(dict(x.split(b": ", 1) for x in http.split(CRLF)[1:])[b"Content-Length"])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and (digest_of(payload) != digest or len(payload) != size):
        raise ValueError("payload and digest differ")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("Page"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("Refers-To-Page"), "payload": None if revisit else payload}


def _roles(pages: DataFrame, min_bytes: int, work: Work) -> DataFrame:
    """pages with ``_first`` (the response's page_id), ``_revisit`` and ``_copies``, how many records a row stands for.

    Only payloads that occur twice or more meet others, as (digest, page_id) counts summed before
    they are shuffled; html moves only if those are too many to broadcast, and of rows that agree in page_id and payload
    with a response: those are counted by url, the least url's first is the response.
    """
    digest = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).alias("_digest")
    long_ = F.coalesce(F.octet_length("html"), F.lit(0)) >= min_bytes
    each = pages.filter(long_).groupBy(digest, "page_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("f")
    twice = each.groupBy("_digest").agg(first, F.sum("n").alias("all")).filter("all > 1").select("_digest", F.col("f.page_id").alias("_first"), F.col("f.n").alias("_ties"))
    twice = work.stage(twice, "twice")
    rows = pages.withColumn("_digest", digest).join(small(twice), "_digest", "left").withColumn("_lead", F.col("page_id").eqNullSafe(F.col("_first")))
    none = F.col("_ties").isNull() | ~long_
    tied = F.coalesce(F.col("_lead") & (F.col("_ties") > 1), F.lit(False)) & ~none
    names = ["page_id", "url", "html", "_first", "_revisit", "_copies"]
    plain = rows.withColumns({"_revisit": ~none & ~F.col("_lead"), "_copies": F.lit(1).cast("long")})
    if not twice.filter("_ties > 1").limit(1).count():
        return plain.select(names)
    same = rows.filter(tied).groupBy("_digest", "page_id", "url").agg(F.first("html").alias("html"), F.first("_first").alias("_first"), F.count("*").alias("_copies"))
    least = F.min(F.struct(F.col("url").isNotNull().alias("some"), "url")).alias("least")
    same = work.stage(same, "tied")
    tops = same.groupBy(F.col("_digest").alias("_d")).agg(least)
    lead = F.col("url").eqNullSafe(F.col("least.url"))
    return plain.filter(~tied).select(names).unionByName(same.join(tops, F.col("_digest") == F.col("_d")).withColumn("_revisit", ~lead).select(names))


class CaptureIndex:
    """Archives of pages and their index, in the shared folder.

    Records are gzip members in files of about FILE_BYTES, a task's own.  The index is sorted by
    capture_key and cut into shards by key range; a shard is a file of compressed blocks of
    BLOCK_LINES entries with a sparse directory, the first key and place of each block.  Shards and the blocks of a
    shard grow alike, with the square root of the captures, so neither the list of shards (their first keys, broadcast) nor a
    shard's directory grows beyond some ten thousand lines in any archive that could be stored.  A search
    bisects the shards' first keys, then a shard's directory, then a
    block, and reads a byte range of an archive.  Repeated rows are records of their own, of one page_id and payload
    the least url's first is the response; an empty table gives an empty index.  File names are unique to a task attempt, and only
    names that a finished attempt has given out are ever read.
    """

    def __init__(self, pages: DataFrame, min_bytes: int = 0, shards: int | None = None):
        """pages: page_id, url, html (null: empty payload).  Payloads of min_bytes or more that are equal share one response."""
        self.spark = pages.sparkSession
        batched(self.spark, 256)
        self.work = Work(self.spark, "warc")
        root = self.work.path
        _made(root)
        rows = _roles(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), min_bytes, self.work)
        entries = rows.mapInArrow(_writer(root), "key string, file string, offset long, length long")
        self.entries = self.work.stage(entries, "entries")
        n = shards or max(1, math.isqrt(self.entries.count() // BLOCK_LINES))
        ranged = self.entries.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
        tops = self.work.stage(ranged.mapInArrow(_packer(root), "first string, shard string"), "shards")
        self.tops = sorted((r["first"], r["shard"]) for r in tops.collect())

    def locate(self, keys: DataFrame) -> DataFrame:
        """(key, file, offset, length) of every capture of the keys (key), by the index."""
        ordered = keys.select("key").distinct().repartitionByRange(parts_of(self.spark), "key").sortWithinPartitions("key")
        return ordered.mapInArrow(_searcher(self.work.path, self.spark.sparkContext.broadcast(self.tops)), "key string, file string, offset long, length long")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(key, page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of every capture of the keys (key).

        Records are read in the order of the archives, each task a range of them.
        """
        placed = self.work.stage(self.locate(keys), f"located-{uuid.uuid4().hex}")
        read = placed.repartitionByRange(parts_of(self.spark), "file", "offset").sortWithinPartitions("file", "offset")
        return read.mapInArrow(_fetcher(self.work.path), "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _made(root: str) -> None:
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(f"{path}/archive", recursive=True)
    fs.create_dir(f"{path}/index", recursive=True)


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        out, name, at = None, "", 0
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for page_id, url, html, first, revisit in (x[:4] + (x[4] or k > 0,) for x in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "_first", "_revisit", "_copies")), strict=True) for k in range(x[5])):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/archive/{name}", compression=None, buffer_size=1 << 20)
                member = encode(url, page_id, (html or "").encode(), first, bool(revisit))
                out.write(member)
                for column, x in zip(rows, (capture_key(url, page_id), name, at, len(member)), strict=True):
                    column.append(x)
                at += len(member)
            yield pa.record_batch(dict(zip(ENTRY, (pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)), strict=True)))
        if out is not None:
            out.close()

    return write


def _packer(root: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        lines: list[str] = []
        keys: list[str] = []
        directory: list[tuple[str, int, int]] = []
        shard, at, out = "", 0, None

        def flush() -> None:
            nonlocal shard, at, out
            if out is None:
                shard = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{base}/index/{shard}.idx", compression=None, buffer_size=1 << 20)
            block = zlib.compress("\n".join(lines).encode(), 6)
            out.write(block)
            directory.append((keys[0], at, len(block)))
            at += len(block)
            lines.clear(), keys.clear()

        for batch in batches:
            for entry in zip(*(batch[c].to_pylist() for c in ENTRY), strict=True):
                keys.append(entry[0])
                lines.append(json.dumps(entry))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{base}/index/{shard}.dir", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.record_batch({"first": pa.array([directory[0][0]]), "shard": pa.array([shard])})

    return pack


class _Files:
    """Open files and decoded blocks under a folder, the last 48 of them."""

    def __init__(self, root: str):
        self.fs, self.base = pafs.FileSystem.from_uri(root)
        self.held: OrderedDict[str, object] = OrderedDict()

    def cached(self, name: str, make):
        if name not in self.held:
            self.held[name] = make()
            while len(self.held) > 48:
                _, old = self.held.popitem(last=False)
                if hasattr(old, "close"):
                    old.close()
        self.held.move_to_end(name)
        return self.held[name]

    def span(self, name: str, offset: int, length: int) -> bytes:
        return self.cached(name, lambda: self.fs.open_input_file(f"{self.base}/{name}")).read_at(length, offset)


def _fetcher(root: str):
    kind = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(root)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist([{"key": e["key"]} | decode(files.span(f"archive/{e['file']}", e["offset"], e["length"])) for e in batch.to_pylist()], schema=kind)

    return fetch


def _searcher(root: str, known):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, tops = _Files(root), known.value
        cached, span, fs, base = files.cached, files.span, files.fs, files.base
        firsts = [x[0] for x in tops]

        def directory(shard: str) -> list:
            def load():
                with fs.open_input_file(f"{base}/index/{shard}.dir") as f:
                    return json.loads(zlib.decompress(f.read()))

            return cached(f"{shard}.dir", load)

        def block(shard: str, k: int) -> list:
            _, offset, length = directory(shard)[k]
            return cached(f"{shard}/{k}", lambda: [json.loads(x) for x in zlib.decompress(span(f"index/{shard}.idx", offset, length)).decode().split("\n")])

        def captures(key: str) -> Iterator[list]:
            # the last shard, and in it the last block, that begins before the key; equal keys may run on
            s = max(0, bisect.bisect_left(firsts, key) - 1)
            k = max(0, bisect.bisect_left(directory(tops[s][1]), key, key=lambda x: x[0]) - 1) if tops else 0
            while s < len(tops):
                blocks = directory(tops[s][1])
                while k < len(blocks):
                    if blocks[k][0] > key:
                        return
                    entries = block(tops[s][1], k)
                    i = bisect.bisect_left(entries, key, key=lambda e: e[0])
                    while i < len(entries) and entries[i][0] == key:
                        yield entries[i]
                        i += 1
                    if i < len(entries):
                        return
                    k += 1
                s, k = s + 1, 0

        for batch in batches:
            rows = [e for key in batch["key"].to_pylist() for e in captures(key)]
            if rows:
                yield pa.record_batch({name: pa.array([e[k] for e in rows], kind) for k, (name, kind) in enumerate(zip(ENTRY, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))})

    return search


def capture_keys(pages: DataFrame) -> DataFrame:
    """(key) of pages (page_id, url)."""
    batched(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"key": pa.array([capture_key(u, p) for u, p in zip(batch["url"].to_pylist(), batch["page_id"].to_pylist(), strict=True)], pa.string())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, "key string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, found again over the index and read from the archives; a row of pages is a row of the result."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = CaptureIndex(pages)
    return index.lookup(capture_keys(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
