"""WARC archives, written index first and read back by coalesced byte ranges.

Every task writes archives of bounded size to the shared folder, one gzip member a
record, under a name of its own attempt; what it returns is the index: file, offset,
length, URL and digest of each record. Only the index of attempts that succeed counts,
so a lost executor leaves at most files that no index names. Reading selects index
rows, deals them by file, sorts them by offset and reads neighbouring ranges at once.

Of records with equal payloads of at least `least` bytes the one with the smallest id
is a response and the others are revisits of it, without payload; smaller payloads are
always responses. A null html counts as empty, as does its URL. A repeated id is
written once a row; if it is the smallest of its payload, all its rows are responses.
A null id is written as an empty one and read back as null; such a record is a revisit
where its payload has a page with an id, else a response. The digests that
several rows share are written first, so Spark knows their size and moves no payload
where they are few. An empty table gives no archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import folder, stage

LEAST = 100
#: Bytes after which a task begins another archive, of one read, and of a gap that is read rather than skipped.
ROLL, READ, GAP = 64 << 20, 4 << 20, 64 << 10
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_ZIP = 16 + zlib.MAX_WBITS
DATE = "2024-01-01T00:00:00Z"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record_bytes(page_id: int | None, url: str, digest: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; refers_to makes it a revisit, which names the payload and doesn't hold it."""
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(named["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where its length says")
    return named, rest[:n]


def _member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, _ZIP)
    return z.compress(data) + z.flush()


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    # only digests of several rows go on: a task keeps one row a digest before anything moves
    shared = own.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stage(shared, "warc-shared")
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("first") < F.col("page_id")))
    return own.join(shared, "digest", "left").withColumn("refers_to", F.when(later, F.col("first"))).drop("first")


def write_archives(pages: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """Write the archives below `path` (a new shared folder if None) and return their index, itself a written table."""
    spark = pages.sparkSession
    path = path or folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, below = _filesystem(path)
        system.create_dir(below, recursive=True)
        attempt, number, out, at = uuid.uuid4().hex, 0, None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None or at >= ROLL:
                    if out is not None:
                        out.close()
                    name, at, number = f"{attempt}-{number:05d}.warc.gz", 0, number + 1
                    out = system.open_output_stream(f"{below}/{name}", compression=None)
                data = _member(record_bytes(page_id, url, digest, html.encode(), refers_to))
                out.write(data)
                rows.append((page_id, url, f"{path}/{name}", at, len(data), digest, "response" if refers_to is None else "revisit"))
                at += len(data)
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "url", "file", "offset", "length", "payload_digest", "record_type"])
        if out is not None:
            out.close()

    return stage(decided(pages, least).mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the index rows name, checked against their digests. payloads=False leaves the payload null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] | None = None
        for batch in batches:
            files, offsets, lengths, urls = (batch.column(c).to_pylist() for c in ("file", "offset", "length", "url"))
            rows, i = [], 0
            while i < len(files):
                if opened is None or opened[0] != files[i]:
                    if opened is not None:
                        opened[1].close()
                    system, at = _filesystem(files[i])
                    opened = files[i], system.open_input_file(at)
                j, end = i + 1, offsets[i] + lengths[i]
                while j < len(files) and files[j] == files[i] and offsets[j] <= end + GAP and offsets[j] + lengths[j] - offsets[i] <= READ:
                    end, j = max(end, offsets[j] + lengths[j]), j + 1
                block = opened[1].read_at(end - offsets[i], offsets[i])
                for k in range(i, j):
                    a = offsets[k] - offsets[i]
                    rows.append(_row(io.BytesIO(block[a : a + lengths[k]]).getbuffer(), urls[k], payloads))
                i = j
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if opened is not None:
            opened[1].close()

    return index.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS)


def _id(urn: str) -> int | None:
    """The id in <urn:page:id>; null for an empty one."""
    own = urn.removeprefix("<urn:page:").rstrip(">")
    return int(own) if own else None


def _row(data: memoryview, url: str, payloads: bool) -> tuple:
    head, block = parse_record(zlib.decompress(data, _ZIP))
    own = _id(head["warc-record-id"])
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    if head["warc-type"] == "revisit":
        return own, url, int(head["warc-payload-length"]), digest, "revisit", _id(head["warc-refers-to"]), None
    if hashlib.sha256(block).hexdigest() != digest:
        raise ValueError(f"page {own}: the payload doesn't have its digest")
    return own, url, len(block), digest, "response", None, block if payloads else None
