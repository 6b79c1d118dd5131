"""WARC archives: one gzip member per record, written and read in sequence.

Pages with equal payloads share one response record, that of the largest page_id; the others are
written as revisits that refer to it and carry no payload.  An archive is a row of a table
(archive, content), a bounded run of whole gzip members, so Spark's readers and writers move
archives to and from any store.  The reader decompresses incrementally, member by member,
frames each record by its Content-Length and verifies its digests.

A null or empty html is an empty payload; a null url is written empty, and the characters of a url
that can't be printed, such as line ends, are percent-encoded.  Pages that repeat an id and a payload are all
responses if that id is the largest.  A null page_id is written without refers-to and is a
response only if no other page has its payload.  Payloads of any length are written whole: an
archive ends after the record that fills it.  An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import apart, map_arrow, record_batch, stored

ARCHIVE_BYTES = 4_000_000
LEVEL = 6
_VERSION = b"WARC/1.1"
_EPOCH = "2000-01-01T00:00:00Z"


class DigestError(ValueError):
    """A record's block or payload doesn't have the digest it states."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member."""
    head = b"".join([_VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in headers), f"Content-Length: {len(block)}\r\n\r\n".encode()])
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = f"sha1:{base32_sha1(payload)}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    safe = "".join(c if c.isprintable() else quote(c.encode("utf-8", "surrogatepass")) for c in (url or ""))
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", _EPOCH),
        ("WARC-Target-URI", safe),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
            ("X-Payload-Length", str(len(payload))),
        ]
    headers += [("WARC-Payload-Digest", digest), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return record(headers, block)


def members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The decompressed gzip members, one at a time, by incremental decompression."""
    at, view = 0, memoryview(content)
    while at < len(content):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(content):
                raise ValueError("the archive ends inside a gzip member")
            part = view[at : at + step]
            at += len(part)
            out.append(z.decompress(part))
        at -= len(z.unused_data)
        yield b"".join(out)


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, framed by its content length, with verified digests."""
    for data in members(content):
        head, mark, rest = data.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not mark or lines[0] != _VERSION:
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        block = rest[:n]
        if len(block) != n or rest[n:] != b"\r\n\r\n":
            raise ValueError("the record's length isn't its content length")
        if headers.get("warc-block-digest") not in (None, f"sha1:{base32_sha1(block)}"):
            raise DigestError(headers.get("warc-record-id", ""))
        if headers["warc-type"] == "response" and headers["warc-payload-digest"] != f"sha1:{base32_sha1(block.partition(b'\r\n\r\n')[2])}":
            raise DigestError(headers.get("warc-record-id", ""))
        yield headers, block


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the largest page_id of the same payload, null where that is the page's own.

    Only digests that occur twice come back to the pages; the pages' side of the join can be split.
    """
    base = pages.selectExpr(
        "CAST(page_id AS BIGINT) AS page_id",
        "CAST(url AS STRING) AS url",
        "coalesce(CAST(html AS STRING), '') AS html",
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = base.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(apart(F.col("digest"), "string").alias("digest"), "first")
    return base.join(first, "digest", "left").select(
        "page_id",
        "url",
        "html",
        F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): each row an archive of whole records."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, n, size = [], 0, 0
        base = TaskContext.get().partitionId() << 32
        row = lambda: record_batch({"archive": ([base + n], pa.int64()), "content": ([b"".join(own)], pa.binary())})
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (batch.column(k)[i].as_py() for k in range(4))
                own.append(page_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, refers_to is not None))
                size += len(own[-1])
                if size >= archive_bytes:
                    yield row()
                    own, n, size = [], n + 1, 0
        if own:
            yield row()

    return with_references(pages).mapInArrow(write, "archive long, content binary")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives, in the archives' order."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda s: int(x) if (x := s[len("<urn:page:") : -1]) else None
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in read_records(content.as_py()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    revisit = headers["warc-type"] == "revisit"
                    rows.append(
                        (
                            number(headers["warc-record-id"]),
                            headers["warc-target-uri"],
                            int(headers["x-payload-length"]) if revisit else len(payload),
                            headers["warc-payload-digest"].partition(":")[2],
                            headers["warc-type"],
                            number(headers["warc-refers-to"]) if revisit else None,
                            None if revisit else payload,
                        )
                    )
                i64, s = pa.int64(), pa.string()
                names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
                yield record_batch({c: ([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, (i64, s, i64, s, s, i64, pa.binary()))) if with_payload or c != "payload"})

    return archives.select("content").mapInArrow(read, schema)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back."""
    return read_archives(stored(write_archives(pages), "warc"), with_payload)
