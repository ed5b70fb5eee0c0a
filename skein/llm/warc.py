"""Operator 9: WARC archives, one gzip member a record, written and read in sequence.

Of records with equal payloads of at least ``least`` bytes, that with the largest
page_id keeps the payload (``response``); the others refer to it (``revisit``).
The reader inflates a member in pieces of 64 kB, takes headers and block by their
lengths, and compares block and payload digests; a damaged record is an error.
Records are written in units of ``UNIT`` bytes, or of one record that is longer, and a file has
``PER_FILE`` units at most, so that a task never holds a large file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import rawfiles
from skein.llm.common import fresh_path, table, written

UNIT, PER_FILE = 4 << 20, 8
BROADCAST_OWNERS = 500_000
PIECE = 1 << 16
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def classified(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, html, bytes, digest, owner): owner is the page that a revisit refers to, else null.
    Digests alone are grouped; bodies move only where more payloads repeat than can be broadcast."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    base = base.select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha1("html").alias("digest"))
    owners = base.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    owners = owners.where("n > 1 and owner is not null").select(F.col("digest").alias("of_digest"), F.col("bytes").alias("of_bytes"), "owner")
    owners = written(owners, "owners")
    owners = F.broadcast(owners) if owners.count() <= BROADCAST_OWNERS else owners
    joined = base.join(owners, (base["digest"] == owners["of_digest"]) & (base["bytes"] == owners["of_bytes"]), "left")
    owner = F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    return joined.select("page_id", "url", F.when(owner.isNull(), F.col("html")).alias("html"), "bytes", "digest", owner.alias("owner"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id: int | None, url: str | None, html: bytes | None, size: int, digest: str, owner: int | None, date: str) -> bytes:
    """The record's gzip member."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (html or b"")
    fields = {
        "WARC-Type": "response" if owner is None else "revisit",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": date,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Block-Digest": _sha1(block),
        "X-Payload-Length": str(size),
    }
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if owner is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(owner, digest), "X-Refers-To-Page-Id": str(owner)}
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields.items()), f"Content-Length: {len(block)}".encode()])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + END + block + END) + packer.flush()


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, checked."""
    view, at = memoryview(content), 0
    while at < len(view):
        if view[at] == 0:  # gzip readers skip zero bytes between members
            at += 1
            continue
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            parts.append(member.decompress(view[at : at + PIECE]))
            at += len(view[at : at + PIECE])
        at -= len(member.unused_data)
        record = b"".join(parts)
        head, found, rest = record.partition(END)
        lines = head.split(b"\r\n")
        if not found or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record ends at byte {at}")
        headers = dict(line.decode().split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        block = rest[:size]
        if rest[size:] != END:
            raise ValueError(f"a record's length is wrong at byte {at}")
        if headers.get("WARC-Block-Digest", _sha1(block)) != _sha1(block):
            raise ValueError(f"a block's digest is wrong at byte {at}")
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != _sha1(block.partition(END)[2]):
            raise ValueError(f"a payload's digest is wrong at byte {at}")
        yield headers, block


def write(pages: DataFrame, path: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archive ``pages`` (page_id, url, html) below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                held.append(make_record(*(c[k].as_py() for c in batch.columns), date))
                size += len(held[-1])
                if size >= UNIT:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["unit"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["unit"])

    rawfiles.write(classified(pages, least).mapInArrow(run, "unit binary"), "unit", path, PER_FILE)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record below ``path``: its page's columns, and with ``payloads`` the url and the stored payload."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", url string, payload binary" if payloads else ""
    names = [f.strip().split()[0] for f in schema.split(",")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def row(headers: dict[str, str], block: bytes) -> tuple:
        number = lambda name: int(headers[name]) if name in headers else None
        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        stored = block.partition(END)[2]
        size = number("X-Payload-Length") if headers["WARC-Type"] == "revisit" else len(stored)
        return number("X-Page-Id"), size, digest, headers["WARC-Type"], number("X-Refers-To-Page-Id"), headers.get("WARC-Target-URI"), stored

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in read_records(content.as_py()):
                    rows.append(row(headers, block)[: len(names)])
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return rawfiles.read(spark, path).select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Archive ``pages`` in the shared folder and return a row for each record read back.

    A null html counts as empty. A null page_id stays null and never owns a payload that
    a page with an id shares; among equal payloads without any id all are responses.
    Repeated rows of the owner are responses each. A null url is left out of its record; a very
    long page is one record. Other columns, whatever their names, are not
    looked at. An empty table gives no rows.
    """
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, least)
    return read(pages.sparkSession, path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, archived and read back."""
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h FROM p),
o AS (SELECT h, n, max(page_id) AS owner FROM d WHERE n >= 1000 GROUP BY h, n)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN o.owner <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.owner <> d.page_id THEN o.owner END AS refers_to
FROM d LEFT JOIN o ON d.h = o.h AND d.n = o.n
"""
