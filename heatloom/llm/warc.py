"""WARC archives in seekable Zstandard bundles.

A bundle is one file: independent Zstandard frames, each of some whole WARC records, then a skippable frame with the seek
table (the public seekable format: compressed and decompressed size of every frame, then a footer). With a bundle goes an
index of record identifier, frame number, and the record's offset and length in the decompressed frame, so a record is read
by decompressing one frame.

A bundle is a row (bundle_id, data, index) of a Parquet table: Spark's writers commit it or not as a whole, on any store.
`save_bundles` writes the same bytes as files where a plain folder is wanted.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import save

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
BUNDLES = "bundle_id string, data binary, index array<struct<record_id string, frame int, offset long, length long>>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: four letters for each five hex digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


#: The first 48 bits of record ids.
NAMESPACE = 0x68656174_6C6F


def record_name(page_id: int | None) -> str:
    """A UUID of version 8 that holds the page id (64 bits, or none) in its free bits, so equal ids have equal names."""
    low = 0 if page_id is None else page_id & (2**64 - 1)
    middle = (low >> 62) | (0 if page_id is None else 4)
    return f"<urn:uuid:{uuid.UUID(int=NAMESPACE << 80 | 8 << 76 | middle << 64 | 2 << 62 | low & (2**62 - 1))}>"


def page_of(name: str) -> int | None:
    whole = uuid.UUID(name[len("<urn:uuid:") : -1]).int
    if not whole >> 66 & 1:
        return None
    low = (whole >> 64 & 3) << 62 | whole & (2**62 - 1)
    return low - 2**64 if low >> 63 else low


def target_uri(url: str) -> str:
    """The URL with white space and control characters percent-encoded, so that it fits on a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def warc_record(page_id: int | None, url: str | None, payload: bytes, payload_bytes: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, its block an HTTP response; a revisit's block ends after the HTTP header."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + target_uri(url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode() + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])}


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields and HTTP fields by lower-case name, and the payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame for frames of these (compressed, decompressed) sizes."""
    entries = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries)) + entries


def frame_starts(data: bytes) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame, from the footer of a bundle."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    found, start = [], 0
    for i in range(count):
        size = struct.unpack_from("<I", data, len(data) - 9 - 8 * (count - i))[0]
        found.append((start, size))
        start += size
    return found


def read_record(data: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record of a bundle, by its place in the index."""
    start, size = frame_starts(data)[frame]
    return zstandard.ZstdDecompressor().decompressobj().decompress(data[start : start + size])[offset : offset + length]


class _Bundle:
    def __init__(self) -> None:
        self.packer, self.frames, self.sizes, self.index, self.bytes = zstandard.ZstdCompressor(level=3), [], [], [], 0
        self.open: list[bytes] = []
        self.open_bytes = 0

    def add(self, name: str, record: bytes) -> None:
        self.index.append((name, len(self.frames), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_bytes))
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def row(self, bundle_id: str) -> pd.DataFrame:
        self.close_frame()
        names = ("record_id", "frame", "offset", "length")
        return pd.DataFrame({"bundle_id": [bundle_id], "data": [b"".join(self.frames) + seek_table(self.sizes)], "index": [[dict(zip(names, x, strict=True)) for x in self.index]]})


def _write(date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, bundle, n = TaskContext.get().partitionId(), _Bundle(), 0
        for batch in batches:
            columns = [batch[c].astype("Int64") for c in ("page_id", "payload_bytes", "refers_to")]
            for page_id, size, refers_to, url, payload, digest in zip(*columns, batch["url"], batch["payload"], batch["digest"], strict=True):
                page_id, refers_to = (None if x is pd.NA else int(x) for x in (page_id, refers_to))
                bundle.add(record_name(page_id), warc_record(page_id, url, bytes(payload), int(size), digest, refers_to, date))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield bundle.row(f"{task:06d}-{n:06d}")
                    bundle, n = _Bundle(), n + 1
        if bundle.index:
            yield bundle.row(f"{task:06d}-{n:06d}")

    return run


def write_bundles(pages: DataFrame, min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Bundles with a record for each row of pages (page_id, url, html); date (ISO 8601, UTC) is when the pages were fetched,
    by default now.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of min_bytes or more the largest page_id is the
    response and the others are revisits of it; smaller ones are responses. A repeated page_id with an equal payload is a
    response each time; a null page_id is a revisit where another page has the payload. Further columns are ignored, and an
    empty table gives no bundles.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    slim = rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", "digest")
    shared = save(slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-shared")
    revisits = slim.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "refers_to", F.col("digest").alias("_digest")).distinct()
    revisits = save(revisits.withColumnRenamed("page_id", "_page"), "warc-revisits")
    same = rows["page_id"].eqNullSafe(revisits["_page"]) & (rows["digest"] == revisits["_digest"])
    rows = rows.join(revisits, same, "left").drop("_page", "_digest")
    kept = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    return rows.select("page_id", "url", kept.alias("payload"), "payload_bytes", "digest", "refers_to").mapInPandas(_write(date), BUNDLES)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for data, index in zip(batch["data"], batch["index"], strict=True):
            data, rows, frame = bytes(data), [], b""
            starts, at = frame_starts(data), -1
            for x in index:
                if x["frame"] != at:
                    at = x["frame"]
                    start, size = starts[at]
                    frame = unpack.decompressobj().decompress(data[start : start + size])
                fields, http, content = parse_record(frame[x["offset"] : x["offset"] + x["length"]])
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-record-id"] != x["record_id"] or kind == "response" and base64.b32encode(hashlib.sha1(content).digest()).decode() != digest:
                    raise ValueError(f"damaged record {x['record_id']}")
                refers_to = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                rows.append((page_of(x["record_id"]), int(http["content-length"]), digest, kind, refers_to))
            found = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield found.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, found through index and seek table, its payload checked against its digest."""
    return bundles.select("data", "index").mapInPandas(_read, RECORDS)


def record_index(bundles: DataFrame) -> DataFrame:
    """Where each record is: record_id, bundle_id, frame, offset, length."""
    return bundles.select("bundle_id", F.explode("index").alias("x")).select("x.record_id", "bundle_id", "x.frame", "x.offset", "x.length")


def save_bundles(bundles: DataFrame, folder: str) -> None:
    """Each bundle as <folder>/<bundle_id>.warc.zst, for a folder that every executor has mounted."""

    def put(rows) -> None:
        import os

        for r in rows:
            part = os.path.join(folder, f".{r.bundle_id}.{TaskContext.get().taskAttemptId()}")
            with open(part, "wb") as f:
                f.write(bytes(r.data))
            os.replace(part, os.path.join(folder, f"{r.bundle_id}.warc.zst"))

    bundles.select("bundle_id", "data").foreachPartition(put)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC bundles and read back; null ids, urls and pages and repeated rows as in `write_bundles`."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_bundles(save(write_bundles(pages), "warc-bundles"))


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT unnest(range(8)) AS i),
b AS (
  SELECT page_id, html, hex, (SELECT string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // 32768) % 32 + 1 AS INT), 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // 1024) % 32 + 1 AS INT), 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // 32) % 32 + 1 AS INT), 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v % 32 + 1 AS INT), 1), '' ORDER BY i)
    FROM (SELECT i, CAST('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5) AS BIGINT) AS v FROM g)) AS payload_digest
  FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last_id FROM b)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM m
"""
