"""WARC archives: written as one gzip stream each, normalised to one member per record.

A monolithic archive is a single gzip stream around all its records, so no record can be
read without all before it. The normaliser inflates each stream once, piece by piece, and
writes every record as a gzip member of its own, with a sidecar index of offsets and
lengths; a record is then read by inflating its member alone. Archives are rows with binary
content, so any store which Spark can reach holds them, and tasks work on one at a time.

Records with equal payloads are written once: the others are revisit records, which carry
the HTTP headers and the payload digest but no payload.

Defined results. NULL html is an empty payload. Of equal payloads of ``min_revisit`` bytes
or more, rows with the smallest page number are responses (several when this row repeats);
rows with a NULL number revisit them like all others. If all numbers are NULL, all are
responses. Damaged gzip streams, records that end early and wrong digests raise an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from ..session import stage

# Digests that occur more than once are broadcast up to this count (about 100 bytes each).
MAX_BROADCAST_DIGESTS = 300_000


@dataclass(frozen=True)
class WarcConfig:
    """Bytes of records after which an archive is closed, smallest revisited payload."""

    archive_bytes: int = 8 << 20
    piece_bytes: int = 1 << 16
    min_revisit: int = 100
    level: int = 1


ARCHIVES = "archive string, content binary"
NORMAL = "archive string, content binary, index array<struct<record_id:string,position:long,length:long>>"


# ------------------------------------------------------------------- records


def format_record(url: str, number: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{number}>",
        f"WARC-Target-URI: {''.join(url.split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head.insert(2, f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode().split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def page_number(value: str) -> str:
    return value.removeprefix("<urn:page:").removesuffix(">")


def parse_record(raw: bytes) -> dict:
    """A record's page number, type, reference, URL, and the size and digest of its full payload."""
    end = raw.index(b"\r\n\r\n")
    head = headers(raw[:end])
    block = raw[end + 4 : end + 4 + int(head["content-length"])]
    cut = block.index(b"\r\n\r\n")
    size, body = int(headers(block[:cut])["content-length"]), block[cut + 4 :]
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    kind = head["warc-type"]
    if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"payload of {head['warc-record-id']} does not fit its digest")
    return {
        "page": page_number(head["warc-record-id"]),
        "url": head["warc-target-uri"],
        "record_type": kind,
        "refers": page_number(head["warc-refers-to"]) if kind == "revisit" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": body if kind == "response" else None,
    }


def records_of(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from pieces of inflated bytes."""
    pending = bytearray()
    need = None
    for piece in stream:
        pending += piece
        while True:
            if need is None:
                end = pending.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 8 + int(headers(bytes(pending[:end]))["content-length"])
            if len(pending) < need:
                break
            yield bytes(pending[:need])
            del pending[:need]
            need = None
    if pending:
        raise ValueError("archive ends within a record")


def inflate(content: bytes, piece: int) -> Iterator[bytes]:
    """One pass over a gzip file, whatever its number of members, in bounded pieces."""
    view, at = memoryview(content), 0
    machine = zlib.decompressobj(31)
    rest = b""
    while rest or at < len(view):
        if not rest:
            rest, at = view[at : at + piece], at + piece
        yield machine.decompress(rest, 16 * piece)
        rest = machine.unconsumed_tail
        if machine.eof:
            rest = machine.unused_data
            if rest or at < len(view):
                machine = zlib.decompressobj(31)
    if not machine.eof:  # what the limit on the last piece held back
        yield machine.flush()
    if not machine.eof:
        raise ValueError("gzip stream ends early")


def gzip_member(raw: bytes, level: int) -> bytes:
    machine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return machine.compress(raw) + machine.flush()


# ------------------------------------------------------------------- Spark


def with_references(pages: DataFrame, cfg: WarcConfig, key: str, url: str, html: str) -> DataFrame:
    """Number, URL, html, digest, and the number of the page whose record is revisited."""
    rows = pages.select(
        F.col(key).alias("_page"),
        F.coalesce(F.col(url), F.lit("")).alias("_url"),
        F.coalesce(F.col(html), F.lit("")).alias("_html"),
    ).withColumn("_digest", F.sha2("_html", 256))
    large = rows.where(F.octet_length("_html") >= cfg.min_revisit)
    first = large.groupBy("_digest").agg(F.min("_page").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = stage(first.where("_n > 1 AND _first IS NOT NULL").drop("_n"), "first-payloads")
    if first.count() <= MAX_BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(first), "_digest", "left")
    else:
        rows = salted_join(rows, first, ["_digest"], "_page", "left")
    refers = F.when(F.col("_page").isNull() | (F.col("_page") != F.col("_first")), F.col("_first"))
    return rows.select(
        F.coalesce(F.col("_page").cast("string"), F.lit("")).alias("page"),
        F.col("_url").alias("url"),
        F.col("_html").alias("html"),
        F.col("_digest").alias("digest"),
        refers.cast("string").alias("refers"),
    )


def write_archives(
    pages: DataFrame, cfg: WarcConfig = WarcConfig(), key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Archives with a record per page, each archive one gzip stream."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        machine, out = zlib.compressobj(cfg.level, zlib.DEFLATED, 31), []

        def close() -> pa.RecordBatch:
            content = b"".join([*out, machine.flush()])
            return pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{number:06d}.warc.gz"], "content": [content]})

        for batch in batches:
            columns = [batch.column(c) for c in ("url", "page", "html", "digest", "refers")]
            for i in range(batch.num_rows):
                link, page, body, digest, refers = (c[i].as_py() for c in columns)
                record = format_record(link, page, body.encode(), digest, refers)
                out.append(machine.compress(record))
                size += len(record)
                if size >= cfg.archive_bytes:
                    yield close()
                    number, size = number + 1, 0
                    machine, out = zlib.compressobj(cfg.level, zlib.DEFLATED, 31), []
        if size:
            yield close()

    return with_references(pages, cfg, key, url, html).mapInArrow(write, ARCHIVES)


def normalise(archives: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Each archive with one gzip member per record, and the index of its members."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("position", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for i in range(batch.num_rows):
                members, index, at = [], [], 0
                for record in records_of(inflate(batch.column("content")[i].as_py(), cfg.piece_bytes)):
                    member = gzip_member(record, cfg.level)
                    name = headers(record[: record.index(b"\r\n\r\n")])["warc-record-id"]
                    index.append({"record_id": name, "position": at, "length": len(member)})
                    members.append(member)
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("archive").slice(i, 1), pa.array([b"".join(members)], pa.binary()), pa.array([index], kind)],
                    names=["archive", "content", "index"],
                )

    return archives.select("archive", "content").mapInArrow(rewrite, NORMAL)


RECORDS = (
    "archive string, position long, length long, page string, url string, record_type string, refers string, "
    "payload_bytes long, payload_digest string"
)


def read_records(normal: DataFrame, payload: bool = True) -> DataFrame:
    """One row per record, found by the index and inflated by itself; the payload on demand."""
    names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(zip(names, [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]))
        for batch in batches:
            for row in range(batch.num_rows):
                archive, content, index = (batch.column(c)[row].as_py() for c in ("archive", "content", "index"))
                found = []
                for entry in index:
                    at, n = entry["position"], entry["length"]
                    found.append({"archive": archive, "position": at, "length": n, **parse_record(zlib.decompress(content[at : at + n], 31))})
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], kinds[c]) for c in names], names=names)

    return normal.select("archive", "content", "index").mapInArrow(read, RECORDS + ", payload binary" * payload)
