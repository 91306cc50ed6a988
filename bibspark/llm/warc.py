"""WARC archives: writing pages, one gzip member for each record, and a sequential reader that verifies them.

A record is ``response`` (HTTP header block and payload) or ``revisit`` (header block alone, profile
identical-payload-digest, referring to the response that holds an equal payload).  Digests are SHA-1 in base32.
The reader decompresses incrementally, frames by Content-Length and checks both digests; a file that
is cut short, framed wrongly or altered raises ValueError with its name and the record's place.

Which record is the response of equal payloads is settled on (page id, digest) pairs alone, aggregated by digest
before they move; the pages themselves move once, by page id, so that a payload shared by a third of
all pages lands in no single task.

Defined cases: a null payload is empty; a null page id is never referred to and is always a response; repeated rows of the
smallest id are all responses; a null url is left out and reads back as null; an empty table writes no archive;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:x-page:(-?\d+|none)>")
_CHUNK = 1 << 18


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member of its own."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _record_id(page_id), "WARC-Date": date}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="%/:=&?~#+!$,;'@()*[]|")
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers_to)}
    else:
        block += payload
    fields |= {"WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "".join([f"{VERSION}\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join((packer.compress(head), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()))


@dataclass
class Record:
    page_id: int | None
    record_type: str
    target_uri: str | None
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    payload: bytes | None


def members(stream, name: str = "") -> Iterator[bytearray]:
    """The gzip members of a stream, each decompressed incrementally, chunk by chunk."""
    data, at = stream.read(_CHUNK), 0
    while data:
        unpacker, out = zlib.decompressobj(31), bytearray()
        while not unpacker.eof:
            if not data:
                raise ValueError(f"{name}: the member {at} is cut short")
            try:
                out += unpacker.decompress(data)
            except zlib.error as e:
                raise ValueError(f"{name}: the member {at} can't be decompressed: {e}") from None
            data = unpacker.unused_data if unpacker.eof else stream.read(_CHUNK)
        yield out
        at += 1
        data = data or stream.read(_CHUNK)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def _id(value: str | None) -> int | None:
    found = _ID.fullmatch(value or "")
    return int(found[1]) if found and found[1] != "none" else None


def records(stream, name: str = "") -> Iterator[Record]:
    """The records of an archive in order, each verified."""
    for at, member in enumerate(members(stream, name)):
        bad = lambda what, at=at: ValueError(f"{name}: record {at}: {what}")
        end = member.find(b"\r\n\r\n")
        if end < 0 or not member.startswith(b"WARC/"):
            raise bad("no header")
        fields = _fields(bytes(member[:end]))
        n = int(fields.get("content-length", -1))
        if n < 0 or len(member) != end + 4 + n + 4 or member[-4:] != b"\r\n\r\n":
            raise bad("its length isn't as stated")
        block = bytes(member[end + 4 : end + 4 + n])
        if f"sha1:{base32_sha1(block)}" != fields.get("warc-block-digest"):
            raise bad("its block has another digest")
        http, _, body = block.partition(b"\r\n\r\n")
        size, digest = int(_fields(http).get("content-length", -1)), fields.get("warc-payload-digest", "")
        kept = fields.get("warc-type") == "response"
        if kept and (len(body) != size or f"sha1:{base32_sha1(body)}" != digest):
            raise bad("its payload has another length or digest")
        yield Record(_id(fields.get("warc-record-id")), fields.get("warc-type", ""), fields.get("warc-target-uri"), size, digest.removeprefix("sha1:"), _id(fields.get("warc-refers-to")), body if kept else None)


def first_copies(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, first) of the pages that revisit an equal payload of at least ``min_bytes`` bytes."""
    narrow = pages.filter(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    return narrow.join(firsts, "digest").filter("page_id > first").dropDuplicates(["page_id", "digest"])


def write(pages: DataFrame, uri: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = 1 << 30) -> list[tuple[str, int]]:
    """Write archives of about ``archive_bytes`` at most below ``uri``; returns (name, records) of each."""
    # Spark's string columns are UTF-8 already, so the cast keeps their bytes.
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    rows = rows.join(first_copies(rows, min_bytes=min_bytes), ["page_id", "digest"], "left")

    def save(batches):
        done, n, size, name, opened, out = [], 0, 0, "", None, None
        for batch in batches:
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is not None and size >= archive_bytes:
                    opened.__exit__(None, None, None)
                    done.append((name, n))
                    out = None
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    opened = files.new_file(f"{uri}/{name}")
                    out = opened.__enter__()
                data = record(page_id, url, payload, first)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            opened.__exit__(None, None, None)
            done.append((name, n))
        yield pa.RecordBatch.from_pydict({"name": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64())})

    return [tuple(r) for r in rows.select("page_id", "url", "payload", "first").mapInArrow(save, "name string, records long").collect()]


def read(spark: SparkSession, uri: str, names: list[str], *, payloads: bool = True) -> DataFrame:
    """The records of these archives, each file read in sequence by one task."""
    kinds = {"page_id": pa.int64(), "record_type": pa.string(), "target_uri": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = files.open_fs(f"{uri}/{name}")
                with system.open_input_stream(path, compression=None) as stream:
                    rows: list[Record] = []
                    size = 0
                    for r in records(stream, name):
                        rows.append(r)
                        size += len(r.payload or b"")
                        if len(rows) >= 5000 or size > 16 << 20:
                            yield _rows(rows, kinds)
                            rows, size = [], 0
                    yield _rows(rows, kinds)

    archives = spark.createDataFrame([(n,) for n in names], "name string")
    return archives.repartition(max(1, len(names))).mapInArrow(run, "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads)


def _rows(rows: list[Record], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([getattr(r, k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))
