"""Legacy archive converter: ARC records to WARC records, and archives of either kind written and read through Spark.

An ARC file begins with a version block whose header lines depend on its version: version 1 describes a record by
URL, IP address, date, type and length; version 2 adds result code, checksum, location, offset and file name. A record
is a header line and as many bytes as it declares. `parse_arc` follows these lines and declared lengths only, never the
payload's own bytes; `to_warc` synthesises what WARC asks for and ARC lacks: a record identifier (an RFC 9562 UUID
whose last 62 bits and variant are taken from the record's number, so that references can be followed without a join),
an ISO 8601 timestamp from the 14-digit one, the record type, and block and payload digests (base32 SHA-1).

Of records with equal payloads, the one with the smallest number is the response and the others are revisits that
refer to it. Payloads of fewer bytes than `min_bytes` are never revisits.

Distribution. Digests are reduced on the map side to the smallest page (so a digest with a third of all pages costs no
more) and joined back by page and digest. Every page then becomes an ARC record, is parsed again and written as a WARC
record, a gzip member of its own, by Spark's text writer into the shared folder, in files of about `FILE_BYTES` before
compression. A member's last byte is the highest of its length, 0 below 16 MB; so the writer's line separator is that
byte (a longer record gets an empty member behind it), and a file is nothing but members. Files are read back whole:
one file is one task's unit of work, so no task holds more than a file. Nothing is opened by local paths, and payloads
are bytes of any kind throughout.

Defined results: a null html is an empty payload; a null url is written as an empty one and read as null; a null
page_id is no number: it comes back null, and its record revisits the smallest page with its payload, or is a response
if no page with a number has it. Rows with one page_id and different payloads are separate records, each by its own
payload; equal rows stay separate rows (each is a response if it is the smallest); an empty table gives an empty table;
a page of any length up to 2 GB is written whole; only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import as_documents, checked_broadcast, drop_staged, new_path, parts, releasing, stage

#: Fixed header lines and field lists of the two ARC versions.
ARC_VERSIONS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ORIGIN = "Example Archive"
FILE_BYTES = 16 << 20
#: Bytes of a file that are unpacked at once: what lies behind a member's end in them is copied, not the rest of the file.
PIECE = 1 << 12
END = "\r\n\r\n"
#: Fixed profile of revisits by equal digests.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    url: str
    date: str
    kind: str
    payload: bytes
    status: int | None = None


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_arc(records: list[Record], version: int = 1, date: str = "19960101000000", name: str = "records.arc") -> bytes:
    """An ARC file of the version."""
    about = f"{version} 0 {ORIGIN}\n{ARC_VERSIONS[version]}\n\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    out = [(head + ("200 - - 0 " + name + " " if version == 2 else "")).encode() + str(len(about)).encode() + b"\n" + about + b"\n"]
    offset = len(out[0])
    for r in records:
        fields = [r.url or "-", "0.0.0.0", r.date, r.kind]
        if version == 2:
            fields += [str(r.status or 200), sha1(r.payload), "-", str(offset), name]
        out.append(" ".join([*fields, str(len(r.payload))]).encode() + b"\n" + r.payload + b"\n")
        offset += len(out[-1])
    return b"".join(out)


def parse_arc(raw: bytes) -> Iterator[Record]:
    """The records of an ARC file, by its version's field list and each record's declared length.

    Fields are taken from the right, as an old URL may hold spaces. Raises ValueError on a broken file.
    """
    at, fields = 0, None
    while at < len(raw):
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at {at}")
        line = raw[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        if not line:  # further line ends between records
            at = end + 1
            continue
        if fields is None and not line.startswith("filedesc://"):
            raise ValueError("no version block")
        n = line.rpartition(" ")[2]
        if not n.isascii() or not n.isdigit() or end + 1 + int(n) > len(raw):
            raise ValueError(f"bad length at {at}")
        body, at = raw[end + 1 : end + 1 + int(n)], end + 1 + int(n)
        if line.startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_VERSIONS:
                raise ValueError(f"unknown version {version}")
            fields = ARC_VERSIONS[version].split()
            continue
        got = dict(zip(fields, line.rsplit(" ", len(fields) - 1)))
        if len(got) < len(fields):
            raise ValueError(f"{len(got)} fields instead of {len(fields)}")
        status = got.get("Result-code", "")
        yield Record("" if got["URL"] == "-" else got["URL"], got["Archive-date"], got["Content-type"], body, int(status) if status.isdigit() else None)


def record_id(number: int | None) -> str:
    """A UUID of version 8 that holds a signed 64-bit number, or none."""
    u = (number or 0) & ((1 << 64) - 1)
    head = (0x6661636574 << 8) | (number is None)
    return f"<urn:uuid:{uuid.UUID(int=(head << 80) | (8 << 76) | ((u >> 62) << 64) | (2 << 62) | (u & ((1 << 62) - 1)))}>"


def number_of(identifier: str) -> int | None:
    value = uuid.UUID(identifier[10:-1]).int
    u = ((value >> 64) & 3) << 62 | (value & ((1 << 62) - 1))
    return None if (value >> 80) & 255 else u - (1 << 64) if u >> 63 else u


def iso_date(date: str) -> str:
    """A 14-digit date (or the leading part of one) as WARC writes it."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def to_warc(r: Record, number: int | None, original: int | None) -> bytes:
    """The WARC record, without the line ends after it; original is the number of the response that r repeats."""
    digest = "sha1:" + sha1(r.payload)
    http = f"HTTP/1.0 {r.status or 200} OK\r\nContent-Type: {r.kind}\r\nContent-Length: {len(r.payload)}\r\n\r\n".encode()
    block = http if original is not None else http + r.payload
    head = {
        "WARC-Type": "response" if original is None else "revisit", "WARC-Record-ID": record_id(number), "WARC-Date": iso_date(r.date), "WARC-Target-URI": r.url,
        "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": "sha1:" + sha1(block), "WARC-Payload-Digest": digest,
    }
    if original is not None:
        head |= {"WARC-Refers-To": record_id(original), "WARC-Profile": PROFILE}
    head["Content-Length"] = str(len(block))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode("utf-8", "surrogateescape") + block


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by declared lengths. Raises ValueError on a broken file."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in raw[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:])
        start = end + 4
        at = start + int(head["Content-Length"])
        if raw[at : at + 4] != END.encode():
            raise ValueError(f"bad length at {start}")
        yield head, raw[start:at]
        at += 4


def _record(page_id: int, url: str | None, html: str | None) -> Record:
    """The page as an ARC record, written and parsed: odd ones in version 2."""
    own = Record((url or "").replace("\n", "%0A").replace("\r", "%0D"), "19990101000000", "text/html", (html or "").encode("utf-8", "surrogateescape"))
    (back,) = parse_arc(write_arc([own], 1 + (page_id or 0) % 2))
    return back


def member(record: bytes) -> bytes:
    """The record as it stands in a file, but for the last byte, which is 0."""
    out = gzip.compress(record + END.encode(), 6, mtime=0)
    return (out if not out[-1] else out + gzip.compress(b"", mtime=0))[:-1]


def unpacked(raw: bytes) -> Iterator[bytes]:
    """What each gzip member of a file holds; the file itself if it isn't compressed."""
    if not raw.startswith(b"\x1f\x8b"):
        yield raw
        return
    view, at = memoryview(raw), 0
    while at < len(raw):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(raw):
                raise ValueError("a member without an end")
            piece = view[at : at + PIECE]
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


@releasing
def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, 256):
        rows = [member(to_warc(_record(i, u, h), i, o)) for i, u, h, o in zip(*(part.column(k).to_pylist() for k in range(4)))]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])


def _write(members: DataFrame, path: str) -> None:
    """members(value): gzip members without their last byte, to files at path."""
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


@releasing
def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in parts(batches, 1):
        rows = []
        for record in unpacked(batch.column(0)[0].as_py()):
            for head, block in parse_warc(record):
                http, _, payload = block.partition(b"\r\n\r\n")
                declared = int(http.rpartition(b"Content-Length: ")[2])
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and (len(payload) != declared or sha1(payload) != digest):
                    raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
                original, url = head.get("WARC-Refers-To"), head["WARC-Target-URI"].encode("utf-8", "surrogateescape").decode(errors="replace")
                rows.append((number_of(head["WARC-Record-ID"]), url or None, declared, digest, head["WARC-Type"], number_of(original) if original else None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """WARC files of all pages at path, a folder that all executors share."""
    payload = F.coalesce("html", F.lit(""))
    own = as_documents(pages, ["page_id", "url", "html"]).withColumn("page_id", F.col("page_id").cast("long")).withColumn("digest", F.sha1(payload.cast("binary")))
    groups = own.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"), F.max(F.octet_length(payload)).cast("long").alias("n"))
    groups = stage(groups, "digests")
    n_files = max(1, math.ceil((groups.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] or 0) / FILE_BYTES))
    first = groups.where((F.col("copies") > 1) & (F.col("n") >= min_bytes) & F.col("first").isNotNull()).select("digest", "first")
    later = ~F.col("page_id").eqNullSafe(F.col("first"))
    repeats = own.select("page_id", "digest").join(checked_broadcast(first), "digest").where(later).distinct()
    repeats = stage(repeats.select(F.col("page_id").alias("page"), F.col("digest").alias("same"), F.col("first").alias("original")), "repeats")
    both = own.join(checked_broadcast(repeats), F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("same")), "left")
    rows = both.select("page_id", "url", "html", "original").repartition(n_files, F.xxhash64("page_id", "url", "html"))
    _write(rows.mapInArrow(_convert, "value binary"), path)
    drop_staged(groups)
    drop_staged(repeats)


def convert_archives(spark, source: str, path: str) -> None:
    """WARC files at path of the ARC files at source, gzip-compressed or not; each record is a response, numbered by a
    hash of its file and place."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            name, raw = batch.column(0)[0].as_py(), b"".join(unpacked(batch.column(1)[0].as_py()))
            for i, r in enumerate(parse_arc(raw)):
                number = int.from_bytes(hashlib.blake2b(f"{name}:{i}".encode(), digest_size=8).digest(), "big", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([member(to_warc(r, number, None))], pa.binary())], ["value"])

    files = spark.read.format("binaryFile").load(source).select("path", "content")
    _write(files.mapInArrow(run, "value binary"), path)


def read_archives(spark, path: str) -> DataFrame:
    """A row for each record of the WARC files at path."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read_back, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A row for each page, as the archives written from pages say it."""
    path = new_path(pages.sparkSession, "archives")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
