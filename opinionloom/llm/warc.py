"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

The writer makes one gzip member per record and leaves files to Spark's text sink, so that archives land in any file
system Spark can write, by its commit protocol. The sink ends every row with a separator; here that is the zero byte a
gzip member ends with anyway.

The reader takes plain and compressed archives. A record or member is checked: gzip trailer, version line, header fields,
length, closing line breaks, block and payload digest. After a failed check it searches for the next member or version
line whose record passes, goes on there, and logs the bytes between as a quarantined gap. The content of a member that
holds several records is searched in the same way, as far as it could be unpacked; a gap in it has the place of the
member, and its reason names the bytes of the content. A single record stands or falls with its member. Archives are read whole, one at a
time; those written here end before the record that would take them above ``ARCHIVE_BYTES``, so only a single larger record makes a larger
archive.

Defined cases: a null payload is empty, a null url is left out, a null key is written and read back as null. Rows that
repeat the smallest key of a payload are all responses. A table without rows gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from contextlib import suppress
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionloom.llm.arrow_text import in_python, slices
from opinionloom.session import written

LEAST_REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
DATE = "2020-01-01T00:00:00Z"
ID = "urn:opinionloom:page:"
CRLF = b"\r\n"
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: An empty gzip member. It ends in a zero byte, which a member of 16 MiB and more need not.
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
CHUNK = 1 << 16


def record_bytes(key, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id(key)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%")))
    if revisit:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", _id(refers_to)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    fields.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    fields.append(("Content-Length", str(len(block))))
    head = CRLF.join([b"WARC/1.1", *(f"{name}: {value}".encode() for name, value in fields)])
    return head + CRLF * 2 + block + CRLF * 2


def _id(key) -> str:
    return f"<{ID}{'' if key is None else quote(str(key), safe='')}>"


def _key_of(field: str | None) -> str | None:
    text = (field or "").strip("<>")
    return unquote(text.removeprefix(ID)) or None if text.startswith(ID) else text or None


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = packer.compress(record) + packer.flush()
    return packed if packed[-1] == 0 else packed + EMPTY_MEMBER


def with_revisits(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """Rows ``(key, url, payload, digest, first, revisit)``: of equal payloads of ``LEAST_REVISIT_BYTES`` and more the one
    with the smallest key is the first, the others revisit it.

    Only digests and keys are shuffled to find the firsts, a row per repeated payload. They are written, so that Spark knows their
    size and broadcasts them below its threshold; beyond, the join deals the payloads by digest.
    """
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload")
    ).withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256))
    repeated = (
        rows.filter(F.octet_length("payload") >= LEAST_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("key").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    firsts = written(repeated.select("digest", "first"), "first-pages")
    # a group of null keys only has no smallest key: all its rows are responses
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    return rows.join(firsts, "digest", "left").withColumn("revisit", revisit)


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """Write one record per row into gzip archives under ``path``, in a folder for the first archive of each task, the second and so on."""
    rows = with_revisits(pages, key, url, payload)

    def run(batches):
        archive, held = 0, 0
        for batch in slices(batches, "payload"):
            records, archives = [], []
            columns = (batch.column(c).to_pylist() for c in ("key", "url", "digest", "first", "revisit"))
            payloads = batch.column("payload").cast(pa.binary()).to_pylist()
            for body, (own, place, digest, first, revisit) in zip(payloads, zip(*columns, strict=True), strict=True):
                packed = member(record_bytes(own, place, body, digest, first, revisit))
                if held and held + len(packed) > archive_bytes:
                    archive, held = archive + 1, 0
                held += len(packed)
                records.append(packed[:-1])
                archives.append(archive)
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()), pa.array(archives, pa.int32())], ["member", "archive"])

    lines = in_python(rows, run, "member binary, archive int").select(F.col("member").cast("string").alias("value"), "archive")
    lines.write.option("lineSep", "\x00").partitionBy("archive").text(path)


class Failed(Exception):
    """A check that failed; the message is the reason. Of a member, also what was unpacked and the place of the failure."""

    def __init__(self, reason: str, content: bytes = b"", stop: int = 0):
        super().__init__(reason)
        self.content, self.stop = content, stop


class Record(NamedTuple):
    position: int
    size: int
    fields: dict[str, str]
    payload: bytes
    payload_bytes: int


class Gap(NamedTuple):
    position: int
    size: int
    reason: str


def parse_record(data: bytes, at: int) -> tuple[Record, int]:
    """The record that begins at a place, and the place behind it; raises ``Failed``."""
    version = VERSION.match(data, at)
    if not version:
        raise Failed("no version line")
    head_end = data.find(CRLF * 2, version.end() - 2)
    if head_end < 0:
        raise Failed("header not closed")
    fields = {}
    for line in data[version.end() : head_end].split(CRLF):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Failed("header line without a colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdecimal():
        raise Failed("no content length")
    begin = head_end + 4
    end = begin + int(fields["content-length"])
    if data[end : end + 4] != CRLF * 2:
        raise Failed("length and record end disagree")
    block = data[begin:end]
    _check(fields.get("warc-block-digest"), block, "block digest")
    http, blank, payload = block.partition(CRLF * 2)
    if not fields.get("content-type", "").startswith("application/http") or not blank:
        http, payload = b"", block
    declared = re.search(rb"(?im)^content-length: *([0-9]+)\r?$", http)
    size = int(declared[1]) if declared else len(payload)
    if fields.get("warc-type") != "revisit":
        _check(fields.get("warc-payload-digest"), payload, "payload digest")
        size = len(payload)
    return Record(at, end + 4 - at, fields, payload, size), end + 4


def _check(declared: str | None, content: bytes, what: str) -> None:
    """Digests in hex or base 32; unknown algorithms are not checked."""
    name, _, value = (declared or "").partition(":")
    if name.lower() in ("sha1", "sha256", "md5"):
        found = hashlib.new(name.lower(), content)
        if value.lower() != found.hexdigest() and value.upper() != base64.b32encode(found.digest()).decode():
            raise Failed(f"{what} differs")


def unpack_member(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a place, and the place behind it; raises ``Failed``."""
    unpacker, parts, view = zlib.decompressobj(31), [], memoryview(data)
    while not unpacker.eof:
        chunk = view[at : at + CHUNK]
        if not len(chunk):
            raise Failed("member cut off", b"".join(parts), at)
        former = unpacker.copy()
        try:
            parts.append(unpacker.decompress(chunk))
        except zlib.error as error:
            # once more byte by byte, for what comes out before the damage
            with suppress(zlib.error):
                for one in range(at, at + len(chunk)):
                    parts.append(former.decompress(view[one : one + 1]))
            raise Failed("member damaged", b"".join(parts), one) from error
        at += len(chunk)
    return b"".join(parts), at - len(unpacker.unused_data)


def _content(content: bytes, at: int, size: int) -> tuple[list[Record | Gap], int]:
    """The records and gaps in the content of the member at a place, and how many records there are."""
    found, inner, gap_at, reason, n = [], 0, None, "", 0

    def close(gap_end: int) -> None:
        if gap_at is not None:
            found.append(Gap(at, size, f"{reason}, bytes {gap_at} to {gap_end} of the member's content"))

    while inner < len(content):
        try:
            record, end = parse_record(content, inner)
        except Failed as failure:
            if gap_at is None:
                gap_at, reason = inner, str(failure)
            later = VERSION.search(content, inner + 1)
            inner = later.start() if later else len(content)
            continue
        close(inner)
        gap_at = None
        found.append(record._replace(position=at, size=size))
        inner, n = end, n + 1
    close(len(content))
    return found, n


def _records_at(data: bytes, at: int) -> tuple[list[Record | Gap], int]:
    """The records of the member, with the gaps between them, or the plain record, at a place."""
    if data[at : at + 3] != GZIP_MAGIC:
        record, end = parse_record(data, at)
        return [record], end
    content, end = unpack_member(data, at)
    found, n = _content(content, at, end - at)
    if found and not n:
        parse_record(content, 0)
    return found, end


_START = re.compile(re.escape(GZIP_MAGIC) + b"|" + VERSION.pattern)


def _held(failure: Failed, at: int) -> list[Record]:
    """The records that pass in what was unpacked of a broken member, unless that is one record and nothing else."""
    found, _ = _content(failure.content, at, failure.stop - at)
    with suppress(Failed):
        if parse_record(failure.content, 0)[1] == len(failure.content):
            return []
    return [x for x in found if isinstance(x, Record)]


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records of an archive that pass the checks, and the gaps between them."""
    at, gap_at, reason = 0, None, ""
    while at < len(data):
        try:
            records, end = _records_at(data, at)
        except Failed as failure:
            if held := _held(failure, at):
                if gap_at is not None:
                    yield Gap(gap_at, at - gap_at, reason)
                gap_at, reason = at, str(failure)
                yield from held
            if gap_at is None:
                gap_at, reason = at, str(failure)
            later = _START.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if gap_at is not None:
            yield Gap(gap_at, at - gap_at, reason)
            gap_at = None
        yield from records
        at = end
    if gap_at is not None:
        yield Gap(gap_at, len(data) - gap_at, reason)


COLUMNS = (
    "archive string, position long, size long, gap string, record_type string, record_id string, refers_to string,"
    " url string, payload_bytes long, payload_digest string, payload binary"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record and per quarantined gap of the archives under ``path``.

    Gaps have their reason in ``gap`` and nulls in the fields of records. ``payload`` is null without ``payloads``.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def row(archive: str, one: Record | Gap) -> dict:
        if isinstance(one, Gap):
            return {"archive": archive, "position": one.position, "size": one.size, "gap": one.reason}
        digest = one.fields.get("warc-payload-digest") or f"sha256:{hashlib.sha256(one.payload).hexdigest()}"
        return {
            "archive": archive,
            "position": one.position,
            "size": one.size,
            "record_type": one.fields.get("warc-type"),
            "record_id": _key_of(one.fields.get("warc-record-id")),
            "refers_to": _key_of(one.fields.get("warc-refers-to")),
            "url": one.fields.get("warc-target-uri"),
            "payload_bytes": one.payload_bytes,
            "payload_digest": digest.partition(":")[2],
            "payload": one.payload if payloads else None,
        }

    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, types[kind]) for name, kind in map(str.split, COLUMNS.split(","))])

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for one in salvage(content.as_py() or b""):
                    rows.append(row(archive, one))
                    held += len(one.payload) if payloads and isinstance(one, Record) else 200
                    if held > CHUNK * 128:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return in_python(files, run, COLUMNS)
