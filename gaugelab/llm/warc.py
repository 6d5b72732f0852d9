"""WARC archives: deduplicating writer and salvaging reader.

The writer makes one record per page, each in a gzip member of its own. Of pages
with equal payloads the one with the smallest id becomes the response; the others
become revisit records without payload that refer to it.

The reader takes archives apart member by member (or record by record where they
are not compressed) and checks every length, terminator and digest. After a
failed check it searches for the next gzip member or version line that passes
all checks, goes on from there, and reports the bytes in between as a gap.

Files are written by Spark's text writer as raw bytes, with an empty gzip member
for its line separator, and read by its binary reader, so they can lie in any
store Spark knows. A task holds one archive at a time; the writer's archives are
as large as a shuffle partition.

Cases: a null payload is empty; a null url leaves the header out; pages with a
null id are responses that nothing refers to; repeated pages with one id and
payload are all responses with the same record id; an empty table gives no
archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks and header names of the formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
END_OF_HEADERS = re.compile(rb"\r?\n\r?\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
LEVEL = 5
FED = 1 << 16
MOST_HEADER_BYTES = 1 << 20


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


EMPTY_MEMBER = gzip_member(b"")


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record of a page; a revisit carries the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).digest())}"]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = 0) -> None:
    """Write the pages as archives into ``folder``. Payloads of fewer than ``least`` bytes are never revisits."""
    payload = F.coalesce(F.encode(F.col(payload_column), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    shared = rows.where((F.length("payload") >= least) & F.col("id").isNotNull()).groupBy("sha1").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    shared = shared.select(F.col("sha1").alias("shared_sha1"), "first", F.lit(True).alias("repeats"))
    found = rows.join(shared, (F.col("sha1") == F.col("shared_sha1")) & (F.length("payload") >= least) & F.col("id").isNotNull(), "left")
    found = found.select(F.col("id").cast("string").alias("id"), "url", "payload", "sha1", F.when(F.col("repeats") & (F.col("id") != F.col("first")), F.col("first").cast("string")).alias("first"))

    def run(batches):
        for batch in batches:
            members = []
            for id_, url, data, sha1, first in zip(*(c for c in batch.columns)):
                digest = base32_sha1(sha1.as_py())
                to = first.as_py()
                record = record_bytes(f"urn:page:{id_.as_py()}:{digest}", url.as_py(), data.as_py(), digest, f"urn:page:{to}:{digest}" if to is not None else None)
                members.append(gzip_member(record))
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    # A binary column cast to string keeps its bytes; the writer adds an empty member after each record.
    archives = found.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    archives.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(folder)


# --- reading ------------------------------------------------------------------------------------


@dataclass
class Record:
    begin: int
    end: int
    headers: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    begin: int
    end: int
    reason: str


@dataclass
class Found:
    """What stands at an offset: where it ends, or why it fails."""

    end: int = -1
    items: list[Record | Gap] = field(default_factory=list)
    reason: str = ""


def _digest_fits(header: str | None, data: bytes) -> bool:
    if not header or not header.lower().startswith("sha1:"):
        return True
    value = header[5:].strip()
    made = hashlib.sha1(data)
    return value.upper() == base32_sha1(made.digest()) or value.lower() == made.hexdigest()


def plain_record(data: bytes, at: int) -> Found:
    """The uncompressed record at an offset, if all its checks pass."""
    version = VERSION_LINE.match(data, at)
    if not version:
        return Found(reason="no version line")
    stop = END_OF_HEADERS.search(data, version.end() - 2, min(len(data), at + MOST_HEADER_BYTES))
    if not stop:
        return Found(reason="headers do not end")
    headers: dict[str, str] = {}
    for line in data[version.end() : stop.start()].split(b"\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return Found(reason="malformed header")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or not headers.get("warc-type") or not headers.get("warc-record-id"):
        return Found(reason="missing header")
    begin = stop.end()
    end = begin + int(size)
    if end > len(data):
        return Found(reason="truncated block")
    if data[end : end + 4] != b"\r\n\r\n":
        return Found(reason="no record end")
    block = data[begin:end]
    if not _digest_fits(headers.get("warc-block-digest"), block):
        return Found(reason="block digest differs")
    payload = block
    if headers.get("content-type", "").lower().startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4 :] if cut >= 0 else b""
    if headers["warc-type"].lower() == "revisit":
        payload = b""
    elif not _digest_fits(headers.get("warc-payload-digest"), payload):
        return Found(reason="payload digest differs")
    return Found(end + 4, [Record(at, end + 4, headers, payload)])


def member(data: bytes, at: int) -> Found:
    """The gzip member at an offset with the records in it, if it unpacks and its checksum fits."""
    unpacker = zlib.decompressobj(31)
    parts, fed = [], at
    try:
        while not unpacker.eof and fed < len(data):
            parts.append(unpacker.decompress(data[fed : fed + FED]))
            fed = min(fed + FED, len(data))
    except zlib.error:
        return Found(reason="damaged member")
    if not unpacker.eof:
        return Found(reason="truncated member")
    end = fed - len(unpacker.unused_data)
    inner = list(salvage(b"".join(parts), False))
    if inner and not any(isinstance(i, Record) for i in inner):
        return Found(reason=inner[0].reason)
    # Offsets of what is in a member are those of the member.
    for i in inner:
        i.begin, i.end = at, end
    return Found(end, inner)


def what_stands(data: bytes, at: int, packed: bool) -> Found:
    if packed and data.startswith(GZIP_MAGIC, at):
        return member(data, at)
    return plain_record(data, at)


def candidates(data: bytes, at: int, packed: bool) -> Iterator[int]:
    """Offsets from ``at`` on where a member or a version line may begin, in order."""
    marks = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]" if packed else rb"WARC/[0-9]")
    for m in marks.finditer(data, at):
        yield m.start()


def salvage(data: bytes, packed: bool = True) -> Iterator[Record | Gap]:
    """All records of an archive that pass their checks, and the byte ranges that hold none."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n\0":  # padding between records
            at += 1
            continue
        found = what_stands(data, at, packed)
        if found.end < 0:
            begin, reason = at, found.reason
            at = len(data)
            for place in candidates(data, begin + 1, packed):
                found = what_stands(data, place, packed)
                if found.end >= 0:
                    at = place
                    break
            yield Gap(begin, at, reason)
            if found.end < 0:
                return
        yield from found.items
        at = found.end


_COLUMNS = "kind string, file string, begin long, end long, reason string, record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload_sha1 string"


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read(spark: SparkSession, *folders: str, payload: bool = True) -> DataFrame:
    """Rows of kind record or gap of all archives in the folders.

    ``payload_sha1`` and ``payload_bytes`` are taken from the payload as read; a
    revisit has none, and states the digest of the other's in ``payload_digest``.
    """
    files = spark.read.format("binaryFile").load(list(folders)).select("path", "content")
    names = [c.split()[0] for c in _COLUMNS.split(", ")] + ["payload"] * payload

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                columns: list[list] = [[] for _ in names]
                for item in salvage(content.as_buffer().to_pybytes()):
                    if isinstance(item, Gap):
                        row = ["gap", path.as_py(), item.begin, item.end, item.reason, *[None] * (7 + payload)]
                    else:
                        h = item.headers
                        kind = h["warc-type"].lower()
                        digest = h.get("warc-payload-digest")
                        row = ["record", path.as_py(), item.begin, item.end, None, kind, _bare(h["warc-record-id"]), h.get("warc-target-uri"), digest.partition(":")[2] if digest else None, _bare(h.get("warc-refers-to"))]
                        row += [None, None] if kind == "revisit" else [len(item.payload), base32_sha1(hashlib.sha1(item.payload).digest())]
                        row += [None if kind == "revisit" else item.payload] * payload
                    for c, v in zip(columns, row):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "payload" else pa.int64() if n in ("begin", "end", "payload_bytes") else pa.string()) for n, c in zip(names, columns)], names)

    return files.mapInArrow(run, _COLUMNS + (", payload binary" if payload else ""))


def resolved(records: DataFrame) -> DataFrame:
    """Size and digest of the full payload for every record: a revisit takes them from the response it refers to."""
    rows = records.where("kind = 'record'")
    full = rows.where("record_type <> 'revisit'").groupBy(F.col("record_id").alias("full_id")).agg(F.max("payload_bytes").alias("full_bytes"), F.max("payload_sha1").alias("full_sha1"))
    known = rows.join(full, F.col("refers_to") == F.col("full_id"), "left")
    return known.withColumns({"payload_bytes": F.coalesce("payload_bytes", "full_bytes"), "payload_sha1": F.coalesce("payload_sha1", "full_sha1")}).drop("full_id", "full_bytes", "full_sha1")
