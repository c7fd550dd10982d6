"""WARC archives of pages: written as files by Spark's own sink, and read back by a reader that salvages damaged ones.

Writing. A page is a response record, but a page whose payload occurs under a larger id is a revisit that names that
page. Revisits are found on a narrow table of digests, in which the copies of one payload are dealt to SALTS keys; pages' texts
are not shuffled while there are at most SENT revisits. Tasks put records together to archives of about ARCHIVE_BYTES,
each the one row of a file, so any file system that Spark knows will do. Archives are plain, or hold a gzip member for
each record and an empty member at their end.

Reading. Each archive is read from front to end. At each place there must be a gzip member or a version line; a record is taken if
its header, its length, the empty lines behind it and its digests are right. After a failed check the reader searches for the next
place at which a member or a version line begins a valid record, goes on there, and logs the bytes between as a gap with the reason.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_dir

#: An archive is closed when it has so many bytes; a longer record is an archive of its own.
ARCHIVE_BYTES = 16 << 20
#: Keys that the copies of one payload are dealt to.
SALTS = 64
#: Revisits that are broadcast at most, an id and a digest each; more are joined by a shuffle.
SENT = 500_000
DATE = "1970-01-01T00:00:00Z"
LEVEL = 1
#: Bytes in which the header of a record must end, bytes that a decompressor takes at once, bytes of a member's content at most.
HEADER_BYTES, CHUNK, MEMBER_BYTES = 1 << 16, 1 << 15, 1 << 30

# Fixed values of the format.
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date")
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_START = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]")
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
_ID = re.compile(r"<urn:page:(-?[0-9]+)>")


# -- writing ---------------------------------------------------------------------------------------------------------


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """A record without the empty lines behind it. payload None: only the HTTP header is its block, with the size of the whole payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32(sha1)}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + block


def member(data: bytes, level: int = LEVEL) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, key, sha1, n, first of each page whose payload occurs under a larger id, which is `first`; pages: page_id, url, html.

    Payloads are equal if their SHA-256, `key`, is. A page with a null id revisits any copy with an id."""
    html = F.col("html").cast("binary")
    keys = pages.select("page_id", "url", F.unhex(F.sha2(html, 256)).alias("key"), F.unhex(F.sha1(html)).alias("sha1"), F.octet_length(html).cast("long").alias("n"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    keys = materialize(keys, "digests")
    dealt = keys.groupBy("key", "salt").agg(F.count("*").alias("rows"), F.max("page_id").alias("most"))
    copies = dealt.groupBy("key").agg(F.sum("rows").alias("rows"), F.max("most").alias("first"), F.collect_set("salt").alias("salts"))
    copies = copies.where("rows > 1 and first is not null").select("key", "first", F.explode("salts").alias("salt"))
    return keys.join(copies, ["key", "salt"]).where("page_id is null or page_id <> first").select("page_id", "url", "key", "sha1", "n", "first")


def write_archives(pages: DataFrame, path: str | None = None, compressed: bool = True, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Writes a record for each page into archives in the folder `path` (a new one in the shared folder, if None), which is returned.

    A null html is an empty payload; null urls are about:blank; null ids and repeated rows are kept, and rows that repeat the largest id
    of a payload are responses all. An empty table makes a folder without archives. Other columns are ignored."""
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark)}/tidemark-{uuid.uuid4().hex}/archives"
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    again = materialize(revisits(own), "revisits")
    n = again.count()
    full = own.select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    if n:
        gone = again.select(F.col("page_id").alias("_id"), "key")
        keyed = full.withColumn("_key", F.unhex(F.sha2("payload", 256)))
        full = keyed.join(F.broadcast(gone) if n <= SENT else gone, keyed["page_id"].eqNullSafe(gone["_id"]) & (keyed["_key"] == gone["key"]), "left_anti").drop("_key")
    rows = full.withColumns({"sha1": F.lit(None).cast("binary"), "n": F.lit(None).cast("long"), "first": F.lit(None).cast("long")})
    if n:
        rows = rows.unionByName(again.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "sha1", "n", "first"))

    def run(batches):
        parts, size = [], 0
        for b in batches:
            for i, url, payload, sha1, length, first in zip(*(c.to_pylist() for c in b.columns)):
                if payload is None:
                    one = record("revisit", i, url, None, length, sha1, first)
                else:
                    one = record("response", i, url, payload, len(payload), hashlib.sha1(payload).digest())
                one = member(one + END) if compressed else one
                if parts and size + len(one) > archive_bytes:
                    yield closed(parts)
                    parts, size = [], 0
                parts.append(one)
                size += len(one)
        if parts:
            yield closed(parts)

    def closed(parts):
        return pa.RecordBatch.from_arrays([pa.array([(b"" if compressed else END).join(parts)], pa.binary())], ["archive"])

    # the sink ends each row with its separator: the empty lines behind the last record, or an empty member
    separator = EMPTY_MEMBER.decode("latin-1") if compressed else END.decode()
    archives = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)
    return path


# -- reading ---------------------------------------------------------------------------------------------------------


class Damaged(ValueError):
    """A check that failed."""


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    size: int  # bytes of the whole payload; a revisit says so in its HTTP header
    digest: str | None  # the payload's SHA-1, as read; of a revisit, the one that it names


@dataclass
class Found:
    """A record, or a gap where `record` is None, at bytes start to stop of the archive."""

    start: int
    stop: int
    record: Record | None
    reason: str | None = None


def _fields(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = ""
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header line without a colon")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def _checked(what: str, said: str | None, data) -> None:
    kind, _, value = (said or "").partition(":")
    if value and kind.lower() in ("sha1", "sha256", "md5"):
        real = hashlib.new(kind.lower(), data)
        if value.upper().rstrip("=") != base32(real.digest()).rstrip("=") and value.lower() != real.hexdigest():
            raise Damaged(f"a wrong {what} digest")


def plain_record(data, at: int = 0) -> tuple[Record, int]:
    """The record at a place of data, and where the next one begins. Raises Damaged."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    stop = data.find(END, version.end() - 2, at + HEADER_BYTES)
    if stop < 0:
        raise Damaged("a header without an end")
    headers = _fields(data[version.end() : stop])
    if not all(headers.get(f) for f in MANDATORY):
        raise Damaged("a header without a mandatory field")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no length")
    first, last = stop + 4, stop + 4 + int(length)
    if last + 4 > len(data):
        raise Damaged("a record cut short")
    if data[last : last + 4] != END:
        raise Damaged("no empty lines behind the block")
    block = data[first:last]
    _checked("block", headers.get("warc-block-digest"), block)
    payload, size, kind = block, len(block), headers.get("warc-type")
    if headers.get("content-type", "").startswith("application/http"):
        cut = block.find(END)
        if cut < 0:
            raise Damaged("an HTTP header without an end")
        http = _fields(block[block.find(b"\r\n") + 2 : cut]) if block.find(b"\r\n") < cut else {}
        payload = block[cut + 4 :]
        size = int(http["content-length"]) if kind == "revisit" and http.get("content-length", "").isdigit() else len(payload)
        if kind == "response" and "transfer-encoding" not in http:
            _checked("payload", headers.get("warc-payload-digest"), payload)
    said = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
    return Record(headers, payload, size, said if kind == "revisit" else base32(hashlib.sha1(payload).digest())), last + 4


def gzip_member(data, at: int = 0) -> tuple[bytes, int]:
    """The content of the member at a place of data, and where the next one begins. Raises Damaged."""
    d, out, size, k, view = zlib.decompressobj(31), [], 0, at, memoryview(data)
    try:
        while not d.eof:
            if k >= len(data):
                raise Damaged("a member cut short")
            given = view[k : k + CHUNK]
            while len(given) and not d.eof:
                out.append(d.decompress(given, 1 << 20))
                size += len(out[-1])
                if size > MEMBER_BYTES:
                    raise Damaged("a member that is too long")
                given = d.unconsumed_tail
            k += CHUNK
    except zlib.error as e:
        raise Damaged("a broken member") from e
    return b"".join(out), min(k, len(data)) - len(d.unused_data)


def _records_at(data, at: int) -> tuple[list[Record], int]:
    """The records of the member at a place, or the one plain record there; all must be valid."""
    if data[at : at + 3] != b"\x1f\x8b\x08":
        one, stop = plain_record(data, at)
        return [one], stop
    content, stop = gzip_member(data, at)
    records, k = [], 0
    while k < len(content):
        one, k = plain_record(content, k)
        records.append(one)
    return records, stop


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of an archive, in order; together with empty members they cover all its bytes."""
    at = 0
    while at < len(data):
        try:
            records, stop = _records_at(data, at)
        except Damaged as e:
            lost, records = at, []
            at = stop = len(data)
            for m in _START.finditer(data, lost + 1):
                try:
                    records, stop = _records_at(data, m.start())
                except Damaged:
                    continue
                at = m.start()
                break
            yield Found(lost, at, None, str(e))
        yield from (Found(at, stop, r) for r in records)
        at = stop


_READ = "archive string, start long, stop long, kind string, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record and each gap of the archives in a folder (kind 'record' or 'gap'), with the record's payload if wanted.

    start and stop are bytes of the archive, of a gzip member where it has some. A gap has its reason, and nulls for the rest. Archives
    are read whole, so Spark's limit of 2 GB for a file holds, and a task needs room for one; the writer's have ARCHIVE_BYTES."""
    names = [c.split()[0] for c in _READ.split(", ")] + ["payload"] * with_payload
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.binary()][: len(names)]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for k in range(b.num_rows):
                name = b.column(0)[k].as_py()
                for f in salvage(b.column(1)[k].as_py()):
                    r = f.record
                    h = r.headers if r else {}
                    row = (name, f.start, f.stop, "record" if r else "gap", f.reason, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), r and r.size, r and r.digest, r and r.payload)
                    rows.append(row[: len(names)])
                    size += len(r.payload) if r and with_payload else 500
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, _READ + ", payload binary" * with_payload)


def page_records(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records of pages that read_archives gives."""
    number = lambda c: F.regexp_extract(c, _ID.pattern, 1).try_cast("long")
    pages = read.where("record_type in ('response', 'revisit')")
    return pages.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
