"""WARC archives: written from pages, and read back past damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.llm.common import share_if_small
from cytoplane.session import cut

VERSION = "WARC/1.1"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Most bytes of an archive, unless one record is larger; each is read by one task.
ARCHIVE_BYTES = 16 << 20
#: Records of alike size are written together: each class is up to so many times larger than the one before.
CLASS_STEP, LEAST_CLASS = 8, 4 << 10
#: Bytes of a record beside its payload, at most, but for its URL.
HEAD_ROOM = 1024
#: Most bytes of a record's header, and those that one gzip member may inflate to: beyond that it counts as damaged.
HEADER_BYTES, INFLATED_BYTES = 1 << 20, 1 << 30
PIECE, NAME_BYTES = 1 << 16, 1 << 12
#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT = 0
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

# ------------------------------------------------------------------- writing


def base32_sha1(text: Column) -> Column:
    """SHA-1 of the UTF-8 bytes in base 32: 20 bits (five hex digits) make four characters."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def records(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, record, most``: the text of one WARC record for each page, without its closing line ends, and the bytes it may take.

    Of pages with equal payloads of ``least_revisit`` bytes or more, the one with
    the least id is a response and the others revisit it.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"),
        base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
        (F.octet_length(payload) + F.coalesce(F.octet_length("url"), F.lit(0)) + F.lit(HEAD_ROOM)).cast("long").alias("most"),
    )
    firsts = (
        rows.where(F.col("bytes") >= least_revisit).groupBy("digest", "bytes")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1")
        .select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "first")
    )
    firsts = cut(firsts)
    rows = rows.join(share_if_small(firsts, 80), (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))

    def uri(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))

    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n")
    )
    rows = rows.withColumn("block", F.when(revisit, head).otherwise(F.concat(head, F.col("payload"))))
    none = F.lit(None).cast("string")
    record = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1F\x7F]", "")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("block")))),
        line("WARC-Refers-To", F.when(revisit, uri(F.col("first"))).otherwise(none)),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE)).otherwise(none)),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    return rows.select("page_id", record.alias("record"), "most")


def write(found: DataFrame, path: str, row_bytes: int) -> None:
    """Archives below ``path`` of records no larger than ``row_bytes``, by Spark's text writer: any file system, safe to retry."""
    lines = found.select("record").write.mode("append").option("lineSep", "\r\n\r\n")
    lines.option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // row_bytes)).text(path)


def write_pages(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT) -> None:
    """Archives of no more than ``ARCHIVE_BYTES``, or of one record if that is larger.

    Records are written by classes of size, a pass over the pages for each class
    that occurs (no more than ten): so a few large pages among many small ones
    don't end up together.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) + F.lit(HEAD_ROOM)
    tops = [LEAST_CLASS * CLASS_STEP**k for k in range(8)]
    name = F.aggregate(F.array(*[F.lit(x) for x in tops]), F.lit(0), lambda n, x: n + F.when(size > x, 1).otherwise(0))
    found = sorted(r["c"] for r in pages.select(name.alias("c")).distinct().collect())
    made = records(pages, least_revisit)
    for c in found or [0]:
        low, high = F.lit(tops[c - 1] if c else -1), F.lit(tops[c] if c < len(tops) else 1 << 62)
        write(made.where((F.col("most") > low) & (F.col("most") <= high)), path, tops[c] if c < len(tops) else ARCHIVE_BYTES)


# ------------------------------------------------------------------- reading


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


class Damaged(Exception):
    pass


_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_TAIL = re.compile(rb"\r?\n\r?\n")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class _HeaderEnds:
    """Blank lines of one archive. Searches only go forward, so that all of them together read it once."""

    def __init__(self, data: bytes):
        self.data, self.low, self.found = data, 0, None
        self.fresh = True

    def after(self, at: int) -> re.Match | None:
        if self.fresh or at < self.low or (self.found is not None and at > self.found.start()):
            self.found = _HEAD_END.search(self.data, at)
            self.low, self.fresh = at, False
        return self.found


def _header_lines(data: bytes, at: int, stop: int) -> Iterator[bytes]:
    while True:
        feed = data.find(b"\n", at, stop)
        yield data[at : stop if feed < 0 else feed].removesuffix(b"\r")
        if feed < 0:
            return
        at = feed + 1


def _plain(data: bytes, at: int, ends: _HeaderEnds) -> tuple[Record, int]:
    """The record at ``at`` and where it ends; every check that fails raises."""
    start = _VERSION.match(data, at)
    if not start:
        raise Damaged("no version line")
    end = ends.after(start.end())
    if not end or end.start() - at > HEADER_BYTES:
        raise Damaged("header not ended")
    headers: dict[str, str] = {}
    last = ""
    for raw in _header_lines(data, start.end(), end.start()):  # a bad line ends it: the rest is not read
        text = raw.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            headers[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise Damaged("bad header line")
        last = name.strip().lower()
        headers[last] = value.strip()
    if not {"warc-type", "warc-record-id", "content-length"} <= headers.keys() or not re.fullmatch(r"[0-9]+", headers["content-length"]):
        raise Damaged("header field missing")
    stop = end.end() + int(headers["content-length"])
    tail = _TAIL.match(data, stop)
    if stop > len(data) or not tail:
        raise Damaged("wrong length or cut off")
    record = Record(at, tail.end() - at, headers, data[end.end() : stop])
    _check_digest(headers.get("warc-block-digest"), record.block, "block digest")
    if headers["warc-type"] in ("response", "resource"):
        _check_digest(headers.get("warc-payload-digest"), payload_of(record), "payload digest")
    return record, tail.end()


def _check_digest(claimed: str | None, data: bytes, what: str) -> None:
    if claimed and claimed.lower().startswith("sha1:") and claimed[5:].strip().upper() != sha1_base32(data):
        raise Damaged(what)


def payload_of(record: Record) -> bytes:
    """The block without its HTTP head, if it has one."""
    if record.headers.get("content-type", "").startswith("application/http"):
        end = _HEAD_END.search(record.block)
        return record.block[end.end() :] if end else b""
    return record.block


def _member_head(data: bytes, at: int) -> None:
    """Raises unless a gzip header stands at ``at`` whose name and comment end soon."""
    flags = data[at + 3] if at + 10 <= len(data) else 0xFF
    if flags & 0xE0:
        raise Damaged("bad gzip member")
    place = at + 10
    if flags & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            place = data.find(b"\0", place, place + NAME_BYTES) + 1
            if not place:
                raise Damaged("bad gzip member")


def _member(data: bytes, at: int) -> tuple[list[Record], int]:
    """The records of the gzip member at ``at`` and where it ends."""
    _member_head(data, at)
    inflate, parts, size, place = zlib.decompressobj(31), [], 0, at
    try:
        while not inflate.eof and place < len(data):
            piece = data[place : place + PIECE]
            place += len(piece)
            while piece and not inflate.eof:
                parts.append(inflate.decompress(piece, INFLATED_BYTES - size + 1))
                size += len(parts[-1])
                if size > INFLATED_BYTES:
                    raise Damaged("gzip member too large")
                piece = inflate.unconsumed_tail
    except zlib.error:
        raise Damaged("bad gzip member") from None
    if not inflate.eof:
        raise Damaged("gzip member cut off")
    plain, end = b"".join(parts), place - len(inflate.unused_data)
    ends = _HeaderEnds(plain)
    found, place = [], 0
    while place < len(plain):
        record, place = _plain(plain, place, ends)
        found.append(Record(at, end - at, record.headers, record.block))
    return found, end


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """Records of one archive, and ``(offset, length, reason)`` for the bytes between them that are given up.

    After a failed check the search goes on behind its first byte, for the next
    gzip member or version line at which a whole record passes every check. A
    start that fails is given up at its first bad line, and the ends of headers
    are found in one pass, so broken starts cost no more than their bytes.
    """
    at, gap, reason = 0, None, ""
    ends = _HeaderEnds(data)
    while at < len(data):
        try:
            if data.startswith(b"\x1f\x8b\x08", at):
                found, end = _member(data, at)
            else:
                record, end = _plain(data, at, ends)
                found = [record]
        except Damaged as why:
            if gap is None:
                gap, reason = at, str(why)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield gap, at - gap, reason
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield gap, len(data) - gap, reason


_SHAPE = (
    "archive string, offset long, length long, reason string, record_type string, record_id string, refers_to string, "
    "target_uri string, payload_bytes long, payload_digest string, payload binary"
)
_NAMES = [part.split()[0] for part in _SHAPE.split(", ")]
_HTTP_LENGTH = re.compile(rb"^content-length:\s*([0-9]+)\s*$", re.IGNORECASE | re.MULTILINE)


def _told(archive: str, x: Record | tuple, payloads: bool) -> tuple:
    if isinstance(x, tuple):
        return (archive, *x, *[None] * 7)
    kind, h = x.headers["warc-type"], x.headers
    if kind == "revisit":
        stated = _HTTP_LENGTH.search(x.block)
        size, data = int(stated[1]) if stated else None, None
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    else:
        data = payload_of(x)
        size, digest = len(data), sha1_base32(data)
    return (archive, x.offset, x.length, None, kind, h["warc-record-id"], h.get("warc-refers-to"), h.get("warc-target-uri"),
            size, digest, data if payloads else None)


def _reader(payloads: bool):
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows: list[tuple] = []
                held = 0
                for x in salvage(content.as_py()):
                    rows.append(_told(path.as_py(), x, payloads))
                    held += len(rows[-1][-1] or b"") + 200
                    if held > ARCHIVE_BYTES // 4:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds)

    return run


def _batch(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archives below ``path``.

    A row is a record, or, with ``reason`` set, a gap (``offset``, ``length``).
    Plain archives and gzip members are both read. One task reads an archive at
    a time, whole, so archives are to be of bounded size (``write`` sees to
    that; files above 2 GB can't be read so).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return files.select("path", "content").mapInArrow(_reader(payloads), _SHAPE)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the whole records below ``path``."""

    def page(uri: str) -> Column:
        return F.nullif(F.regexp_extract(uri, r"^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")

    found = read(spark, path, payloads=False).where("reason is null")
    return found.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Pages written as archives below ``path`` and read back, one row for each.

    A null ``html`` is an empty payload. A null ``page_id`` stays null and is
    never one that others refer to, unless all equal payloads have none. Rows
    that repeat the least id of their payload are all responses. Control
    characters are left out of a target URI; a null ``url`` has none. Other
    columns are not written. An empty table gives an empty result.
    """
    write_pages(pages, path)
    return page_records(pages.sparkSession, path)
