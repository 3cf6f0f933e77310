"""WARC archives: a writer that marks repeated payloads, and a salvage reader.

Records are built with SQL functions, packed into one gzip member each, so that damage
stays in the record that it hits, and committed by Spark's text writer.  The reader
parses every archive in Spark tasks.  Where a check fails (version line, header
block, length, record separator, gzip CRC, payload digest) it searches for the next
byte position at which a gzip member or a version line starts and passes all checks,
goes on from there, and reports the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
SEPARATOR = CRLF + CRLF
GZIP = b"\x1f\x8b\x08"
PIECE = 1 << 16
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
RECORD_URN = "urn:page:"
#: The archives' capture time; the pages carry none.
DATE = "1970-01-01T00:00:00Z"

SCHEMA = (
    "kind string, archive string, offset long, length long, record_id string, record_type string, refers_to string, "
    "target_uri string, payload binary, payload_bytes long, payload_digest string, reason string"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: each 5 hex digits are 4 base32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each page.

    Of pages with the same payload of at least ``min_bytes`` bytes, the one with the
    smallest page_id is the response.  Repeated rows of that page_id are responses too.
    Null html is an empty payload.  Null page_ids are never referred to: such a row is
    a response if no page with an id has its payload, else a revisit.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    digests = pages.select("page_id", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")).where(F.length("payload") >= min_bytes)
    first = digests.groupBy(base32_sha1(F.col("payload")).alias("digest")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    # the concat is a fresh key expression: both sides shuffle for the join, and a hot payload can be split
    joined = rows.join(first.select(F.concat("digest", F.lit("=")).alias("key"), "first_id"), F.concat("payload_digest", F.lit("=")) == F.col("key"), "left")
    repeat = F.col("first_id").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(repeat, "revisit").otherwise("response").alias("record_type"), F.when(repeat, F.col("first_id")).alias("refers_to"),
    )


#: A gzip member of no bytes, and the byte that ends every member written: the high byte of the length of under 16 MB.
EMPTY, LAST = zlib.compress(b"", wbits=31), "\x00"


def gzip_member(record: bytes) -> bytes:
    """The record as one gzip member, without its last byte, ``LAST``.

    The text writer needs a separator, and puts that byte back.  Where a record is so long
    that its member ends otherwise, an empty member follows.
    """
    member = zlib.compress(record, wbits=31)
    return member[:-1] if member.endswith(LAST.encode()) else member + EMPTY[:-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([gzip_member(r.as_py()) for r in batch["value"]], pa.binary())], names=["value"])


def write_warc(records: DataFrame, path: str, date: str = DATE, compression: str = "gzip") -> None:
    """Write planned records as WARC/1.1 archives, one per task: one gzip member a record, or plain with ``none``.

    A failed task's files are never committed, so lost executors leave no half
    archives.  A revisit keeps the HTTP head with the payload's length, not the payload.
    """
    is_revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(SEPARATOR))
    block_bytes = F.octet_length(http) + F.when(is_revisit, 0).otherwise(F.col("payload_bytes"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    urn = lambda c: F.concat(F.lit(f"<{RECORD_URN}"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"), F.lit(CRLF),
        F.lit("WARC-Record-ID: "), urn(F.coalesce(F.col("page_id").cast("string"), F.lit("none"))), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}"),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%0A")), line("WARC-Refers-To", urn(F.col("refers_to"))),
        F.when(is_revisit, f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}").otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        block_bytes.cast("string"), F.lit(SEPARATOR), http,
    )
    body = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload")).cast("string")
    out, separator = records.select(F.concat(head, body).alias("value")), SEPARATOR
    if compression == "gzip":
        members = out.select(F.concat("value", F.lit(SEPARATOR)).cast("binary").alias("value")).mapInArrow(_members, "value binary")
        out, separator, compression = members.select(F.col("value").cast("string")), LAST, "none"  # the cast keeps all bytes
    out.write.option("lineSep", separator).option("compression", compression).text(path)


class Damaged(Exception):
    """A check of a record failed."""


class Short(Damaged):
    """The data ends before the record does."""


def _headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for part in block.split(b"\r\n"):
        name, colon, value = part.partition(b":")
        if not colon or not name.strip():
            raise Damaged("header line")
        out.setdefault(name.strip().decode("latin-1").lower(), value.strip().decode("utf-8", "replace"))
    return out


def _record(data, at: int, whole: bool) -> tuple[dict, int]:
    """The record whose version line starts at ``at``, and where the next one may start."""
    version = VERSION.match(data, at)
    if not version:
        raise (Short if len(data) - at < 10 else Damaged)("version line")
    stop = data.find(b"\r\n\r\n", version.end())
    if stop < 0:
        raise Short("header block")
    head = _headers(bytes(data[version.end() : stop]))
    if not head.get("content-length", "").isdigit() or "warc-type" not in head or "warc-record-id" not in head:
        raise Damaged("mandatory header")
    begin, end = stop + 4, stop + 4 + int(head["content-length"])
    if end > len(data):
        raise Short("content length")
    if bytes(data[end : end + 4]) != b"\r\n\r\n" and not (whole and end == len(data)):
        raise (Short if end + 4 > len(data) else Damaged)("record separator")
    block = bytes(data[begin:end])
    payload, declared = block, None
    if head.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise Damaged("HTTP head")
        found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        declared = int(found[1]) if found else None
    revisit = head["warc-type"] == "revisit"
    digest = "" if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if digest and stated and digest != stated:
        raise Damaged("payload digest")
    size = declared if revisit and declared is not None else len(payload)
    row = {
        "kind": "record", "record_id": head["warc-record-id"].strip("<>"), "record_type": head["warc-type"], "refers_to": head.get("warc-refers-to", "").strip("<>") or None,
        "target_uri": head.get("warc-target-uri"), "payload": payload, "payload_bytes": size, "payload_digest": digest or stated or None, "reason": None,
    }
    return row, min(end + 4, len(data))


NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def _member(data: bytes, at: int) -> Iterator[tuple[list[dict], int | None, str]]:
    """(records, end, reason) steps of the gzip member at ``at``.

    Inflated piece by piece; records go out as soon as they are whole, so records
    before a damaged byte are kept.  The last step has the member's end, or None if its
    compressed data is damaged.  A record that fails inside a sound member is left out
    with a reason, and the next version line of the member is searched.
    """
    inflate, plain, dropped, pos, k, resync = zlib.decompressobj(31), bytearray(), 0, 0, at, -1
    while True:
        piece = data[k : k + PIECE]
        try:
            plain += inflate.decompress(piece)
        except zlib.error:
            yield [], None, "gzip data"
            return
        k += len(piece)
        rows, lost = [], ""
        while pos < len(plain):
            if resync < 0:
                try:
                    row, pos = _record(plain, pos, inflate.eof)
                    rows.append(row)
                    continue
                except Damaged as e:
                    if isinstance(e, Short) and not inflate.eof:
                        break
                    resync, lost = dropped + pos, f"{lost}; {e}".lstrip("; ")
            found = VERSION.search(plain, pos + 1)
            if not found and not inflate.eof:
                pos = max(pos, len(plain) - 16)
                break
            pos, resync = (found.start() if found else len(plain)), -1
        del plain[:pos]
        dropped, pos = dropped + pos, 0
        if inflate.eof:
            yield rows, k - len(inflate.unused_data), lost
            return
        if rows or lost:
            yield rows, at, lost
        if not piece:
            yield [], None, "gzip end"
            return


def parse_archive(name: str, data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, in byte order; entries and gaps together cover every byte.

    Records of one gzip member share its offset and length.  A gap inside a sound
    member has the member's offset and length 0, as none of the archive's bytes is lost.
    """
    at, bad, reason = 0, None, ""
    while at < len(data):
        rows, end, why, held = [], None, "", []
        if data[at : at + 3] == GZIP:
            for rows, end, why in _member(data, at):
                held += [{**r, "archive": name, "offset": at, "length": 0} for r in rows]
                if why and end is not None:
                    held.append(_gap(name, at, at, f"inside member: {why}"))
        else:
            try:
                row, end = _record(data, at, False)
                held = [{**row, "archive": name, "offset": at, "length": 0}]
            except Damaged as e:
                why = str(e)
        if (held or end is not None) and bad is not None:
            yield _gap(name, bad, at, reason)
            bad = None
        if held and end is not None:
            held[0]["length"] = end - at
        yield from held
        if end is None:
            bad, reason = (at, why) if bad is None else (bad, reason)
            found = NEXT.search(data, at + 1)
            end = found.start() if found else len(data)
        at = end
    if bad is not None:
        yield _gap(name, bad, len(data), reason)


def _gap(name: str, start: int, end: int, reason: str) -> dict:
    return dict.fromkeys(x.split()[0] for x in SCHEMA.split(", ")) | {"kind": "gap", "archive": name, "offset": start, "length": end - start, "reason": reason}


def read_warc(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` of all archives under ``path`` (plain or gzip members).

    One archive is parsed in one task, so its size bounds the task's memory; write_warc
    writes one archive a task.  Repeated or empty archives are read as they are.
    """
    fields = [pa.field(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                rows, held = [], 0
                for row in parse_archive(name, content.as_py()):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held >= batch_bytes or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    # one archive to a batch: a batch of many would hold them all in memory at once
    return files.mapInArrow(parse, SCHEMA)
