"""Web archives: records written through Spark's own writer, and a salvage reader.

The writer makes uncompressed WARC/1.1 files: each row is one record's bytes without its last
line feed, which the text writer adds, so any store that Spark can write to will do. Payloads
that occur more than once are written once; the others are revisit records.

The reader takes plain and gzip files, whole or damaged. It checks each record (version line,
headers, length, closing line feeds, block digest; of gzip members the stream and checksum).
After a failed check it searches for the next version line, or the next gzip member that
holds a record, goes on from there, and logs the bytes it passed over as a gap. It does the
same inside a gzip member, and inside what a broken member still inflates to.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_root, staged

VERSION = b"WARC/1.1\r\n"
_START = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_NEXT = re.compile(rb"\nWARC/1\.[01]\r\n")
#: How far headers are looked for first; longer ones may go on to the next version line.
HEADER_USUAL = 1 << 16

RECORDS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("kind", T.StringType()),  # a record type, or gap
        T.StructField("reason", T.StringType()),  # of a gap
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


class Parsed(NamedTuple):
    headers: dict[str, str]
    block: bytes
    end: int


def parse_record(data: bytes, at: int) -> Parsed | str:
    """The record that begins at `at`, or why there is none."""
    if not _START.match(data, at):
        return "no version line"
    stop = data.find(b"\r\n\r\n", at, at + HEADER_USUAL)
    if stop < 0:
        following = _NEXT.search(data, at)
        stop = data.find(b"\r\n\r\n", at, following.start() + 1 if following else len(data))
    if stop < 0:
        return "headers do not end"
    headers: dict[str, str] = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        key = name.strip().lower().decode("latin-1")
        if key in headers and key != "warc-concurrent-to":  # two records run into one another
            return "repeated header"
        headers[key] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,15}", headers.get("content-length", "")) or "warc-type" not in headers:
        return "no length or type"
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "block does not end as it should"
    block = data[begin:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and not same_digest(digest[5:], block):
        return "block digest differs"
    return Parsed(headers, block, end + 4)


def same_digest(written: str, data: bytes) -> bool:
    found = hashlib.sha1(data, usedforsecurity=False)
    if len(written) == 40:
        return written.lower() == found.hexdigest()
    import base64

    return written.upper() == base64.b32encode(found.digest()).decode()


def _inflate(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What a gzip member that begins at `at` inflates to, where it ends, and whether it is whole and checked.

    Of a broken stream, all that inflates before the fault is given, and `at` for its unknown end.
    """
    stream, view, out = zlib.decompressobj(31), memoryview(data)[at:], []
    step, place, consumed = 1 << 16, 0, at
    while place < len(view) and not stream.eof:
        sound = stream.copy() if step > 1 else stream
        try:
            out.append(stream.decompress(view[place : place + step]))
        except zlib.error:
            if step == 1:
                break
            stream, step = sound, max(1, step // 64)  # nearer to the fault
            continue
        place += step
    if stream.eof:
        consumed += min(place, len(view)) - len(stream.unused_data)
    return b"".join(out), consumed, stream.eof


def _records(data: bytes) -> Iterator[tuple[int, int, Parsed | str]]:
    """(position, length, record or reason of a gap) over inflated bytes, by their version lines alone."""
    at, gap, why = 0, -1, ""
    while at < len(data):
        record = parse_record(data, at)
        if isinstance(record, str):
            if gap < 0:
                gap, why = at, record
            line = _START.search(data, at + 1)
            at = line.start() if line else len(data)
            continue
        if gap >= 0:
            yield gap, at - gap, why
            gap = -1
        yield at, record.end - at, record
        at = record.end
    if gap >= 0:
        yield gap, len(data) - gap, why


def salvage(data: bytes) -> Iterator[tuple[int, int, Parsed | str]]:
    """(position, length, record or reason of a gap) over a file, in order, without holes.

    The records of a gzip member that is whole all have the member's place and length, and so has
    each gap between them, whose reason tells its place in the inflated bytes. What a broken member
    still gives comes with length 0, before the gap that the member's bytes are part of. A record
    at the very end of what it gives is not taken, as neither a checksum nor a later byte vouches for it.
    """
    at, size, gap, why = 0, len(data), -1, ""
    given: list[Parsed] = []  # by the last broken member; its bytes may hold them unpacked, too
    while at < size:
        found: list[Parsed | str] = []
        if data.startswith(_MEMBER, at):
            inner, after, whole = _inflate(data, at)
            parts = list(_records(inner))
            reason = "broken gzip member"
            if not whole and parts and parts[-1][0] + parts[-1][1] == len(inner) and isinstance(parts[-1][2], Parsed):
                parts[-1] = (*parts[-1][:2], "not vouched for")
            if whole:
                reason = next((r for *_, r in parts if isinstance(r, str)), "gzip member without a record")
            found = [f"{r} (inflated bytes {p} to {p + n})" if isinstance(r, str) else r for p, n, r in parts]
            if not any(isinstance(r, Parsed) for r in found):
                found = []
            elif not whole:
                if gap >= 0:
                    yield gap, at - gap, why
                for record in found:
                    yield at, 0, record
                given = [r for r in found if isinstance(r, Parsed)]
                gap, why, found = at, reason, []
        else:
            record = parse_record(data, at)
            reason, after = (record, at) if isinstance(record, str) else ("", record.end)
            found = [] if isinstance(record, str) else [record]
            if gap >= 0 and found and any(r[:2] == record[:2] for r in given):
                at = after
                continue
        if found:
            if gap >= 0:
                yield gap, at - gap, why
                gap = -1
            for record in found:
                yield at, after - at, record
            at = after
            continue
        if gap < 0:
            gap, why = at, reason
        line, member_at = _START.search(data, at + 1), data.find(_MEMBER, at + 1)
        at = min([x for x in (line.start() if line else -1, member_at) if x >= 0], default=size)
    if gap >= 0:
        yield gap, size - gap, why


def _payload(record: Parsed) -> tuple[bytes | None, int | None]:
    """The payload of a response, and the length it had when it was captured."""
    if not record.headers.get("content-type", "").startswith("application/http"):
        return record.block, len(record.block)
    head, _, body = record.block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,15})[ \t]*\r?$", head)
    if record.headers["warc-type"] == "revisit":
        return None, int(told[1]) if told else None
    return body, len(body)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = RECORDS.fieldNames()
    for batch in batches:
        for file, data in zip(batch.path, batch.content, strict=True):
            rows, held = [], 0
            for at, length, record in salvage(data):
                if isinstance(record, str):
                    rows.append((file, at, length, "gap", record, *[None] * 6))
                else:
                    h = record.headers
                    payload, size = _payload(record)
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    if payload is not None:
                        found = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
                        if digest and not same_digest(digest, payload):
                            rows.append((file, at, length, "gap", "payload digest differs", *[None] * 6))
                            continue
                        digest = found
                    rows.append((file, at, length, h["warc-type"], None, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest or None, size, payload))
                    held += len(payload or b"")
                if held > 8_000_000 or len(rows) >= 5000:
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all files under `path`; damaged files give what can be salvaged.

    A task holds one file at a time; the writer keeps files small. An empty file gives no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return files.select("path", "content").mapInPandas(_read, RECORDS)


def _utf8(column):
    return F.encode(column, "UTF-8")


def with_revisits(pages: DataFrame, id_col: str, payload: str, *, least_bytes: int) -> DataFrame:
    """Adds _digest, _bytes and _first: the largest id with an equal payload, if that is another row.

    Only payloads that occur more than once are joined back, from a table, so a payload that a
    third of all rows share is a skewed side that adaptive execution splits.
    """
    rows = pages.withColumn("_digest", F.sha1(payload)).withColumn("_bytes", F.octet_length(payload).cast("long"))
    shared = staged(
        rows.where(F.col("_bytes") >= least_bytes)
        .groupBy("_digest", "_bytes")
        .agg(F.max(id_col).alias("_holder"), F.count("*").alias("_rows"))
        .where("_rows > 1 and _holder is not null")
        .select(F.col("_digest").alias("_d"), F.col("_bytes").alias("_b"), "_holder"),
        "shared",
    )
    joined = rows.join(shared, (F.col("_digest") == F.col("_d")) & (F.col("_bytes") == F.col("_b")), "left")
    return joined.withColumn("_first", F.when(~F.col(id_col).eqNullSafe(F.col("_holder")), F.col("_holder"))).drop("_d", "_b", "_holder")


#: What a record's own lines may take beside its payload and three times its url.
HEAD_BYTES = 2048
#: A reader's task holds a whole file, so files are bounded by bytes; a longer record has a file of its own.
FILE_BYTES = 64 << 20


def size_classes(records: int, file_bytes: int) -> list[tuple[int, int | None]]:
    """(records a file, bytes of a record up to which that many fit in `file_bytes`), least records last, without a bound."""
    fit = [records]
    while fit[-1] > 1:
        fit.append(max(1, fit[-1] // 16))
    return [(n, file_bytes // n if n > 1 else None) for n in fit]


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, records_per_file: int = 2000, file_bytes: int = FILE_BYTES) -> None:
    """A record per row; equal payloads of `least_bytes` or more are written once.

    No file is longer than `file_bytes` unless a single record is: records are written by classes
    of size, each with as many to a file as fit whatever their order. Classes that no payload can
    fall in are not written, so pages of usual size take one pass.

    A null html is an empty payload. A null url is written as the record's own id. Of equal
    payloads, the row with the largest id is the response; rows with a null id are responses
    unless another row with their payload has an id. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), _utf8(F.coalesce(html_col, F.lit(""))).alias("_payload"))
    longest = rows.agg(F.max(F.octet_length("_payload") + F.coalesce(F.octet_length("_url"), F.lit(0)) * 3)).first()[0]  # one number
    rows = with_revisits(rows, "_id", "_payload", least_bytes=least_bytes)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    again = F.col("_first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    rows = rows.withColumn("_block", F.when(again, _utf8(http)).otherwise(F.concat(_utf8(http), F.col("_payload"))))
    uri = F.coalesce(F.regexp_replace("_url", r"[\x00-\x20\x7F<>]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("_id").cast("string"), F.lit("none"))))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(VERSION.decode()),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("_id")),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", uri),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn("_first")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("_block"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit("\r\n"),
    )
    # the text writer puts a line feed after each row: the record's own last byte
    record = F.concat(_utf8(head), F.col("_block"), _utf8(F.lit("\r\n\r")))
    records = rows.select(record.cast("string").alias("value"))
    size, above, most = F.octet_length("value") + 1, -1, (longest or 0) + HEAD_BYTES
    for number, (fit, below) in enumerate(size_classes(records_per_file, file_bytes)):
        if number and most <= above:
            break
        part = records.where(size > above) if below is None else records.where((size > above) & (size <= below))
        part.write.option("maxRecordsPerFile", fit).text(f"{path}/records-{number}")
        above = below


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes `pages` as archives, reads them back, and returns a row per record with its page's id."""
    import uuid

    spark = pages.sparkSession
    path = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    whole = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return read_archives(spark, path).where("kind <> 'gap'").select(whole("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), whole("refers_to").alias("refers_to"), "target_uri", "file", "position")


__all__ = ["archived_pages", "parse_record", "read_archives", "salvage", "size_classes", "write_archives"]
