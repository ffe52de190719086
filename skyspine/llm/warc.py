"""WARC archives: written as gzip members, read back by byte ranges.

Writer: one record per row; equal payloads are stored once and the others revisit it. Each task writes one archive.
Reader: the archives are cut into byte ranges, one task each. A task looks for gzip magic from its range's start, takes a
candidate for a record only if its decoded head is a WARC header and another member or the file's end follows it, and owns the
records that start inside its range, reading past its end for the last one. Any range size gives the same records; only an archive
that lies whole and unpacked inside a payload could be taken for records, by a range that starts inside its carrier.

Odd rows: a null payload is an empty one; a null id is written as a missing id and comes back null; rows that repeat the
largest id of a payload are all responses; an empty table gives no records; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from skyspine.llm import common
from skyspine.session import scratch

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
#: Bytes fetched from an archive at a time.
READ_BYTES = 1 << 20

FILES = common.arrow_schema(path=pa.string(), size=pa.int64(), records=pa.int64())
_FILES_DDL = "path string, size long, records long"
RECORDS = common.arrow_schema(path=pa.string(), start=pa.int64(), record_type=pa.string(), id=pa.int64(), url=pa.string(),
                              payload_digest=pa.string(), payload_bytes=pa.int64(), refers_to=pa.int64(), payload=pa.binary())
_RECORDS_DDL = ("path string, start long, record_type string, id long, url string, payload_digest string, payload_bytes long, "
                "refers_to long, payload binary")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the folder on it."""
    if re.match(r"[a-z0-9+.-]+:", folder):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return fs.LocalFileSystem(), folder


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(x: int | None) -> str:
    return "<urn:row:none>" if x is None else f"<urn:row:{x}>"


def _row_id(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:row:(-?[0-9]+)>", text or "")
    return int(m[1]) if m else None


def member(kind: str, row_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One record as a gzip member of its own."""
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(row_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?&=#%+,;@~!$()*[]') if url else ''}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0) -> DataFrame:
    """Writes one archive per task below ``folder`` and returns (path, size, records).

    Of equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response. That id is found on
    digests alone: an aggregate, then a join whose hot side the adaptive planner can split. A task that is run again
    writes a new file; only the files of the tasks that counted are returned.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    largest = (rows.where(F.col("size") >= min_bytes).groupBy("digest")
               .agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = rows.join(largest, "digest", "left").select("id", "url", "payload", "first")
    spark = pages.sparkSession

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _store(folder)
        system.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        size = records = 0
        sink = None
        for batch in it:
            for row in batch.to_pylist():
                sink = sink or system.open_output_stream(f"{base}/{name}", compression=None)
                first = row["first"]
                kind = "response" if first is None or first == row["id"] else "revisit"
                data = member(kind, row["id"], row["url"], digest_of(row["payload"]), len(row["payload"]), first, row["payload"])
                sink.write(data)
                size, records = size + len(data), records + 1
        if sink is not None:
            sink.close()
            yield common.record(FILES, [f"{folder.rstrip('/')}/{name}"], [size], [records])

    return common.stored(common.prepare(spark).createDataFrame([], _FILES_DDL).unionAll(rows.mapInArrow(write, _FILES_DDL)), "warc-files")


def head_of(raw: bytes) -> dict[str, str] | None:
    """The named fields of a WARC header, or None if it is none."""
    if not raw.startswith(b"WARC/1.") or b"\r\n\r\n" not in raw:
        return None
    lines = raw[:raw.index(b"\r\n\r\n")].decode("utf-8", "replace").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields if fields.get("WARC-Type") and fields.get("Content-Length", "").isdigit() else None


class _Window:
    """Bytes of a file from one place on, fetched as they are asked for."""

    def __init__(self, file: io.RawIOBase, start: int, size: int):
        self.file, self.base, self.size, self.held = file, start, size, b""
        file.seek(start)

    def upto(self, end: int) -> bool:
        """Whether bytes before ``end`` are held, after reading if need be."""
        while self.base + len(self.held) < min(end, self.size):
            more = self.file.read(READ_BYTES)
            if not more:
                break
            self.held += more
        return self.base + len(self.held) >= end

    def forget(self, before: int) -> None:
        if before > self.base:
            self.held = self.held[before - self.base:]
            self.base = before


def _decode(window: _Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record whose gzip member starts at ``at``: header, body and the place after it; None if there is none."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    checked = False
    try:
        while not unpack.eof:
            if not window.upto(pos + 1):
                return None
            chunk = window.held[pos - window.base:pos - window.base + (1 << 16)]
            out.append(unpack.decompress(chunk))
            pos += len(chunk)
            if not checked and sum(map(len, out)) >= 7:
                if not b"".join(out).startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    raw = b"".join(out)
    fields = head_of(raw)
    if fields is None:
        return None
    after = pos - len(unpack.unused_data)
    if window.upto(after + 1) and not (window.upto(after + len(MAGIC)) and window.held.startswith(MAGIC, after - window.base)):
        return None
    begin = raw.index(b"\r\n\r\n") + 4
    return fields, raw[begin:begin + int(fields["Content-Length"])], after


def records_in(file: io.RawIOBase, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records that start in [start, end) of a file of ``size`` bytes."""
    window, at = _Window(file, start, size), start
    while at < end:
        window.upto(min(end, at + READ_BYTES) + len(MAGIC) - 1)
        found = window.held.find(MAGIC, at - window.base)
        if found < 0 or window.base + found >= end:
            at = max(at + 1, window.base + len(window.held) - len(MAGIC) + 1)
            if found >= 0 or window.base + len(window.held) >= size:
                return
            window.forget(at)
            continue
        at = window.base + found
        got = _decode(window, at)
        if got is None:
            at += 1
        else:
            fields, body, after = got
            yield at, fields, body
            at = after
        window.forget(min(at, window.base + len(window.held)))


def read_archives(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the archives in ``files`` (path, size): see ``_RECORDS_DDL``. Ranges are dealt out by shuffle."""
    common.prepare(spark)
    ranges = (files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
              .where("size > 0"))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                system, path = _store(r["path"])
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for at, fields, body in records_in(file, r["start"], r["start"] + range_bytes, r["size"]):
                        kind, url = fields["WARC-Type"], fields.get("WARC-Target-URI")
                        rows.append((r["path"], at, kind, _row_id(fields.get("WARC-Record-ID")), unquote(url) if url is not None else None,
                                     fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
                                     int(fields["X-Payload-Length"]) if fields.get("X-Payload-Length", "").isdigit() else len(body),
                                     _row_id(fields.get("WARC-Refers-To")), body))
                        held += len(body)
                        if held > READ_BYTES or len(rows) >= common.BATCH_ROWS:
                            yield common.record(RECORDS, *zip(*rows))
                            rows, held = [], 0
                if rows:
                    yield common.record(RECORDS, *zip(*rows))

    tasks = max(1, ranges.count())  # a number of its own keeps the small ranges from being put together again
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, _RECORDS_DDL)


def query(pages: DataFrame) -> DataFrame:
    """Round trip of the pages. ``payload_bytes`` is null where a response's payload as read has another length; ``payload_sha1`` is
    the digest of that payload, to be held against the record's own ``payload_digest``."""
    spark = pages.sparkSession
    files = write_archives(pages, scratch(spark, "warc"))
    back = read_archives(spark, files)
    whole = (F.col("record_type") == "revisit") | ((F.octet_length("payload") == F.col("payload_bytes")))
    return back.select(F.col("id").alias("page_id"), F.when(whole, F.col("payload_bytes")).alias("payload_bytes"),
                       "payload_digest", "record_type", "refers_to", F.when(F.col("record_type") == "response", F.sha1("payload")).alias("payload_sha1"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS hex FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST(CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS INTEGER) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN first = page_id OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to,
       CASE WHEN first = page_id OR first IS NULL THEN hex END AS payload_sha1
FROM g
"""
