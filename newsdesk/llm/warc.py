"""WARC archives of pages: written with revisit records, read back sequentially (operator 10).

Each record is a gzip member of its own.  The reader never holds a file, nor a
record unless its payload is asked for: it decompresses step by step, cuts the
header (of any length, as long addresses make long ones) from the first bytes, counts the content length down, and feeds the payload
to its digest piece by piece.  Archives are written by tasks under names that no
other attempt uses, and closed at about ``ARCHIVE_BYTES``; only files in the
manifest, which Spark commits as a table, count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, staged, table

#: Payloads of fewer bytes are stored again rather than revisited.
MIN_REVISIT_BYTES = 1000
#: Bytes read from an archive at a time.
READ_BYTES = 1 << 18
#: Bytes of an archive from which a task begins another.
ARCHIVE_BYTES = 1 << 30
#: Revisits that are sent to every task (some 60 bytes each); with more, pages are joined with them by shuffle.
SENT_REVISITS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, http_length long, payload_digest string, payload binary"


def _uri(text: str | None) -> str:
    """A header-safe URI: control characters and white space are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "about:blank")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def write_record(write: Callable[[bytes], object], page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, date: str = DATE) -> int:
    """Writes a record as one gzip member, a response, or a revisit if ``refers_to`` is given; returns its bytes.  The payload is not copied as a whole."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _name(page_id), "WARC-Date": date, "WARC-Target-URI": _uri(url), "WARC-Payload-Digest": "sha1:" + base64.b32encode(sha1).decode()}
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _name(refers_to)}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(http) + (len(payload) if refers_to is None else 0))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z, size, view = zlib.compressobj(6, zlib.DEFLATED, 31), 0, memoryview(payload)
    pieces = (view[i : i + READ_BYTES] for i in range(0, len(payload), READ_BYTES)) if refers_to is None else ()
    for piece in (text.encode() + http, *pieces, b"\r\n\r\n"):
        if data := z.compress(piece):
            write(data)
            size += len(data)
    data = z.flush()
    write(data)
    return size + len(data)


def record_bytes(*record) -> bytes:
    """A record as bytes; arguments as those of write_record."""
    out = []
    write_record(out.append, *record)
    return b"".join(out)


def _members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The decompressed pieces of each gzip member, in order."""
    left = b""

    def pieces() -> Iterator[bytes]:
        nonlocal left
        z = zlib.decompressobj(31)
        while not z.eof:
            data = z.unconsumed_tail or left or stream.read(READ_BYTES)
            left = b""
            if not data:
                raise ValueError("the archive ends inside a record")
            if out := z.decompress(data, READ_BYTES):
                yield out
        left = z.unused_data

    while left or (left := stream.read(READ_BYTES)):
        yield pieces()


class _Pieces:
    """The bytes of a record, taken from its pieces by a mark or by a number."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def until(self, mark: bytes, most: int | None = None) -> bytes | None:
        """What stands before a mark (that ends within the next ``most`` bytes), the mark passed; None if there is none.  No byte is looked at twice."""
        looked = 0
        while (at := self.held.find(mark, max(0, looked - len(mark) + 1), most)) < 0:
            looked = len(self.held)
            piece = next(self.pieces, None) if most is None or looked < most else None
            if piece is None:
                return None
            self.held += piece
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces; fewer at the end."""
        while n > 0:
            piece = bytes(self.held[:n]) or next(self.pieces, b"")
            if not piece:
                return
            if self.held:
                del self.held[: len(piece)]
            elif len(piece) > n:
                piece, self.held = piece[:n], bytearray(piece[n:])
            n -= len(piece)
            yield piece


def read_records(stream: BinaryIO, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes, bytes | None]]:
    """(headers, HTTP header, payload) of each record; without ``payloads`` none is held.  Raises ValueError on a broken frame or a wrong digest."""
    for member in _members(stream):
        data = _Pieces(member)
        head = data.until(b"\r\n\r\n")
        lines = head.decode().split("\r\n") if head is not None else [""]
        if not lines[0].startswith("WARC/1."):
            raise ValueError("no WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        n = int(headers["Content-Length"])
        http = data.until(b"\r\n\r\n", n)
        if http is None:
            raise ValueError("a record has no HTTP header")
        left, sha1, kept = n - len(http) - 4, hashlib.sha1(), []
        if left < 0:
            raise ValueError("a record's length is wrong")
        for piece in data.take(left):
            left -= len(piece)
            sha1.update(piece)
            if payloads:
                kept.append(piece)
        if left or b"".join(data.take(5)) != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(sha1.digest()).decode():
            raise ValueError(f"{headers['WARC-Record-ID']}: the payload digest is wrong")
        yield headers, http, b"".join(kept) if payloads else None


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, sha1, refers_to) of pages whose payload an earlier choice already holds.

    Of pages with equal payloads of at least ``min_bytes``, the one with the
    largest page_id is stored.  Only digests are shuffled, combined before.
    """
    narrow = pages.select("page_id", "sha1", "n").filter(F.col("n") >= min_bytes)
    kept = narrow.groupBy("sha1", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return narrow.join(kept, ["sha1", "n"]).filter("page_id <> refers_to").select("page_id", "sha1", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) as .warc.gz files below ``path``; returns the committed manifest.

    A null html is an empty payload, and an address may be null (about:blank) or of any
    length.  Other columns are not read.  Rows with the largest page_id of a group are
    all responses, also when the row is repeated; so are rows without page_id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    found = staged(revisits(rows, min_bytes), "revisits")
    # Payloads stay where they are, unless there are too many revisits to send them all to every task.
    plan = rows.join(F.broadcast(found) if found.count() <= SENT_REVISITS else found.hint("shuffle_hash"), ["page_id", "sha1"], "left")

    def run(batches):
        from pyarrow import fs

        out, target, records, size, turn = None, "", 0, 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([target]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, payload, sha1, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                if out is None:
                    target, records, size, turn = f"{path}/part-{TaskContext.get().partitionId():05d}-{turn:03d}-{uuid.uuid4().hex}.warc.gz", 0, 0, turn + 1
                    store, name = fs.FileSystem.from_uri(target)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(name)
                size += write_record(out.write, page_id, url, payload, bytes.fromhex(sha1), refers, date)
                records += 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return staged(plan.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(run, MANIFEST), "manifest")


def scan_archives(manifest: DataFrame, payloads: bool = True, partitions: int | None = None) -> DataFrame:
    """The records of a manifest's archives, each file read by one task from start to end.

    The payload of a revisit is null here; payload_digest is lower-case hex.
    """
    # Files of up to ARCHIVE_BYTES: one to a task.
    n = partitions or max(1, manifest.count())

    def run(batches):
        from pyarrow import fs

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("http_length", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(name) as stream:
                    for headers, http, payload in read_records(stream, payloads):
                        length = re.search(rb"(?mi)^Content-Length: (\d+)\r?$", http + b"\r\n")
                        kind = headers["WARC-Type"]
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append((_number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], kind, _number(headers.get("WARC-Refers-To")), int(length[1]) if length else None, digest, payload if kind == "response" else None))
                        held += len(payload) if payloads else 64
                        if held >= 1 << 23:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    return manifest.select("path").repartition(n).mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit takes length and digest from the response it refers to; one whose
    response is missing or has another digest fails the job.
    """
    held = records.filter("record_type = 'response'").select(F.col("page_id").alias("held_id"), F.col("http_length").alias("held_length"), F.col("payload_digest").alias("held_digest")).distinct()
    back = records.filter("record_type = 'revisit'").join(held, (F.col("refers_to") == F.col("held_id")) & (F.col("payload_digest") == F.col("held_digest")), "left")
    length = F.when(F.col("held_length") == F.col("http_length"), F.col("held_length")).otherwise(F.raise_error(F.lit("a revisit record has no matching response")).cast("long"))
    own = records.filter("record_type = 'response'").select("page_id", F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return own.unionByName(back.select("page_id", length.alias("payload_bytes"), F.col("held_digest").alias("payload_digest"), "record_type", "refers_to"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}-warc")
    return resolved(staged(scan_archives(manifest, payloads=False).drop("payload"), "records"))


ORACLE_OP10 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, n, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.top <> p.page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n
"""
