"""WARC archives and a chunked record table.

Writing streams each payload through an incremental compressor, one gzip member a record; equal
payloads become revisit records that refer to the first. Reading yields rows of record and chunk
number with at most `chunk` bytes, the bytes and the SHA-256 so far, and never holds a whole record.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, join_groups, load, make_dir, open_fs, shared_dir

#: Payloads under so many bytes are never revisits; bytes of a chunk; of a file before the next begins; gzip level.
LEAST = 100
CHUNK = 1 << 20
FILE_BYTES = 128 << 20
LEVEL = 3
_PIECE = 1 << 16
_END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _head(lines: list[tuple[str, object]]) -> bytes:
    """Header lines; line breaks, which a header cannot hold, are escaped."""
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    return "".join(f"{k}: {clean(v)}\r\n" for k, v in lines if v is not None).encode()


def write_record(sink, page_id: int | None, url: str | None, payload: memoryview, digest: str, refers_to: int | None, date: str, level: int = LEVEL) -> int:
    """Writes one gzip member; returns its bytes."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    body = 0 if revisit else len(payload)
    head = b"WARC/1.1\r\n" + _head([("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Target-URI", url), ("Target-URI-JSON", json.dumps(url) if url and ("\r" in url or "\n" in url) else None), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", record_id(refers_to) if revisit else None), ("Page-ID", page_id), ("Refers-To-Page-ID", refers_to), ("Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + body)]) + b"\r\n"
    squeeze, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
    for part in (head, http, *(payload[at : at + _PIECE] for at in range(0, body, _PIECE)), _END):
        if out := squeeze.compress(part):
            size += len(out)
            sink.write(out)
    out = squeeze.flush()
    sink.write(out)
    return size + len(out)


class _Stream:
    """The decompressed bytes of a file of gzip members, a bounded piece at a time."""

    def __init__(self, source) -> None:
        self.source, self.raw, self.held = source, b"", bytearray()
        self.open = None

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(_PIECE)
                if not self.raw:
                    return False
            if self.open is None:
                self.open = zlib.decompressobj(31)
            out = self.open.decompress(self.raw, _PIECE)
            if self.open.eof:
                self.raw, self.open = self.open.unused_data, None
            else:
                self.raw = self.open.unconsumed_tail
            if out:
                self.held += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)


def read_chunks(source, chunk: int = CHUNK) -> Iterator[tuple]:
    """(record id, page id, type, refers to, url, stated digest, stated bytes, chunk number, last, bytes, bytes so far, digest so far)."""
    stream = _Stream(source)
    while (head := stream.until(_END)) is not None:
        f = _fields(head)
        http = stream.until(_END)
        left = int(f["Content-Length"]) - len(http)
        digest, done, number = hashlib.sha256(), 0, 0
        page, refers = f.get("Page-ID"), f.get("Refers-To-Page-ID")
        key = (f["WARC-Record-ID"], page and int(page), f["WARC-Type"], refers and int(refers), json.loads(f["Target-URI-JSON"]) if "Target-URI-JSON" in f else f.get("WARC-Target-URI"), f["WARC-Payload-Digest"].partition(":")[2], int(f["Payload-Length"]))
        while True:
            part = stream.take(min(chunk, left))
            if left and not part:
                raise EOFError(f"record {key[0]} is cut off")
            left -= len(part)
            done += len(part)
            digest.update(part)
            yield (*key, number, left == 0, part, done, digest.hexdigest())
            number += 1
            if not left:
                break
        stream.take(len(_END))


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds html_digest and refers_to: of equal payloads of at least `least` bytes all but those of the smallest page_id refer to it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("large", F.octet_length("html") >= least)
    # records without an earlier twin need no partner, and of a hot payload no more than its digest meets
    firsts = rows.where("large").groupBy("large", "digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = join_groups(rows, checkpoint(firsts), ["large", "digest"], pages.count(), "page_id", alone=~F.col("large"))
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least: int = LEAST, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Archives page_id, url, html (null: empty) under `path`/data, with a table of committed files in `path`/manifest.

    Repeated rows are records of their own; rows of the group's smallest page_id are all responses.
    A null page_id or url is left out of the record's fields. Other columns are ignored; an empty
    table gives no archives. A payload is streamed, so only one row's text is held at a time.
    """
    data = make_dir(f"{path}/data")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, sink, name, size, n = TaskContext.get().partitionId(), 0, None, "", 0, 0

        def done() -> pa.RecordBatch:
            sink.close()
            return pa.record_batch({"file": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for page, url, html, digest, refers in zip(*(c if i == 2 else c.to_pylist() for i, c in enumerate(batch.columns)), strict=True):
                if sink is None:
                    name = f"part-{part:07d}-{seq:05d}-{uuid.uuid4().hex}.warc.gz"
                    fs, at = open_fs(f"{data}/{name}")
                    sink, size, n = fs.open_output_stream(at, compression=None), 0, 0
                size += write_record(sink, page, url, memoryview(html.as_buffer()), digest, refers, date)
                n += 1
                if size >= file_bytes:
                    yield done()
                    sink, seq = None, seq + 1
        if sink is not None:
            yield done()

    with_revisits(pages, least).mapInArrow(write, "file string, records long, bytes long").write.mode("overwrite").parquet(f"{path}/manifest")


CHUNKS = "record_id string, page_id long, record_type string, refers_to long, url string, stated_digest string, stated_bytes long, chunk_no int, last boolean, chunk binary, bytes_so_far long, digest_so_far string"


def read_warc(spark: SparkSession, path: str, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """The chunked record table of the committed archives; an empty payload is one empty chunk."""
    data = f"{path}/data"
    names = [f.split(" ")[0] for f in CHUNKS.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[f.split(" ")[1]]) for n, f in zip(names, CHUNKS.split(", "), strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = open_fs(f"{data}/{name}")
                with fs.open_input_stream(at, compression=None) as source:
                    rows, size = [], 0
                    for row in read_chunks(source, chunk):
                        size += len(row[9])
                        rows.append(row if payload else (*row[:9], None, *row[10:]))
                        if len(rows) >= 1024 or payload and size >= 16 * CHUNK:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    manifest = spark.read.parquet(f"{path}/manifest").select("file")
    return manifest.repartition(max(1, min(manifest.count(), 1 << 20))).mapInArrow(read, CHUNKS)


def resolved(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of a chunked record table.

    A response's bytes and digest are those of the payload read, and must be the stated ones; a revisit's
    are those of the response it names, which must be there with them, else a ValueError tells.
    """
    ends = checkpoint(chunks.where("last").select("page_id", "record_type", "refers_to", "stated_digest", "stated_bytes", "bytes_so_far", "digest_so_far"))
    own = F.col("record_type") == "response"
    if not ends.where(own & ((F.col("stated_digest") != F.col("digest_so_far")) | (F.col("stated_bytes") != F.col("bytes_so_far")))).isEmpty():
        raise ValueError("a response's payload is not what its header states")
    named = ends.where(~own).select(F.col("refers_to").alias("page_id"), F.col("stated_digest").alias("digest"), F.col("stated_bytes").alias("bytes")).distinct()
    there = ends.where(own).select("page_id", F.col("digest_so_far").alias("digest"), F.col("bytes_so_far").alias("bytes"))
    # the archives' list says nothing of their records' size, so Spark must not take them for small
    if not named.join(there.hint("merge"), ["page_id", "digest", "bytes"], "left_anti").isEmpty():
        raise ValueError("a revisit names no response with its payload")
    return ends.select("page_id", F.when(own, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"), F.when(own, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"), "record_type", "refers_to")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_warc(load(spark, sf_dir, "pages"), path)
    return resolved(read_warc(spark, path, payload=False))


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
