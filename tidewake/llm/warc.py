"""Operator 1: WARC archives by way of a chunked record table.

A payload is never handed over as one value: the JVM cuts it into (record, chunk number) rows of at most ``chunk_bytes``,
the writer streams these rows into a gzip member per record, and the reader gives (record, chunk number) rows again.  Each
chunk row carries the SHA-1 of its record up to and including that chunk, so the last chunk's digest is the payload's.

Records with equal payloads of at least ``min_revisit`` bytes share one response, that of the largest key; the others become
revisit records with no block.  Equal payloads are found by SHA-256, combined before the shuffle, and joined back by key.

Archives go to a folder that all executors share, one file per task attempt (named by attempt, rolled over at
``max_archive`` bytes).  Only files listed by the attempts that Spark committed are read, so a lost or repeated task leaves no
record twice.  The folder may be any URI that ``pyarrow.fs`` opens.

A null payload is empty.  Null keys and repeated rows each give a record; equal rows with the largest key are all responses.
An empty table writes no archive and reads back as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import in_batches, shared_path

CHUNK_BYTES = 64 * 1024
MIN_REVISIT = 1000
MAX_ARCHIVE = 1 << 30
_BLOCK = 1 << 20
_MANIFEST = "path string, records bigint, bytes bigint"
_CHUNKS = (
    "record_id string, record_key string, url string, record_type string, refers_to string, declared_digest string, "
    "payload_bytes bigint, chunk_no bigint, data binary, digest string, is_last boolean"
)


def plan_records(pages: DataFrame, key: str, url: str, payload: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """One row per record: key, url, payload (binary), record_type and refers_to."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    sums = rows.select("key", F.sha2("payload", 256).alias("sum"), F.octet_length("payload").alias("size")).where(F.col("size") >= min_revisit)
    shared = sums.groupBy("sum").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    refs = sums.join(shared, "sum").where(~F.col("key").eqNullSafe(F.col("first"))).select("key", "sum", "first").distinct()
    rows = rows.withColumn("sum", F.sha2("payload", 256))
    on = rows["key"].eqNullSafe(refs["key"]) & (rows["sum"] == refs["sum"])
    return rows.join(refs, on, "left").select(
        rows["key"], "url", "payload",
        F.when(refs["sum"].isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("first").cast("string").alias("refers_to"))


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Record rows as chunk rows; a record's chunks follow each other in its partition."""
    n = F.greatest(F.ceil(F.octet_length("payload") / F.lit(chunk_bytes)), F.lit(1))
    # the digest is taken below the explode: beside it, the plan would hash the whole payload once per chunk
    whole = records.select(
        F.col("key").cast("string").alias("key"), "url", "record_type", "refers_to",
        F.octet_length("payload").cast("bigint").alias("size"), F.sha1("payload").alias("sha1"), "payload")
    rows = whole.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).alias("chunk_no"))
    cut = F.substring(F.col("payload"), (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    last = (F.col("chunk_no") + 1) * chunk_bytes >= F.col("size")
    return rows.select("key", "url", "record_type", "refers_to", "size", "sha1", "chunk_no", cut.alias("data"), last.alias("last"))


def _record_id(key: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'record:' + ('' if key is None else key))}>"


def _line(value: str) -> str:
    return re.sub(r"[\r\n]", lambda m: "%0D" if m[0] == "\r" else "%0A", value)


def _header(key, url, kind, refers_to, size, sha1, date) -> bytes:
    b32 = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(key)}", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha1:{b32}", f"X-Payload-Length: {size}"]
    if key is not None:
        lines.append(f"X-Record-Key: {_line(key)}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Key: {_line(refers_to)}", "Content-Length: 0"]
    else:
        lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


class _Archive:
    """One open archive file; each record is a gzip member of its own."""

    def __init__(self, store, path: str):
        self.path, self.out, self.records, self.bytes, self.z = path, store.open_output_stream(path, compression=None), 0, 0, None

    def put(self, data: bytes):
        if packed := self.z.compress(data):
            self.out.write(packed)
            self.bytes += len(packed)

    def begin(self, header: bytes):
        self.z, self.digest = zlib.compressobj(3, zlib.DEFLATED, 31), hashlib.sha1()
        self.put(header)

    def end(self):
        self.put(b"\r\n\r\n")
        tail = self.z.flush()
        self.out.write(tail)
        self.bytes += len(tail)
        self.records += 1


def write_archives(chunks: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", max_archive: int = MAX_ARCHIVE) -> DataFrame:
    """Streams chunk rows into archives below ``folder``; gives the stored list (path, records, bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        done, now = [], None
        for batch in batches:
            cols = [batch.column(c) for c in ("key", "url", "record_type", "refers_to", "size", "sha1", "chunk_no", "data", "last")]
            for i in range(batch.num_rows):
                key, url, kind, refers_to, size, sha1, no, data, last = (c[i].as_py() for c in cols)
                if no == 0:
                    if now is None or now.bytes >= max_archive:
                        if now is not None:
                            now.out.close()
                        now = _Archive(store, f"{name}-{len(done):04d}.warc.gz")
                        done.append(now)
                    now.begin(_header(key, url, kind, refers_to, size, sha1, date))
                now.digest.update(data)
                if kind == "response":
                    now.put(data)
                if last:
                    if now.digest.hexdigest() != sha1:
                        raise ValueError(f"record {key}: the chunks' digest is not the payload's")
                    now.end()
        if now is not None:
            now.out.close()
        yield pa.RecordBatch.from_pydict(
            {"path": [a.path for a in done], "records": [a.records for a in done], "bytes": [a.bytes for a in done]},
            schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    spark = chunks.sparkSession
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    in_batches(chunks).mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


class _Members:
    """A stream over the unpacked bytes of all gzip members of a file, in blocks."""

    def __init__(self, raw):
        self.raw, self.z, self.buf, self.packed = raw, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.z.eof:
                self.packed, self.z = self.z.unused_data, zlib.decompressobj(31)
            if not self.packed:
                self.packed = self.raw.read(_BLOCK)
                if not self.packed:
                    return False
            got = self.z.decompress(self.packed, _BLOCK)
            self.packed = b"" if self.z.eof else self.z.unconsumed_tail
            if got:
                self.buf += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buf.find(mark)) < 0:
            if not self.more():
                return None
        got, self.buf = self.buf[:at], self.buf[at + len(mark):]
        return got

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and self.more():
            pass
        got, self.buf = self.buf[:n], self.buf[n:]
        if len(got) < n:
            raise ValueError("the archive ends inside a record")
        return got


def _read_chunks(raw, chunk_bytes: int):
    """Chunk rows of one archive stream, in the order of _CHUNKS."""
    s = _Members(raw)
    while (head := s.until(b"\r\n\r\n")) is not None:
        h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        left, no, digest = int(h["Content-Length"]), 0, hashlib.sha1()
        kind = h["WARC-Type"]
        declared = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        while True:
            data = s.take(min(left, chunk_bytes))
            left -= len(data)
            digest.update(data)
            upto = digest.copy().hexdigest() if kind == "response" else declared
            if not left and upto != declared:
                raise ValueError(f"{h['WARC-Record-ID']}: the payload's digest is not the declared one")
            yield (h["WARC-Record-ID"], h.get("X-Record-Key"), h.get("WARC-Target-URI"), kind, h.get("X-Refers-To-Key"), declared,
                   int(h["X-Payload-Length"]), no, data, upto, not left)
            no += 1
            if not left:
                break
        s.take(4)


def read_archives(archives: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of the listed archives; a task streams whole archives, each of a bounded size."""
    types = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.binary(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip([x.split()[0] for x in _CHUNKS.split(", ")], types)))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as raw:
                    for row in _read_chunks(raw, chunk_bytes):
                        rows.append(row)
                        held += len(row[8]) + 200
                        if held >= 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    spread = archives.repartition(max(1, archives.count()))  # one row per archive
    return spread.mapInArrow(read, _CHUNKS)


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and gives the chunk rows read back from them."""
    folder = shared_path(pages.sparkSession, "warc")
    listed = write_archives(chunk_rows(plan_records(pages, key, url, payload)), folder)
    return read_archives(listed, folder)
