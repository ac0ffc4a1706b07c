"""WARC archives, and the chunked record table read from them.

Pages become records of gzip-compressed archives in a shared folder, one compressed member each. Of records with equal
payloads, the one with the smallest page id is a response, and the others are revisits that name it and carry its
digest but no payload. Reading streams an archive and gives a row per chunk of a record: record, chunk number, bytes
so far and the SHA-1 of the payload so far. Neither side of the archive holds more of a payload than a chunk,
however large the record is; what a record is as a whole stands in its last chunk's row.

An archive's name carries the attempt that wrote it, and only archives named in the stored manifest count, so tasks can
be run again anywhere.

Defined results: a null payload is empty. Empty payloads are equal to each other. A null page id is no candidate
for the smallest; if all records of a payload lack one, all are responses. Repeated rows with the smallest page id are
responses each. An empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import prepared, scratch, stored
from windrow.llm.records import opened

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 28  # of payload; then the next archive begins
READ_BYTES = 1 << 18
HEADER_BYTES = 1 << 20
LEVEL = 4
MANIFEST = "path string, n_records long"
CHUNKS = (
    "path string, record_no long, record_id string, page_id string, url string, record_type string, refers_to string, "
    "chunk_no long, data binary, bytes_so_far long, digest_so_far string, last boolean"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "1970-01-01T00:00:00Z"  # archives of the same pages are the same


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record_id(page_id: str) -> str:
    return f"<urn:page:{quote(page_id, safe='')}>"


def record_head(row: dict, size: int, digest: str) -> tuple[bytes, bytes]:
    """The record's header, and the HTTP header that begins its block."""
    revisit = row["first"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Date: {WRITTEN}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
        f"Payload-Length: {size}",
    ]
    if row["page_id"] is not None:
        lines.append(f"WARC-Record-ID: {record_id(row['page_id'])}")
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['url'], safe=URI_SAFE)}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(row['first'])}", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


URI_SAFE = ":/?#[]@!$&'()*+,;=-._~"


def write_archives_of(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get()
    out, path, n, written, number = None, "", 0, 0, 0
    done: list[tuple[str, int]] = []
    for batch in batches:
        heads = batch.drop_columns(["html"]).to_pylist()
        for row, payload in zip(heads, batch.column("html"), strict=True):
            data = memoryview(payload.as_buffer() or b"")
            if out is None:
                path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                system, name = opened(path)
                out = system.open_output_stream(name, compression=None)
            head, http = record_head(row, len(data), row["digest"])
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            out.write(packer.compress(head + http))
            if row["first"] is None:
                for at in range(0, len(data), CHUNK_BYTES):
                    out.write(packer.compress(data[at : at + CHUNK_BYTES]))
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            n, written = n + 1, written + len(data)
            if written >= ARCHIVE_BYTES:
                out.close()
                done.append((path, n))
                out, n, written, number = None, 0, 0, number + 1
    if out is not None:
        out.close()
        done.append((path, n))
    if done:
        paths, counts = zip(*done, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64())], names=["path", "n_records"])


def write_archives(pages: DataFrame, folder: str | None = None, revisit_bytes: int = 0) -> DataFrame:
    """Writes every row of ``pages(page_id, url, html)``; returns the stored manifest, a row per archive.

    Payloads smaller than ``revisit_bytes`` are always written as responses. The smallest page of a payload is found
    from digests alone and joined back, where adaptive execution splits a payload that many pages share.
    """
    spark = pages.sparkSession
    prepared(spark)
    folder = folder or scratch(spark, "archives")
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string"), html.alias("html"))
    digest = F.concat(F.sha1("html"), F.lit("/"), F.octet_length("html").cast("string"))
    firsts = (
        rows.select("page_id", digest.alias("payload"), F.octet_length("html").alias("size"))
        .filter(F.col("size") >= revisit_bytes)
        .groupBy("payload")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("payload", F.col("first").cast("string"))
    )
    named = rows.withColumn("payload", digest).join(firsts, "payload", "left")
    page = F.col("page_id").cast("string")
    records = named.select(
        page.alias("page_id"),
        "url",
        "html",
        F.when(page.eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first"),
        F.substring_index("payload", "/", 1).alias("sha1"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def with_digest() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                digests = [base32(bytes.fromhex(x)) for x in batch.column("sha1").to_pylist()]
                yield batch.append_column("digest", pa.array(digests, pa.string()))

        return write_archives_of(with_digest(), folder)

    return stored(records.mapInArrow(run, MANIFEST), "manifest")


class Stream:
    """Bytes of an archive in turn, inflated a bounded piece at a time."""

    def __init__(self, file):
        self.file, self.waiting, self.buffer = file, b"", b""
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        """Adds a piece to the buffer; false at the end of the file."""
        while True:
            data = self.inflate.unconsumed_tail or self.inflate.unused_data or self.file.read(READ_BYTES)
            if not data:
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            piece = self.inflate.decompress(data, CHUNK_BYTES)
            if piece:
                self.buffer += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which is passed; None at the end of the file."""
        at = self.buffer.find(mark)
        while at < 0:
            if len(self.buffer) > HEADER_BYTES:
                raise ValueError("damaged record: a header doesn't end")
            if not self.more():
                if self.buffer:
                    raise ValueError("damaged record: the archive ends inside a header")
                return None
            at = self.buffer.find(mark)
        head, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return head

    def take(self, size: int) -> bytes:
        """The next bytes, at most a chunk."""
        while len(self.buffer) < size:
            if not self.more():
                raise ValueError("damaged record: the archive ends inside a block")
        out, self.buffer = self.buffer[:size], self.buffer[size:]
        return out


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def page_of(name: str | None) -> str | None:
    return None if name is None else unquote(name.removeprefix("<urn:page:").removesuffix(">"))


def record_chunks(path: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of the chunked record table of one archive. An empty payload and a revisit have a single, empty chunk."""
    system, name = opened(path)
    with system.open_input_stream(name, compression=None) as file:
        stream, number = Stream(file), 0
        while (head := stream.until(b"\r\n\r\n")) is not None:
            record = fields(head)
            http = stream.until(b"\r\n\r\n")
            left = int(record["content-length"]) - len(http) - 4
            kind, known = record["warc-type"], record["warc-payload-digest"].removeprefix("sha1:")
            refers = page_of(record.get("warc-refers-to"))
            url = unquote(record["warc-target-uri"]) if "warc-target-uri" in record else None
            about = (path, number, record.get("warc-record-id"), page_of(record.get("warc-record-id")), url, kind, refers)
            sha, size, chunk_no = hashlib.sha1(), 0, 0
            while True:
                data = stream.take(min(left, chunk_bytes))
                sha.update(data)
                left, size = left - len(data), size + len(data)
                last = left == 0
                digest = base32(sha.digest())
                if last and kind == "revisit":
                    size, digest = int(record["payload-length"]), known
                if last and digest != known:
                    raise ValueError(f"damaged record {number} of {path}: payload digest")
                yield (*about, chunk_no, data, size, digest, last)
                chunk_no += 1
                if last:
                    break
            if stream.take(4) != b"\r\n\r\n":
                raise ValueError(f"damaged record {number} of {path}: no end mark")
            number += 1


def chunk_table(spark: SparkSession, manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """All chunks of the archives in the manifest. Without ``data`` the payload's bytes stay in the task."""
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split(" ")[0] for x in CHUNKS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                held = 0
                for row in record_chunks(path, chunk_bytes):
                    held += len(row[8])
                    rows.append(row if data else (*row[:8], None, *row[9:]))
                    if len(rows) >= 2000 or data and held >= 4 * chunk_bytes:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    archives = manifest.select("path").repartition(max(1, manifest.count()))
    return archives.mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """A row per record: what the last chunk says of the whole payload."""
    return chunks.filter("last").select(
        "page_id",
        F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
