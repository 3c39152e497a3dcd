"""WARC archives read as a table of chunks (operator 5).

Writing: one gzip member per record, as archives are usually kept. Reading: a file is
streamed in bounded pieces; a payload becomes rows (record_id, chunk_no, ...) of at
most ``CHUNK`` bytes that carry the running digest, so no record is ever held whole."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import shared

CHUNK = 256 << 10
VERSION = b"WARC/1.1\r\n"
FILE_BYTES = 1 << 30


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def decide(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """(row key, refers_to): of equal payloads the largest id is the response.

    Equal means equal SHA-1, length and 64-bit hash. A group is reduced to its largest
    id inside tasks; the join back is split where one payload is hot."""
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.unhex(F.sha1(body)).alias("sha"),
                        F.octet_length(body).alias("bytes"), F.xxhash64(body).alias("mark")).distinct()
    groups = rows.where(F.col("bytes") >= min_revisit).groupBy("sha", "bytes", "mark").agg(F.max("page_id").alias("first"))
    # one more hash in the key: both sides are shuffled afresh, so a hot payload can be split
    again = F.xxhash64("mark", "sha")
    both = rows.withColumn("again", again).join(groups.withColumn("again", again), ["again", "sha", "bytes", "mark"], "left")
    return both.select("page_id", "mark", F.when(F.col("page_id") < F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_revisit: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write every row as a response or revisit record; returns the stored manifest
    (uri, records). A record's payload is compressed and hashed chunk by chunk.

    Null payloads are empty; a null id is written as 'none' and never refers to another
    record; repeated rows are written each; other columns are ignored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stream, finish, uri, records, size = TaskContext.get().partitionId(), None, None, "", 0, 0
        for batch in batches:
            ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for page, url, body, first in zip(ids, urls, batch.column(2), refers, strict=True):
                if stream is None:
                    stream, finish = shared.open_target(f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.warc.gz")
                view = memoryview(body.as_buffer() or b"")
                digest = hashlib.sha1()
                for at in range(0, len(view), chunk):
                    digest.update(view[at:at + chunk])
                sent = len(view) if first is None else 0
                kind = "response" if first is None else "revisit"
                name = "none" if page is None else page
                head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
                        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{_base32(digest.digest())}",
                        f"WARC-Payload-Length: {len(view)}", f"Content-Length: {sent}"]
                if first is not None:
                    head.insert(3, f"WARC-Refers-To: <urn:page:{first}>")
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                size += stream.write(packer.compress(VERSION + "\r\n".join(head).encode() + b"\r\n\r\n"))
                for at in range(0, sent, chunk):
                    size += stream.write(packer.compress(view[at:at + chunk]))
                size += stream.write(packer.compress(b"\r\n\r\n") + packer.flush())
                records += 1
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_pydict({"uri": [finish()], "records": [records]})
                    stream, records, size = None, 0, 0
        if stream is not None:
            yield pa.RecordBatch.from_pydict({"uri": [finish()], "records": [records]})

    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        body.alias("body"), F.xxhash64(body).alias("mark"))
    choice = decide(pages, id_col, payload_col, min_revisit).where("refers_to IS NOT NULL")
    rows = rows.join(choice, ["page_id", "mark"], "left").select("page_id", "url", F.col("body").cast("binary"), "refers_to")
    return shared.stored(rows.mapInArrow(write, "uri STRING, records BIGINT"), "warc-manifest")


class _Inflated:
    """Bytes of a gzip file of many members, a bounded piece at a time."""

    def __init__(self, stream, piece: int):
        self.stream, self.piece, self.held, self.member, self.rest = stream, piece, bytearray(), None, b""

    def _more(self) -> bool:
        if not self.rest:
            self.rest = self.stream.read(self.piece)
            if not self.rest:
                last = self.member.flush() if self.member is not None and not self.member.eof else b""
                self.held += last
                return bool(last)
        if self.member is None or self.member.eof:
            self.member = zlib.decompressobj(31)
        self.held += self.member.decompress(self.rest, self.piece)
        self.rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def take(self, n: int) -> bytes:
        """Up to n bytes; fewer only at the end of what is held or the file."""
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def head(self) -> dict[str, str] | None:
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("archive ends inside a record")
                return None
        lines = bytes(self.held[:end]).decode().split("\r\n")
        del self.held[:end + 4]
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def read_chunks(uri: str, chunk: int = CHUNK, with_data: bool = True) -> Iterator[dict]:
    """Chunk rows of one archive; a record without payload is one empty chunk."""
    source = _Inflated(shared.open_source(uri), chunk)
    while (head := source.head()) is not None:
        left, number, digest, seen = int(head["content-length"]), 0, hashlib.sha1(), 0
        while True:
            data = source.take(min(left, chunk))
            if len(data) < min(left, chunk):
                raise ValueError("archive ends inside a payload")
            digest.update(data)
            left, seen = left - len(data), seen + len(data)
            yield {"record_id": head["warc-record-id"][10:-1], "chunk_no": number, "chunk_bytes": len(data), "bytes_so_far": seen,
                   "digest_so_far": _base32(digest.digest()), "data": data if with_data else None, "is_last": left == 0,
                   "record_type": head["warc-type"], "refers_to": head.get("warc-refers-to", "")[10:-1] or None,
                   "stated_digest": head["warc-payload-digest"].removeprefix("sha1:"),
                   "stated_bytes": int(head["warc-payload-length"])}
            number += 1
            if not left:
                break
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("record does not end where its length says")


SCHEMA = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int64()), ("chunk_bytes", pa.int64()), ("bytes_so_far", pa.int64()),
                    ("digest_so_far", pa.string()), ("data", pa.binary()), ("is_last", pa.bool_()), ("record_type", pa.string()),
                    ("refers_to", pa.string()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64())])


def chunk_table(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """All archives as chunk rows; a batch holds at most about 16 chunks of data."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in read_chunks(uri, chunk, with_data):
                    rows.append(row)
                    held += row["chunk_bytes"] if with_data else 0
                    if held >= 16 * chunk or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    schema = "record_id STRING, chunk_no BIGINT, chunk_bytes BIGINT, bytes_so_far BIGINT, digest_so_far STRING, data BINARY, " \
             "is_last BOOLEAN, record_type STRING, refers_to STRING, stated_digest STRING, stated_bytes BIGINT"
    return manifest.select("uri").repartition(max(manifest.count(), 1), "uri").mapInArrow(read, schema)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from the last chunk's running digest. A revisit carries no
    payload: its length and digest are those it states. ``intact`` tells whether a
    response's own bytes agree with what it states."""
    response = F.col("record_type") == "response"
    return chunks.where("is_last").select(
        F.when(F.col("record_id") != "none", F.col("record_id")).cast("long").alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type", F.col("refers_to").cast("long").alias("refers_to"),
        (~response | (F.col("digest_so_far") == F.col("stated_digest"))).alias("intact"))
