"""Token-id files of patched frame-of-reference blocks (operator 9).

Ids are cut into blocks of 256. A block subtracts its minimum and packs the rest at
the width that holds ``PERCENTILE`` of its values; larger ones go to an exception
list as (position, value). Blocks of about a million ids form a segment whose header
lists minima, widths, exception counts and the start of every block, so a single
block can be decoded alone. The file ends with the documents' ids and lengths."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import shared, tokens
from ledgerloom.llm.kernels import bounds, gather, pieces

MAGIC = b"PFOR\x01\0\0\0"
BLOCK, LANE, PERCENTILE, SEGMENT = 256, 64, 90, 1 << 20
END_ID = 2
_HEAD = struct.Struct("<QQQQ")  # ids, blocks, packed words, exceptions
_FOOT = struct.Struct("<QQQQ8s")  # segments, documents, ids, place of the tables, magic


def _bit_length(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(lanes: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below 2**width as rows of ``width`` 64-bit words."""
    out = np.zeros((len(lanes), width), np.uint64)
    for j in range(LANE):
        word, shift = divmod(j * width, 64)
        value = lanes[:, j]
        out[:, word] |= value << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= value >> np.uint64(64 - shift)
    return out


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(packed), LANE), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(LANE):
        word, shift = divmod(j * width, 64)
        value = packed[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | packed[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = value & mask
    return out


def encode_segment(ids: np.ndarray) -> bytes:
    """At most ``SEGMENT`` ids below 2**32."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint64)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    full = full - low[:, None]
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = _bit_length(np.partition(full, rank, axis=1)[:, rank])
    over = full >> width.astype(np.uint64)[:, None] > 0
    exceptions = over.sum(axis=1)
    where, place = np.nonzero(over)
    values = full[where, place]
    full[over] = 0
    starts = bounds(width * (BLOCK // LANE))
    words = np.zeros(starts[-1], np.uint64)
    for w in np.unique(width).tolist():
        if w:
            chosen = np.flatnonzero(width == w)
            packed = pack(full[chosen].reshape(-1, LANE), w)
            words[gather(starts[chosen], np.full(len(chosen), w * (BLOCK // LANE)))] = packed.ravel()
    return b"".join((_HEAD.pack(n, blocks, len(words), len(values)), low.astype("<u4").tobytes(),
                     width.astype("u1").tobytes(), exceptions.astype("<u2").tobytes(), starts[:-1].astype("<u4").tobytes(),
                     words.astype("<u8").tobytes(), place.astype("u1").tobytes(), values.astype("<u4").tobytes()))


class Segment:
    """One segment of a file; reads the header arrays, then blocks on demand."""

    def __init__(self, stream):
        self.n, self.blocks, self.words, self.over = _HEAD.unpack(stream.read(_HEAD.size))
        take = lambda kind, count: np.frombuffer(stream.read(np.dtype(kind).itemsize * count), kind)
        self.low, self.width = take("<u4", self.blocks), take("u1", self.blocks)
        self.exceptions, self.starts = take("<u2", self.blocks), take("<u4", self.blocks)
        self.packed, self.place, self.values = take("<u8", self.words), take("u1", self.over), take("<u4", self.over)

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of blocks first..last-1."""
        last = self.blocks if last is None else min(last, self.blocks)
        out = np.zeros((last - first, BLOCK), np.uint64)
        width = self.width[first:last]
        for w in np.unique(width).tolist():
            if w:
                chosen = np.flatnonzero(width == w)
                per = w * (BLOCK // LANE)
                rows = self.packed[gather(self.starts[first:last][chosen].astype(np.int64), np.full(len(chosen), per))]
                out[chosen] = unpack(rows.reshape(-1, w), w).reshape(-1, BLOCK)
        at = bounds(self.exceptions)
        row = np.repeat(np.arange(last - first), self.exceptions[first:last])
        out[row, self.place[at[first]:at[last]]] = self.values[at[first]:at[last]]
        out += self.low[first:last, None]
        return out.ravel()[: min(self.n, last * BLOCK) - first * BLOCK].astype("<u4")


class Writer:
    def __init__(self, uri: str):
        self.stream, self.finish = shared.open_target(uri)
        self.stream.write(MAGIC)
        self.at, self.segments, self.docs, self.counts, self.rest = len(MAGIC), [], [], [], []
        self.waiting = self.total = 0

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids.astype("<i8"))
        self.counts.append(counts.astype("<u8"))
        self.rest.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= SEGMENT:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        at = 0
        while len(ids) - at >= SEGMENT or all_of_it and at < len(ids):
            data = encode_segment(ids[at:at + SEGMENT])
            self.segments.append(self.at)
            self.stream.write(data)
            self.at += len(data)
            at += SEGMENT
        self.rest = [ids[at:].copy()]
        self.waiting = max(len(ids) - at, 0)

    def close(self) -> str:
        self._flush(True)
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, "<i8")
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, "<u8")
        self.stream.write(docs.tobytes() + counts.tobytes() + np.asarray(self.segments, "<u8").tobytes())
        self.stream.write(_FOOT.pack(len(self.segments), len(docs), self.total, self.at, MAGIC))
        return self.finish()


class Reader:
    def __init__(self, uri: str):
        self.stream = shared.open_source(uri)
        self.stream.seek(self.stream.size() - _FOOT.size)
        segments, docs, self.total, tables, magic = _FOOT.unpack(self.stream.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.stream.seek(tables)
        self.docs = np.frombuffer(self.stream.read(8 * docs), "<i8")
        self.counts = np.frombuffer(self.stream.read(8 * docs), "<u8").astype(np.int64)
        self.places = np.frombuffer(self.stream.read(8 * segments), "<u8")

    def segment(self, i: int) -> Segment:
        self.stream.seek(int(self.places[i]))
        return Segment(self.stream)

    def tokens(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from place ``first`` on; decodes only the blocks they lie in."""
        parts, last = [], min(first + count, self.total)
        while first < last:
            s, inside = divmod(first, SEGMENT)
            stop = min(last - s * SEGMENT, SEGMENT)
            block = inside // BLOCK
            got = self.segment(s).decode(block, -(-stop // BLOCK))
            parts.append(got[inside - block * BLOCK: stop - block * BLOCK])
            first = s * SEGMENT + stop
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(doc ids, starts, lengths, crc32 of the ids), one segment at a time in memory."""
        ends = np.cumsum(self.counts)
        crc, done = 0, 0
        for s in range(len(self.places)):
            body = memoryview(self.segment(s).decode().tobytes())
            begin, end = s * SEGMENT, s * SEGMENT + len(body) // 4
            stop = int(np.searchsorted(ends, end, "right"))
            crcs = np.zeros(stop - done, np.int64)
            at = begin
            for k, e in enumerate(ends[done:stop].tolist()):
                crcs[k] = zlib.crc32(body[(at - begin) * 4:(e - begin) * 4], crc)
                crc, at = 0, e
            crc = zlib.crc32(body[(at - begin) * 4:], crc)
            yield self.docs[done:stop], ends[done:stop] - self.counts[done:stop], self.counts[done:stop], crcs
            done = stop


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by ``end_id``; the ids and the lengths."""
    counts = np.diff(at) + 1
    out = np.full(counts.sum(), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts) - 1] = False
    out[keep] = ids
    return out, counts


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write files in ascending id order.

    Returns the manifest (part, uri, n_docs, n_tokens, first_token), stored. Null and
    empty texts are the end id alone; a null id is stored as the smallest integer and
    comes first; repeated rows are kept, each with its own ids; rows of one id are
    ordered by a hash of their text. One file per range of
    ids, made by a range partitioning; a task holds one segment and one batch."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, n = tokens.bpe(vocabulary), None, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids_col = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            for texts in pieces(batch.column(1)):
                out = out or Writer(f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.pfor")
                ids, counts = with_end(*encoder.encode(texts), end_id)
                out.add(ids_col[texts.rows], counts, ids)
                n += len(texts)
        if out:
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [out.close()], "n_docs": [n], "n_tokens": [out.total]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.hash("text")]  # rows of one id follow each other alike in every run
    rows = rows.repartitionByRange(shared.slots(spark), *order).sortWithinPartitions(*order)
    manifest = shared.stored(rows.mapInArrow(write, "part BIGINT, uri STRING, n_docs BIGINT, n_tokens BIGINT"), "tokens-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents as the files hold them: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for docs, starts, counts, crcs in Reader(uri).documents():
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64(), mask=docs == -(1 << 63)),
                                                      "start": starts + first, "n_tokens": counts, "ids_crc32": crcs})

    files = max(manifest.count(), 1)
    return manifest.select("uri", "first_token").repartition(files, "uri").mapInArrow(
        read, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")
