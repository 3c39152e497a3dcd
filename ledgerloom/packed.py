"""Rows that travel through a shuffle as compressed columns: a slice of rows is cut by the
part each row goes to, and a part's rows are one message."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

#: Bytes of rows packed at a time, and what a packed row is.
SLICE_BYTES, PART = 64 << 20, "part"
PACKED = T.StructType([T.StructField(PART, T.LongType()), T.StructField("rows", T.BinaryType())])


def _whole(column: pa.Array) -> pa.Array:
    """The column's values with what lies below its nulls."""
    return pa.Array.from_buffers(column.type, len(column), [None, column.buffers()[1]], offset=column.offset)


def _planes(column: pa.Array, back: bool = False) -> pa.Array:
    """A numeric column with the first bytes of all its values together, then the second and
    so on: neighbours share most of them. ``back`` undoes it; other columns stay as they are."""
    if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)) or not len(column):
        return column
    # moved bytes stand in the places of nulls too
    values = (column.fill_null(0) if column.null_count and not back else _whole(column)).to_numpy()
    shape = (values.itemsize, len(values)) if back else (len(values), values.itemsize)
    moved = np.ascontiguousarray(values.view(np.uint8).reshape(shape).T)
    valid = column.is_valid().buffers()[1] if column.null_count else None
    return pa.Array.from_buffers(column.type, len(column), [valid, pa.py_buffer(moved)])


def _as_planes(rows: pa.RecordBatch, back: bool = False) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_planes(c, back) for c in rows.columns], schema=rows.schema)


def _packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    part = rows.column(PART).to_numpy()
    order = np.argsort(part, kind="stable")
    rows, part = rows.drop_columns([PART]).take(pa.array(order)).combine_chunks().to_batches()[0], part[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(part)]]))
    messages = [_as_planes(rows.slice(a, n)).serialize() for a, n in zip(starts.tolist(), sizes.tolist())]
    # the length of the message comes first: decompressing asks for it
    packed = [len(m).to_bytes(8, "little") + pa.compress(m, "zstd", asbytes=True) for m in messages]
    return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int64()), pa.array(packed, pa.binary())], names=[PART, "rows"])


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the ``part`` they go to, as one compressed row per part and slice."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= SLICE_BYTES:
            yield _packed(held)
            held, size = [], 0
    if held:
        yield _packed(held)


def unpacked(message: bytes, schema: pa.Schema) -> pa.RecordBatch:
    """The rows of one message; ``schema`` is theirs without ``part``."""
    rows = pa.decompress(message[8:], int.from_bytes(message[:8], "little"), "zstd")
    return _as_planes(pa.ipc.read_record_batch(rows, schema), back=True)


def unpack_rows(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for message in batch.column(1):
                yield unpacked(message.as_py(), schema)

    return unpack
