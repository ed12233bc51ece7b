"""Views of Arrow string columns as flat byte arrays, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text worked on at once inside a task; a single longer text is one slice of its own.
SLICE_BYTES = 1 << 18


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and len + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `limit` bytes of text each."""
    if batch.num_rows == 0:
        return
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.diff(utf8(column)[1])
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def named(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the given fields, from arrays or lists."""
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=schema.field(k).type) for k, x in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema([schema.field(k) for k in columns]))
