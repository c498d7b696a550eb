"""Binary columns of Arrow batches as NumPy arrays, some bytes at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: What is worked on at a time, so that a worker's memory doesn't follow the batches that it is sent.
STEP_BYTES = 1 << 20


def binary_parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of byte strings, and the bytes that these lie in, without a copy."""
    _, offsets, data = values.buffers()
    wide = np.int64 if pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type) else np.int32
    if not len(values) or offsets is None:
        return np.zeros(len(values), np.int64), np.zeros(len(values), np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, dtype=wide)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return at[:-1], np.diff(at), np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def matrix(values: pa.Array, size: int) -> np.ndarray:
    """Byte strings of ``size`` each as rows, without a copy."""
    starts, sizes, data = binary_parts(values)
    if (sizes != size).any():
        raise ValueError(f"a block isn't of {size} bytes")
    return data[starts[0] : starts[0] + len(values) * size].reshape(len(values), size) if len(values) else np.zeros((0, size), np.uint8)


def binary_rows(rows: np.ndarray, sizes: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix of bytes as byte strings, each cut to its size."""
    n, width = rows.shape
    if sizes is None:
        sizes, data = np.full(n, width), np.ascontiguousarray(rows)
    else:
        data = rows[np.arange(width) < sizes[:, None]]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def stepwise(batches: Iterable[pa.RecordBatch], row_bytes: int) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of about ``STEP_BYTES``."""
    step = max(1, STEP_BYTES // row_bytes)
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)
