"""CRC-32C (Castagnoli), which Spark lacks: its ``crc32`` has another polynomial."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from siltscan.functions.arrow import STEP_BYTES, binary_parts

POLYNOMIAL = 0x82F63B78
ONES = np.uint32(0xFFFFFFFF)
#: Blocks longer than this are cut into this many lanes, whose checksums run side by side and are then joined.
LANES, LANES_FROM = 16, 1_024


@cache
def _bytes_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


@cache
def _pairs_table() -> np.ndarray:
    """The register after two zero bytes, by its low 16 bits."""
    one = _bytes_table()
    low = np.arange(1 << 16, dtype=np.uint32)
    half = one[low & 0xFF] ^ (low >> 8)
    return one[half & 0xFF] ^ (half >> 8)


@cache
def _shift_tables(n: int) -> np.ndarray:
    """Four tables, by byte of the register: what the register becomes after ``n`` zero bytes."""
    one = _bytes_table()
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    matrix, result = one[basis & 0xFF] ^ (basis >> 8), basis.copy()

    def apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for bit in range(32):
            out ^= np.where((v >> np.uint32(bit)) & 1, m[bit], np.uint32(0)).astype(np.uint32)
        return out

    while n:
        if n & 1:
            result = apply(matrix, result)
        matrix, n = apply(matrix, matrix), n >> 1
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([apply(result, byte << np.uint32(8 * k)) for k in range(4)])


def _advance(register: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Feed each row's bytes, all rows in step."""
    even = rows.shape[1] // 2 * 2
    words = np.ascontiguousarray(np.ascontiguousarray(rows[:, :even]).view("<u2").T)
    pairs = _pairs_table()
    for w in words:
        register = pairs[(register ^ w) & np.uint32(0xFFFF)] ^ (register >> np.uint32(16))
    if even < rows.shape[1]:
        register = _bytes_table()[(register ^ rows[:, -1]) & np.uint32(0xFF)] ^ (register >> np.uint32(8))
    return register


def crc32c_rows(rows: np.ndarray) -> np.ndarray:
    """Checksums of the rows of a matrix of bytes."""
    n, size = rows.shape
    if size < LANES_FROM:
        return _advance(np.full(n, ONES), rows) ^ ONES
    lane = size // LANES
    head = size - lane * LANES
    register = _advance(np.full(n, ONES), rows[:, :head]) if head else np.full(n, ONES)
    parts = _advance(np.zeros(n * LANES, dtype=np.uint32), np.ascontiguousarray(rows[:, head:]).reshape(n * LANES, lane)).reshape(n, LANES)
    a, b, c, d = _shift_tables(lane)
    for k in range(LANES):
        register = a[register & 0xFF] ^ b[(register >> 8) & 0xFF] ^ c[(register >> 16) & 0xFF] ^ d[register >> 24] ^ parts[:, k]
    return register ^ ONES


def crc32c_array(values: pa.Array) -> pa.Array:
    """Checksums of an Arrow array of byte strings, ``STEP_BYTES`` at a time; those of one length run in step. Null gives null."""
    starts, sizes, data = binary_parts(values)
    out = np.zeros(len(values), dtype=np.int64)
    there = np.ones(len(values), dtype=bool) if not values.null_count else values.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[there]).tolist():
        at = np.flatnonzero(there & (sizes == size))
        step = max(1, STEP_BYTES // max(size, 1))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            begin = starts[some]
            if size and (np.diff(begin) == size).all():
                rows = data[begin[0] : begin[-1] + size].reshape(len(some), size)
            else:
                rows = data[begin[:, None] + np.arange(size)]
            out[some] = crc32c_rows(rows)
    return pa.array(out, mask=~there)


def crc32c_many(values: list[bytes | None]) -> list[int | None]:
    """Checksums of byte strings. Null gives null."""
    return crc32c_array(pa.array(values, pa.large_binary())).to_pylist()


def crc32c_bytes(value: bytes) -> int:
    return crc32c_many([value])[0]


def crc32c(column: Column | str) -> Column:
    """CRC-32C of a binary column as BIGINT.

    Marked non-deterministic so that Spark evaluates it once where it is both filtered on and projected.
    """

    @F.arrow_udf(LongType())
    def run(values: pa.Array) -> pa.Array:
        return crc32c_array(values)

    return run.asNondeterministic()(column)
