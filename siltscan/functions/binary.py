"""Little-endian fields of binary columns, decoded and encoded by Spark's own functions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"


def field_sql(block: str, at: int, width: int) -> str:
    digits = ", ".join(f"hex(substring({block}, {at + width - i}, 1))" for i in range(width))
    return f"CASE WHEN octet_length({block}) >= {at + width} THEN CAST(conv(concat({digits}), 16, 10) AS {U64 if width == 8 else 'bigint'}) END"


def signed_sql(block: str, at: int) -> str:
    """The signed 64-bit field at ``at`` as BIGINT."""
    return f"(shiftleft({field_sql(block, at + 4, 4)}, 32) | {field_sql(block, at, 4)})"


def field(block: str, at: int, width: int) -> Column:
    """The ``width``-byte unsigned field at ``at`` (from 0) of a column: DECIMAL(20,0) for 8 bytes, else BIGINT. Null past the end.

    Written as one SQL string: a plan has dozens of fields, and each function call from Python costs a round trip.
    """
    return F.expr(field_sql(block, at, width))


def unsigned(x: Column | str) -> Column:
    """DECIMAL(20,0) of a BIGINT that holds an unsigned 64-bit pattern."""
    x = F.col(x) if isinstance(x, str) else x
    d = x.cast("decimal(21,0)")
    return F.when(x < 0, d + F.lit(Decimal(1 << 64)).cast("decimal(21,0)")).otherwise(d).cast(U64)


def encoded(x: Column, width: int) -> Column:
    """The ``width`` little-endian bytes of a BIGINT; negative numbers as two's complement."""
    big = F.unhex(F.lpad(F.hex(x.cast("bigint")), 16, "0"))
    return F.concat(*[F.substring(big, 8 - i, 1) for i in range(width)])


def zeros(n: int) -> Column:
    return F.unhex(F.lit("00" * n))


def any_set(b: Column) -> Column:
    """Whether any byte is not zero."""
    return F.length(F.replace(F.hex(b), F.lit("0"), F.lit(""))) > 0


def any_in(b: Column, start: int, end: int) -> Column:
    return any_set(F.substring(b, start + 1, end - start))
