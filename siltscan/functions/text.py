"""Names, modes, sizes and times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltscan import layout

#: Printable: no control, format, unassigned or separator character but the blank. ``\\A`` and ``\\z``, since ``$`` would
#: let a trailing line break through.
PRINTABLE = r"\A[[^\p{C}\p{Z}] ]*+\z"


def as_text(raw: Column) -> Column:
    """UTF-8 with malformed sequences replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def is_name(name: Column) -> Column:
    return name.rlike(PRINTABLE) & (F.trim(name) != "")


def safe_name(name: Column) -> Column:
    """Characters other than letters, digits, dot, underscore and hyphen become underscores."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def mode_string(mode: Column) -> Column:
    """``drwxr-xr-x`` and the like; set-id and sticky bits don't show."""
    kinds = {0o140000: "s", 0o120000: "l", 0o100000: "-", 0o060000: "b", 0o040000: "d", 0o020000: "c", 0o010000: "p"}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), mode.bitwiseAND(F.lit(0o170000)).cast("int")), F.lit("?"))
    bits = [F.when(mode.bitwiseAND(F.lit(1 << (8 - i))) != 0, F.lit("rwx"[i % 3])).otherwise("-") for i in range(9)]
    return F.concat(kind, *bits)


def _tenths(n: Column, bits: int) -> Column:
    """``n`` over a power of two, to one place; halves go to the even digit, where ``%.1f`` alone would round them up."""
    return F.bround(n / F.lit(float(1 << bits)), 1)


def size_string(n: Column) -> Column:
    steps = F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB")):
        steps = steps.when(n < 1 << (10 * power + 10), F.format_string("%.1f " + unit, _tenths(n, 10 * power)))
    return steps.otherwise(F.format_string("%.1f GB", _tenths(n, 30)))


def iso_time(seconds: str) -> str:
    """SQL for the UTC time, without a fraction, of an expression in seconds; ``<invalid: sec=N>`` outside the years 1 to 9999.

    Counted from a zoneless epoch, so that the session's time zone doesn't matter.
    """
    ok = f"{seconds} BETWEEN -62135596800 AND 253402300799"
    span = f"make_dt_interval(0, 0, 0, CAST(CASE WHEN {ok} THEN {seconds} END AS decimal(18,6)))"
    shown = f"replace(CAST(timestamp_ntz'1970-01-01 00:00:00' + {span} AS string), ' ', 'T')"
    return f"CASE WHEN {ok} THEN concat({shown}, '+00:00') ELSE concat('<invalid: sec=', CAST({seconds} AS string), '>') END"


def _named(code: Column, names: dict[int, str], other: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code.cast("int")), other)


def type_name(code: Column) -> Column:
    return _named(code, layout.TYPE_NAMES, F.lit(None).cast("string"))


def file_type_name(code: Column) -> Column:
    return _named(code, layout.FILE_TYPE_NAMES, F.lit(None).cast("string"))


def compression_name(code: Column) -> Column:
    return _named(code, layout.COMPRESSION_NAMES, F.concat(F.lit("unknown("), code.cast("string"), F.lit(")")))
