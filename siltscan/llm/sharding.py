"""Sharding along a Hilbert curve over several metadata dimensions.

Dimensions: language, source and length. Language and source are quantised to ``2**BITS`` equal-depth buckets of their
values in order (a value's bucket is that of the rows before it; null comes first); length to its number of binary
digits. The grid has ``2**(3 * BITS)`` cells however large the table is, so the cells, with their row and character
counts, are the only thing that is ordered: by Hilbert index, then cut into runs of ``SHARD_CHARS`` characters.
A cell heavier than a shard is split by a hash of the id into even parts. Neighbouring shards are neighbours in every
dimension, so a filter on any of them prunes files by their minima and maxima.

Null or negative lengths count 0. Repeated rows go to one shard. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from siltscan.llm._common import cut, small

BITS, DIMENSIONS, SHARD_CHARS = 4, 3, 8_000_000


def hilbert_index(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of rows of non-negative coordinates (Skilling's transform, all rows at once)."""
    x = coordinates.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[:, i] & q) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(up, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


@F.pandas_udf(LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a, b, c], axis=1)))


def _buckets(docs: DataFrame, column: str) -> DataFrame:
    """(value, bucket) of the distinct values of ``column``.

    The rows before a value are summed on two levels: distinct values in ranges, each range a task of its own, and
    the ranges' totals, one row a range, so that no task orders all values.
    """
    n = docs.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    n = cut(n.repartitionByRange(F.asc_nulls_first("value")).withColumn("range", F.spark_partition_id()))
    all_ = Window.partitionBy(F.lit(0))
    whole = n.groupBy("range").agg(F.sum("n").alias("own"))
    base = F.sum("own").over(all_.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.broadcast(whole.select("range", base.alias("base"), F.sum("own").over(all_).alias("total")))  # a row a range
    before = F.sum("n").over(Window.partitionBy("range").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, -1))
    placed = n.withColumn("before", before).join(whole, "range")
    return placed.select("value", F.expr(f"(coalesce(base, 0) + coalesce(before, 0)) * {1 << BITS} div total").alias("bucket"))


def _length() -> Column:
    n = F.greatest(F.coalesce(F.col("n_chars").cast("bigint"), F.lit(0)), F.lit(0))
    return F.when(n == 0, F.lit(0)).otherwise(F.least(F.length(F.bin(n)), F.lit((1 << BITS) - 1))).cast("bigint")


def shards(docs: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``doc_id``, ``hilbert`` and ``shard`` of every row. Texts are not read; the tables joined are one row per value and per cell."""
    meta = docs.select("doc_id", "lang", "source", "n_chars")
    lang, source = small(_buckets(meta, "lang")), small(_buckets(meta, "source"))
    lang = lang.select(F.col("value").alias("lang_value"), F.col("bucket").alias("a"))
    source = source.select(F.col("value").alias("source_value"), F.col("bucket").alias("b"))
    placed = (
        meta.join(lang, meta["lang"].eqNullSafe(lang["lang_value"]))
        .join(source, meta["source"].eqNullSafe(source["source_value"]))
        .select("doc_id", "a", "b", _length().alias("c"), F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)).alias("chars"))
    )
    cells = placed.groupBy("a", "b", "c").agg(F.sum("chars").alias("chars")).withColumn("hilbert", _curve("a", "b", "c"))
    along = Window.partitionBy(F.lit(0)).orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    # Light cells share a run; a cell of one shard or more opens its own.
    parts = F.expr(f"greatest(1, (chars + {shard_chars - 1}) div {shard_chars})")
    cells = cells.withColumn("parts", parts).withColumn("light", F.when(F.col("parts") > 1, 0).otherwise(F.col("chars")))
    cells = cells.withColumn("light_before", F.coalesce(F.sum("light").over(along), F.lit(0)))
    cells = cells.withColumn("heavy_before", F.coalesce(F.sum(F.when(F.col("parts") > 1, F.col("parts")).otherwise(0)).over(along), F.lit(0)))
    # A run is one stretch of light cells between heavy ones, cut every shard_chars; the key orders runs along the curve.
    runs = cells.withColumn("cut_at", F.expr(f"light_before div {shard_chars}"))
    ordered = Window.partitionBy(F.lit(0)).orderBy("hilbert")
    changed = F.coalesce(
        (F.col("parts") > 1) | (F.lag("parts").over(ordered) > 1) | (F.lag("cut_at").over(ordered) != F.col("cut_at")), F.lit(True)
    )
    runs = runs.withColumn("opens", F.when(F.col("parts") > 1, F.lit(0)).otherwise(changed.cast("int")))
    up_to = ordered.rowsBetween(Window.unboundedPreceding, 0)
    first = F.sum("opens").over(up_to) + F.col("heavy_before")
    runs = runs.withColumn("first", F.when(F.col("parts") > 1, first).otherwise(first - 1).cast("bigint"))
    runs = small(runs.select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("c").alias("rc"), "hilbert", "parts", "first"))
    at = (placed["a"] == runs["ra"]) & (placed["b"] == runs["rb"]) & (placed["c"] == runs["rc"])
    spread = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")
    return placed.join(runs, at).select("doc_id", "hilbert", (F.col("first") + spread % F.col("parts")).alias("shard"))


def _oracle() -> str:
    """The same result in SQL; each step of the transform is a common table expression."""
    top = 1 << BITS
    x = ["x0", "x1", "x2"]
    steps, name = [], "s0"

    def step(**new: str) -> None:
        nonlocal name
        after = f"s{len(steps) + 1}"
        steps.append(f"{after} AS (SELECT a, b, c, chars, {', '.join(f'{new.get(k, k)} AS {k}' for k in x)} FROM {name})")
        name = after

    q = top >> 1
    while q > 1:
        for i in range(DIMENSIONS):
            up, p = f"(x{i} & {q}) <> 0", q - 1
            if i == 0:
                step(x0=f"CASE WHEN {up} THEN xor(x0, {p}) ELSE x0 END")
            else:
                step(
                    x0=f"CASE WHEN {up} THEN xor(x0, {p}) ELSE xor(x0, xor(x0, x{i}) & {p}) END",
                    **{f"x{i}": f"CASE WHEN {up} THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {p}) END"},
                )
        q >>= 1
    for i in range(1, DIMENSIONS):
        step(**{f"x{i}": f"xor(x{i}, x{i - 1})"})
    t = "0"
    q = top >> 1
    while q > 1:
        t = f"xor({t}, CASE WHEN (x{DIMENSIONS - 1} & {q}) <> 0 THEN {q - 1} ELSE 0 END)"
        q >>= 1
    step(**{k: f"xor({k}, {t})" for k in x})
    bits = [f"((x{i} >> {b}) & 1) << {b * DIMENSIONS + DIMENSIONS - 1 - i}" for b in range(BITS) for i in range(DIMENSIONS)]

    def buckets(column: str) -> str:
        return f"""SELECT {column} AS v, (coalesce(sum(count(*)) OVER (ORDER BY {column} NULLS FIRST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {top} // sum(count(*)) OVER ())::BIGINT AS k FROM documents GROUP BY {column}"""

    return f"""
WITH la AS ({buckets("lang")}), so AS ({buckets("source")}),
placed AS (
  SELECT doc_id, la.k AS a, so.k AS b, greatest(coalesce(n_chars, 0), 0) AS chars,
    CASE WHEN coalesce(n_chars, 0) <= 0 THEN 0 ELSE least(length(bin(n_chars)), {top - 1}) END AS c
  FROM documents JOIN la ON lang IS NOT DISTINCT FROM la.v JOIN so ON source IS NOT DISTINCT FROM so.v
), s0 AS (SELECT a, b, c, sum(chars)::BIGINT AS chars, a AS x0, b AS x1, c AS x2 FROM placed GROUP BY a, b, c),
{", ".join(steps)},
cells AS (
  SELECT a, b, c, chars, ({" + ".join(f"({e})" for e in bits)})::BIGINT AS hilbert, greatest(1, (chars + {SHARD_CHARS - 1}) // {SHARD_CHARS}) AS parts FROM {name}
), along AS (
  SELECT *, coalesce(sum(CASE WHEN parts > 1 THEN 0 ELSE chars END) OVER w, 0) // {SHARD_CHARS} AS cut_at,
    coalesce(sum(CASE WHEN parts > 1 THEN parts ELSE 0 END) OVER w, 0) AS heavy_before
  FROM cells WINDOW w AS (ORDER BY hilbert ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (
  SELECT *, CASE WHEN parts > 1 THEN 0 WHEN coalesce(lag(parts) OVER (ORDER BY hilbert), 2) > 1
    OR lag(cut_at) OVER (ORDER BY hilbert) <> cut_at THEN 1 ELSE 0 END AS opens FROM along
), numbered AS (
  SELECT *, sum(opens) OVER (ORDER BY hilbert) + heavy_before - CASE WHEN parts > 1 THEN 0 ELSE 1 END AS first FROM opened
)
SELECT doc_id, hilbert, (first + ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % parts)::BIGINT AS shard
FROM placed JOIN numbered USING (a, b, c)
"""


ORACLE = _oracle()
