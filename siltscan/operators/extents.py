"""Recovered files: naming, deduplication, translation, and reading their bytes from the image."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltscan.functions.text import safe_name
from siltscan.operators.superblock import translated
from siltscan.sources.image import open_image

PIECE_BYTES = 8 << 20


def first_per(rows: DataFrame, keys: list[str | Column], flag: str, order: str = "pos") -> DataFrame:
    """``rows`` with ``flag``: whether a row is the first of its key."""
    return rows.withColumn(flag, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1)


def file_path(kind: str) -> Column:
    """Name of a recovered file below the output folder, before any suffix."""
    return F.concat(safe_name(F.col("filename")), F.lit("_gen"), F.col("gen").cast("string"), F.lit("_"), F.col("source"), F.lit(f"_{kind}"))


def inline_files(named: DataFrame) -> DataFrame:
    """Inline files, one per path: the first."""
    rows = named.where("extent_type = 'inline'").withColumn("output_path", F.concat(file_path("inline"), F.lit(".bin")))
    rows = first_per(rows, ["output_path"], "is_first").where("is_first")
    return rows.withColumn("compressed", F.col("compression") != 0).drop("is_first")


def numbered(rows: DataFrame, base: str, out: str, order: str = "pos") -> DataFrame:
    """``out``: ``base`` for the first row of a base, then with _1, _2 and so on; ``.bin`` behind."""
    k = F.row_number().over(Window.partitionBy(base).orderBy(order)) - 1
    return rows.withColumn(out, F.concat(F.col(base), F.when(k > 0, F.concat(F.lit("_"), k.cast("string"))).otherwise(""), F.lit(".bin")))


def regular_files(named: DataFrame, chunks: DataFrame, n_chunks: int | None = None) -> DataFrame:
    """Regular extents with ``state``: recovered, failed (not in the chunk map) or duplicate, and ``output_path``.

    A key (disk_bytenr, offset, size) is taken by its first row even if that fails, so later ones are duplicates.
    """
    rows = first_per(named.where("extent_type = 'regular'"), ["disk_bytenr", "offset", "size"], "is_first")
    first = translated(rows.where("is_first"), "disk_bytenr", chunks, ["pos"], n_chunks=n_chunks).withColumn("base", file_path("extent"))
    done = numbered(first.where("physical IS NOT NULL"), "base", "output_path").withColumn("state", F.lit("recovered"))
    failed = first.where("physical IS NULL").withColumns({"output_path": F.lit(None).cast("string"), "state": F.lit("failed")})
    again = rows.where("NOT is_first").withColumns({"output_path": F.lit("(duplicate)"), "state": F.lit("duplicate")})
    return done.unionByName(failed).unionByName(again, allowMissingColumns=True).drop("base", "is_first")


def extent_pieces(files: DataFrame, image: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(output_path, piece, data, short_read) of recovered extents, read on the executors after deduplication.

    An extent comes in pieces, so that no row is larger than ``piece_bytes``; one beyond the image's end is one empty piece.
    """
    rows = files.where("state = 'recovered'").select("output_path", (F.col("physical") + F.col("offset")).cast("decimal(22,0)").alias("at"), F.col("size").cast("decimal(22,0)").alias("n"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = open_image(image)
        with fs.open_input_file(name) as f:
            end = f.size()
            for batch in batches:
                for path, at, n in zip(*(batch.column(c).to_pylist() for c in ("output_path", "at", "n"))):
                    at, n = int(at), int(n)
                    there = max(0, min(n, end - at))
                    for k, start in enumerate(range(0, there, piece_bytes) if there else [0]):
                        data = f.read_at(min(piece_bytes, there - start), at + start) if there else b""
                        yield pa.RecordBatch.from_pydict({"output_path": [path], "piece": [k], "data": [data], "short_read": [there < n]}, schema=SCHEMA)

    return rows.mapInArrow(read, "output_path string, piece bigint, data binary, short_read boolean")


SCHEMA = pa.schema([("output_path", pa.string()), ("piece", pa.int64()), ("data", pa.binary()), ("short_read", pa.bool_())])
