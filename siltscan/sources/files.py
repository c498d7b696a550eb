"""Sinks: recovered bytes as files, written where they are computed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan.sources.image import open_image

#: Subfolders that very many files are spread over, tasks that read them, and bytes and files in a record batch.
SUBFOLDERS, READERS, BATCH_BYTES, BATCH_FILES = 256, 64, 8 << 20, 1_000


def write_files(pieces: DataFrame, folder: str, together: bool = False) -> int:
    """Write (output_path, piece, data) below ``folder``, each file by one task from its pieces in order; the number of files.

    ``together``: a file's pieces follow each other in one partition already, so that nothing needs shuffling.
    A task that is repeated writes the same file again under a temporary name and renames it, so readers never see half.
    """
    fs, root = open_image(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        fs, root = open_image(folder)
        path, out, temporary = None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(temporary, f"{root}/{path}")

        for batch in batches:
            done = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name != path:
                    close()
                    path, temporary = name, f"{root}/.{uuid.uuid4().hex}{os.extsep}part"
                    out = fs.open_output_stream(temporary)
                    done.append(name)
                out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["output_path"])
        close()

    rows = pieces.select("output_path", "piece", "data")
    rows = rows if together else rows.repartition("output_path").sortWithinPartitions("output_path", "piece")
    return rows.mapInArrow(write, "output_path string").count()


def spread(path: Column) -> Column:
    """``path`` in one of the subfolders that ``make_subfolders`` makes."""
    return F.concat(F.format_string("%02x/", F.pmod(F.xxhash64(path), F.lit(SUBFOLDERS))), path)


def make_subfolders(folder: str) -> None:
    fs, root = open_image(folder)
    for k in range(SUBFOLDERS):
        fs.create_dir(f"{root}/{k:02x}", recursive=True)


def read_spread(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length, content) of all files of the subfolders, each listed and read by one task: the driver lists nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_image(folder)
        schema = pa.schema([("name", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows, held = [], 0
                for info in fs.get_file_info(pafs.FileSelector(f"{root}/{k:02x}")):
                    if not info.is_file or info.base_name.startswith(".") and info.base_name.endswith(".part"):
                        continue
                    with fs.open_input_file(info.path) as f:
                        data = f.read()
                    rows.append((info.base_name, len(data), data))
                    held += len(data)
                    if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return spark.range(0, SUBFOLDERS, 1, READERS).mapInArrow(read, "name string, length bigint, content binary")


def write_text(folder: str, name: str, pieces: Iterable[str]) -> None:
    fs, root = open_image(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as f:
        for piece in pieces:
            f.write(piece.encode())


