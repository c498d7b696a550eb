"""A raw image as a Spark data source: rows of (off, block) over byte ranges, and reads at given positions.

Paths go through ``pyarrow.fs``, so that an image may lie on any file system that all executors reach; a plain path is a
local or mounted one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltscan import layout

#: Bytes of image a partition covers at least, partitions of an image at most, and bytes of blocks in a record batch.
RANGE_BYTES, MOST_RANGES, BATCH_BYTES = 64 << 20, 20_000, 16 << 20


def open_image(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def image_size(path: str) -> int:
    fs, name = open_image(path)
    info = fs.get_file_info(name)
    if not info.is_file:
        raise FileNotFoundError(path)
    return info.size


def read_at(path: str, at: int, n: int) -> bytes:
    """Up to ``n`` bytes from ``at``; fewer at the end of the image."""
    fs, name = open_image(path)
    with fs.open_input_file(name) as f:
        size = f.size()
        return f.read_at(max(0, min(n, size - at)), at) if at < size else b""


def block_count(size: int, nodesize: int) -> int:
    """Blocks that a scan visits: from one node past the superblock on, as long as a header fits."""
    first = layout.SUPERBLOCK_AT + nodesize
    return max(0, (size - layout.HEADER_BYTES - first) // nodesize + 1)


@dataclass
class Range(InputPartition):
    start: int
    end: int


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.nodesize = options["path"], int(options["nodesize"])
        if self.nodesize <= layout.HEADER_BYTES:
            raise ValueError(f"nodesize must be more than {layout.HEADER_BYTES}")
        self.fsid = bytes.fromhex(options.get("fsid", ""))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        size = image_size(self.path)
        n = block_count(size, self.nodesize)
        span = max(1, self.range_bytes // self.nodesize, n // MOST_RANGES)
        return [Range(i, min(n, i + span)) for i in range(0, n, span)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        size, first = self.nodesize, layout.SUPERBLOCK_AT + self.nodesize
        fs, name = open_image(self.path)
        step = max(1, BATCH_BYTES // size)
        at, end = layout.FSID_AT, layout.FSID_AT + layout.FSID_BYTES
        with fs.open_input_file(name) as f:
            for i in range(partition.start, partition.end, step):
                n = min(step, partition.end - i)
                base = first + i * size
                data = memoryview(f.read_at(min(n * size, f.size() - base), base))
                picks = [k for k in range(0, n * size, size) if not self.fsid or data[k + at : k + end] == self.fsid]
                if picks:
                    offs = pa.array([base + k for k in picks], pa.int64())
                    yield pa.RecordBatch.from_arrays([offs, pa.array([bytes(data[k : k + size]) for k in picks], pa.binary())], ["off", "block"])


class ImageSource(DataSource):
    """``spark.read.format("siltimage")``; options ``path``, ``nodesize``, ``fsid`` (hex: only blocks that hold it), ``rangebytes``."""

    @classmethod
    def name(cls) -> str:
        return "siltimage"

    def schema(self) -> str:
        return "off BIGINT, block BINARY"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options)


def blocks(spark: SparkSession, path: str, nodesize: int, fsid: bytes | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(off, block) of the scan of an image. With ``fsid``, blocks of another filesystem aren't even shipped to the JVM."""
    # The source is planned in a Python process that may lack this package on its path, so its code goes along.
    for module in (sys.modules[__name__], layout):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(ImageSource)
    reader = spark.read.format("siltimage").option("path", path).option("nodesize", nodesize).option("rangebytes", range_bytes)
    return (reader.option("fsid", fsid.hex()) if fsid else reader).load()
