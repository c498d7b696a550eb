"""Helpers that the operators share: reading, cutting lineage, size-checked broadcasts, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table is broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 100_000
#: Entries of a Python worker's memo of words; a full memo is emptied, so its size never follows the corpus.
MEMO_ENTRIES = 400_000
#: Characters of a memo's key; longer ones (base64, minified code) are worked out anew, so the memo's bytes are bounded too.
MEMO_KEY = 64
#: Characters of text that a worker takes apart at a time.
GROUP_CHARS = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, as ``spark.checkpoint.dir`` sets it. Without that setting a local session gets a
    folder of its own; on a cluster, where executors don't share one, this raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="siltscan-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, so that later steps read only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` cut and counted; hinted for broadcast only where it has at most ``rows`` rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def drop_long(memo: dict, keys: Iterable[str]) -> None:
    """Take the keys of more than ``MEMO_KEY`` characters out of ``memo``, which held them for one run of texts."""
    for key in keys:
        if len(key) > MEMO_KEY:
            memo.pop(key, None)


class Memo(dict):
    """A bounded memo of a pure function of a string."""

    def __init__(self, fn: Callable, entries: int = MEMO_ENTRIES, longest: int = MEMO_KEY):
        super().__init__()
        self.fn, self.entries, self.longest = fn, entries, longest

    def __missing__(self, key):
        value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


_HELD: list = [None, None]


def per_worker(key, build: Callable):
    """What ``build`` makes, kept by this Python worker until it is asked for something with another key.

    A worker serves one operator after the other; holding one operator's tables and memo at a time bounds its memory.
    """
    if _HELD[0] != key:
        _HELD[:] = None, None
        _HELD[:] = key, build()
    return _HELD[1]


def by_size(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about ``GROUP_CHARS`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        n = len(text or "")
        if run and size + n > GROUP_CHARS:
            yield run
            run, size = [], 0
        run.append(text)
        size += n
    if run:
        yield run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Short runs of the batches' rows, so that a worker holds the objects and results of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``df.mapInArrow`` with a function of a short batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(fn, slices(batches))

    return df.mapInArrow(over, schema)


def kept_columns(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with the distinct ``doc_id`` of ``ids``, whatever other columns ``docs`` has."""
    keys = ids.select(F.col("doc_id").alias("__silt_id"))
    return docs.join(keys, docs["doc_id"] == keys["__silt_id"], how)
