"""The superblock, the chunk map, and logical addresses made physical.

Both are tiny and parametrise everything else, so they are read on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan import layout
from siltscan.functions.binary import U64

Chunk = tuple[int, int, int, int]  # logical start, logical end, physical start, length
#: Chunks up to which the map is broadcast to a range join; a larger one is joined by bucket.
BROADCAST_CHUNKS, BUCKET_BYTES, WIDEST = 2_000, 1 << 28, 1 << 40


def _int(data: bytes, at: int, width: int) -> int:
    return int.from_bytes(data[at : at + width], "little")


def parse_superblock(raw: bytes) -> dict | None:
    """Fields of the 4096 bytes at 64 KiB; None if they are too few or the magic is missing."""
    if len(raw) < layout.SUPERBLOCK_BYTES or raw[layout.MAGIC_AT : layout.MAGIC_AT + 8] != layout.MAGIC:
        return None
    fields = {name: _int(raw, at, width) for name, (at, width) in layout.SUPERBLOCK.items()}
    return {"fsid": raw[layout.FSID_AT : layout.FSID_AT + layout.FSID_BYTES], **fields}


def _stripes(body: bytes, logical: int) -> list[Chunk]:
    length, n = _int(body, 0, 8), _int(body, 44, 2)
    starts = [layout.CHUNK_BYTES + layout.STRIPE_BYTES * k for k in range(n)]
    return [(logical, logical + length, _int(body, s + 8, 8), length) for s in starts if s + layout.STRIPE_BYTES <= len(body)]


def system_chunks(raw: bytes) -> list[Chunk]:
    """The chunks in the superblock's own array, a row per stripe, up to the first other key."""
    out: list[Chunk] = []
    at, end = layout.ARRAY_AT, layout.ARRAY_AT + _int(raw, layout.ARRAY_SIZE_AT, 4)
    while at < end and at + 17 + layout.CHUNK_BYTES <= len(raw) and raw[at + 8] == layout.CHUNK:
        n = _int(raw, at + 17 + 44, 2)
        body = raw[at + 17 : at + 17 + layout.CHUNK_BYTES + layout.STRIPE_BYTES * n]
        out += _stripes(body, _int(raw, at + 9, 8))
        at += 17 + layout.CHUNK_BYTES + layout.STRIPE_BYTES * n
    return out


def to_physical(address: int, chunks: list[Chunk]) -> int | None:
    """By the first chunk of the list that covers the address."""
    return next((physical + address - start for start, end, physical, _ in chunks if start <= address < end), None)


def chunk_tree(read: Callable[[int, int], bytes], root: int, nodesize: int, known: list[Chunk]) -> list[Chunk]:
    """All chunks: the known ones, then those of the chunk tree's leaves, depth first; the first of equal ones stays.

    Children are looked up in the map as it has grown so far. A node is visited once, so a cycle ends.
    """
    chunks = list(known)
    top = to_physical(root, known)
    if top is None:
        return chunks
    seen = {top}
    # Each entry is a node, or the remaining children of one, so that they are translated as late as a recursion would.
    todo: list = [top]
    while todo:
        at = todo.pop()
        if isinstance(at, list):
            if not at:
                continue
            child, rest = at[0], at[1:]
            todo.append(rest)
            physical = to_physical(child, chunks)
            if physical is not None and physical not in seen:
                seen.add(physical)
                todo.append(physical)
            continue
        node = read(at, nodesize)
        if len(node) < layout.HEADER_BYTES:
            continue
        n, level = _int(node, 96, 4), node[100]
        kind = layout.POINTER if level else layout.ITEM
        n = min(n, (len(node) - layout.HEADER_BYTES) // kind.itemsize)
        entries = np.frombuffer(node, dtype=kind, count=n, offset=layout.HEADER_BYTES)
        if level:
            todo.append(entries["child"].tolist())
            continue
        for e in entries[(entries["type"] == layout.CHUNK) & (entries["data_size"] >= layout.CHUNK_BYTES)]:
            start = layout.HEADER_BYTES + int(e["data_offset"])
            body = read(at + start, int(e["data_size"])) if start + int(e["data_size"]) > len(node) else node[start : start + int(e["data_size"])]
            if len(body) >= layout.CHUNK_BYTES:
                chunks += _stripes(body, int(e["key_offset"]))
    return list({(c[0], c[2]): c for c in reversed(chunks)}.values())[::-1]


def chunk_table(spark: SparkSession, chunks: list[Chunk]) -> DataFrame:
    """(ord, logical_start, logical_end, physical_start, chunk_length); ``ord`` is the order of the list, which matters."""
    rows = [(i, *map(Decimal, c)) for i, c in enumerate(chunks)]
    wide = "decimal(21,0)"
    return spark.createDataFrame(rows, f"ord bigint, logical_start {U64}, logical_end {wide}, physical_start {U64}, chunk_length {U64}")


def superblock_table(spark: SparkSession, sb: dict) -> DataFrame:
    names = ["generation", "nodesize", "sectorsize", "total_bytes", "bytes_used", "root_tree_addr", "chunk_tree_addr", "root_dir_objid", "root_level"]
    return spark.createDataFrame([(bytearray(sb["fsid"]), *(Decimal(sb[n]) for n in names))], "fsid binary, " + ", ".join(f"{n} {U64}" for n in names))


def translated(rows: DataFrame, address: str, chunks: DataFrame, key: list[str], out: str = "physical", n_chunks: int | None = None) -> DataFrame:
    """``rows`` with ``out``: the physical address of ``address`` by the first chunk that covers it, null if none does.

    ``key`` names the columns that tell ``rows`` apart. A small map is broadcast to the range condition. A larger one is
    spread over buckets of the address space to be an equi-join; only its few very wide chunks are still broadcast.
    """
    n = chunks.count() if n_chunks is None else n_chunks
    covers = (F.col(address) >= F.col("logical_start")) & (F.col(address) < F.col("logical_end"))
    value = F.col("physical_start") + F.col(address) - F.col("logical_start")
    asked = rows.select(*key, address).where(F.col(address).isNotNull())
    if n <= BROADCAST_CHUNKS:
        hits = asked.join(F.broadcast(chunks), covers)
    else:
        wide = chunks.where(F.col("chunk_length") > WIDEST)
        bucket = lambda a: F.floor(a / F.lit(BUCKET_BYTES)).cast("bigint")
        last = F.greatest(F.col("logical_end") - 1, F.col("logical_start"))
        spread = chunks.where(F.col("chunk_length") <= WIDEST).withColumn("bucket", F.explode(F.sequence(bucket(F.col("logical_start")), bucket(last))))
        hits = asked.withColumn("bucket", bucket(F.col(address))).join(spread, "bucket").where(covers).drop("bucket")
        if (few := wide.limit(BROADCAST_CHUNKS + 1).count()) > 0:
            wide = F.broadcast(wide) if few <= BROADCAST_CHUNKS else wide
            hits = hits.unionByName(asked.join(wide, covers))
    first = hits.groupBy(*key).agg(F.min_by(value, "ord").alias(out))
    return rows.join(first, key, "left")


def literal_u64(n: int) -> Column:
    return F.lit(Decimal(n)).cast(U64)
