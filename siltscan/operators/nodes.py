"""Blocks to validated, classified metadata nodes, and nodes to items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscan import layout
from siltscan.functions.arrow import STEP_BYTES, matrix, stepwise
from siltscan.functions.binary import field, unsigned
from siltscan.functions.checksum import crc32c
from siltscan.operators.superblock import literal_u64

ITEM_FIELDS = "slot int, phase int, objectid bigint, type int, key_offset bigint, data_offset bigint, data_size bigint, payload binary"


def of_filesystem(blocks: DataFrame, fsid: bytes, nodesize: int) -> DataFrame:
    """Whole blocks that carry the filesystem's id: native predicates, which Spark keeps below the checksum."""
    here = F.substring("block", layout.FSID_AT + 1, layout.FSID_BYTES) == F.lit(bytearray(fsid))
    return blocks.where(here & (F.octet_length("block") == nodesize))


def checked(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``csum_ok``."""
    body = F.expr(f"substring(block, {layout.CHECKED_FROM + 1})")
    return blocks.withColumn("csum_ok", field("block", 0, 4) == crc32c(body))


def classed(gen: Column, level: Column, generation: int, scan_current: bool = True) -> Column:
    """orphan: older than the superblock; current: any other leaf, if wanted; else ignored."""
    return F.when(gen < literal_u64(generation), "orphan").when(F.lit(scan_current) & (level == 0), "current").otherwise("ignored")


def routed(kind: Column, owner: Column, level: Column) -> Column:
    """Which decoder a node goes to: extent or device leaf (orphans only), leaf, or internal."""
    leaf, orphan = level == 0, kind == "orphan"
    return (
        F.when(kind == "ignored", "none")
        .when(orphan & leaf & (owner == layout.EXTENT_TREE), "extent")
        .when(orphan & leaf & (owner == layout.DEVICE_TREE), "device")
        .when(leaf, "leaf")
        .otherwise("internal")
    )


def nodes(blocks: DataFrame, fsid: bytes, generation: int, nodesize: int, scan_current: bool = True) -> DataFrame:
    """Nodes of the filesystem: off, block, header fields, ``csum_ok``, ``class`` and ``route``; bad checksums stay, for counting."""
    rows = checked(of_filesystem(blocks, fsid, nodesize))
    rows = rows.select("off", "block", *[field("block", *where).alias(name) for name, where in layout.HEADER.items()], "csum_ok")
    rows = rows.withColumn("class", F.when(F.col("csum_ok"), classed(F.col("gen"), F.col("level"), generation, scan_current)).otherwise("ignored"))
    return rows.withColumn("route", routed(F.col("class"), F.col("owner"), F.col("level")))


def capacity(nodesize: int) -> int:
    """Item pointers that fit a node."""
    return (nodesize - layout.HEADER_BYTES) // layout.ITEM.itemsize


def items(nodes_: DataFrame, nodesize: int) -> DataFrame:
    """Items of leaf, extent and device nodes, with the nodes' off, gen, owner, class and route.

    phase 0: the valid slots, of orphaned nodes only. phase 1: up to ``ORPHAN_SLOTS`` slots past them, of leaf nodes only,
    where they look like an item. ``payload`` is the item's data, of known types only, cut at the node's end and at
    least ``WINDOW`` bytes where the node has them. Nodes with more items than fit are dropped.
    """
    most, room = capacity(nodesize), nodesize - layout.HEADER_BYTES
    wanted = np.zeros(256, dtype=bool)
    wanted[[*layout.MINED, layout.EXTENT_ENTRY, layout.EXTENT_REF, layout.DEVICE]] = True
    plausible = np.zeros(256, dtype=bool)
    plausible[list(layout.PLAUSIBLE)] = True

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.arange(most)
        for batch in stepwise(batches, nodesize):
            blocks = matrix(batch.column("block"), nodesize)
            n = batch.column("nritems").to_numpy()[:, None]
            orphan, leaf = (np.array([v == want for v in batch.column(c).to_pylist()], dtype=bool)[:, None] for c, want in (("class", "orphan"), ("route", "leaf")))
            inside = (slots >= np.where(orphan, 0, n)) & (slots < np.where(leaf, np.minimum(most, n + layout.ORPHAN_SLOTS), n))
            table = np.ascontiguousarray(blocks[:, layout.HEADER_BYTES : layout.HEADER_BYTES + most * layout.ITEM.itemsize]).view(layout.ITEM)
            row, slot = np.nonzero(inside & ((slots < n) | plausible[table["type"]]))
            e = table[row, slot]
            size, offset = e["data_size"].astype(np.int64), e["data_offset"].astype(np.int64)
            valid = slot < n[row, 0]
            keep = valid | ((size > 0) & (size <= nodesize) & (offset + size <= room))
            e, row, slot, valid, size, offset = (x[keep] for x in (e, row, slot, valid, size, offset))
            if not len(row):
                continue
            begin = np.minimum(layout.HEADER_BYTES + offset, nodesize)
            stop = np.minimum(layout.HEADER_BYTES + offset + np.maximum(size, layout.WINDOW), nodesize)
            known = wanted[e["type"]]
            data = blocks.tobytes()
            # Payloads may overlap, so their bytes bound a batch, too.
            ends = np.flatnonzero(np.diff(np.cumsum(np.where(known, stop - begin, 0)) // (8 * STEP_BYTES))) + 1
            for some in np.split(np.arange(len(row)), ends):
                at, x = row[some], e[some]
                own = [batch.column(c).take(pa.array(at)) for c in ("off", "gen", "owner", "class", "route")]
                first, last = (at * nodesize + begin[some]).tolist(), (at * nodesize + stop[some]).tolist()
                cols = [
                    pa.array(slot[some].astype(np.int32)),
                    pa.array((~valid[some]).astype(np.int32)),
                    pa.array(np.ascontiguousarray(x["objectid"]).view(np.int64)),
                    pa.array(x["type"].astype(np.int32)),
                    pa.array(np.ascontiguousarray(x["key_offset"]).view(np.int64)),
                    pa.array(offset[some]),
                    pa.array(size[some]),
                    pa.array([data[a:b] if ok else None for a, b, ok in zip(first, last, known[some].tolist())], pa.binary()),
                ]
                names = ["off", "gen", "owner", "class", "route", "slot", "phase", "objectid", "type", "key_offset", "data_offset", "data_size", "payload"]
                yield pa.RecordBatch.from_arrays([*own, *cols], names)

    src = nodes_.where(F.col("route").isin("leaf", "extent", "device") & (F.col("nritems") <= most))
    src = src.select("off", "block", "gen", "owner", "nritems", "class", "route")
    out = src.mapInArrow(decode, f"off bigint, gen decimal(20,0), owner decimal(20,0), class string, route string, {ITEM_FIELDS}")
    source = F.when(F.col("phase") == 0, "valid").otherwise("orphan")
    return out.withColumns({"objectid": unsigned("objectid"), "key_offset": unsigned("key_offset"), "source": source})


def position(sub: Column | None = None) -> Column:
    """Where the scan meets an event: it orders all events as a single reader from front to back would."""
    return F.struct("off", "phase", "slot", (F.lit(0) if sub is None else sub).cast("int").alias("sub"))


def orphan_pointers(nodes_: DataFrame, nodesize: int) -> DataFrame:
    """Key pointers past the valid ones of internal nodes, up to the first that is null or not aligned to 4096."""
    most = (nodesize - layout.HEADER_BYTES) // layout.POINTER.itemsize
    src = nodes_.where("route = 'internal'").where(F.col("nritems") < most)
    def at(offset: int) -> str:
        start = f"{layout.HEADER_BYTES + 1 + offset} + i * {layout.POINTER.itemsize}"
        digits = ", ".join(f"hex(substring(block, {start} + {7 - k}, 1))" for k in range(8))
        return f"CAST(conv(concat({digits}), 16, 10) AS decimal(20,0))"

    slots = f"sequence(CAST(nritems AS int), {most - 1})"
    pointers = F.expr(f"transform({slots}, i -> named_struct('slot', i, 'child_logical', {at(17)}, 'child_gen', {at(25)}))")
    rows = src.select("off", "gen", pointers.alias("p"))
    return rows.select("off", "gen", F.explode(take_while(F.col("p"), lambda p: (p["child_logical"] != 0) & (p["child_logical"] % 4096 == 0))).alias("p")).select(
        F.col("off").alias("parent_offset"), F.col("gen").alias("parent_gen"), "p.child_logical", "p.child_gen", "p.slot"
    )


def take_while(array: Column, good) -> Column:
    """The elements before the first that isn't ``good``."""
    bad = F.array_position(F.transform(array, good), F.lit(False))
    return F.slice(array, F.lit(1), F.when(bad > 0, bad.cast("int") - 1).otherwise(F.size(array)))


def slack_residuals(nodes_: DataFrame, nodesize: int) -> DataFrame:
    """(off, gen, residuals): item-like structures on the 25-byte grid behind the pointers of internal nodes, where there are any."""
    step, room = layout.ITEM.itemsize, nodesize - layout.HEADER_BYTES
    mined = np.zeros(256, dtype=bool)
    mined[list(layout.MINED)] = True

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepwise(batches, nodesize):
            out = []
            for n, block in zip(batch.column("nritems").to_pylist(), batch.column("block").to_pylist()):
                start = layout.HEADER_BYTES + n * layout.POINTER.itemsize
                count = max(0, (nodesize - start) // step)
                e = np.frombuffer(block, dtype=layout.ITEM, count=count, offset=min(start, nodesize - 1)) if count else np.zeros(0, dtype=layout.ITEM)
                size, offset = e["data_size"].astype(np.int64), e["data_offset"].astype(np.int64)
                out.append(int((mined[e["type"]] & (size > 0) & (size < nodesize) & (offset + size <= room)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("off"), batch.column("gen"), pa.array(out, pa.int64())], ["off", "gen", "residuals"])

    src = nodes_.where("route = 'internal'").select("off", "gen", "nritems", "block")
    return src.mapInArrow(mine, "off bigint, gen decimal(20,0), residuals bigint").where("residuals > 0")


def leaf_slack(nodes_: DataFrame, nodesize: int) -> DataFrame:
    """(kind, off, gen, bytes): what lies between the item pointers and the first item data of leaves, where any of it is set.

    Cut at the node's end.
    """
    most = capacity(nodesize)

    def slack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepwise(batches, nodesize):
            keep, found = [], []
            for row, (n, block) in enumerate(zip(batch.column("nritems").to_pylist(), batch.column("block").to_pylist())):
                e = np.frombuffer(block, dtype=layout.ITEM, count=n, offset=layout.HEADER_BYTES)
                used = e["data_offset"][e["data_size"] > 0]
                first = min(int(used.min()) if len(used) else nodesize, nodesize)
                gap = block[layout.HEADER_BYTES + n * layout.ITEM.itemsize : layout.HEADER_BYTES + first]
                if gap.strip(b"\0"):
                    keep.append(row)
                    found.append(gap)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("off").take(at), batch.column("gen").take(at), pa.array(found, pa.binary())], ["off", "gen", "bytes"])

    src = nodes_.where("route = 'leaf' AND nritems > 0").where(F.col("nritems") <= most).select("off", "gen", "nritems", "block")
    return src.mapInArrow(slack, "off bigint, gen decimal(20,0), bytes binary").select(F.lit("leaf").alias("kind"), "off", "gen", "bytes")
