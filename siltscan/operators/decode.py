"""Items to records, by Spark's own functions except where a record repeats within an item."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from siltscan import layout
from siltscan.functions.binary import any_in, field, field_sql, signed_sql
from siltscan.functions.text import as_text, is_name, iso_time
from siltscan.operators.nodes import position

KEYS = ("off", "phase", "slot")


def _whole(n: int) -> Column:
    """At least ``n`` bytes, both by the item's stated size and in fact."""
    return (F.col("data_size") >= n) & (F.octet_length("payload") >= n)


def inode_struct(payload: str, layout_: str = "parity") -> Column:
    """The twelve numbers and four times of an inode record; a time is a struct of sec, nsec and iso."""
    parts = [f"'{name}', {field_sql(payload, *where)}" for name, where in reversed(layout.INODE_FIELDS.items())]
    for name, at in layout.INODE_TIMES[layout_].items():
        sec = signed_sql(payload, at)
        parts.append(f"'{name}', named_struct('sec', {sec}, 'nsec', {field_sql(payload, at + 8, 4)}, 'iso', {iso_time(sec)})")
    return F.expr(f"named_struct({', '.join(parts)})")


def inode_items(items: DataFrame, layout_: str = "parity") -> DataFrame:
    """Every inode record of a leaf, in no order; ``first_inode_metadata`` picks one per inode and generation."""
    rows = items.where((F.col("route") == "leaf") & (F.col("type") == layout.INODE) & _whole(layout.INODE_BYTES))
    return rows.select(position().alias("pos"), F.col("objectid").alias("inode"), F.col("gen"), inode_struct("payload", layout_).alias("meta"))


def first_inode_metadata(inodes: DataFrame) -> DataFrame:
    """(inode, gen, meta) that the scan meets first."""
    return inodes.groupBy("inode", "gen").agg(F.min_by("meta", "pos").alias("meta"))


def ref_names(payload: Column, data_size: Column) -> Column:
    """The raw names of a reference record: 8 bytes of index, 2 of length, the name, again and again; a bad length ends it."""

    @F.pandas_udf(ArrayType(BinaryType()))
    def run(payloads: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([_split_names(bytes(p or b""), int(n)) for p, n in zip(payloads, sizes)], dtype="object")

    return run(payload, data_size)


def _split_names(data: bytes, size: int) -> list[bytes]:
    out: list[bytes] = []
    at, left = 0, size
    while left >= 10 and at + 10 <= len(data):
        n = int.from_bytes(data[at + 8 : at + 10], "little")
        left -= 10
        if not 0 < n <= min(layout.LONGEST_NAME, left) or at + 10 + n > len(data):
            break
        out.append(data[at + 10 : at + 10 + n])
        at, left = at + 10 + n, left - n
    return out


def name_events(items: DataFrame) -> DataFrame:
    """(pos, kind, inode, gen, name, file_type): each valid name that a directory entry or reference gives an inode."""
    leaf = items.where("route = 'leaf'")
    length = field("payload", 27, 2)
    entry = leaf.where(F.col("type").isin(layout.DIR_ITEM, layout.DIR_INDEX) & _whole(layout.DIR_HEADER))
    entry = entry.where(length.between(1, layout.LONGEST_NAME) & (F.octet_length("payload") >= layout.DIR_HEADER + length))
    entry = entry.select(
        position().alias("pos"),
        F.when(F.col("type") == layout.DIR_ITEM, "DIR_ITEM").otherwise("DIR_INDEX").alias("kind"),
        field("payload", 0, 8).alias("inode"),
        "gen",
        as_text(F.substring(F.col("payload"), F.lit(layout.DIR_HEADER + 1), length.cast("int"))).alias("name"),
        field("payload", 29, 1).cast("int").alias("file_type"),
    )
    refs = leaf.where(F.col("type") == layout.REF).select(*KEYS, "objectid", "gen", F.posexplode(ref_names(F.col("payload"), F.col("data_size"))).alias("sub", "raw"))
    refs = refs.select(
        position(F.col("sub")).alias("pos"), F.lit("INODE_REF").alias("kind"), F.col("objectid").alias("inode"), "gen", as_text(F.col("raw")).alias("name"),
        F.lit(None).cast("int").alias("file_type"),
    )
    return entry.unionByName(refs).where(is_name(F.col("name")))


def file_extents(items: DataFrame) -> DataFrame:
    """Inline payloads and references to regular extents; sparse and preallocated ones are left out."""
    p = "payload"
    wide = "decimal(38,0)"
    rows = items.where((F.col("route") == "leaf") & (F.col("type") == layout.EXTENT) & (F.octet_length(p) >= layout.EXTENT_HEADER))
    rows = rows.select(
        position().alias("pos"),
        F.col("objectid").alias("inode"),
        "gen",
        "source",
        "data_size",
        p,
        field(p, 16, 1).cast("int").alias("compression"),
        field(p, 20, 1).cast("int").alias("extent_type"),
    )
    inline = rows.where((F.col("extent_type") == 0) & (F.col("data_size") > layout.EXTENT_HEADER) & (F.octet_length(p) >= F.col("data_size")))
    at = layout.EXTENT_HEADER
    regular = rows.where((F.col("extent_type") == 1) & (F.octet_length(p) >= at + layout.EXTENT_POINTER))
    common = ["pos", "inode", "gen", "source", "compression"]
    inline = inline.select(
        *common, F.lit("inline").alias("extent_type"), (F.col("data_size") - at).cast("decimal(20,0)").alias("size"),
        F.substring(p, F.lit(at + 1), (F.col("data_size") - at).cast("int")).alias("data"),
    )
    disk, n, offset, size = (field(p, at + 8 * k, 8) for k in range(4))
    regular = regular.select(
        *common, F.lit("regular").alias("extent_type"), size.alias("size"), disk.alias("disk_bytenr"), n.alias("disk_num_bytes"), offset.alias("offset"),
        F.greatest(n.cast(wide) - offset.cast(wide) - size.cast(wide), F.lit(0).cast(wide)).alias("file_slack"),
    ).where("disk_bytenr <> 0")
    return inline.unionByName(regular, allowMissingColumns=True)


def root_anomalies(items: DataFrame) -> DataFrame:
    """(pos, objectid, gen) of root records with anything set in their reserved bytes."""
    rows = items.where((F.col("route") == "leaf") & (F.col("type") == layout.ROOT) & _whole(layout.ROOT_BYTES))
    return rows.where(any_in(F.col("payload"), *layout.ROOT_RESERVED)).select(position().alias("pos"), "objectid", "gen")


def extent_backrefs(items: DataFrame) -> DataFrame:
    """Data references of extent leaves with the address from the last extent entry before them in the same node.

    The window is partitioned by node, so the state never crosses one. ``extent_objectid`` is that entry's other number.
    """
    rows = items.where((F.col("route") == "extent") & F.col("type").isin(layout.EXTENT_ENTRY, layout.EXTENT_REF))
    before = Window.partitionBy("off").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    entry = F.col("type") == layout.EXTENT_ENTRY
    rows = rows.withColumn("laddr", F.last(F.when(entry, F.col("key_offset")), ignorenulls=True).over(before))
    rows = rows.withColumn("entry_objectid", F.last(F.when(entry, F.col("objectid")), ignorenulls=True).over(before))
    rows = rows.where((F.col("type") == layout.EXTENT_REF) & _whole(layout.EXTENT_REF_BYTES))
    p = "payload"
    return rows.select(
        position().alias("pos"), F.col("laddr").alias("extent_laddr"), F.col("entry_objectid").alias("extent_objectid"), field(p, 0, 8).alias("root"),
        field(p, 8, 8).alias("inode"), field(p, 16, 8).alias("file_offset"), field(p, 24, 4).alias("ref_count"), F.col("gen").alias("node_gen"),
    )


def devices(items: DataFrame, layout_: str = "parity") -> DataFrame:
    """Device records of device leaves."""
    rows = items.where((F.col("route") == "device") & (F.col("type") == layout.DEVICE) & _whole(layout.DEVICE_BYTES))
    h = F.lower(F.hex(F.substring("payload", layout.DEVICE_UUID[layout_] + 1, 16)))
    uuid = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return rows.select(
        position().alias("pos"), field("payload", 0, 8).alias("devid"), uuid.alias("uuid"), field("payload", 8, 8).alias("total_bytes"),
        field("payload", 16, 8).alias("bytes_used"), F.col("gen").alias("node_gen"),
    )
