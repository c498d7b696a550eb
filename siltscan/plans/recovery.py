"""A whole recovery as a set of DataFrames, from blocks or from an image."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan import layout
from siltscan.functions.binary import any_set
from siltscan.operators import decode, extents, names, nodes, report, superblock
from siltscan.sources import files, image


def read_superblock(path: str) -> dict | None:
    """The superblock's fields with ``chunks``: the whole chunk map, in order. None where there is no valid superblock."""
    raw = image.read_at(path, layout.SUPERBLOCK_AT, layout.SUPERBLOCK_BYTES)
    sb = superblock.parse_superblock(raw)
    if sb is None:
        return None
    if sb["nodesize"] <= layout.HEADER_BYTES:
        raise ValueError(f"nodesize {sb['nodesize']} can't hold a node")
    tree = superblock.chunk_tree(lambda at, n: image.read_at(path, at, n), sb["chunk_tree_addr"], sb["nodesize"], superblock.system_chunks(raw))
    return {**sb, "chunks": tree}


def recover_blocks(
    blocks: DataFrame, sb: dict, nodes_scanned: int, chunks: DataFrame | None = None, scan_current: bool = True, layout_: str = "parity", persist: bool = True
) -> dict[str, DataFrame]:
    """All tables of a recovery from (off, block) and the superblock's fields.

    What feeds several branches is kept, on disk where memory is short; a lost executor's part is
    computed again from the image.
    """
    spark, size = blocks.sparkSession, sb["nodesize"]
    chunks = superblock.chunk_table(spark, sb["chunks"]) if chunks is None else chunks
    keep = (lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)) if persist else (lambda df: df)
    t: dict[str, DataFrame] = {"chunks": chunks, "superblock": superblock.superblock_table(spark, sb)}
    t["nodes"] = keep(nodes.nodes(blocks, sb["fsid"], sb["generation"], size, scan_current))
    t["leaf_items"] = keep(nodes.items(t["nodes"], size))
    t["inode_items"] = decode.inode_items(t["leaf_items"], layout_)
    t["inode_metadata"] = decode.first_inode_metadata(t["inode_items"])
    t["name_events"] = keep(decode.name_events(t["leaf_items"]))
    t["names"] = names.final_names(t["name_events"])
    t["moves"] = keep(names.moves(t["name_events"]))
    t["file_extents"] = decode.file_extents(t["leaf_items"])
    # Payloads stay out of the windows over inodes and paths and join back once, by their place in the image.
    t["named_extents"] = named = keep(names.resolved(t["file_extents"].drop("data"), t["name_events"]))
    t["inline_names"] = keep(extents.inline_files(named))
    payloads = t["file_extents"].where("extent_type = 'inline'").select("pos", "data")
    t["inline_files"] = t["inline_names"].join(payloads, "pos")
    t["regular_files"] = keep(extents.regular_files(named, chunks, len(sb["chunks"]) if "chunks" in sb else None))
    t["root_anomalies"] = decode.root_anomalies(t["leaf_items"])
    t["extent_backrefs"] = decode.extent_backrefs(t["leaf_items"])
    t["devices"] = decode.devices(t["leaf_items"], layout_)
    t["orphan_pointers"] = nodes.orphan_pointers(t["nodes"], size)
    t["slack_residuals"] = nodes.slack_residuals(t["nodes"], size)
    t["leaf_slack"] = nodes.leaf_slack(t["nodes"], size)
    t["recovered_files"] = report.recovered_files(t)
    t["stats"] = report.stats(t, nodes_scanned, sb)
    return t


def edges_of_image(spark: SparkSession, path: str, nodesize: int | None) -> DataFrame:
    """(kind, off, gen, bytes) of the boot area and of the bytes behind the last whole node, where anything in them is set."""
    size = image.image_size(path)
    found = [("boot", 0, bytearray(image.read_at(path, 0, layout.SUPERBLOCK_AT)))]
    if nodesize and size % nodesize:
        found.append(("volume", size - size % nodesize, bytearray(image.read_at(path, size - size % nodesize, nodesize))))
    rows = spark.createDataFrame([(k, o, None, b) for k, o, b in found], "kind string, off bigint, gen decimal(20,0), bytes binary")
    return rows.where(any_set(F.col("bytes")))


def recover(spark: SparkSession, path: str, scan_current: bool = True, layout_: str = "parity") -> dict[str, DataFrame]:
    """All tables of a recovery from an image, ``slack`` of all kinds included.

    Without a valid superblock there is only what lies in the boot area.
    """
    sb = read_superblock(path)
    if sb is None:
        return {"slack": edges_of_image(spark, path, None)}
    size = sb["nodesize"]
    blocks = image.blocks(spark, path, size, sb["fsid"])
    t = recover_blocks(blocks, sb, image.block_count(image.image_size(path), size), scan_current=scan_current, layout_=layout_)
    t["slack"] = edges_of_image(spark, path, size).unionByName(t["leaf_slack"])
    return t


def slack_path() -> Column:
    leaf = F.concat(F.format_string("leaf_slack_0x%X_gen", F.col("off")), F.col("gen").cast("string"), F.lit(".bin"))
    return F.when(F.col("kind") == "boot", "boot_sector.bin").when(F.col("kind") == "volume", "volume_slack.bin").otherwise(leaf)


def save(t: dict[str, DataFrame], path: str, folder: str) -> None:
    """Recovered files, slack and ``recovery_report.json`` below ``folder``. Files of an earlier run are replaced."""
    first = F.lit(0).cast("bigint")
    pieces = t["slack"].select(slack_path().alias("output_path"), first.alias("piece"), F.col("bytes").alias("data"))
    if "stats" in t:
        inline = t["inline_files"].select("output_path", first.alias("piece"), "data")
        pieces = pieces.unionByName(inline).unionByName(extents.extent_pieces(t["regular_files"], path).drop("short_read"))
    # Files are of one piece, or come piece by piece from the task that reads them: nothing is shuffled to be written.
    files.write_files(pieces, folder, together=True)
    if "stats" in t:
        files.write_text(folder, "recovery_report.json", report.report_text(t))


def save_catalog(t: dict[str, DataFrame], folder: str) -> None:
    """Every table but the raw nodes, and those that others repeat, as Parquet below ``folder``."""
    for name, df in t.items():
        if name not in ("nodes", "inline_names", "named_extents"):
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def release(t: dict[str, DataFrame]) -> None:
    """Give back what a recovery keeps on the executors; its tables can still be used and are computed again then."""
    for df in t.values():
        if df.is_cached:
            df.unpersist()


def run_recovery_engine(spark: SparkSession, image_file: str, output_dir: str, scan_current_gen: bool = True) -> dict[str, DataFrame]:
    """Recover from ``image_file`` into ``output_dir`` and return the tables."""
    t = recover(spark, image_file, scan_current_gen)
    save(t, image_file, output_dir)
    release(t)
    return t
