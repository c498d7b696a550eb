"""Counters, warnings and the report: aggregates over the recovered tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscan import layout
from siltscan.functions.text import size_string

#: Counters in the report; the rest are flags.
COUNTERS = (
    "nodes_scanned", "orphan_nodes_found", "current_nodes_scanned", "checksum_failures", "subvolume_nodes_seen", "orphan_items_found",
    "root_item_anomalies", "leaf_slacks_found", "internal_slack_residuals", "internal_orphan_ptrs_found", "extent_backrefs_found",
    "move_artifacts_found", "regular_extents_failed", "regular_extents_recovered", "inline_files_recovered", "total_artifacts",
)


def _node_counters() -> dict[str, Column]:
    """Nodes by class, checksum failures, and nodes of subvolumes (of any generation; ids count as unsigned)."""
    ok = F.col("csum_ok")
    return {
        "orphan_nodes_found": F.col("class") == "orphan",
        "current_nodes_scanned": F.col("class") == "current",
        "checksum_failures": ~ok,
        "subvolume_nodes_seen": ok & (F.col("owner") >= layout.FIRST_SUBVOLUME),
    }


def node_counters(nodes: DataFrame) -> DataFrame:
    """The counters of nodes as one row."""
    return nodes.agg(*[F.count_if(c).cast("bigint").alias(name) for name, c in _node_counters().items()])


def defrag_warning(orphans: Column, scanned: Column, used: Column, total: Column) -> Column:
    """Hardly any orphans on a disk more than half full; a total of 0 counts as empty."""
    few = orphans / F.when(scanned > 0, scanned) < 0.01
    full = F.coalesce(used.cast("double") / F.when(total > 0, total).cast("double"), F.lit(0.0)) > 0.5
    return F.coalesce(few & full, F.lit(False))


def stats(t: dict[str, DataFrame], nodes_scanned: int, sb: dict) -> DataFrame:
    """The counters and flags as one row: what each table adds to a counter, under each other, and one aggregate over all."""

    def adds(table: str, counters: dict[str, Column]) -> DataFrame:
        each = [F.struct(F.lit(name).alias("name"), value.cast("bigint").alias("n")) for name, value in counters.items()]
        return t[table].select(F.inline(F.array(*each)))

    state = F.col("state")
    parts = [
        adds("nodes", _node_counters()),
        adds("leaf_items", {"orphan_items_found": (F.col("phase") == 1) & (F.col("route") == "leaf")}),
        adds("root_anomalies", {"root_item_anomalies": F.lit(1)}),
        adds("leaf_slack", {"leaf_slacks_found": F.lit(1)}),
        adds("slack_residuals", {"internal_slack_residuals": F.col("residuals")}),
        adds("orphan_pointers", {"internal_orphan_ptrs_found": F.lit(1)}),
        adds("extent_backrefs", {"extent_backrefs_found": F.lit(1)}),
        adds("moves", {"move_artifacts_found": F.lit(1)}),
        adds("inline_names", {"inline_files_recovered": F.lit(1)}),
        adds("regular_files", {"regular_extents_recovered": state == "recovered", "regular_extents_failed": state == "failed", "regular": F.lit(1)}),
    ]
    names = [c for c in (*COUNTERS, "regular") if c not in ("nodes_scanned", "total_artifacts")]
    one = reduce(DataFrame.unionAll, parts).agg(*[F.coalesce(F.sum(F.when(F.col("name") == c, F.col("n"))), F.lit(0)).cast("bigint").alias(c) for c in names])
    one = one.withColumns({"nodes_scanned": F.lit(nodes_scanned).cast("bigint"), "total_artifacts": F.col("inline_files_recovered") + F.col("regular")})
    used, total = F.lit(float(sb["bytes_used"])), F.lit(float(sb["total_bytes"]))
    return one.select(
        *COUNTERS,
        defrag_warning(F.col("orphan_nodes_found"), F.col("nodes_scanned"), used, total).alias("defrag_warning"),
        (F.col("subvolume_nodes_seen") > 0).alias("has_snapshots"),
    )


INLINE = ("filename", "inode", "generation", "extent_type", "size", "output_path", "source", "compressed")
REGULAR = (*INLINE[:-1], "disk_bytenr", "disk_num_bytes", "offset", "file_slack")


def recovered_files(t: dict[str, DataFrame]) -> DataFrame:
    """Inline and regular files in one table; what one kind lacks is null."""
    inline, regular = (t[name].withColumnRenamed("gen", "generation").select("pos", *columns) for name, columns in (("inline_names", INLINE), ("regular_files", REGULAR)))
    return inline.unionByName(regular, allowMissingColumns=True)


#: Sections of the report, and what encloses the rows of each; a section without is one value.
SECTIONS = (
    ("generated_at", ""), ("stats", ""), ("recovered_files", "[]"), ("inode_metadata", "{}"), ("extent_backrefs", "[]"), ("orphan_child_ptrs", "[]"),
    ("move_artifacts", "[]"), ("device_info", "[]"),
)


def report_rows(t: dict[str, DataFrame]) -> DataFrame:
    """(section, at, json): the report row by row, each made where its data are. ``at`` orders a section as the scan goes.

    A row has all fields of its kind; those without a value are null.
    """
    none = F.array().cast("array<bigint>")

    def rows(section: str, df: DataFrame, columns: list[str], pos: tuple[str, ...] = ("pos.off", "pos.phase", "pos.slot", "pos.sub")) -> DataFrame:
        at = F.array(*[F.col(c).cast("bigint") for c in pos])
        json = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        number = [name for name, _ in SECTIONS].index(section)
        return df.select(F.lit(number).alias("section"), (at if pos else none).alias("at"), json.alias("json"))

    now = F.to_json(F.array(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))
    key = F.concat_ws("_", F.col("inode").cast("string"), F.col("gen").cast("string"))
    meta = F.to_json(F.col("meta"), {"ignoreNullFields": "false"})
    inline, regular = (t[name].withColumnRenamed("gen", "generation") for name in ("inline_names", "regular_files"))
    backrefs, pointers, moves, devices = t["extent_backrefs"], t["orphan_pointers"], t["moves"], t["devices"]
    parts = [
        t["superblock"].select(F.lit(0).alias("section"), none.alias("at"), now.substr(F.lit(2), F.length(now) - 2).alias("json")),
        rows("stats", t["stats"], t["stats"].columns, ()),
        rows("recovered_files", inline, list(INLINE)),
        rows("recovered_files", regular, list(REGULAR)),
        t["inode_metadata"].select(F.lit(3).alias("section"), none.alias("at"), F.concat(F.lit('"'), key, F.lit('": '), meta).alias("json")),
        rows("extent_backrefs", backrefs, [c for c in backrefs.columns if c not in ("pos", "extent_objectid")]),
        rows("orphan_child_ptrs", pointers, pointers.columns, ("parent_offset", "slot")),
        rows("move_artifacts", moves, [c for c in moves.columns if c != "pos"]),
        rows("device_info", devices, [c for c in devices.columns if c != "pos"]),
    ]
    return reduce(DataFrame.unionAll, parts)


def report_text(t: dict[str, DataFrame]) -> Iterator[str]:
    """The report's JSON in pieces: rows sorted by the executors and streamed partition by partition, so that the driver never holds more than some."""
    ordered = report_rows(t).orderBy("section", "at", "json").select("section", "json")
    yield "{"
    done = 0  # sections that are begun
    for row in ordered.toLocalIterator(prefetchPartitions=True):
        fresh = row.section >= done
        while done <= row.section:
            yield _closed(done - 1) + f'{"," if done else ""}\n"{SECTIONS[done][0]}": {SECTIONS[done][1][:1]}'
            done += 1
        yield ("\n" if fresh else ",\n") + row.json
    while done < len(SECTIONS):
        yield _closed(done - 1) + f'{"," if done else ""}\n"{SECTIONS[done][0]}": {SECTIONS[done][1][:1]}'
        done += 1
    yield _closed(done - 1) + "\n}\n"


def _closed(section: int) -> str:
    return "\n" + SECTIONS[section][1][1:] if section >= 0 and SECTIONS[section][1] else ""


def summary(t: dict[str, DataFrame], limit: int = 200) -> str:
    """Counters and the first recovered files, for a terminal."""
    row = t["stats"].first().asDict()
    lines = ["Recovery summary", ""]
    lines += [f"  {name.replace('_', ' '):<28}{row[name]}" for name in COUNTERS]
    if row["defrag_warning"]:
        lines.append("  Defragmentation may have run: few stale nodes on a well-filled disk.")
    if row["has_snapshots"]:
        lines.append(f"  Snapshots or subvolumes: {row['subvolume_nodes_seen']} nodes")
    files = recovered_files(t).withColumn("shown", size_string(F.col("size"))).orderBy("pos").limit(limit + 1).collect()
    if files:
        lines += ["", f"  {'name':<30} {'inode':<8} {'gen':<6} {'type':<8} {'size':<10} source"]
        lines += [f"  {f.filename[:30]:<30} {f.inode!s:<8} {f.generation!s:<6} {f.extent_type:<8} {f.shown:<10} {f.source}" for f in files[:limit]]
    if len(files) > limit:
        lines.append("  ...")
    for m in t["moves"].orderBy("pos").limit(limit).collect():
        lines.append(f"  inode {m.inode}: {m.original_path!r} -> {m.current_path!r}")
    return "\n".join(lines)
