"""Driver queries of the recovery operators, by the inventory's ids, with their SQL.

Round trips encode table rows as nodes, run the real operators on these, and compare with plain SQL over the table.
Analogues run a relational operator itself on table columns; they recover nothing and are named so in their docstrings.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscan import layout
from siltscan.functions import text
from siltscan.functions.binary import any_set, encoded, field, zeros
from siltscan.functions.checksum import crc32c
from siltscan.operators import decode, extents, names, nodes, report, superblock
from siltscan.plans import encode, recovery
from siltscan.sources import files, image

FSID = bytes(range(16, 32))
NODE, PER_NODE, GENERATION = 4096, 8, 100
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _items(rows: DataFrame, key: Column, kind: int, payload: Column, objectid: Column | None = None, slot: Column | None = None, **more: Column) -> DataFrame:
    """Items for ``encode_leaves``, ``PER_NODE`` keys to a node."""
    cols = {"gen": F.lit(50), "owner": F.lit(5), "key_offset": F.lit(0)} | more
    node = cols.pop("node", F.floor(key / PER_NODE))
    return rows.select(
        node.alias("node"), (key * 4 if slot is None else slot).alias("slot"), (key if objectid is None else objectid).alias("objectid"), F.lit(kind).alias("type"),
        payload.alias("payload"), *[c.alias(n) for n, c in cols.items()],
    )


def _full_nodes(place: Column, payload: int) -> Column:
    """Nodes as full as items of ``payload`` bytes make them, by a place that counts rows within each partition."""
    most = F.lit((NODE - layout.HEADER_BYTES) // (layout.ITEM.itemsize + payload))
    return F.floor((place - place % most) / most)


def _nodes(items: DataFrame, scan_current: bool = True) -> DataFrame:
    return nodes.nodes(encode.encode_leaves(items, NODE, FSID), FSID, GENERATION, NODE, scan_current)


def _decoded(items: DataFrame) -> DataFrame:
    return nodes.items(_nodes(items), NODE)


def _long(*names_: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names_]


# Round trips.


@query("SELECT c_custkey AS inode, 'cust ' || c_name || '.txt' AS filename, length(c_mktsegment || c_name)::BIGINT AS size, c_mktsegment || c_name AS content, 'valid' AS source FROM customer")
def flagship_deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which deleted inline files can be recovered: customers as directory entries and inline extents (round trip)."""
    c, key = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    files = _items(c, key, layout.EXTENT, encode.inline_extent(F.encode(F.concat("c_mktsegment", "c_name"), "UTF-8")), slot=key * 4 + 1)
    entries = _items(c, key, layout.DIR_ITEM, encode.dir_entry(key, F.concat(F.lit("cust "), F.col("c_name"), F.lit(".txt"))))
    items = _decoded(entries.unionByName(files))
    found = extents.inline_files(names.resolved(decode.file_extents(items), decode.name_events(items)))
    return found.select(F.col("inode").cast("bigint").alias("inode"), "filename", F.col("size").cast("bigint").alias("size"), F.decode("data", "UTF-8").alias("content"), "source")


def _shared(spark: SparkSession) -> str:
    """The session's shared folder as a path at which files can be written; a local session without one gets its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = (folder or tempfile.mkdtemp(prefix="siltscan-")).removeprefix("file://")
    if "://" in folder:
        raise ValueError("an image can only be written at offsets to a mounted folder")
    return folder


def _image_of(spark: SparkSession, blocks: DataFrame, n_blocks: int) -> str:
    """Write blocks into one image in the session's shared folder, each task at its own offsets."""
    folder = _shared(spark)
    path = f"{folder}/image-{uuid.uuid4().hex}.img"
    size = layout.SUPERBLOCK_AT + NODE * (n_blocks + 1)

    def write(batches):
        import os

        for batch in batches:
            fd = os.open(path, os.O_RDWR)
            try:
                for off, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    os.pwrite(fd, block, off)
            finally:
                os.close(fd)
        yield from ()

    import os

    os.makedirs(folder, exist_ok=True)
    with open(path, "wb") as f:
        f.truncate(size)
    blocks.mapInArrow(write, "off bigint").count()
    return path


@query(f"""
SELECT CASE WHEN gen < {GENERATION} THEN 'orphan' ELSE 'current' END AS class, gen, count(*) AS n FROM (
  SELECT s_suppkey // {PER_NODE} AS node, min(10 + s_suppkey // {PER_NODE} % 120)::BIGINT AS gen FROM supplier GROUP BY 1
) GROUP BY ALL""")
def s1_image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image written from suppliers, scanned by the data source; nodes by class and generation (round trip)."""
    s, key = _read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    items = _items(s, key, layout.DIR_ITEM, encode.dir_entry(key, F.col("s_name")), gen=F.lit(10) + F.floor(key / PER_NODE) % 120)
    last = s.agg(F.max(F.floor(key / PER_NODE))).first()[0]
    path = _image_of(spark, encode.encode_leaves(items, NODE, FSID), int(last or 0) + 1)
    found = nodes.nodes(image.blocks(spark, path, NODE, FSID), FSID, GENERATION, NODE).where("csum_ok")
    return found.groupBy("class", F.col("gen").cast("bigint").alias("gen")).agg(F.count("*").alias("n"))


@query(f"""
SELECT node, logical_bytenr, csum_ok FROM (
  SELECT p_partkey // {PER_NODE} AS node, ({layout.SUPERBLOCK_AT + NODE} + p_partkey // {PER_NODE} * {NODE})::BIGINT AS logical_bytenr, NOT bool_or(p_size = 7) AS csum_ok FROM part GROUP BY 1, 2
)""")
def f3_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with any part of size 7 get a wrong checksum (round trip)."""
    p, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    items = _items(p, key, layout.DIR_ITEM, encode.dir_entry(key, F.col("p_name")), broken=F.col("p_size") == 7)
    node = F.expr(f"(off - {layout.SUPERBLOCK_AT + NODE}) div {NODE}").alias("node")
    return _nodes(items).select(node, F.col("logical_bytenr").cast("bigint").alias("logical_bytenr"), "csum_ok")


@query(f"""
SELECT CASE WHEN gen < {GENERATION} THEN 'orphan' ELSE 'current' END AS class,
  CASE WHEN gen < {GENERATION} AND owner = 2 THEN 'extent' WHEN gen < {GENERATION} AND owner = 4 THEN 'device' ELSE 'leaf' END AS route,
  count(*) AS n, sum(CASE WHEN owner >= 256 THEN 1 ELSE 0 END)::BIGINT AS subvolumes
FROM (SELECT p_partkey // {PER_NODE} AS node, min(90 + p_partkey // {PER_NODE} % 20) AS gen, min(p_partkey // {PER_NODE} % 7 + CASE WHEN p_partkey // {PER_NODE} % 11 = 0 THEN 256 ELSE 0 END) AS owner FROM part GROUP BY 1)
GROUP BY ALL""")
def f4_f5_classes_and_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation classes, owner routes and subvolume nodes (round trip)."""
    p, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    n = F.floor(key / PER_NODE)
    items = _items(p, key, layout.INODE, zeros(8), gen=F.lit(90) + n % 20, owner=n % 7 + F.when(n % 11 == 0, 256).otherwise(0))
    return _nodes(items).groupBy("class", "route").agg(F.count("*").alias("n"), F.count_if(F.col("owner") >= layout.FIRST_SUBVOLUME).alias("subvolumes"))


@query(f"""
SELECT p_partkey AS objectid, CASE WHEN p_size % 3 = 0 THEN 'orphan' ELSE 'valid' END AS source, (p_partkey * 3)::BIGINT AS key_offset, length(p_name)::BIGINT + 30 AS data_size
FROM part WHERE p_partkey // {PER_NODE} % 5 <> 0 OR p_size % 3 = 0""")
def g1_g2_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid items of orphaned nodes, and items hidden past the valid ones of all leaves (round trip)."""
    p, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    gen = F.when(F.floor(key / PER_NODE) % 5 == 0, GENERATION).otherwise(50)
    got = _decoded(_items(p, key, layout.DIR_ITEM, encode.dir_entry(key, F.col("p_name")), gen=gen, key_offset=key * 3, hidden=F.col("p_size") % 3 == 0))
    return got.select(*_long("objectid"), "source", *_long("key_offset", "data_size"))


@query("SELECT p_partkey AS inode, name, sub FROM part, LATERAL (VALUES (p_name, 0), (p_brand, 1), (p_type, 2)) AS v(name, sub)")
def g6_inode_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three names in one reference item (round trip)."""
    p, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    payload = F.concat(*[encode.ref_entry(F.lit(i), F.col(c)) for i, c in enumerate(("p_name", "p_brand", "p_type"))])
    got = decode.name_events(_decoded(_items(p, key, layout.REF, payload)))
    return got.select(*_long("inode"), "name", F.col("pos.sub").alias("sub"))


@query("""
SELECT o_orderkey AS inode, o_custkey AS uid, (o_orderkey * 7)::BIGINT AS size, (o_orderkey % 512 + 32768)::BIGINT AS mode, epoch(o_orderdate)::BIGINT AS mtime,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM orders""")
def p3_inode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as inode records with a modification time (round trip)."""
    o, key = _read(spark, sf_dir, "orders").withColumn("place", F.monotonically_increasing_id()), F.col("o_orderkey")
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate AS timestamp_ntz))") if dict(o.dtypes)["o_orderdate"] == "timestamp_ntz" else seconds
    record = encode.inode_record(size=key * 7, uid=F.col("o_custkey"), mode=key % 512 + 32768, mtime=seconds)
    got = decode.inode_items(_decoded(_items(o, key, layout.INODE, record, slot=F.col("place"), node=_full_nodes(F.col("place"), layout.INODE_BYTES))))
    m = "meta."
    return got.select(*_long("inode"), F.col(m + "uid").alias("uid"), F.col(m + "size").cast("bigint").alias("size"), F.col(m + "mode").alias("mode"), F.col(m + "mtime.sec").alias("mtime"), F.col(m + "mtime.iso").alias("iso"))


@query("""
SELECT l_orderkey AS inode, l_partkey * 4096 AS disk_bytenr, l_suppkey * 4096 AS disk_num_bytes, l_linenumber::BIGINT * 512 AS offset_, 1024::BIGINT AS size,
  greatest(l_suppkey * 4096 - (l_linenumber::BIGINT * 512 + 1024), 0) AS file_slack FROM lineitem WHERE l_linenumber <= 2 AND l_partkey <> 0""")
def p8_regular_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as regular extents with file slack; address 0 means sparse, which is left out (round trip)."""
    rows = _read(spark, sf_dir, "lineitem").where("l_linenumber <= 2").withColumn("place", F.monotonically_increasing_id())
    key = F.col("place")
    payload = encode.regular_extent(F.col("l_partkey") * 4096, F.col("l_suppkey") * 4096, F.col("l_linenumber").cast("bigint") * 512, F.lit(1024))
    # As many rows to a node as fit, in the order they are read. Slots past the valid ones are looked for all over a node; payloads of a
    # multiple of an item's 25 bytes lie alike on that grid, where no slot has both a type and a size, whatever the values are.
    size = 3 * layout.ITEM.itemsize
    payload = F.concat(payload, zeros(size - layout.EXTENT_HEADER - layout.EXTENT_POINTER))
    items = _items(rows, key, layout.EXTENT, payload, objectid=F.col("l_orderkey"), slot=key, node=_full_nodes(key, size))
    got = decode.file_extents(_decoded(items))
    return got.select(*_long("inode", "disk_bytenr", "disk_num_bytes"), F.col("offset").cast("bigint").alias("offset_"), *_long("size", "file_slack"))


@query(f"""
SELECT s_suppkey AS devid, '00000000-0000-0000-0000-' || lpad(lower(hex(s_suppkey)), 12, '0') AS uuid, s_suppkey * 1000 AS total_bytes, s_nationkey::BIGINT AS bytes_used FROM supplier""")
def g8_p11_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as device records (round trip)."""
    s, key = _read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    big = F.unhex(F.lpad(F.hex(key), 32, "0"))
    payload = F.concat(encoded(key, 8), encoded(key * 1000, 8), encoded(F.col("s_nationkey"), 8), zeros(58), big)
    got = decode.devices(_decoded(_items(s, key, layout.DEVICE, payload, owner=F.lit(layout.DEVICE_TREE))))
    return got.select(*_long("devid"), "uuid", *_long("total_bytes", "bytes_used"))


@query(f"""
SELECT event_id AS inode, user_id AS root, last_value(CASE WHEN event_type = 'purchase' OR event_id % 3 = 0 THEN event_id * 4096 END IGNORE NULLS)
  OVER (PARTITION BY event_id // {PER_NODE * 4} ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS extent_laddr FROM events QUALIFY NOT (event_type = 'purchase' OR event_id % 3 = 0)""")
def g7_w3_backrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as extent entries and references to the last entry before them in the same node (round trip)."""
    e, key = _read(spark, sf_dir, "events"), F.col("event_id")
    entry = (F.col("event_type") == "purchase") | (key % 3 == 0)
    payload = F.concat(encoded(F.col("user_id"), 8), encoded(key, 8), zeros(8), encoded(F.lit(1), 4))
    items = e.select(
        F.floor(key / (PER_NODE * 4)).alias("node"), key.alias("slot"), key.alias("objectid"), F.when(entry, layout.EXTENT_ENTRY).otherwise(layout.EXTENT_REF).alias("type"),
        (key * 4096).alias("key_offset"), payload.alias("payload"), F.lit(50).alias("gen"), F.lit(layout.EXTENT_TREE).alias("owner"),
    )
    got = decode.extent_backrefs(_decoded(items))
    return got.select(*_long("inode", "root", "extent_laddr"))


@query("SELECT p_partkey AS objectid FROM part WHERE p_size % 4 = 0")
def p9_root_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as root records, some with a reserved byte set (round trip)."""
    p, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    payload = F.concat(zeros(300), F.when(F.col("p_size") % 4 == 0, F.unhex(F.lit("05"))).otherwise(zeros(1)), zeros(138))
    return decode.root_anomalies(_decoded(_items(p, key, layout.ROOT, payload))).select(*_long("objectid"))


@query(f"""
SELECT node, {NODE - layout.HEADER_BYTES} - shown * 25 - used AS slack, hidden > 0 AS found FROM (
  SELECT p_partkey // {PER_NODE} AS node, sum(CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END)::BIGINT AS shown, sum(CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) AS hidden,
    sum(CASE WHEN p_size % 3 = 0 THEN 0 ELSE length(p_name) + 30 END)::BIGINT AS used FROM part GROUP BY 1)
WHERE hidden > 0 AND shown > 0""")
def k2_leaf_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the slack of leaves whose hidden items leave bytes there (round trip)."""
    p, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    items = _items(p, key, layout.DIR_ITEM, encode.dir_entry(key, F.col("p_name")), hidden=F.col("p_size") % 3 == 0)
    got = nodes.leaf_slack(_nodes(items), NODE)
    return got.select(F.expr(f"(off - {layout.SUPERBLOCK_AT + NODE}) div {NODE}").alias("node"), F.octet_length("bytes").cast("bigint").alias("slack"), any_set(F.col("bytes")).alias("found"))


@query(f"""
WITH n AS (SELECT c_custkey // {PER_NODE} AS node, count(*) AS items, bool_or(c_nationkey = 3) AS broken FROM customer GROUP BY 1)
SELECT (max(node) + 1)::BIGINT AS nodes_scanned, sum(CASE WHEN broken THEN 0 ELSE 1 END)::BIGINT AS orphan_nodes_found, sum(CASE WHEN broken THEN 1 ELSE 0 END)::BIGINT AS checksum_failures,
  sum(CASE WHEN broken THEN 0 ELSE items END)::BIGINT AS inline_files_recovered, sum(CASE WHEN broken THEN 0 ELSE items END)::BIGINT AS total_artifacts, false AS has_snapshots, false AS defrag_warning FROM n""")
def a1_recovery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a whole recovery of an image with inline files, some nodes broken (round trip)."""
    c, key = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    items = _items(c, key, layout.EXTENT, encode.inline_extent(F.encode("c_name", "UTF-8")), broken=F.col("c_nationkey") == 3)
    n = int(c.agg(F.max(F.floor(key / PER_NODE))).first()[0] or 0) + 1
    sb = {"fsid": FSID, "generation": GENERATION, "nodesize": NODE, "bytes_used": 6, "total_bytes": 10, "chunks": []}
    sb |= dict.fromkeys(["sectorsize", "root_tree_addr", "chunk_tree_addr", "root_dir_objid", "root_level"], 0)
    t = recovery.recover_blocks(encode.encode_leaves(items, NODE, FSID), sb, n)
    return t["stats"].select("nodes_scanned", "orphan_nodes_found", "checksum_failures", "inline_files_recovered", "total_artifacts", "has_snapshots", "defrag_warning")


def _report(spark: SparkSession, t: dict[str, DataFrame], schema: str) -> DataFrame:
    """The report as it is written, read again."""
    folder = f"{_shared(spark)}/report-{uuid.uuid4().hex}"
    files.write_text(folder, "recovery_report.json", report.report_text(t))
    return spark.read.schema(schema).json(f"{folder}/recovery_report.json", multiLine=True)


@query("SELECT json_extract_string(value, '$.filename') AS filename, json_extract_string(value, '$.size')::BIGINT AS size FROM (SELECT json_object('filename', 'inode_' || n_nationkey, 'size', length(n_name)) AS value FROM nation)")
def k4_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report of a recovery, parsed again (round trip)."""
    c, key = _read(spark, sf_dir, "nation"), F.col("n_nationkey").cast("bigint")
    items = _items(c, key, layout.EXTENT, encode.inline_extent(F.encode("n_name", "UTF-8")))
    sb = {"fsid": FSID, "generation": GENERATION, "nodesize": NODE, "bytes_used": 6, "total_bytes": 10, "chunks": []}
    sb |= dict.fromkeys(["sectorsize", "root_tree_addr", "chunk_tree_addr", "root_dir_objid", "root_level"], 0)
    t = recovery.recover_blocks(encode.encode_leaves(items, NODE, FSID), sb, 4)
    return _report(spark, t, "recovered_files array<struct<filename:string,size:bigint>>").select(F.explode("recovered_files").alias("f")).select("f.filename", "f.size")


@query("SELECT 'inode_' || s_suppkey || '_gen50_valid_extent.bin' AS output_path, s_name AS content, false AS short_read FROM supplier")
def s7_regular_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names as regular extents elsewhere in an image: deduplicated, translated and read back (round trip)."""
    s, key = _read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    raw, step = F.encode("s_name", "UTF-8"), 256
    last = int(s.agg(F.max("s_suppkey")).first()[0] or 0)
    n, logical = last // PER_NODE + 1, 1 << 30
    data_at = layout.SUPERBLOCK_AT + NODE * (n + 1)
    extent = encode.regular_extent(key * step + logical, F.lit(step), F.lit(0), F.octet_length(raw))
    blocks = encode.encode_leaves(_items(s, key, layout.EXTENT, extent), NODE, FSID)
    data = s.select((key * step + data_at).alias("off"), raw.alias("block"))
    path = _image_of(spark, blocks.unionByName(data), n + (last + 1) * step // NODE + 1)
    chunks = superblock.chunk_table(spark, [(logical, logical + (1 << 40), data_at, 1 << 40)])
    items = nodes.items(nodes.nodes(image.blocks(spark, path, NODE, FSID), FSID, GENERATION, NODE), NODE)
    named = names.resolved(decode.file_extents(items), decode.name_events(items))
    pieces = extents.extent_pieces(extents.regular_files(named, chunks), path)
    return pieces.select("output_path", F.decode("data", "UTF-8").alias("content"), "short_read")


@query("""
SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, (n_nationkey + 1) * 1048576 AS logical_start, (n_nationkey + 1) * 1048576 + 4096 + n_regionkey AS logical_end,
  CASE WHEN n_nationkey = 0 THEN 69632 ELSE n_nationkey * 8192 + 7 END::BIGINT AS physical_start FROM nation""")
def s2_s5_s6_chunk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk map of an image whose superblock holds the first nation's chunk and whose chunk tree holds all (round trip)."""
    rows = [r.asDict() for r in _read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]

    def chunk(r: dict) -> tuple[int, bytes]:
        k = r["n_nationkey"]
        physical = layout.SUPERBLOCK_AT + NODE if k == 0 else k * 8192 + 7
        body = (4096 + r["n_regionkey"]).to_bytes(8, "little") + bytes(36) + b"\1\0" + bytes(10) + physical.to_bytes(8, "little") + bytes(16)
        return (k + 1) << 20, body

    start, body = chunk(rows[0])
    array = bytes(8) + bytes([layout.CHUNK]) + start.to_bytes(8, "little") + body
    leaf = encode.sealed([encode.pack_node([(256, layout.CHUNK, *chunk(r)) for r in rows], NODE, FSID, 1, 3)])[0]
    sb = bytearray(layout.SUPERBLOCK_BYTES)
    sb[layout.FSID_AT : layout.FSID_AT + 16], sb[layout.MAGIC_AT : layout.MAGIC_AT + 8] = FSID, layout.MAGIC
    for at, width, value in ((*layout.SUPERBLOCK["nodesize"], NODE), (*layout.SUPERBLOCK["chunk_tree_addr"], start), (layout.ARRAY_SIZE_AT, 4, len(array))):
        sb[at : at + width] = value.to_bytes(width, "little")
    sb[layout.ARRAY_AT : layout.ARRAY_AT + len(array)] = array
    parts = spark.createDataFrame([(layout.SUPERBLOCK_AT, sb), (layout.SUPERBLOCK_AT + NODE, bytearray(leaf))], "off bigint, block binary")
    got = recovery.read_superblock(_image_of(spark, parts, 2))
    return superblock.chunk_table(spark, got["chunks"]).select(*_long("ord", "logical_start", "logical_end", "physical_start"))


@query("SELECT kind, off, n FROM (VALUES ('boot', 0::BIGINT, 65536::BIGINT), ('volume', (65536 + 4096 * (2 + 1))::BIGINT, 7::BIGINT)) v(kind, off, n)")
def s3_s4_boot_and_volume_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boot area and the bytes behind the last whole node of an image that has something in both (round trip)."""
    path = _image_of(spark, spark.createDataFrame([(5, bytearray(b"BOOT"))], "off bigint, block binary"), 2)
    with open(path, "ab") as f:
        f.write(b"trailer")
    got = recovery.edges_of_image(spark, path, NODE)
    return got.select("kind", "off", F.octet_length("bytes").cast("bigint").alias("n"))


def _small_superblock(**more) -> dict:
    sb = {"fsid": FSID, "generation": GENERATION, "nodesize": NODE, "bytes_used": 6, "total_bytes": 10, "chunks": []}
    return sb | dict.fromkeys(["sectorsize", "root_tree_addr", "chunk_tree_addr", "root_dir_objid", "root_level"], 0) | more


def _pointers(rows: DataFrame, key: Column, **cols: Column) -> DataFrame:
    """Internal nodes of ``PER_NODE`` pointers from a table."""
    cols = {"child": key * 4096, "child_gen": key, "gen": F.lit(50), "owner": F.lit(5), "tail": F.lit(b""), "hidden": F.lit(False)} | cols
    rows = rows.select(F.floor(key / PER_NODE).alias("node"), key.alias("slot"), *[c.alias(n) for n, c in cols.items()])
    return nodes.nodes(encode.encode_internal(rows, NODE, FSID), FSID, GENERATION, NODE)


@query(f"""
WITH p AS (SELECT p_partkey // {PER_NODE} AS node, p_partkey AS key, p_size % 2 = 0 AS hidden, CASE WHEN p_size % 10 = 4 THEN p_partkey * 4096 + 1 WHEN p_size % 10 = 6 THEN 0 ELSE p_partkey * 4096 END AS child FROM part),
q AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hidden, key) - 1 AS slot FROM p),
r AS (SELECT *, bool_or(child = 0 OR child % 4096 <> 0) FILTER (hidden) OVER (PARTITION BY node ORDER BY slot ROWS UNBOUNDED PRECEDING) AS over FROM q)
SELECT ({layout.SUPERBLOCK_AT + NODE} + node * {NODE})::BIGINT AS parent_offset, child::BIGINT AS child_logical, key AS child_gen, slot::INT AS slot FROM r WHERE hidden AND NOT coalesce(over, false) AND node % 3 <> 0""")
def g4_orphan_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pointers of internal nodes, some past the valid ones, null or unaligned; current nodes have none (round trip)."""
    p, key, size = _read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    child = F.when(size % 10 == 4, key * 4096 + 1).when(size % 10 == 6, F.lit(0)).otherwise(key * 4096)
    gen = F.when(F.floor(key / PER_NODE) % 3 == 0, GENERATION).otherwise(50)
    got = nodes.orphan_pointers(_pointers(p, key, child=child, hidden=size % 2 == 0, gen=gen), NODE)
    return got.select("parent_offset", *_long("child_logical", "child_gen"), "slot")


@query(f"""
WITH p AS (SELECT s_suppkey // {PER_NODE} AS node, arg_min(s_nationkey, s_suppkey) AS kind FROM supplier GROUP BY 1)
SELECT ({layout.SUPERBLOCK_AT + NODE} + node * {NODE})::BIGINT AS off, CASE WHEN kind % 2 = 1 THEN 2 ELSE 1 END::BIGINT AS residuals FROM p WHERE kind % 5 <> 0""")
def g5_internal_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remains of items on the grid behind an internal node's pointers: one or two, or implausible ones (round trip)."""
    s, key, kind = _read(spark, sf_dir, "supplier"), F.col("s_suppkey"), F.col("s_nationkey")

    def item(type_: Column, size: Column) -> Column:
        return F.concat(encoded(F.lit(7), 8), encoded(type_, 1), encoded(F.lit(9), 8), encoded(F.lit(10), 4), encoded(size, 4))

    good, odd = item(F.lit(layout.INODE), F.lit(5)), item(F.lit(7), F.lit(5))
    tail = F.concat(F.when(kind % 5 == 0, odd).otherwise(good), item(F.lit(layout.INODE), F.lit(0)), F.when((kind % 2 == 1) & (kind % 5 != 0), good).otherwise(odd))
    return nodes.slack_residuals(_pointers(s, key, tail=tail), NODE).select("off", "residuals")


@query(f"SELECT CASE WHEN p_partkey // {PER_NODE} % 5 = 4 THEN 'current' ELSE 'orphan' END AS class, count(DISTINCT p_partkey // {PER_NODE}) AS n FROM part WHERE p_partkey // {PER_NODE} % 4 <> 0 GROUP BY 1")
def f2_whole_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are only half there are no nodes (round trip)."""
    p, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    node = F.floor(key / PER_NODE)
    items = _items(p, key, layout.INODE, zeros(8), gen=F.when(node % 5 == 4, GENERATION).otherwise(50), short=node % 4 == 0)
    return _nodes(items).groupBy("class").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey AS objectid FROM part WHERE p_partkey // {PER_NODE} % 4 <> 0")
def f6_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that claim more items than fit give none (round trip)."""
    p, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    claimed = F.when(F.floor(key / PER_NODE) % 4 == 0, nodes.capacity(NODE) + 1)
    got = _decoded(_items(p, key, layout.DIR_ITEM, encode.dir_entry(key, F.col("p_name")), claimed=claimed)).where("phase = 0")
    return got.select(*_long("objectid"))


@query(f"""
SELECT CASE WHEN p_partkey // {PER_NODE} % 5 = 0 THEN 'ignored' ELSE 'orphan' END AS class, CASE WHEN p_partkey // {PER_NODE} % 5 = 0 THEN 'none' ELSE 'leaf' END AS route,
  count(DISTINCT p_partkey // {PER_NODE}) AS n FROM part GROUP BY ALL""")
def f12_without_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current nodes are left alone if so wanted (round trip)."""
    p, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    items = _items(p, key, layout.INODE, zeros(8), gen=F.when(F.floor(key / PER_NODE) % 5 == 0, GENERATION).otherwise(50))
    return _nodes(items, scan_current=False).groupBy("class", "route").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS inode, c_name || chr(65533) || 'x' || chr(65533) || 'A' || chr(65533) || chr(65533) AS name FROM customer")
def c3_malformed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with bytes that aren't UTF-8: each malformed sequence becomes one replacement character (round trip)."""
    c, key = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    raw = F.concat(F.encode("c_name", "UTF-8"), F.unhex(F.lit("FF" "78" "E282" "41" "C3" "F0")))
    payload = F.concat(encoded(key, 8), zeros(19), encoded(F.octet_length(raw), 2), F.unhex(F.lit("01")), raw)
    return decode.name_events(_decoded(_items(c, key, layout.DIR_ITEM, payload))).select(*_long("inode"), "name")


@query("SELECT c_nationkey || '.txt_gen50_valid_inline.bin' AS output_path, min(c_custkey) AS inode FROM customer GROUP BY c_nationkey")
def d2_first_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose files go by their nation's name: one path each, the first file (round trip)."""
    c, key = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    found = extents.inline_files(_named_customers(c, key, F.concat(F.col("c_nationkey").cast("string"), F.lit(".txt"))))
    return found.select("output_path", *_long("inode"))


def _named_customers(c: DataFrame, key: Column, name: Column) -> DataFrame:
    """Inline extents with the customer's name in them, of inodes with a name of their own."""
    inline = _items(c, key, layout.EXTENT, encode.inline_extent(F.encode("c_name", "UTF-8")), slot=key * 4 + 1)
    items = _decoded(_items(c, key, layout.DIR_ITEM, encode.dir_entry(key, name)).unionByName(inline))
    return names.resolved(decode.file_extents(items), decode.name_events(items))


@query("SELECT c_custkey || '.txt_gen50_valid_inline.bin' AS name, length(c_name)::BIGINT AS length, c_name AS content FROM customer")
def k1_recovered_binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' files as they are written, read again (round trip)."""
    c, key = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    found = extents.inline_files(_named_customers(c, key, F.concat(key.cast("string"), F.lit(".txt"))))
    folder = f"{_shared(spark)}/files-{uuid.uuid4().hex}"
    files.make_subfolders(folder)
    files.write_files(found.select(files.spread(F.col("output_path")).alias("output_path"), F.lit(0).alias("piece"), "data"), folder, together=True)
    return files.read_spread(spark, folder).select("name", "length", F.decode("content", "UTF-8").alias("content"))


@query("""
SELECT n_nationkey || '_50' AS key, n_regionkey AS uid, n_nationkey * 7 AS size, 1700000000 + n_nationkey AS mtime,
  strftime(to_timestamp(1700000000 + n_nationkey) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM nation""")
def c9_metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as inode records in the JSON report, parsed again (round trip)."""
    n, key = _read(spark, sf_dir, "nation"), F.col("n_nationkey").cast("bigint")
    record = encode.inode_record(size=key * 7, uid=F.col("n_regionkey"), mtime=key + 1_700_000_000)
    blocks = encode.encode_leaves(_items(n, key, layout.INODE, record), NODE, FSID)
    meta = "inode_metadata map<string,struct<uid:bigint,size:bigint,mtime:struct<sec:bigint,iso:string>>>"
    got = _report(spark, recovery.recover_blocks(blocks, _small_superblock(), 4), meta).select(F.explode("inode_metadata").alias("key", "m"))
    return got.select("key", "m.uid", "m.size", F.col("m.mtime.sec").alias("mtime"), "m.mtime.iso")


@query("""
SELECT 'inline files recovered' AS counter, count(*) AS n FROM nation UNION ALL SELECT 'total artifacts', count(*) FROM nation
UNION ALL SELECT 'checksum failures', 0 UNION ALL SELECT 'nodes scanned', 4""")
def k5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters as the summary for a terminal shows them (round trip)."""
    n, key = _read(spark, sf_dir, "nation"), F.col("n_nationkey").cast("bigint")
    blocks = encode.encode_leaves(_items(n, key, layout.EXTENT, encode.inline_extent(F.encode("n_name", "UTF-8"))), NODE, FSID)
    lines = report.summary(recovery.recover_blocks(blocks, _small_superblock(), 4)).split("\n")
    shown = spark.createDataFrame([(line,) for line in lines], "line string").select(F.regexp_extract("line", r"^  (\D+?)\s+(\d+)$", 1).alias("counter"), F.regexp_extract("line", r"(\d+)$", 1).alias("n"))
    return shown.where(F.col("counter").isin("inline files recovered", "total artifacts", "checksum failures", "nodes scanned")).select("counter", F.col("n").cast("bigint").alias("n"))


@query("""
SELECT row_number() OVER (ORDER BY n_nationkey % 2, n_nationkey) AS ord, (n_nationkey + 16) * 16777216 AS logical_start, (n_nationkey * 8192 + 7)::BIGINT AS physical_start FROM nation
UNION ALL SELECT 0, 16777216, 65536""")
def j5_chunk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk tree of a root with two leaves, found through the superblock's own chunk (round trip)."""
    keys = [r.n_nationkey for r in _read(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]

    def chunk(logical: int, physical: int, length: int) -> tuple[int, bytes]:
        return logical, length.to_bytes(8, "little") + bytes(36) + b"\1\0" + bytes(10) + physical.to_bytes(8, "little") + bytes(16)

    base = 1 << 24  # the superblock's chunk: what is at ``base`` lies at the superblock's place
    leaves = [[(256, layout.CHUNK, *chunk((k + 16) << 24, k * 8192 + 7, 4096)) for k in keys if k % 2 == odd] for odd in (0, 1)]
    blocks = [encode.pack_internal([(base + NODE * 2, 1), (base + NODE * 3, 1)], NODE, FSID, 1, 3), *(encode.pack_node(x, NODE, FSID, 1, 3) for x in leaves)]
    start, body = chunk(base, layout.SUPERBLOCK_AT, 1 << 20)
    array = bytes(8) + bytes([layout.CHUNK]) + start.to_bytes(8, "little") + body
    sb = bytearray(layout.SUPERBLOCK_BYTES)
    sb[layout.FSID_AT : layout.FSID_AT + 16], sb[layout.MAGIC_AT : layout.MAGIC_AT + 8] = FSID, layout.MAGIC
    for at, width, value in ((*layout.SUPERBLOCK["nodesize"], NODE), (*layout.SUPERBLOCK["chunk_tree_addr"], base + NODE), (layout.ARRAY_SIZE_AT, 4, len(array))):
        sb[at : at + width] = value.to_bytes(width, "little")
    sb[layout.ARRAY_AT : layout.ARRAY_AT + len(array)] = array
    parts = [(layout.SUPERBLOCK_AT, sb), *((layout.SUPERBLOCK_AT + NODE * (k + 1), bytearray(b)) for k, b in enumerate(encode.sealed(blocks)))]
    got = recovery.read_superblock(_image_of(spark, spark.createDataFrame(parts, "off bigint, block binary"), 4))
    return superblock.chunk_table(spark, got["chunks"]).select(*_long("ord", "logical_start", "physical_start"))


# Analogues on table columns.


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name events from user events: the inode is the user, the generation the day modulo 5, the name the type."""
    e = _read(spark, sf_dir, "events")
    pos = F.struct(F.col("event_id").alias("off"), F.lit(0).alias("phase"), F.lit(0).alias("slot"), F.lit(0).alias("sub"))
    kind = F.when(F.col("event_id") % 4 == 0, "INODE_REF").otherwise("DIR_ITEM")
    return e.select(pos.alias("pos"), kind.alias("kind"), F.col("user_id").alias("inode"), (F.dayofmonth("ts") % 5).cast("bigint").alias("gen"), F.col("event_type").alias("name"), "event_id")


_EVENTS_SQL = "e AS (SELECT event_id AS pos, user_id AS inode, (day(ts) % 5)::BIGINT AS gen, event_type AS name, event_id % 4 = 0 AS ref FROM events)"
_CLAIMS_SQL = (
    f"{_EVENTS_SQL}, f AS (SELECT *, min(pos) OVER (PARTITION BY inode, gen) AS first FROM e), "
    "c AS (SELECT *, CASE WHEN NOT ref OR pos = first THEN struct_pack(n := length(name), pos := pos, name := name) END AS claim FROM f)"
)


@query(f"""
WITH {_CLAIMS_SQL}, probes AS (SELECT * FROM e WHERE pos % 10 = 7), kept AS (SELECT * FROM c WHERE pos % 10 <> 7),
first AS (SELECT inode, gen, min(pos) AS first FROM e WHERE pos % 10 <> 7 GROUP BY ALL),
k AS (SELECT e.pos, e.inode, e.gen, CASE WHEN NOT e.ref OR e.pos = first.first THEN struct_pack(n := length(e.name), pos := e.pos, name := e.name) END AS claim FROM e JOIN first USING (inode, gen) WHERE e.pos % 10 <> 7),
g AS (SELECT inode, arg_min(gen, first) AS g0 FROM first GROUP BY inode)
SELECT p.pos AS event_id, coalesce(min(k.claim) FILTER (k.gen = p.gen).name, min(k.claim) FILTER (k.gen = g.g0).name, 'inode_' || p.inode) AS filename
FROM probes p LEFT JOIN k ON k.inode = p.inode AND k.pos < p.pos LEFT JOIN g ON g.inode = p.inode GROUP BY p.pos, p.inode""".replace("min(k.claim) FILTER (k.gen = p.gen).name", "(min(k.claim) FILTER (k.gen = p.gen)).name").replace("min(k.claim) FILTER (k.gen = g.g0).name", "(min(k.claim) FILTER (k.gen = g.g0)).name"))
def w1_j2_names_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as of a position, by window (analogue)."""
    e = _events(spark, sf_dir)
    probe = F.col("event_id") % 10 == 7
    got = names.resolved(e.where(probe).select("pos", "inode", "gen", "event_id"), e.where(~probe).drop("event_id"))
    return got.select("event_id", "filename")


@query(f"""
WITH {_CLAIMS_SQL}, cur AS (
  SELECT p.pos, p.inode, p.name, q.gen, min(q.claim).name AS held, min(q.first) AS first FROM e p JOIN c q ON q.inode = p.inode AND q.pos < p.pos WHERE NOT p.ref GROUP BY ALL
)
SELECT pos AS event_id, name AS original_path, arg_min(held, first) AS current_path FROM cur WHERE held <> name GROUP BY ALL""".replace("min(q.claim).name AS held", "(min(q.claim)).name AS held"))
def j3_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves, by an interval self-join on names in force (analogue)."""
    got = names.moves(_events(spark, sf_dir).drop("event_id"))
    return got.select(F.col("pos.off").alias("event_id"), "original_path", "current_path")


@query("SELECT user_id AS inode, day(ts)::BIGINT AS gen, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def a4_first_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record per key (analogue)."""
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("inode"), F.dayofmonth("ts").cast("bigint").alias("gen"), F.col("event_id").alias("pos"), F.col("value").alias("meta"))
    return decode.first_inode_metadata(e).withColumnRenamed("meta", "value")


@query("""
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_quantity ORDER BY l_orderkey, l_linenumber, l_extendedprice) = 1 AS is_first,
  l_extendedprice FROM lineitem""")
def d1_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-wins deduplication of extent keys (analogue)."""
    rows = _read(spark, sf_dir, "lineitem").withColumn("pos", F.struct("l_orderkey", "l_linenumber", "l_extendedprice"))
    return extents.first_per(rows, ["l_partkey", "l_suppkey", "l_quantity"], "is_first").select("l_orderkey", "l_linenumber", "is_first", "l_extendedprice")


@query("""
SELECT p_partkey, p_brand || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.bin' AS output_path
FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)""")
def d3_numbered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixes for colliding paths (analogue)."""
    return extents.numbered(_read(spark, sf_dir, "part"), "p_brand", "output_path", "p_partkey").select("p_partkey", "output_path")


_CHUNKS = [(k * 1000, k * 1000 + 900, 1_000_000 + k * 5000, 900) for k in range(12)] + [(500, 2500, 77, 2000), (1 << 20, 1 << 40, 5, (1 << 40) - (1 << 20))]


@query(
    "WITH c(ord, s, e, p) AS (VALUES " + ", ".join(f"({i}, {s}, {e}, {p})" for i, (s, e, p, _) in enumerate(_CHUNKS)) + ") "
    "SELECT o_orderkey, arg_min(p + o_orderkey - s, ord)::BIGINT AS physical FROM orders LEFT JOIN c ON o_orderkey >= s AND o_orderkey < e GROUP BY o_orderkey"
)
def j1_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as logical addresses, made physical by the first chunk that covers them (analogue)."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey")
    got = superblock.translated(o, "o_orderkey", superblock.chunk_table(spark, _CHUNKS), ["o_orderkey"], n_chunks=len(_CHUNKS))
    return got.select("o_orderkey", F.col("physical").cast("bigint").alias("physical"))


@query("""
WITH t AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 2197175160) ELSE x >> 1 END) AS v FROM range(256) r(i)),
tab AS (SELECT list(v ORDER BY i) AS tab FROM t)
SELECT c_custkey, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(c_name) + 1), lambda k: ascii(substr(c_name, k, 1))::BIGINT)),
  lambda crc, b: xor(tab[xor(crc, b) % 256 + 1], crc >> 8)), 4294967295)::BIGINT AS crc FROM customer, tab""")
def c1_crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32C of customer names."""
    return _read(spark, sf_dir, "customer").select("c_custkey", crc32c(F.encode("c_name", "UTF-8")).alias("crc"))


@query("""
SELECT user_id, count(*) AS taken FROM (SELECT user_id, event_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM events)
WHERE stop IS NULL OR event_id < stop GROUP BY user_id""")
def g4_take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Take-while over an array, as for stale key pointers: each user's events before the first purchase (analogue)."""
    each = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("a"))
    taken = F.size(nodes.take_while(F.col("a"), lambda x: x["event_type"] != "purchase")).cast("bigint")
    return each.select("user_id", taken.alias("taken")).where("taken > 0")


@query("SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{N}._-]', '_', 'g') AS safe FROM documents")
def c5_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitised names, of whole texts."""
    return _read(spark, sf_dir, "documents").select("doc_id", text.safe_name(F.col("text")).alias("safe"))


@query("SELECT doc_id, NOT regexp_matches(text, '\\p{C}|[^\\P{Z} ]') AND trim(text) <> '' AS ok FROM documents")
def f8_valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether whole texts would do as names."""
    return _read(spark, sf_dir, "documents").select("doc_id", text.is_name(F.col("text")).alias("ok"))


@query("""
SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN '-' ELSE 'l' END ||
  array_to_string(list_transform(range(9), lambda i: CASE WHEN (o_orderkey % 512) & (1 << (8 - i)) <> 0 THEN substr('rwx', (i % 3 + 1)::INT, 1) ELSE '-' END), '') AS mode FROM orders""")
def c7_mode_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permission strings."""
    kind = F.when(F.col("o_custkey") % 3 == 0, 0o040000).when(F.col("o_custkey") % 3 == 1, 0o100000).otherwise(0o120000)
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.mode_string(kind + F.col("o_orderkey") % 512).alias("mode"))


@query("""
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size
FROM (SELECT doc_id, n_chars * (doc_id % 7 + 1) * (doc_id % 5 + 1) * 4 AS n FROM documents)""")
def c8_size_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes for people."""
    n = F.col("n_chars") * (F.col("doc_id") % 7 + 1) * (F.col("doc_id") % 5 + 1) * 4
    return _read(spark, sf_dir, "documents").select("doc_id", text.size_string(n).alias("size"))


@query("SELECT count(*) AS scanned, count(*) FILTER (event_type = 'purchase') AS orphans, coalesce(count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE < 0.01 AND 0.6 > 0.5, false) AS warning FROM events")
def a2_defrag_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defragmentation rule (analogue)."""
    e = _read(spark, sf_dir, "events").agg(F.count("*").alias("scanned"), F.count_if(F.col("event_type") == "purchase").alias("orphans"))
    return e.select("scanned", "orphans", report.defrag_warning(F.col("orphans"), F.col("scanned"), F.lit(6), F.lit(10)).alias("warning"))


@query("SELECT c_custkey, (c_custkey * 1000003 + 7)::BIGINT AS u64, (c_custkey % 65536)::BIGINT AS u16, (c_custkey % 5 = 0) AS zero FROM customer")
def p13_little_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Little-endian fields written and read by native functions."""
    key = F.col("c_custkey")
    raw = F.concat(encoded(key * 1000003 + 7, 8), encoded(key % 65536, 2), F.when(key % 5 == 0, zeros(3)).otherwise(F.unhex(F.lit("000100"))))
    b = _read(spark, sf_dir, "customer").select("c_custkey", raw.alias("b"))
    return b.select("c_custkey", field("b", 0, 8).cast("bigint").alias("u64"), field("b", 8, 2).alias("u16"), (~any_set(F.substring("b", 11, 3))).alias("zero"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'zlib' WHEN 2 THEN 'lzo' WHEN 3 THEN 'zstd' ELSE 'unknown(0)' END AS compression,
  CASE p_size % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'file' ELSE 'dir' END AS file_type,
  CASE p_size WHEN 1 THEN 'INODE_ITEM' WHEN 12 THEN 'INODE_REF' WHEN 13 THEN 'INODE_EXTREF' WHEN 24 THEN 'XATTR_ITEM' WHEN 48 THEN 'ORPHAN_ITEM' END AS item_type FROM part""")
def c10_c11_code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of codes."""
    size = F.col("p_size")
    return _read(spark, sf_dir, "part").select(
        "p_partkey", text.compression_name(size % 4).alias("compression"), text.file_type_name(size % 3).alias("file_type"), text.type_name(size).alias("item_type")
    )
