import tracemalloc

from pyspark.sql import functions as F

from siltscan import layout, queries
from siltscan.functions import checksum
from siltscan.plans import encode

FSID, SIZE = bytes(range(16, 32)), 4096


def test_checksums_of_a_large_batch_need_little_memory():
    blocks = [bytes([k % 251]) * SIZE for k in range(8000)]
    tracemalloc.start()
    got = checksum.crc32c_many(blocks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:3] == [checksum.crc32c_bytes(b) for b in blocks[:3]]
    assert peak < 40 << 20


def test_nodes_are_packed_alike_however_rows_are_batched(spark):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    items = spark.range(40).select(
        F.floor(F.col("id") / 7).alias("node"), (-F.col("id")).alias("slot"), (F.col("id") - 3).alias("objectid"), F.lit(layout.DIR_ITEM).alias("type"),
        F.col("id").alias("key_offset"), F.expr("cast(repeat('x', cast(id % 5 AS int)) AS binary)").alias("payload"), F.lit(50).alias("gen"), F.lit(5).alias("owner"),
        (F.col("id") % 3 == 0).alias("hidden"), (F.col("id") == 8).alias("broken"), (F.col("id") == 15).alias("short"),
    )
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        got = {r.off: bytes(r.block) for r in encode.encode_leaves(items, SIZE, FSID).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = {}
    for node in range(6):
        ids = sorted(range(node * 7, min(node * 7 + 7, 40)), key=lambda i: (i % 3 == 0, -i))
        off = layout.SUPERBLOCK_AT + SIZE * (node + 1)
        packed = encode.pack_node([(i - 3, layout.DIR_ITEM, i, b"x" * (i % 5)) for i in ids], SIZE, FSID, 50, 5, sum(i % 3 != 0 for i in ids), off)
        block = encode.sealed([packed])[0]
        block = block[:1] + bytes([block[1] ^ 0xFF]) + block[2:] if node == 1 else block
        want[off] = block[: SIZE // 2] if node == 2 else block
    assert got == want


def test_rows_of_any_keys_fill_their_nodes(spark, monkeypatch):
    made, encode_leaves = [], encode.encode_leaves
    monkeypatch.setattr(encode, "encode_leaves", lambda *a: made.append(encode_leaves(*a)) or made[-1])
    for name, fill in (("p8_regular_extents", 39), ("p3_inode_records", 21)):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        rows, nodes = df.count(), made[-1].count()
        assert nodes <= rows // fill + 8, (name, rows, nodes)
