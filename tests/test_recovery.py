import json
import os
import struct

import pytest
from images import FSID, SIZE, chunk, inner, inode, leaf, refs, sample_image, slow_crc32c, superblock
from pyspark.sql import functions as F

from siltscan.functions import checksum, text
from siltscan.operators import decode, names, nodes, report
from siltscan.operators import superblock as sbop
from siltscan.plans import recovery
from siltscan.sources import image


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    path = tmp_path_factory.mktemp("image") / "sample.img"
    path.write_bytes(sample_image())
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, sample):
    return recovery.recover(spark, sample)


def test_sample_counters(tables):
    got = tables["stats"].first().asDict()
    want = dict(
        nodes_scanned=13, checksum_failures=1, orphan_nodes_found=8, current_nodes_scanned=3, orphan_items_found=4, leaf_slacks_found=3, extent_backrefs_found=1,
        internal_orphan_ptrs_found=2, internal_slack_residuals=0, move_artifacts_found=2, root_item_anomalies=1, inline_files_recovered=4,
        regular_extents_recovered=2, regular_extents_failed=1, total_artifacts=9, has_snapshots=True, subvolume_nodes_seen=1, defrag_warning=False,
    )
    assert got == want


def test_sample_names_moves_and_metadata(tables):
    moved = [(r.original_path, r.current_path) for r in tables["moves"].orderBy("pos").collect()]
    assert moved == [("a.txt", "longer_name.txt"), ("renamed.txt", "a.txt")]
    held = {(int(r.inode), int(r.gen)): r.name for r in tables["names"].collect()}
    assert held == {(257, 50): "a.txt", (257, 60): "renamed.txt", (300, 60): "bad��name", (400, 70): "orph.txt", (401, 100): "cur.txt"}
    assert tables["inode_metadata"].count() == 2


def test_sample_trees(tables):
    ref = tables["extent_backrefs"].first()
    assert (int(ref.extent_laddr), int(ref.root), int(ref.inode), ref.ref_count, int(ref.extent_objectid)) == (0x1000, 5, 257, 1, 0x111000)
    dev = tables["devices"].first()
    assert (int(dev.devid), dev.uuid) == (1, "46464646-4646-4646-4646-464646464646")
    assert [(int(r.child_logical), r.slot) for r in tables["orphan_pointers"].orderBy("slot").collect()] == [(0x2000000, 1), (0x3000000, 2)]
    assert [tuple(map(int, (r.logical_start, r.physical_start))) for r in tables["chunks"].orderBy("ord").collect()] == [(0x1000000, 0x14000), (0x5000000, 0x20000)]


def test_sample_files(spark, sample, tables, tmp_path):
    out = str(tmp_path / "out")
    recovery.save(tables, sample, out)
    sizes = {n: os.path.getsize(f"{out}/{n}") for n in os.listdir(out)}
    doc = json.load(open(f"{out}/recovery_report.json"))
    sizes.pop("recovery_report.json")
    assert sizes == {
        "a.txt_gen50_valid_inline.bin": 17, "inode_258_gen50_valid_inline.bin": 6, "orph.txt_gen70_orphan_inline.bin": 9, "cur.txt_gen100_orphan_inline.bin": 8,
        "renamed.txt_gen60_valid_extent.bin": 4096, "renamed.txt_gen60_valid_extent_1.bin": 4096, "leaf_slack_0x1C000_gen50.bin": 15802,
        "leaf_slack_0x24000_gen70.bin": 16098, "leaf_slack_0x28000_gen100.bin": 16098, "boot_sector.bin": 65536, "volume_slack.bin": 4,
    }
    assert open(f"{out}/a.txt_gen50_valid_inline.bin", "rb").read() == b"inline file data!"
    raw = open(sample, "rb").read()
    assert open(f"{out}/renamed.txt_gen60_valid_extent_1.bin", "rb").read() == raw[0x21000:0x22000]
    assert doc["stats"]["nodes_scanned"] == 13 and len(doc["recovered_files"]) == 9 and set(doc) == {
        "generated_at", "stats", "recovered_files", "inode_metadata", "extent_backrefs", "orphan_child_ptrs", "move_artifacts", "device_info",
    }
    meta = doc["inode_metadata"]["257_50"]
    assert (meta["size"], meta["nlink"], meta["mtime"]["sec"], meta["mtime"]["nsec"]) == (1024, 1, 1700000000, 123456789)
    assert [f["output_path"] for f in doc["recovered_files"] if f.get("output_path") == "(duplicate)"] == ["(duplicate)"] * 2
    assert "(257" not in report.summary(tables) and "a.txt" in report.summary(tables)


def test_without_current_nodes(spark, sample):
    row = recovery.recover(spark, sample, scan_current=False)["stats"].first()
    assert (row.current_nodes_scanned, row.orphan_items_found, row.inline_files_recovered, row.subvolume_nodes_seen) == (0, 2, 3, 1)


def test_catalog_and_engine(spark, sample, tmp_path):
    t = recovery.run_recovery_engine(spark, sample, str(tmp_path / "a"))
    recovery.save_catalog(t, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b" / "recovered_files")).count() == 9


def test_command_line(spark, sample, tmp_path, capsys):
    from siltscan.__main__ import main

    out = tmp_path / "out"
    assert main([sample, "-o", str(out)]) == 0
    shown = capsys.readouterr().out
    assert "inline files recovered" in shown and "renamed.txt" in shown and json.load(open(out / "recovery_report.json"))["stats"]["current_nodes_scanned"] == 3
    assert main([sample, "-o", str(tmp_path / "b"), "--no-current-gen"]) == 0
    assert json.load(open(tmp_path / "b" / "recovery_report.json"))["stats"]["current_nodes_scanned"] == 0
    assert main([str(tmp_path / "none.img"), "-o", str(out)]) == 1 and "no such image" in capsys.readouterr().err
    (tmp_path / "x.img").write_bytes(bytes(70000))
    assert main([str(tmp_path / "x.img"), "-o", str(out)]) == 1 and "superblock" in capsys.readouterr().err


def test_report_keeps_nulls_order_and_odd_names(spark, sample, tables):
    doc = json.loads("".join(report.report_text(tables)))
    kinds = {f["extent_type"]: f for f in doc["recovered_files"]}
    assert set(kinds["inline"]) == set(report.INLINE) and set(kinds["regular"]) == set(report.REGULAR)
    assert [f["output_path"] for f in doc["recovered_files"] if f["extent_type"] == "regular"].count(None) == 1
    assert [f["filename"] for f in doc["recovered_files"]] == [r.filename for r in tables["recovered_files"].orderBy("pos").collect()]
    assert list(doc) == [name for name, _ in report.SECTIONS] and doc["extent_backrefs"][0]["extent_laddr"] == 0x1000
    none = tables | {name: tables[name].limit(0) for name in ("inline_names", "regular_files", "inode_metadata", "extent_backrefs", "orphan_pointers", "moves", "devices")}
    empty = json.loads("".join(report.report_text(none)))
    assert empty["recovered_files"] == empty["device_info"] == [] and empty["inode_metadata"] == {} and empty["stats"] == doc["stats"]


def test_tables_are_released(spark, sample, tmp_path):
    t = recovery.run_recovery_engine(spark, sample, str(tmp_path / "a"))
    assert not any(df.is_cached for df in t.values()) and t["stats"].first().nodes_scanned == 13


def test_no_superblock(spark, tmp_path):
    path = tmp_path / "x.img"
    path.write_bytes(b"BOOT" + bytes(70000))
    t = recovery.recover(spark, str(path))
    assert [r.kind for r in t["slack"].collect()] == ["boot"] and "stats" not in t
    path.write_bytes(bytes(100))
    assert recovery.recover(spark, str(path))["slack"].count() == 0
    with pytest.raises(FileNotFoundError):
        recovery.recover(spark, str(tmp_path / "none.img"))


def _blocks(spark, *raw):
    return spark.createDataFrame([(0x10000 + (k + 1) * len(b), bytearray(b)) for k, b in enumerate(raw)], "off bigint, block binary")


def _items(spark, *raw):
    return nodes.items(nodes.nodes(_blocks(spark, *raw), FSID, 100, SIZE), SIZE)


def test_orphan_slots_are_capped(spark):
    pointers = b"".join(struct.pack("<QBQII", i, 1, 0, 10, 5) for i in range(500))
    assert _items(spark, leaf(50, 5, [], extra=[(101, pointers)])).where("phase = 1").count() == 200


def test_too_many_items_drop_the_node(spark):
    assert _items(spark, leaf(50, 5, [(1, 1, 0, inode())], n=652)).count() == 0
    assert nodes.leaf_slack(nodes.nodes(_blocks(spark, leaf(50, 5, [], n=652)), FSID, 100, SIZE), SIZE).count() == 0


def test_plausible_slots_are_skipped_not_ended(spark):
    bad, good = struct.pack("<QBQII", 1, 7, 0, 10, 5), struct.pack("<QBQII", 2, 108, 0, 10, 5)
    too_far = struct.pack("<QBQII", 3, 108, 0, SIZE - 101, 5)
    got = _items(spark, leaf(50, 5, [], extra=[(101, bad + too_far + good)])).select("objectid", "slot").collect()
    assert [(int(r.objectid), r.slot) for r in got] == [(2, 2)]


def test_slack_of_a_leaf_without_data_ends_with_the_node(spark):
    got = nodes.leaf_slack(nodes.nodes(_blocks(spark, leaf(50, 5, [(1, 1, 0, b"")], extra=[(200, b"x")])), FSID, 100, SIZE), SIZE).first()
    assert len(got.bytes) == SIZE - 126


def test_residuals_lie_on_a_grid(spark):
    item = struct.pack("<QBQII", 1, 132, 0, 10, 5)
    for shift, want in ((0, [2]), (1, [])):
        node = inner(50, 5, [0x1000], extra=[(101 + 33 + shift, item * 2)])
        got = nodes.slack_residuals(nodes.nodes(_blocks(spark, node), FSID, 100, SIZE), SIZE)
        assert [r.residuals for r in got.collect()] == want


def test_generations_owners_and_short_blocks(spark):
    last = (1 << 64) - 1
    raw = [leaf(last, last, []), leaf(99, 2, []), leaf(99, 4, []), leaf(99, 7, []), inner(100, 5, []), inner(99, 2, [])]
    df = nodes.nodes(_blocks(spark, *raw).unionByName(spark.createDataFrame([(1, bytearray(raw[0][:5000]))], "off bigint, block binary")), FSID, 100, SIZE)
    got = {(r["class"], r.route, int(r.owner)) for r in df.collect()}
    assert got == {
        ("current", "leaf", last), ("orphan", "extent", 2), ("orphan", "device", 4), ("orphan", "leaf", 7), ("ignored", "none", 5), ("orphan", "internal", 2),
    }
    assert report.node_counters(df).first().subvolume_nodes_seen == 1


def test_checksum_runs_once_under_native_filters(spark):
    df = nodes.nodes(_blocks(spark, leaf(50, 5, [])), FSID, 100, SIZE).where("csum_ok")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_reader_counts_and_prunes(spark, sample):
    n = image.block_count(os.path.getsize(sample), SIZE)
    assert n == 13 and image.block_count(0x14000 + 100, SIZE) == 0 and image.block_count(0x14000 + 101, SIZE) == 1
    every = image.blocks(spark, sample, SIZE, range_bytes=40000)
    assert every.count() == 13 and [r.off for r in every.orderBy("off").collect()][:2] == [0x14000, 0x18000]
    assert image.blocks(spark, sample, SIZE, fsid=b"\1" * 16).count() == 0
    with pytest.raises(Exception, match="nodesize"):
        image.blocks(spark, sample, 0).count()


@pytest.mark.parametrize(
    "data, crc",
    [(b"", 0), (bytes(32), 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (bytes(range(32)), 0x46DD794E), (bytes(range(31, -1, -1)), 0x113FDB5C), (b"123456789", 0xE3069283)],
)
def test_crc32c_vectors(data, crc):
    assert checksum.crc32c_bytes(data) == crc


def test_crc32c_sizes_and_column(spark):
    data = [os.urandom(n) for n in (1, 2, 7, 1023, 1024, 1040, 5000, 1024)]
    assert checksum.crc32c_many([*data, None]) == [*map(slow_crc32c, data), None]
    df = spark.createDataFrame([(bytearray(d),) for d in data] + [(None,)], "b binary")
    assert [r[0] for r in df.select(checksum.crc32c("b")).collect()] == [*map(slow_crc32c, data), None]


@pytest.mark.parametrize("sec, iso", [(0, "1970-01-01T00:00:00+00:00"), (2**62, f"<invalid: sec={2**62}>"), (-1, "1969-12-31T23:59:59+00:00"), (1700000000, "2023-11-14T22:13:20+00:00"), (-62135596800, "0001-01-01T00:00:00+00:00")])
def test_inode_times(spark, sec, iso):
    row = decode.inode_items(_items(spark, leaf(50, 5, [(9, 1, 0, inode(size=0, sec=sec, mode=0o040755, nlink=2))]))).first()
    assert (row.meta.atime.sec, row.meta.atime.nsec, row.meta.otime.iso) == (sec, 123456789, iso)
    assert (int(row.meta.size), row.meta.nlink, row.meta.mode, row.meta.uid) == (0, 2, 0o040755, 1000) and len(row.meta) == 16


def test_short_inode_records_are_dropped(spark):
    assert decode.inode_items(_items(spark, leaf(50, 5, [(9, 1, 0, inode()[:100])]))).count() == 0


def test_spec_layout(spark):
    body = inode()[:80] + bytes(32) + struct.pack("<qI", 5, 6) * 4
    row = decode.inode_items(_items(spark, leaf(50, 5, [(9, 1, 0, body)])), "spec").first()
    assert (row.meta.mtime.sec, row.meta.mtime.nsec) == (5, 6)


def test_text_functions(spark):
    f = lambda v, kind, fn: spark.createDataFrame([(v,)], f"v {kind}").select(fn(F.col("v"))).first()[0]
    assert [f(m, "bigint", text.mode_string) for m in (0o104755, 0o040755, 0o120777, 0)] == ["-rwxr-xr-x", "drwxr-xr-x", "lrwxrwxrwx", "?---------"]
    assert [f(n, "bigint", text.size_string) for n in (0, 1023, 1024, 1536, 1 << 20, 3 << 30)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "3.0 GB"]
    assert [f(s, "string", text.is_name) for s in ("a b", " ", "", "a\n", "a\u0085", "nb sp", "é漢", "\x01")] == [True, False, False, False, False, False, True, False]
    assert f("a/b ü漢.tar-1_x", "string", text.safe_name) == "a_b_ü漢.tar-1_x"
    assert f(bytearray(b"a\xffb\xc3"), "binary", text.as_text) == b"a\xffb\xc3".decode("utf-8", "replace")
    assert [f(n, "int", text.compression_name) for n in (1, 3, 9)] == ["zlib", "zstd", "unknown(9)"]
    assert f(108, "int", text.type_name) == "EXTENT_DATA" and f(2, "int", text.file_type_name) == "dir"


def test_references_stop_at_bad_lengths():
    data = refs("one", "two")
    assert decode._split_names(data, len(data)) == [b"one", b"two"]
    assert decode._split_names(data, len(data) - 1) == [b"one"]
    assert decode._split_names(struct.pack("<QH", 0, 0) + data, 99) == []


def test_chunk_tree_walks_cycles_and_grows():
    n0 = inner(1, 3, [0x1004000, 0x1000000, 0x7000000, 0x1008000], size=4096)
    n1 = leaf(1, 3, [(256, 228, 0x7000000, chunk(4096, 0x3000, 0x9000)), (256, 228, 1, b"short")], size=4096)
    n2 = leaf(1, 3, [(256, 228, 0x8000000, chunk(10, 20))], size=4096)
    disk = {0x1000: n0, 0x5000: n1, 0x3000: leaf(1, 3, [(256, 228, 0x6000000, chunk(1, 2))], size=4096), 0x9000: n2}
    got = sbop.chunk_tree(lambda at, n: disk.get(at, b"")[:n], 0x1000000, 4096, [(0x1000000, 0x1010000, 0x1000, 0x10000)])
    assert [c[0] for c in got] == [0x1000000, 0x7000000, 0x7000000, 0x6000000, 0x8000000]
    assert sbop.to_physical(0x7000001, got) == 0x3001 and sbop.to_physical(0x7001000, got) is None


def test_system_chunks_end_at_another_key():
    raw = superblock(array=((1 << 20, 4096, 77), (1 << 21, 4096, 99)))
    assert [c[2] for c in sbop.system_chunks(raw)] == [77, 99]
    assert sbop.system_chunks(raw[: 0x32B + 97 + 8] + b"\0" + raw[0x32B + 97 + 9 :]) == [(1 << 20, (1 << 20) + 4096, 77, 4096)]


@pytest.mark.parametrize("limit", [sbop.BROADCAST_CHUNKS, 0])
def test_translation_takes_the_first_chunk(spark, monkeypatch, limit):
    monkeypatch.setattr(sbop, "BROADCAST_CHUNKS", limit)
    big = (1 << 64) - 4096
    chunks = [(0, 1 << 45, 5, 1 << 45), (1000, 2000, 7_000, 1000), (1 << 46, (1 << 46) + (1 << 29), 9, 1 << 29), (big, big + 4096, 0, 4096)]
    table = sbop.chunk_table(spark, chunks)
    asks = [0, 1500, (1 << 46) + (1 << 29) - 1, (1 << 46) + (1 << 29), big + 5]
    from decimal import Decimal

    rows = spark.createDataFrame([(i, Decimal(a)) for i, a in enumerate(asks)], "i int, a decimal(20,0)")
    got = {r.i: r.p for r in sbop.translated(rows, "a", table, ["i"], "p").collect()}
    assert [None if got[i] is None else int(got[i]) for i in range(5)] == [sbop.to_physical(a, chunks) for a in asks]


def test_names_against_a_sequential_reader(spark):
    import random

    rng = random.Random(5)
    events, probes, want_names, want_moves = [], [], {}, []
    for case in range(40):
        held = {}
        for k in range(rng.randint(1, 25)):
            pos, i, gen = (case * 1000 + k, 0, 0, 0), case * 10 + rng.randint(0, 2), rng.randint(1, 3)
            name = rng.choice(["a", "bb", "cc", "ddd", "é", "漢字", "eeee"])
            kind = rng.choice(["DIR_ITEM", "DIR_INDEX", "INODE_REF", "probe"])
            if kind == "probe":
                probes.append((pos, i, gen, "x"))
                any_gen = [n for (j, _), n in held.items() if j == i]
                want_names[pos] = held.get((i, gen)) or (any_gen[0] if any_gen else f"inode_{i}")
                continue
            events.append((pos, kind, i, gen, name))
            if kind != "INODE_REF":
                other = [n for (j, _), n in held.items() if j == i and n != name]
                if other:
                    want_moves.append((pos, i, name, other[0]))
                if (i, gen) not in held or len(name) < len(held[i, gen]):
                    held[i, gen] = name
            else:
                held.setdefault((i, gen), name)
    pos = "struct<off:bigint,phase:int,slot:int,sub:int>"
    e = spark.createDataFrame(events, f"pos {pos}, kind string, inode bigint, gen bigint, name string")
    p = spark.createDataFrame(probes, f"pos {pos}, inode bigint, gen bigint, source string")
    assert {tuple(r.pos): r.filename for r in names.resolved(p, e).collect()} == want_names
    assert sorted((tuple(r.pos), r.inode, r.original_path, r.current_path) for r in names.moves(e).collect()) == sorted(want_moves)
