from pyspark.sql import functions as F

from siltscan.sources import files


def test_spread_files_are_read_again_by_few_tasks(spark, tmp_path):
    folder = str(tmp_path / "many")
    want = {f"file {k} é.bin": bytes([k % 256]) * (k % 7) for k in range(2500)}
    rows = spark.createDataFrame([(n, 0, bytearray(d)) for n, d in want.items()], "output_path string, piece int, data binary")
    files.make_subfolders(folder)
    files.write_files(rows.withColumn("output_path", files.spread(F.col("output_path"))), folder, together=True)
    (tmp_path / "many" / "00" / ".0.part").write_bytes(b"half")
    got = files.read_spread(spark, folder)
    assert got.rdd.getNumPartitions() == files.READERS
    assert {r.name: (r.length, bytes(r.content)) for r in got.collect()} == {n: (len(d), d) for n, d in want.items()}
