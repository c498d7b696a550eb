import random

from siltscan.operators import names
from siltscan.streaming.names import name_changes

POS = "struct<off:bigint,phase:int,slot:int,sub:int>"


def test_stream_gives_the_names_of_a_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [((k, 0, 0, 0), rng.choice(["DIR_ITEM", "INODE_REF"]), rng.randint(1, 6), rng.randint(1, 3), "n" * rng.randint(1, 9) + rng.choice("ab")) for k in range(300)]
    schema = f"pos {POS}, kind string, inode bigint, gen bigint, name string"
    source, out = str(tmp_path / "in"), []
    for part in (rows[:100], rows[100:220], rows[220:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = name_changes(spark.readStream.schema(schema).parquet(source)).writeStream.foreachBatch(lambda df, _: out.extend(df.collect()))
        run = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None
    last = {}
    for r in sorted(out, key=lambda r: r.off):
        last[r.inode, r.gen] = r.name
    assert last == {(r.inode, r.gen): r.name for r in names.final_names(spark.createDataFrame(rows, schema)).collect()}
