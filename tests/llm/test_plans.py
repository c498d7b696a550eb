"""What the plans may and may not hold."""

import pytest

from siltscan.llm import bpe, linecrf, mixing, neardup, sharding, tokens, toxicity
from siltscan.llm._common import Memo, per_worker, small


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_maps_are_narrow_and_read_two_columns(docs):
    for df in (tokens.token_counts(docs), toxicity.toxic_documents(docs), bpe.encode(docs), neardup.signatures(docs), linecrf.content_shares(docs, linecrf.LineCrf())):
        p = plan(df)
        assert "Exchange" not in p and "ReadSchema: struct<doc_id:bigint,text:string>" in p and p.count("MapInArrow") == 1


def test_sharding_never_reads_texts(docs):
    assert "text" not in plan(sharding.shards(docs)).split("ReadSchema", 1)[1]


def test_mixing_ships_no_text(docs):
    assert "text" not in plan(mixing.mixture(docs))


def test_broadcast_hint_depends_on_size(spark):
    a, b = spark.range(50).withColumnRenamed("id", "x"), spark.range(40).withColumnRenamed("id", "y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in plan(a.join(small(b, 40), a.x == b.y)) and "SortMergeJoin" in plan(a.join(small(b, 39), a.x == b.y))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_memos_are_bounded():
    m = Memo(len, entries=10, longest=5)
    assert [m["x" * (k % 9)] for k in range(100)] == [k % 9 for k in range(100)] and len(m) <= 10 and "x" * 8 not in m
    made = []
    assert [per_worker(k, lambda: made.append(1) or len(made)) for k in "aabba"] == [1, 1, 2, 2, 3]
