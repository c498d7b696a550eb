import os

import duckdb
import pytest

import __spark_entry__ as driver
from siltscan import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, tables, name):
    df, want = queries.QUERIES[name](spark, SF), tables.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    a, b = [df.columns.index(c) for c in sorted(df.columns)], [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted([shown(r[i]) for i in a] for r in df.collect()) == sorted([shown(r[i]) for i in b] for r in want.fetchall())
    spark.catalog.clearCache()


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.dirname(driver.__file__)
    for folder, _, files in os.walk(os.path.join(root, "siltscan")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in folder:
                assert "llm" not in open(os.path.join(folder, f)).read(), f
