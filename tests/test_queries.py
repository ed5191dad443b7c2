"""Every registered transit query against its DuckDB form, and a contract check of the entry module."""

import duckdb
import pytest

import __spark_entry__ as entry
from farandole import rule_queries as transit

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(transit.ORACLE_SQL))
def test_against_sql(spark, con, name):
    df = transit.QUERIES[name](spark, SF)
    cur = con.execute(transit.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(transit.QUERIES) <= set(entry.queries())
