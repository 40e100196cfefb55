"""Every query with SQL against DuckDB on the same tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from citeloom.plans import registry


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert mine == theirs


#: Queries that SQL cannot express, and the test that compares each with brute force.
WITHOUT_SQL = {"verbatim_tiers_full": "test_brute_force.py", "bm25_stemmed": "test_brute_force.py", "null_control": "test_brute_force.py"}


def test_every_query_has_sql_or_brute_force():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == set(WITHOUT_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
