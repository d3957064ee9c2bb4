"""Registered queries against their SQL in DuckDB, at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from passagework.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations") if os.path.exists(f"{SF}/{t}.parquet")]
SLOW = {"m06_query_results", "m09_ndcg", "m12_compare_rerankers"}  # the same SQL as m10_run_summary's


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list | tuple):
        return [canon(x) for x in v]
    return v


def same(spark, duck, queries, oracles, name):
    df = queries[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([canon(r[c]) for c in cols]) for r in df.collect())
    rel = duck.sql(oracles[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert got == sorted(str([canon(r[i]) for i in order]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW))
def test_query(spark, duck, name):
    same(spark, duck, registry.QUERIES, registry.ORACLES, name)


def test_entry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and registry.FLAGSHIP in entry.queries()
