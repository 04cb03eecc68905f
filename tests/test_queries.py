"""Every query of the library against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from silkloom.plans.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents pages conversations labels benchmark".split()


def compare(spark, name, queries, sql):
    got = queries[name](spark, DATA)
    rows = got.collect()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(sql[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    theirs = con.sql("select " + ", ".join(f'"{c}"' for c in order) + " from want").fetchall()
    assert sorted(repr(tuple(r[c] for c in order)) for r in rows) == sorted(map(repr, theirs))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, name, QUERIES, SQL)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1 and entry.oracle_sql().keys() <= entry.queries().keys()
