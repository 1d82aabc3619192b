"""Every query with SQL of its own gives the same rows; each runs."""

import os

import duckdb
import pytest

from pagelens import queries as own


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, sf_dir, sql, name):
    df = own.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in own.ORACLES:
        return
    want = sql.sql(own.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [df.columns.index(c) for c in want.columns]
    assert sorted(str(tuple(r[i] for i in at)) for r in rows) == sorted(map(str, want.fetchall()))
