"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from deflow import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    got = check.rows(df.columns, df.collect())
    if name in oracle_sql():
        cur = con.execute(oracle_sql()[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == check.rows(columns, cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_checks_exist():
    assert set(oracle_sql()) <= set(queries())
    assert set(plans.QUERIES) == set(plans.ORACLES)
