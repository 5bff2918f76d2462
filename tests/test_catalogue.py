"""Every query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from boutframe.plans import catalogue
from check import TABLES, compare, type_differences

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {k: v for k, v in contract.queries().items() if k in catalogue.QUERIES}
SQL = {k: v for k, v in contract.oracle_sql().items() if k in catalogue.QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{ROOT}/{t}.parquet')")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, ROOT)
    result = duck.sql(SQL[name])
    assert compare(df.toPandas(), result.df()) == "ok"
    assert type_differences(df, result) == []
