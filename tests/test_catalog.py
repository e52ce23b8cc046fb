"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from tideline import catalog
from verify import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
SQL = catalog.oracle_sql()
MODELS = ["ml_alert_model", "ml_quantile_bands", "ml_permutation_importance"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES)
    without = set(QUERIES) - set(SQL)
    assert all(n.startswith("ml_") for n in without)


def test_entry_point_has_every_query():
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("name", MODELS)
def test_model_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 1
