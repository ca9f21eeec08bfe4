"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from itemloom import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    clean = lambda x: None if x is None or pd.isna(x) else round(float(x), 6) if isinstance(x, float) else str(x)
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_sql_run(spark):
    for name in set(plans.QUERIES) - set(plans.ORACLES):
        assert plans.QUERIES[name](spark, SF).count() > 0
