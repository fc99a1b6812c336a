import os

import duckdb
import pytest

import __spark_entry__ as entry
from packsight.plans import queries as relational

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v.item() if hasattr(v, "item") else v


def rows(df):
    columns = sorted(df.columns)
    return sorted(([plain(v) for v in r] for r in df[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(relational.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = relational.queries()[name](spark, SF).toPandas()
    want = duck.sql(relational.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(relational.queries()) - set(relational.oracle_sql())))
def test_package_queries_run(spark, name):
    assert relational.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(relational.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
