"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from factloom.plans import catalog, code, formats, more  # noqa: F401

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(catalog.SQL[name]).df())


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
