"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from graphloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    expected = con.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
