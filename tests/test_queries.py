"""Every query on timelines against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from chronoforge.plans.timeline_queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(tuple, df[cols].astype(str).values))


@pytest.mark.parametrize("name", queries())
def test_query_equals_its_sql(spark, tables, name):
    got, want = queries()[name](spark, SF).toPandas(), tables.execute(oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_entry_works_without_the_corpus_part(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
