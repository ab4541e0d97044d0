"""Every library query that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from voxstrata.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(map(str, pdf[cols].astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert rows(got.astype(want[got.columns].dtypes.to_dict())) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    """Rows of the queries that SQL can't express; the smallest tables have no component that is large enough for two of them."""
    rows = registry.queries()[name](spark, SF)
    n = rows.count()
    assert (n == 0) == (name in ("i_skeletonize", "i_skeletonize_command")) and len(set(rows.columns)) == len(rows.columns)


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark)
    assert rows.columns == ["x", "y", "z", "d2"] and rows.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
