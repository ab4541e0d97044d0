"""The registered queries on the smallest tables, against DuckDB where SQL can express them."""

import os

import duckdb
import pandas as pd
import pytest

from voxstrata.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want = c.execute(queries.oracle_sql()[name]).fetchdf().astype(object)
    got = queries.queries()[name](spark, SF).toPandas().astype(object)
    cols = sorted(want.columns)
    plain = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else x
    rows = lambda df: sorted(str(tuple(map(plain, r))) for r in df[cols].itertuples(index=False, name=None))
    assert sorted(got.columns) == cols and rows(got) == rows(want)
