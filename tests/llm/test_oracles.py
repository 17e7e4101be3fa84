"""Queries that SQL can express give the SQL's rows."""

import os

import duckdb
import pytest
from lumagrain.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), c.sql(queries.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = sorted(str(tuple(r[n] for n in names)) for r in df.collect())
    at = [want.columns.index(n) for n in names]
    assert got == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())
