"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumigraph.plans import library_queries, queries

QUERIES, SQL = queries.QUERIES | library_queries.QUERIES, queries.SQL | library_queries.SQL
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    """A value as text, so that rows sort: doubles to six places, null and NaN apart from all numbers."""
    if x is None:
        return "null"
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{round(x, 6) + 0.0:.6f}"
    return f"{type(x).__name__} {x}"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    """Collected rows, not data frames: there a nullable integer would turn into a float."""
    got, found = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in got.select(*columns).collect()) == want
