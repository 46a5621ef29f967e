"""Every registered query with SQL equals DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

import skarn.queries_basics  # noqa: F401
import skarn.queries_files  # noqa: F401
import skarn.queries_graph  # noqa: F401
import skarn.queries_lookups  # noqa: F401
import skarn.queries_patterns  # noqa: F401
import skarn.queries_search  # noqa: F401
import skarn.queries_services  # noqa: F401
import skarn.queries_streams  # noqa: F401
import skarn.queries_vectors  # noqa: F401
import skarn.queries_walks  # noqa: F401
from skarn.bindings import TABLES
from skarn.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    QUERIES[name](spark, DATA).collect()
