"""The training-data queries with SQL give the same rows as DuckDB on the smallest tables; the others run whole."""

import os

import duckdb
import pytest

from lacuna.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    result = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0
