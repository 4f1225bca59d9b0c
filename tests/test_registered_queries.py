"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tablemill.queries import ORACLES, QUERIES
from tablemill.queries.registry import TABLES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    wanted = duck.sql(ORACLES[name])
    assert sorted(wanted.columns) == columns
    order = [wanted.columns.index(c) for c in columns]
    expected = [tuple(r[i] for i in order) for r in wanted.fetchall()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert expected, "an empty answer proves nothing"
