"""Each query of the text operators against its SQL in DuckDB, over 0.01."""

import os

import duckdb
import pytest

from hearthlake.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import plain

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    got, want = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)
