"""The queries that SQL can express, against DuckDB."""

import os

import pytest
from conftest import rows

from sessionloom.llm import queries

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert rows(queries.queries()[name](spark, DATA)) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
