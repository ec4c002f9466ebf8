"""Queries whose results SQL can state, against DuckDB on whole tables."""

import duckdb
import pytest
from docweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert set(got.columns) == set(columns)
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(want.fetchall())
