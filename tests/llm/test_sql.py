"""The registered queries that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from memlake.llm import oracles, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({oracles.SQL[name]})").fetchall(), key=repr)
