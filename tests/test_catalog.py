"""Every registered query of the library against its SQL twin in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry
from memlake.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(found, columns):
    return sorted((tuple(plain(v) for v in r) for r in found), key=repr), columns


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect(), columns)
    if name not in catalog.SQL:
        assert got[0]
        return
    sql = catalog.SQL[name]
    theirs = sorted(duck.sql(sql).columns)
    assert got == rows(duck.sql(f"SELECT {', '.join(theirs)} FROM ({sql})").fetchall(), theirs)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
