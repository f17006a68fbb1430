"""Queries against their SQL on rows that the smallest tables lack."""

from __future__ import annotations

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from memlake.operators import text
from memlake.plans import catalog


def both(spark, folder, name, table, rows, schema):
    """The query's rows and its SQL's, over one table of these rows."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    df = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return sorted(map(tuple, df.collect())), sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL[name]})").fetchall())


@pytest.mark.parametrize("name", ["t18_event_scores"])
def test_words_beside_letters_with_marks(spark, tmp_path, name):
    rows = [(1, i, "user", f"on {w} it") for i, w in enumerate(["test", "étest", "testä", "detest", "ß error", "ERROR_"])]
    got, want = both(spark, tmp_path, name, "conversations", rows, "conv_id long, turn long, role string, text string")
    assert got == want and [r[2] for r in got] == [1.0, 1.0, 1.0, 0.75, 1.0, 0.75]


def test_licences_beside_letters_with_marks(spark, tmp_path):
    got, want = both(spark, tmp_path, "f4_regex_words", "documents", [(1, "élicense"), (2, "sublicense"), (3, "copyrightö")], "doc_id long, text string")
    assert got == want == [(1,), (3,)]


def test_dates_in_both_parts_of_a_cut_fragment(spark, tmp_path):
    """Both dates that the query adds fall into different parts, a cut parts a date, and a file is dated after its capture only."""
    rows = [(3, "word " * 236 + "end"), (6, "w" * 1187), (2, "On 2024-05-06 it was. " + "word " * 400), (9, "Short.")]
    rows = [(i, t, "en", "s", len(t)) for i, t in rows]
    got, want = both(spark, tmp_path, "s2_ingest_chain", "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got == want


def test_budget_parts_keep_their_letters(spark):
    """The SQL of t5_budget_parts takes the letter v for a blank (DuckDB knows no escape of that letter); the query must not."""
    docs = spark.createDataFrame([(1, "vec " * 400), (2, "\v\vvv\v")], "id long, text string")
    got = {(r.id, r.part): (r.char_start, r.char_end) for r in text.budget_parts(docs, "id", most=1200).collect()}
    assert got == {(1, 0): (0, 1199), (1, 1): (1200, 1599), (2, 0): (2, 4)}
