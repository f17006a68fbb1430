"""Feeds of several files a batch, and keyed state without a pandas frame for every key."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.streaming import stateful, streams


def _batches(spark, df, n, order):
    seen: list = []
    stream = streams.file_feed(df, n, order)
    streams.drain(stream, "append", lambda batch, _: seen.append((sorted(r.n for r in batch.collect()), batch.select(F.input_file_name()).distinct().count())))
    return seen


def test_a_batch_is_several_files(spark, monkeypatch):
    monkeypatch.setattr(streams, "FEED_ROWS", 50)
    df = spark.range(0, 600, 1, 3).withColumnRenamed("id", "n")
    seen = _batches(spark, df, 3, F.col("n"))
    assert [rows for rows, _ in seen] == [list(range(i, 600, 3)) for i in range(3)]
    assert {files for _, files in seen} == {5}


def test_a_batch_too_small_for_its_files_keeps_its_rows(spark, monkeypatch):
    monkeypatch.setattr(streams, "FEED_ROWS", 50)
    df = spark.range(0, 600, 1, 3).withColumnRenamed("id", "n")
    seen = _batches(spark, df, 2, F.when(F.col("n") == 7, 1).otherwise(0))
    assert [rows for rows, _ in seen] == [[i for i in range(600) if i != 7], [7]]


def test_state_is_kept_by_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a", "x", "2024-01-01 00:00:00")], "n long, user string, state string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "rows"))
    stream = streams.source(spark, str(tmp_path / "rows"))
    for df in (stateful.status_versions(stream, "user", "state", "ts", "n", "1 day"), stateful.file_changes(stream, "user", "state", "ts", 60)):
        assert "InPandas" not in df._jdf.queryExecution().analyzed().toString()
