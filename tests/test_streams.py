"""Keyed state with timers: late rows, deletions, a query that dies between batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import lifecycle
from memlake.streaming import stateful, streams

START = dt.datetime(2024, 1, 1)


def feed(spark, rows, schema, folder, batches):
    """One file a batch, in the order of the batches."""
    for some in batches:
        spark.createDataFrame([rows[j] for j in some], schema).coalesce(1).write.mode("append").parquet(folder)
    return streams.source(spark, folder, 1)


def test_versions_from_rows_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", None]), START + dt.timedelta(minutes=rng.randrange(500)), n) for n, k in enumerate(rng.choices(range(6), k=240))]
    schema = "user long, state string, ts timestamp, n long"
    order = rng.sample(range(240), 240)
    stream = feed(spark, rows, schema, str(tmp_path / "feed"), [order[i::5] for i in range(5)])
    changes = streams.drain(stateful.status_versions(stream, "user", "state", "ts", "n", "1 day"), "update")
    got = sorted(map(tuple, stateful.latest_versions(changes).select("key", "version", "state", "valid_from", "valid_until").collect()), key=repr)
    expected = lifecycle.versions(spark.createDataFrame(rows, schema), "user", "state", "ts", "n").select("user", "version", "state", "valid_from", "valid_until")
    assert got == sorted(map(tuple, expected.collect()), key=repr)
    assert changes.groupBy("key", "version").count().filter("count > 1").count() > 0  # versions were reopened


def test_versions_after_their_rows_expired(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted((1 + n % 3, rng.choice("abc"), START + dt.timedelta(hours=n, minutes=rng.randrange(50)), n) for n in range(200))
    rows.sort(key=lambda r: r[2])
    schema = "user long, state string, ts timestamp, n long"
    # nearly in order: rows of a batch are shuffled, and far older ones have left the state
    stream = feed(spark, rows, schema, str(tmp_path / "feed"), [rng.sample(range(i, i + 20), 20) for i in range(0, 200, 20)])
    changes = streams.drain(stateful.status_versions(stream, "user", "state", "ts", "n", "2 hours"), "update")
    got = sorted(map(tuple, stateful.latest_versions(changes).select("key", "version", "state", "valid_from", "valid_until").collect()), key=repr)
    expected = lifecycle.versions(spark.createDataFrame(rows, schema), "user", "state", "ts", "n").select("user", "version", "state", "valid_from", "valid_until")
    assert got == sorted(map(tuple, expected.collect()), key=repr)


def test_no_row_is_lost_behind_the_watermark(spark, tmp_path):
    rows = [(n, START + dt.timedelta(minutes=n)) for n in range(600)] + [(600, None)]
    rng = random.Random(6)
    order = rng.sample(range(601), 601)
    stream = feed(spark, rows, "n long, ts timestamp", str(tmp_path / "feed"), [order[:200], order[200:400], order[400:]])
    base = str(tmp_path / "out")
    streams.split_late(stream, "ts", "1 hour", base)
    on_time, late = (spark.read.parquet(f"{base}/{t}").drop("epoch") for t in ("on_time", "late"))
    assert late.count() > 100 and sorted(r.n for r in on_time.union(late).collect()) == list(range(601))
    highs, seen = [], None
    for batch in (order[:200], order[200:400], order[400:]):
        highs.append(seen)
        seen = max([t for j in batch if (t := rows[j][1])] + [seen or START])
    expected = {j for high, batch in zip(highs, (order[:200], order[200:400], order[400:]), strict=True) for j in batch if high and rows[j][1] and rows[j][1] < high - dt.timedelta(hours=1)}
    assert {r.n for r in late.collect()} == expected
    by_hour = lambda df: df.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hours = lambda df: df.filter("ts is not null").withColumn("hour", F.hour("ts"))
    merged = streams.replayed(by_hour(hours(on_time)), hours(late), hours(on_time.union(late)), ["hour"], by_hour)
    assert {r.hour: r.n for r in merged.collect()} == {h: 60 for h in range(10)}


def test_sessions_merge_on_late_rows(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(5), START + dt.timedelta(minutes=rng.randrange(2000))) for _ in range(300)]
    order = rng.sample(range(300), 300)
    stream = feed(spark, rows, "user long, ts timestamp", str(tmp_path / "feed"), [order[i::4] for i in range(4)])
    got = streams.drain(streams.sessions(stream.withWatermark("ts", "2 days"), "user", "ts"), "complete")
    batch = streams.sessions(spark.createDataFrame(rows, "user long, ts timestamp"), "user", "ts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def scans():
    files = [{"a": "1", "b": "1", "c": "1"}, {"a": "1", "b": "2", "d": "1"}, {"a": "1", "c": "3", "d": "1"}, {"a": "1", "d": "2"}]
    return [[(p, c, START + dt.timedelta(seconds=60 * i)) for p, c in f.items()] for i, f in enumerate(files)]


@pytest.mark.parametrize("dies", [False, True])
def test_monitored_files(spark, tmp_path, dies):
    """New, changed and deleted files over several triggers, one of which dies after it has merged; then it is started again."""
    rows = [r for s in scans() for r in s]
    at, batches = 0, []
    for s in scans():
        batches.append(range(at, at + len(s)))
        at += len(s)
    stream = feed(spark, rows, "path string, checksum string, at timestamp", str(tmp_path / "scans"), batches)
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    died = []

    def merge(df, epoch):
        df.write.mode("overwrite").parquet(f"{log}/epoch={epoch}")
        streams.merge_changes(table, df, "path", "change", "scanned_at", 4)
        if dies and epoch == 1 and not died:
            died.append(epoch)
            raise RuntimeError("killed")

    def run():
        changes = stateful.file_changes(stream, "path", "checksum", "at", 60)
        q = changes.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    if dies:
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    assert bool(died) == dies
    got = {(r.path, r.change, r.checksum, (r.scanned_at - START).seconds // 60) for r in spark.read.parquet(log).collect()}
    assert got == {
        ("a", "new", "1", 0), ("b", "new", "1", 0), ("c", "new", "1", 0), ("b", "changed", "2", 1), ("c", "deleted", "1", 1), ("d", "new", "1", 1), ("c", "new", "3", 2), ("b", "deleted", "2", 2),
        ("c", "deleted", "3", 3), ("d", "changed", "2", 3),
    }
    assert {(r.path, r.checksum) for r in streams.merged_table(spark, table, "path").collect()} == {("a", "1"), ("d", "2")}
