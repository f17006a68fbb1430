"""Queries of the streaming operators, drained over the events table, each beside its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memlake.plans.catalog import SQL, query, read, stamp
from memlake.session import shared_dir
from memlake.streaming import stateful, streams


def _events(spark, d):
    return streams.source(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _out_of_order(spark, d):
    """The events as a feed of four batches that are dealt by a digest, so that each comes before earlier ones."""
    events = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.file_feed(events, 4, F.xxhash64("event_id"))


@query("SELECT DISTINCT event_id, user_id FROM events")
def st3_idempotent_intake(spark, d):
    e = _events(spark, d)
    return streams.drain(streams.idempotent(e.unionByName(e), ["event_id"], "ts", "60 days").select("event_id", "user_id"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st5_tumbling_days(spark, d):
    return streams.drain(streams.tumbling(_events(spark, d), "ts", "event_type"), "complete").withColumn("window_start", stamp("window_start"))


@query("SELECT strftime(date_trunc('day', ts) - to_days(i), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest(range(0, 7))::INT AS i) GROUP BY 1, 2")
def st9_sliding_week(spark, d):
    return streams.drain(streams.tumbling(_events(spark, d), "ts", "event_type", "7 days", slide="1 day"), "complete").withColumn("window_start", stamp("window_start"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n_events FROM s GROUP BY user_id, k""")
def st6_sessions(spark, d):
    rows = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(rows, "user_id", "ts").withColumn("session_start", stamp("session_start"))


@query("""WITH c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), k AS (SELECT * FROM c WHERE event_type IS DISTINCT FROM before) SELECT user_id AS key, event_type AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts)::INT AS version, strftime(ts, '%Y-%m-%d %H:%M:%S') AS valid_from FROM k""")
def k1_stream_versions(spark, d):
    changes = stateful.status_versions(_out_of_order(spark, d), "user_id", "event_type", "ts", "event_id", "60 days")
    return stateful.latest_versions(streams.drain(changes, "update")).select("key", "state", "version", stamp("valid_from").alias("valid_from"))


@query("""WITH c AS (SELECT *, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT * FROM c WHERE event_type IS DISTINCT FROM before)
SELECT user_id AS key, event_type AS state, strftime(ts, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), '%Y-%m-%d %H:%M:%S') AS valid_until FROM k""")
def k1_stream_intervals(spark, d):
    changes = stateful.status_versions(_out_of_order(spark, d), "user_id", "event_type", "ts", "event_id", "60 days")
    return stateful.latest_versions(streams.drain(changes, "update")).select("key", "state", stamp("valid_from").alias("valid_from"), stamp("valid_until").alias("valid_until"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def st4_late_replay(spark, d):
    """Daily totals from a feed in which most rows come behind the watermark: late rows are set aside, and their days are built again."""
    base = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    streams.split_late(_out_of_order(spark, d), "ts", "1 day", base)
    on_time, late = (spark.read.parquet(f"{base}/{t}").withColumn("day", F.date_format("ts", "yyyy-MM-dd")) for t in ("on_time", "late"))
    totals = lambda rows: rows.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return streams.replayed(totals(on_time), late, on_time.unionByName(late), ["day", "event_type"], totals)


@query(SQL["st6_sessions"])
def st6_stream_sessions(spark, d):
    """Sessions on a stream whose rows come out of order, so that late rows lengthen and merge sessions."""
    stream = _out_of_order(spark, d).withWatermark("ts", "60 days")
    return streams.drain(streams.sessions(stream, "user_id", "ts"), "complete").withColumn("session_start", stamp("session_start"))


#: Three scans: some pages appear at the second, some are gone from it on, some change at the third.
SCANS = """SELECT url AS path, i AS scan, sha256(coalesce(html, '') || CASE WHEN page_id % 3 = 0 AND i = 2 THEN ' v2' ELSE '' END) AS checksum FROM pages, (SELECT unnest(range(0, 3))::INT AS i)
WHERE (page_id % 5 > 0 OR i > 0) AND (page_id % 7 > 0 OR i = 0)"""


@query(f"SELECT path, max(checksum) AS checksum FROM ({SCANS}) WHERE scan = 2 GROUP BY 1")
def s6_monitored_import(spark, d):
    """The table that follows a monitored folder from scan to scan, with what was deleted gone."""
    page, scan = F.col("page_id"), F.col("scan")
    pages = read(spark, d, "pages").withColumn("scan", F.explode(F.array(*map(F.lit, range(4)))))
    content = F.concat(F.coalesce("html", F.lit("")), F.when((page % 3 == 0) & (scan >= 2), " v2").otherwise(""))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + 60 * scan)
    # a last scan like the one before tells what that one no longer showed
    shown = pages.filter(((page % 5 > 0) | (scan > 0)) & ((page % 7 > 0) | (scan == 0))).select(F.col("url").alias("path"), F.sha2(content.cast("binary"), 256).alias("checksum"), at.alias("at"), "scan")
    table = f"{shared_dir(spark)}/monitored-{uuid.uuid4().hex}"
    changes = stateful.file_changes(streams.file_feed(shown, 4, scan), "path", "checksum", "at", 60)
    streams.drain(changes, "update", lambda batch, _: streams.merge_changes(table, batch, "path", "change", "scanned_at"))
    return streams.merged_table(spark, table, "path").select("path", "checksum")


@query("SELECT event_id, least(60, pow(2, event_id % 9))::BIGINT AS minutes FROM events WHERE event_type = 'error'")
def st2_backoff(spark, d):
    from memlake.operators.lifecycle import backoff_minutes

    return read(spark, d, "events").filter("event_type = 'error'").select("event_id", backoff_minutes(F.col("event_id") % 9).alias("minutes"))


@query("""SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def st10_latest_run(spark, d):
    from memlake.operators.relational import top_per_group

    return top_per_group(read(spark, d, "events"), ["event_type"], [F.desc("ts"), F.asc("event_id")]).select("event_type", "user_id", "event_id")
