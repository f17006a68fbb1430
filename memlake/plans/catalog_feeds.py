"""Queries of sources and sinks, over payloads and files that are made of the tables' rows, each beside its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memlake.operators import extract
from memlake.plans.catalog import query, read
from memlake.session import shared_dir
from memlake.sources import tables

# --- webhooks ---------------------------------------------------------------------------------------------------------


@query("""SELECT event_id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS sent_at, CASE event_id % 3 WHEN 0 THEN 'c' || user_id WHEN 1 THEN 'd' || user_id ELSE event_type END AS channel, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'name ' || user_id WHEN event_id % 3 = 1 THEN 'author ' || user_id ELSE user_id::VARCHAR END AS sender, event_type || ' "' || event_id || '"' AS text FROM events""")
def s7_webhook_messages(spark, d):
    """Events as the payloads of three producers, read back as messages."""
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("user_id").cast("string").alias("who"), "event_type", "event_id")
    said = F.concat(F.col("event_type"), F.lit(' "'), F.col("id"), F.lit('"'))
    inner = F.struct(F.concat(F.lit("c"), F.col("who")).alias("channel"), F.col("who").alias("user"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("name "), F.col("who"))).alias("username"), said.alias("text"))
    first = F.to_json(F.struct(F.col("id").alias("event_id"), F.col("at").alias("event_time"), inner.alias("event")))
    second = F.to_json(F.struct("id", F.col("at").alias("timestamp"), F.concat(F.lit("d"), F.col("who")).alias("channel_id"), F.struct(F.concat(F.lit("author "), F.col("who")).alias("username")).alias("author"), said.alias("content")))
    third = F.to_json(F.struct("id", F.col("at").alias("timestamp"), F.col("event_type").alias("channel"), F.col("who").alias("user"), said.alias("text")))
    payload = F.when(F.col("event_id") % 3 == 0, first).when(F.col("event_id") % 3 == 1, second).otherwise(third)
    return tables.webhook_messages(e.select(payload.alias("value"))).withColumnsRenamed({"at": "sent_at", "user": "sender"})


# --- files ------------------------------------------------------------------------------------------------------------


@query("SELECT year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS d, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3")
def s10_day_partitions(spark, d):
    """Events written to a folder for each day and read back, their day taken from the folder alone."""
    path = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    tables.write_by_day(read(spark, d, "events").select("ts", "value"), "ts", path)
    return spark.read.parquet(path).groupBy("y", "m", "d").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT user_id AS session, event_id::INT AS event_index, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE CASE event_type WHEN 'click' THEN 'user_msg' WHEN 'view' THEN 'assistant_msg' WHEN 'purchase' THEN 'exec_begin' WHEN 'signup' THEN 'apply_patch' ELSE 'turn' END END AS event_type,
CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE CASE event_type WHEN 'click' THEN 'user_message' WHEN 'view' THEN 'assistant_message' WHEN 'purchase' THEN 'shell_command' WHEN 'signup' THEN 'file_edit' ELSE 'unknown' END END AS category, event_type AS role, 'k' || event_id AS text FROM events WHERE event_id % 13 <> 0""")
def s11_session_log(spark, d):
    """Events as lines of JSON session logs, written as text files and read back; broken lines are told and left out."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    name = F.when(F.col("event_type") == "click", "user_msg").when(F.col("event_type") == "view", "assistant_msg").when(F.col("event_type") == "purchase", "exec_begin").when(F.col("event_type") == "signup", "apply_patch").otherwise("turn")
    line = F.to_json(F.struct(F.col("event_id").alias("index"), F.when(F.col("event_id") % 11 != 0, name).alias("type"), F.col("event_type").alias("role"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("text")))
    broken = F.when(F.col("event_id") % 13 == 0, F.expr("substring(line, 1, 9)")).otherwise(F.col("line"))
    lines = read(spark, d, "events").withColumn("line", line).select(F.concat_ws("\t", "user_id", broken).alias("value"))
    lines.write.text(path)
    read_back = spark.read.text(path).select(F.split_part("value", F.lit("\t"), F.lit(1)).cast("long").alias("session"), F.split_part("value", F.lit("\t"), F.lit(2)).alias("line"))
    return extract.session_events(read_back, "session", "line").filter("not broken").select("session", "event_index", "event_type", "category", "role", "text")


@query("""WITH w AS (SELECT conv_id, turn, role, unnest(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) > 3)) AS word, generate_subscripts(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) > 3), 1) AS i FROM conversations WHERE conv_id % 2 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS place FROM w), g AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY place) AS fresh FROM o), r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY place) - 1 AS run FROM g)
SELECT conv_id, run::INT AS nth, any_value(role) AS speaker, sha256(string_agg(word, ' ' ORDER BY place)) AS digest, (min(place) * 500)::BIGINT AS start_ms, (max(place) * 500 + 250)::BIGINT AS end_ms FROM r GROUP BY 1, 2
UNION ALL SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT, role, sha256(text), turn * 2000, turn * 2000 + 1500 FROM conversations WHERE conv_id % 2 = 1""")
def s13_transcripts(spark, d):
    """Conversations as transcript JSON, half of them as timed segments, half as timed words, read back as utterances."""
    c = read(spark, d, "conversations")
    listed = lambda rows, *order: F.array_sort(F.collect_list(F.struct(*order, rows))).alias("all")
    seconds = lambda x: x.cast("double")
    segment = F.struct(seconds(F.col("turn") * 2).alias("start"), seconds(F.col("turn") * 2 + 1.5).alias("end"), "text", F.col("role").alias("speaker")).alias("s")
    segments = c.filter("conv_id % 2 = 1").groupBy("conv_id").agg(listed(segment, "turn")).select("conv_id", F.to_json(F.struct(F.transform("all", lambda x: x.s).alias("segments"))).alias("payload"))
    words = c.filter("conv_id % 2 = 0").select("conv_id", "turn", "role", F.posexplode(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.length(x) > 3)).alias("i", "word"))
    spoken = words.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "i", "word", "role"))).alias("all"))
    timed = F.transform("all", lambda x, i: F.struct(x.word.alias("word"), seconds(i * 0.5).alias("start"), seconds(i * 0.5 + 0.25).alias("end"), x.role.alias("speaker")))
    spoken = spoken.select("conv_id", F.to_json(F.struct(timed.alias("words"))).alias("payload"))
    found = extract.utterances(segments.unionByName(spoken), "conv_id", "payload")
    return found.select("conv_id", "nth", "speaker", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "start_ms", "end_ms")
