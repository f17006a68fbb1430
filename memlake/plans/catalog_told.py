"""Queries of text rules over texts in which every rule fires: rows of the tables, told in sentences.

The sentences are one SQL expression that Spark and DuckDB both read; the rules are those of the other catalogs.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from memlake.functions import scalar
from memlake.operators import extract, identity, ingest, text
from memlake.plans import catalog_deep, catalog_more, catalog_rest, catalog_text, planner  # noqa: F401  (their SQL)
from memlake.plans.catalog import SQL, query, read

DOCUMENT = """CASE doc_id % 12
WHEN 0 THEN 'I met Anna in Paris for project Orion. ' WHEN 1 THEN 'I really love ' || source || '. I want to read ' || lang || '! ' WHEN 2 THEN 'I can parse ' || lang || '. I think that ' || source || ' is long. '
WHEN 3 THEN 'key sk-abcdefghijklmnopqrst' || doc_id || ' and ghp_abcdefghijklmnopqrstuvwx. ' WHEN 4 THEN 'postgres://user:pw@' || source || '/db with API_KEY=' || source || doc_id || '. '
WHEN 5 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || source || chr(10) || '-----END RSA PRIVATE KEY----- ' WHEN 6 THEN 'session: abcdefghijklmnopqrstuvwx' || doc_id || ' refresh_token=abcdefghijklmnopqrst' || doc_id || ' eyJabcdefghijk.abcdefghijkl.abcdefghijkl '
WHEN 7 THEN 'a confidential medical note about ' || lang || ' ' WHEN 8 THEN 'met Bob at Rome, repo Atlas from Carl ' ELSE '' END || coalesce(text, '')"""
COPY = "CASE WHEN n_chars % 2 = 0 THEN 'Notice of ' || source || ', part ' || (n_chars % 3) ELSE text END"
QUESTION = "text || CASE WHEN turn % 2 = 1 THEN ' Is it so? ' ELSE '' END"
LINE = "CASE turn % 4 WHEN 1 THEN '- ' WHEN 2 THEN turn || '. ' WHEN 3 THEN 'Done in 2021: ' ELSE '' END || text"
ASKED = "CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN 'What happened?' ELSE 'So what did they do about ' || role || '?' END"
URL = "CASE page_id % 6 WHEN 0 THEN url || '.png' WHEN 1 THEN 'HTTP://host/talk' || page_id || '.MP3?x=1' WHEN 2 THEN 'file:/papers/' || page_id || '.pdf' WHEN 3 THEN page_id || '.Markdown' WHEN 4 THEN 'note-' || page_id ELSE url END"


def _told(spark, d, table: str, column: str, expression: str):
    return read(spark, d, table).withColumn(column, F.expr(expression))


def _over(table: str, column: str, expression: str, sql: str) -> str:
    """``sql`` over a table whose column is told anew."""
    body = re.sub(rf"\b{table}\b", "told", sql.strip())
    told = f"WITH told AS (SELECT * REPLACE ({expression} AS {column}) FROM {table})"
    return f"{told}, {body.removeprefix('WITH ')}" if body.startswith("WITH ") else f"{told} {body}"


def _documents(spark, d):
    return _told(spark, d, "documents", "text", DOCUMENT)


@query(_over("documents", "text", DOCUMENT, SQL["t21_mentions"]))
def t21_told_mentions(spark, d):
    return extract.mentions(_documents(spark, d), "doc_id")


RULES = " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{predicate}' AS predicate, {weight} AS weight" for kind, (predicate, weight) in extract.EDGE_RULES.items())


@query(_over("documents", "text", DOCUMENT, f"WITH m AS ({SQL['t21_mentions']}), e AS ({RULES}) SELECT source AS subject, predicate, name AS object, max(weight)::DOUBLE AS confidence, count(DISTINCT doc_id) AS n_documents FROM documents JOIN m USING (doc_id) JOIN e USING (kind) GROUP BY 1, 2, 3"))
def t22_told_edges(spark, d):
    """Edges from each source to what its documents mention."""
    docs = _documents(spark, d)
    return extract.rule_edges(docs.select("doc_id", F.col("source").alias("subject")), extract.mentions(docs, "doc_id"), "doc_id")


@query(_over("documents", "text", DOCUMENT, SQL["t25_statements"]))
def t25_told_statements(spark, d):
    return extract.statements(_documents(spark, d), "doc_id")


@query(_over("documents", "text", DOCUMENT, SQL["k12_redaction"]))
def k12_told_redaction(spark, d):
    redacted = _documents(spark, d).select("doc_id", "text", scalar.redact(F.col("text")).alias("redacted"))
    return redacted.select("doc_id", F.sha2(F.col("redacted").cast("binary"), 256).alias("digest"), (F.col("redacted") != F.col("text")).alias("was_redacted"))


@query(_over("documents", "text", DOCUMENT, SQL["k12_privacy_tier"]))
def k12_told_tier(spark, d):
    return _documents(spark, d).select("doc_id", scalar.privacy_tier(F.col("text")).alias("tier"))


@query(_over("documents", "text", COPY, SQL["e9_near_duplicates"]))
def e9_told_copies(spark, d):
    """Keepers where most documents of a source are copies of a notice."""
    labelled = read(spark, d, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    docs = _told(spark, d, "documents", "text", COPY).join(labelled, "doc_id", "left")
    return identity.keepers_of_copies(docs, [F.col("source"), F.col("lang"), F.sha2(F.col("text").cast("binary"), 256)], [F.when(F.col("labelled"), 0).otherwise(1)], "doc_id")


@query(_over("conversations", "text", QUESTION, SQL["t12_answered_turns"]))
def t12_told_answers(spark, d):
    return text.answered_turns(_told(spark, d, "conversations", "text", QUESTION))


@query(_over("conversations", "text", LINE, SQL["t16_task_lines"]))
def t16_told_lines(spark, d):
    return catalog_rest.task_lines(_told(spark, d, "conversations", "text", LINE))


@query(_over("conversations", "text", ASKED, SQL["f10_low_information"]))
def f10_told_questions(spark, d):
    significant = F.filter(scalar.tokens(F.col("text")), lambda t: F.length(t) > 6)
    return _told(spark, d, "conversations", "text", ASKED).select("conv_id", "turn", scalar.low_information(F.col("text"), significant).alias("is_low"))


@query(_over("pages", "url", URL, SQL["t28_source_kind"]))
def t28_told_kinds(spark, d):
    return _told(spark, d, "pages", "url", URL).select("page_id", text.source_kind(F.col("url")).alias("kind"))


# --- ingest -----------------------------------------------------------------------------------------------------------

DATED = "coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' Seen on 2024-01-1' || (doc_id % 10) || ', and on 2024-02-03.' WHEN 1 THEN chr(10) || chr(10) || 'Nothing dated, but long: ' || repeat('word ', 300) || 'end.' ELSE '' END"
CAPTURED = "2024-02-01 00:00:00"


@query(_over("documents", "text", DATED, f"""WITH f AS (SELECT doc_id, scene, {catalog_text.SENTENCES.format('scene_text')} AS s FROM ({catalog_text.SCENES})), g AS (SELECT doc_id, scene, s, unnest(range(0, ceil(len(s) / 3)::BIGINT)) AS i FROM f), c AS (SELECT doc_id, array_to_string(s[3 * i + 1:3 * i + 3], ' ') AS content FROM g),
n AS (SELECT doc_id, content, list_min(list_concat(regexp_extract_all(content, '\\b((?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}})\\b'), []::VARCHAR[])) AS day FROM c),
d AS (SELECT doc_id, count(*) FILTER (WHERE length(content) <= 1200) AS whole, count(*) FILTER (WHERE day IS NOT NULL) AS dated, min(coalesce(day::TIMESTAMP, TIMESTAMP '{CAPTURED}')) AS first_at FROM n GROUP BY 1)
SELECT t.doc_id, CASE WHEN doc_id % 4 = 1 THEN 4 ELSE 1 END::INT AS version, coalesce(whole, 0) AS whole, coalesce(dated, 0) AS dated, strftime(first_at, '%Y-%m-%d') AS first_day FROM documents t LEFT JOIN d USING (doc_id) WHERE doc_id % 4 <> 0"""))
def s2_ingest_chain(spark, d):
    """Documents as files: a quarter is known already, a quarter has an older content. What each new content becomes."""
    files = _told(spark, d, "documents", "text", DATED).withColumn("uri", F.col("doc_id").cast("string"))
    same = F.sha2(F.col("text").cast("binary"), 256)
    ledger = files.filter("doc_id % 4 < 2").select("uri", F.when(F.col("doc_id") % 4 == 0, same).otherwise("older").alias("checksum"), F.when(F.col("doc_id") % 4 == 0, 1).otherwise(3).alias("version"))
    artifacts, found = ingest.ingested(files, ledger, "uri", "text", F.lit(CAPTURED).cast("timestamp_ntz"))
    # parts of a fragment share its day; each fragment has one first part
    first = F.min(F.coalesce(F.col("fragment_day").cast("timestamp_ntz"), F.col("occurred_at")))
    per = found.groupBy("uri", "version").agg(F.count_if((F.col("part") == 0) & ~F.col("split")).alias("whole"), F.count_if((F.col("part") == 0) & F.col("dated")).alias("dated"), first.alias("first_at"))
    return artifacts.join(per, ["uri", "version"], "left").select(F.col("uri").cast("long").alias("doc_id"), "version", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("dated", F.lit(0)).alias("dated"), F.date_format("first_at", "yyyy-MM-dd").alias("first_day"))


# --- whole tables where the others read a part -----------------------------------------------------------------------


@query(rf"SELECT doc_id, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(text, '(\b[A-Z][a-z]+\b)', 1), lambda x: x NOT IN ({catalog_text.STOP})), lambda x: lower(x)))) AS name FROM documents")
def t20_all_names(spark, d):
    """Capitalised names of the documents of every language."""
    return read(spark, d, "documents").select("doc_id", F.explode(text.capitalized_names(F.col("text"))).alias("name"))


SPOKEN = r"trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))"


@query(rf"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS nth, upper(left(role, 1)) || substr(role, 2) AS speaker, length({SPOKEN})::INT AS n_chars, sha256({SPOKEN}) AS digest FROM conversations WHERE {SPOKEN} <> ''""")
def t8_whole_turns(spark, d):
    """Turns read back from a script of each conversation, with all that was said."""
    said = F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " "))
    lines = read(spark, d, "conversations").withColumn("line", F.concat(F.initcap("role"), F.lit(": "), said)).filter(F.length(said) > 0)
    scripts = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x.line), "\n").alias("text"))
    return extract.speaker_turns(scripts, "conv_id").select("conv_id", F.col("turn").alias("nth"), "speaker", F.length("text").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


# --- plans ------------------------------------------------------------------------------------------------------------

QUESTIONS = (
    "What happened yesterday?", "What did we do last week?", "Where was I in March 2024?", "Notes two weeks after January 5, 2024", "What happened since 2023?", "Why did the build fail?",
    "Who is connected to Anna?", "When was the parser released?", "three months ago", "last weekend plans", "what was I doing around then", "favourite editor",
)
#: Of each question: start, end, granularity, class, intent, hops, candidates, weights, layers, terms.
PLANS = """(0, d - 1, d, 'day', 'temporal_summary', 'complex', 1, 4, 1.35, 1.05, 'day,week,month', ''), (1, w - 7, w, 'broad', 'temporal_summary', 'complex', 1, 6, 1.05, 1.3, 'year,month,week,day', ''),
(2, DATE '2024-03-01', DATE '2024-04-01', 'month', 'temporal_summary', 'complex', 1, 4, 1.35, 1.05, 'month,week,day', ''), (3, DATE '2024-01-19', DATE '2024-01-20', 'day', 'temporal_summary', 'complex', 1, 4, 1.35, 1.05, 'day,week,month', 'Notes'),
(4, DATE '2023-01-01', ts, 'broad', 'temporal_summary', 'complex', 1, 6, 1.05, 1.3, 'year,month,week,day', ''), (5, NULL, NULL, 'none', 'causal', 'complex', 2, 4, 1.0, 1.0, 'week,day', 'build,fail'),
(6, NULL, NULL, 'none', 'graph_multi_hop', 'complex', 3, 4, 1.0, 1.0, 'week,day', 'Anna,connected'), (7, NULL, NULL, 'none', 'temporal_detail', 'complex', 1, 4, 1.0, 1.0, 'week,day', 'parser,released'),
(8, date_trunc('month', d - INTERVAL 3 MONTH), date_trunc('month', d - INTERVAL 3 MONTH) + INTERVAL 1 MONTH, 'month', 'temporal_summary', 'complex', 1, 4, 1.35, 1.05, 'month,week,day', ''),
(9, w - 2, w, 'broad', 'temporal_summary', 'complex', 1, 6, 1.05, 1.3, 'year,month,week,day', 'plan,plans,planning,going to,will'), (10, NULL, NULL, 'none', 'direct_fact', 'hybrid', 1, 5, 1.2, 1.15, 'week,day', 'doing,around,then'),
(11, NULL, NULL, 'none', 'direct_fact', 'simple', 1, 4, 1.0, 1.0, '', 'favourite,editor')"""


@query(f"""WITH e AS (SELECT event_id, ts, ts::DATE AS d, date_trunc('week', ts)::DATE AS w FROM events) SELECT event_id, strftime(p.s::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS starts, strftime(p.e::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS ends, granularity, kind, intent, hops::INT AS hops, candidates::INT AS candidates, row_weight::DOUBLE AS row_weight, summary_weight::DOUBLE AS summary_weight, layers, terms
FROM e, LATERAL (SELECT * FROM (VALUES {PLANS}) AS v(n, s, e, granularity, kind, intent, hops, candidates, row_weight, summary_weight, layers, terms) WHERE n = event_id % 12) p""")
def p1_planned_questions(spark, d):
    """A question for each event, asked when it happened: its time window, class, intent, limits and terms."""
    asked = read(spark, d, "events").withColumn("question", F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("event_id") % 12 + 1).cast("int")))
    made = planner.planned(asked, ["event_id"], "question", "ts")
    moment = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return made.select("event_id", moment("starts"), moment("ends"), "granularity", "kind", "intent", "hops", "candidates", "row_weight", "summary_weight", F.array_join("layers", ",").alias("layers"), F.array_join("terms", ",").alias("terms"))
