"""Queries of consolidation, projections, typed lanes, spans and names, each beside its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memlake.operators import consolidation, graph, identity, projections, spans
from memlake.plans.catalog import query, read, stamp
from memlake.session import shared_dir

# --- consolidation ----------------------------------------------------------------------------------------------------


def _candidates(spark, d):
    """What events say, as sentences of all eight families; some of them say nothing."""
    k, rest, high = F.get_json_object("props", "$.k").cast("long"), F.col("event_id") % 5, F.col("value") >= 20
    said = {
        "preference": F.concat(F.when(high, "I really like").otherwise("I no longer like"), F.lit(" option "), k % 10, F.lit(".")),
        "decision": F.concat(F.lit("We decided on set "), k % 4, F.lit(" for area "), k % 7),
        "goal": F.concat(F.lit("My main goal is to reach level "), k % 6, F.lit("!")),
        "belief": F.concat(F.lit("I think page "), k % 9, F.lit(" is "), F.when(high, "useful").otherwise("dull")),
        "constraint": F.concat(F.when(high, "Always").otherwise("Never"), F.lit(" open page "), k % 9),
        "skill": F.when(k % 4 == 0, "broken").otherwise(F.concat(F.lit("I know how to mend part "), k % 8)),
        "style": F.concat(F.lit("Write in lines of "), k % 5),
        "plan": F.concat(F.lit("I plan to retry step "), k % 6),
    }
    family = F.when(F.col("event_type") == "click", "preference").when(F.col("event_type") == "purchase", "decision").when(F.col("event_type") == "signup", "goal").when(F.col("event_type") == "view", "belief")
    family = family.when(rest < 2, "constraint").when(rest == 2, "skill").when(rest == 3, "style").otherwise("plan")
    content = F.lit(None)
    for name, text in said.items():
        content = F.when(F.col("family") == name, text).otherwise(content)
    return read(spark, d, "events").withColumn("family", family).withColumn("content", content).select("event_id", "user_id", "family", "content", "ts")


CANDIDATES = """e AS (SELECT *, (props::JSON ->> '$.k')::BIGINT AS k, value >= 20 AS high, event_id % 5 AS rest FROM events),
c AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'preference' WHEN 'purchase' THEN 'decision' WHEN 'signup' THEN 'goal' WHEN 'view' THEN 'belief' ELSE CASE WHEN rest < 2 THEN 'constraint' WHEN rest = 2 THEN 'skill' WHEN rest = 3 THEN 'style' ELSE 'plan' END END AS family, k, high FROM e),
m AS (SELECT event_id, user_id, ts, family, CASE family WHEN 'preference' THEN 'option ' || k % 10 WHEN 'decision' THEN 'area ' || k % 7 WHEN 'belief' THEN 'page ' || k % 9 WHEN 'constraint' THEN 'open page ' || k % 9 WHEN 'skill' THEN 'mend part ' || k % 8 WHEN 'style' THEN 'lines of ' || k % 5 ELSE 'current' END AS about,
  CASE family WHEN 'preference' THEN CASE WHEN high THEN 'like' ELSE 'dislike' END WHEN 'decision' THEN 'set ' || k % 4 WHEN 'goal' THEN 'reach level ' || k % 6 WHEN 'belief' THEN CASE WHEN high THEN 'useful' ELSE 'dull' END WHEN 'constraint' THEN CASE WHEN high THEN 'always' ELSE 'never' END WHEN 'plan' THEN 'retry step ' || k % 6 ELSE 'stated' END AS value
  FROM c WHERE NOT (family = 'skill' AND k % 4 = 0)),
l AS (SELECT *, family || ':' || about AS key, lag(value) OVER w AS before FROM m WINDOW w AS (PARTITION BY user_id, family, about ORDER BY ts, event_id)),
v AS (SELECT *, sum((before IS DISTINCT FROM value)::INT) OVER (PARTITION BY user_id, key ORDER BY ts, event_id)::INT AS version, before IS DISTINCT FROM value AS changed FROM l)"""


@query(f"""WITH {CANDIDATES}, g AS (SELECT user_id, key, version, any_value(value) AS value, min(ts) AS valid_from, count(*) - 1 AS confirmed FROM v GROUP BY 1, 2, 3)
SELECT user_id, key, version, value, confirmed, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(lead(valid_from) OVER w, '%Y-%m-%d %H:%M:%S') AS valid_until, CASE WHEN lead(valid_from) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status FROM g WINDOW w AS (PARTITION BY user_id, key ORDER BY version)""")
def k2_memories(spark, d):
    found = consolidation.consolidated(_candidates(spark, d), "user_id", "event_id", "family", "content", "ts")
    kept = consolidation.memories(found, "user_id", "ts")
    return kept.select("user_id", "key", "version", "value", "confirmed", stamp("valid_from").alias("valid_from"), stamp("valid_until").alias("valid_until"), "status")


@query(f"""WITH {CANDIDATES}, n AS (SELECT event_id, count(*) AS n, sum(changed::INT) AS promoted, sum((changed AND version > 1)::INT) AS superseded FROM v GROUP BY 1),
o AS (SELECT c.family, CASE WHEN n.n > 0 THEN 'accepted' ELSE 'rejected' END AS status, coalesce(promoted, 0) AS promoted, coalesce(superseded, 0) AS superseded FROM c LEFT JOIN n USING (event_id) UNION ALL SELECT 'belief', 'rejected', 0, 0 FROM conversations)
SELECT family, status, count(*) AS candidates, sum(promoted)::BIGINT AS promoted, sum(superseded)::BIGINT AS superseded FROM o GROUP BY 1, 2""")
def k2_outcomes(spark, d):
    """Candidates by family and outcome; turns of conversations stand in as beliefs, most of which state nothing."""
    turns = read(spark, d, "conversations").select((-1 - F.col("conv_id") * 100_000 - F.col("turn")).alias("event_id"), F.col("conv_id").alias("user_id"), F.lit("belief").alias("family"), F.col("text").alias("content"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    candidates = _candidates(spark, d).unionByName(turns)
    found = consolidation.consolidated(candidates, "user_id", "event_id", "family", "content", "ts")
    outcomes = consolidation.candidate_outcomes(candidates, found, "event_id").join(candidates.select("event_id", "family"), "event_id")
    return outcomes.groupBy("family", "status").agg(F.count(F.lit(1)).alias("candidates"), F.sum("promoted").alias("promoted"), F.sum("superseded").alias("superseded"))


# --- projections ------------------------------------------------------------------------------------------------------

REQUIRED = ("click", "purchase", "view")
BEFORE = "2024-01-30 12:00:00"


@query(f"""WITH h AS (SELECT user_id, count(*) AS support, max_by(event_id, struct_pack(a := ts, b := event_id)) AS latest, list_sort(list_intersect(list_distinct(list(event_type)), {list(REQUIRED)})) AS f, max(ts) >= TIMESTAMP '{BEFORE}' AS changed FROM events GROUP BY 1)
SELECT user_id, support, latest, array_to_string(f, ',') AS fulfilled, round(len(f) / 3, 4)::DOUBLE AS completeness, CASE WHEN len(f) = 3 THEN 'complete' WHEN len(f) > 0 THEN 'partial' ELSE 'missing' END AS truth, CASE WHEN changed THEN 2 ELSE 1 END::INT AS version FROM h""")
def k11_projection_rebuild(spark, d):
    """Heads by user, built over the events up to a moment and brought up to date: only users with newer events are built again."""
    events, path = read(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), f"{shared_dir(spark)}/projection-{uuid.uuid4().hex}"
    build = lambda facts: projections.report_heads(facts, "user_id", "event_type", "ts", "event_id", REQUIRED)
    projections.rebuild(events.filter(F.col("ts") < F.lit(BEFORE).cast("timestamp_ntz")), "user_id", build, path)
    projections.rebuild(events, "user_id", build, path)
    return projections.current(spark, path, "user_id").select("user_id", "support", "latest", "fulfilled", "completeness", "truth", "version")


# --- lanes, spans, names ----------------------------------------------------------------------------------------------


def _told(spark, d):
    """Turns of conversations, each with what its speaker tells besides; what is told follows from the turn's place."""
    c, t = F.col("conv_id") % 5, F.col("turn") % 10
    told = F.concat(
        F.col("text"), F.lit(" I love tea "), c, F.lit(". We watched Film "), F.col("turn"), F.lit("; Ann Lee called Bob on 2024-01-1"), t,
        F.when(t % 3 == 0, ", then visited Paris on 12 May 2024").otherwise(" and Cy lives in Rome since 2019"), F.lit("."),
    )
    return read(spark, d, "conversations").select("conv_id", "turn", "role", told.alias("told"))


TOLD = """s AS (SELECT conv_id, turn, length(text) AS n, ' I love tea ' || conv_id % 5 AS p1, '. We watched Film ' || turn AS p2, '; Ann Lee called Bob on 2024-01-1' || turn % 10 AS p3, CASE WHEN turn % 10 % 3 = 0 THEN ', then visited Paris on 12 May 2024' ELSE ' and Cy lives in Rome since 2019' END AS p4, turn % 10 % 3 = 0 AS trip, text FROM conversations),
o AS (SELECT *, n + length(p1) AS o2, n + length(p1) + length(p2) AS o3, n + length(p1) + length(p2) + length(p3) AS o4 FROM s)"""


@query(f"""WITH {TOLD} SELECT conv_id, turn, 'preference' AS lane, 'likes' AS predicate, NULL AS subject, 'tea ' || conv_id % 5 AS object, NULL AS time_hint, (n + 1)::INT AS starts, o2::INT AS ends FROM o
UNION ALL SELECT conv_id, turn, 'media', 'watched', NULL, 'Film ' || turn, NULL, (o2 + 5)::INT, o3::INT FROM o UNION ALL SELECT conv_id, turn, 'person_time', 'called', 'Ann Lee', 'Bob', '2024-01-1' || turn % 10, (o3 + 10)::INT, o4::INT FROM o
UNION ALL SELECT conv_id, turn, 'person_time', 'visited', NULL, 'Paris', '12 May 2024', (o4 + 7)::INT, (o4 + length(p4))::INT FROM o WHERE trip""")
def t26_typed_lanes(spark, d):
    return spans.typed_lanes(_told(spark, d), ["conv_id", "turn"], "told")


@query(rf"""WITH {TOLD}, f AS (SELECT *, text || p1 || p2 || p3 || p4 || '.' AS told FROM o), m AS (SELECT conv_id, turn, told, unnest(regexp_extract_all(told, '[^.!?
]+(?:[.!?]+|
|$)')) AS sentence FROM f)
SELECT conv_id, turn, 'turn' AS kind, told AS said, 1.0::DOUBLE AS sure FROM f UNION ALL SELECT conv_id, turn, 'sentence', trim(sentence, ' ' || chr(10) || chr(9) || chr(13)), 0.7 FROM m WHERE trim(sentence, ' ' || chr(10) || chr(9) || chr(13)) <> ''
UNION ALL SELECT conv_id, turn, 'date', '2024-01-1' || turn % 10, 0.78 FROM f UNION ALL SELECT conv_id, turn, 'date', CASE WHEN trip THEN '12 May 2024' ELSE '2019' END, 0.78 FROM f
UNION ALL SELECT conv_id, turn, CASE WHEN trip THEN 'event' ELSE 'fact' END, CASE WHEN trip THEN substr(p4, 3) ELSE substr(p3, 3) || p4 END, CASE WHEN trip THEN 0.76 ELSE 0.74 END FROM f""")
def t13_answerable_spans(spark, d):
    """Spans of five kinds, as the offsets cut them out of the text."""
    told = _told(spark, d)
    found = spans.answerable_spans(told, ["conv_id", "turn"], "told").join(told, ["conv_id", "turn"])
    return found.select("conv_id", "turn", "kind", F.expr("substring(told, starts + 1, ends - starts)").alias("said"), "sure")


def _names(spark, d):
    """Capitalised words of the conversations, as names with numbers that follow from their letters."""
    words = read(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{2,})"), F.lit(1))).alias("name")).distinct()
    return words.select("name", F.unhex(F.sha2(F.col("name").cast("binary"), 256)).alias("id"))


def _within(most: int) -> str:
    return f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{{2,}}')) AS name FROM conversations), n AS (SELECT sha256(name) AS id, lower(name) AS name FROM w)
SELECT a.name AS name_a, b.name AS name_b, levenshtein(a.name, b.name)::INT AS distance FROM n a JOIN n b ON a.id < b.id AND left(a.name, 1) = left(b.name, 1) AND abs(length(a.name) - length(b.name)) <= {most} WHERE levenshtein(a.name, b.name) <= {most}"""


@query(_within(2))
def e5_names_within_2(spark, d):
    return identity.names_within(_names(spark, d), "id", "name", 2).select("name_a", "name_b", "distance")


@query(_within(3))
def e5_names_within_3(spark, d):
    return identity.names_within(_names(spark, d), "id", "name", 3).select("name_a", "name_b", "distance")


# --- summaries --------------------------------------------------------------------------------------------------------

#: A graph of summaries: all, languages and sources, documents. Documents lie below both, sources below each language that
#: they have, and one source leads back to the top.
SUMMARIES = """x AS (SELECT 'all' AS parent, 'lang:' || lang AS child FROM documents UNION SELECT 'all', 'source:' || source FROM documents UNION SELECT 'lang:' || lang, 'source:' || source FROM documents
UNION SELECT 'lang:' || lang, 'doc:' || doc_id FROM documents UNION SELECT 'source:' || source, 'doc:' || doc_id FROM documents UNION SELECT 'source:' || min(source), 'all' FROM documents),
s AS (SELECT DISTINCT parent AS seed FROM x), r AS (SELECT seed, seed AS node, 0 AS distance FROM s UNION SELECT r.seed, x.child, distance + 1 FROM r JOIN x ON r.node = x.parent WHERE distance < 6),
m AS (SELECT seed, node, min(distance)::INT AS distance FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS nth FROM m WHERE distance > 0)"""


def _summaries(spark, d):
    docs = read(spark, d, "documents")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    top = F.lit("all")
    links = [(top, name("lang", "lang")), (top, name("source", "source")), (name("lang", "lang"), name("source", "source")), (name("lang", "lang"), name("doc", "doc_id")), (name("source", "source"), name("doc", "doc_id"))]
    edges = docs.groupBy().agg(F.concat(F.lit("source:"), F.min("source")).alias("parent")).withColumn("child", top)
    for parent, child in links:
        edges = edges.unionByName(docs.select(parent.alias("parent"), child.alias("child")))
    return edges.distinct()


@query(f"WITH RECURSIVE {SUMMARIES} SELECT seed, node, distance FROM k WHERE nth <= 100")
def r18_deep_read(spark, d):
    """What a read of each summary opens: nearest first, a hundred nodes, each once though several summaries lead to it."""
    edges = _summaries(spark, d)
    return graph.expand_down(edges, edges.select(F.col("parent").alias("seed")).distinct(), "parent", "child", 100)


@query(f"WITH RECURSIVE {SUMMARIES} SELECT seed, count(*) AS nodes, count(*) FILTER (WHERE starts_with(node, 'doc:')) AS windows, max(distance)::INT AS depth FROM k GROUP BY 1")
def r18_source_windows(spark, d):
    """How many nodes and source windows lie below each summary, and how deep, without a budget that cuts."""
    edges = _summaries(spark, d)
    below = graph.expand_down(edges, edges.select(F.col("parent").alias("seed")).distinct(), "parent", "child", 1 << 40)
    return below.groupBy("seed").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node").startswith("doc:")).alias("windows"), F.max("distance").alias("depth"))
