"""Queries of extraction units, pair binding, stored values, neighbourhoods and support rows, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import extract, lifecycle, lookup, text
from memlake.plans.catalog import query, read
from memlake.plans.catalog_text import SENTENCES
from memlake.plans.catalog_told import DOCUMENT

# --- extraction units -------------------------------------------------------------------------------------------------

#: From each unit's first sentence f: the first j that fills it, and the first that would pass the limit. c: running ends, with a blank each.
UNITS = f"""l AS (SELECT doc_id, {SENTENCES.format('text')} AS s FROM {{}}), p AS (SELECT doc_id, s, len(s) AS n, list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: length(x))) + i) AS c FROM l WHERE len(s) > 0),
u AS (SELECT *, least(coalesce(list_position(list_transform(c[f:], lambda x: x - base >= 1296), true) + f - 1, n), coalesce(f + list_position(list_transform(c[f + 1:], lambda x: x - base > 1800), true) - 1, n)) AS e FROM (SELECT *, 1::BIGINT AS f, 0 AS unit, 1::BIGINT AS base FROM p) UNION ALL
SELECT *, least(coalesce(list_position(list_transform(c[f:], lambda x: x - base >= 1296), true) + f - 1, n), coalesce(f + list_position(list_transform(c[f + 1:], lambda x: x - base > 1800), true) - 1, n)) AS e FROM (SELECT doc_id, s, n, c, g AS f, unit + 1 AS unit, c[g - 1] + 1 AS base FROM (SELECT *, greatest(e, f + 1) AS g FROM u) WHERE g <= n))"""


@query(f"WITH RECURSIVE {UNITS.format('documents')} SELECT doc_id, unit, (f - 1)::INT AS first_sentence, (e - 1)::INT AS last_sentence, (c[e] - base)::INT AS n_chars, CASE WHEN c[e] - base > 1800 THEN 'needs_split_review' ELSE 'ready' END AS status, sha256(array_to_string(s[f:e], ' ')) AS digest FROM u")
def t27_extraction_units(spark, d):
    units = text.extraction_units(read(spark, d, "documents"), "doc_id")
    return units.withColumn("digest", F.sha2(F.col("content").cast("binary"), 256)).drop("content")


FAMILIES = " UNION ".join(f"SELECT doc_id, unit, '{name}' AS family, trim(unnest(regexp_extract_all(content, '{pattern}', 1))) AS statement FROM t" for name, pattern in extract.STATEMENTS.items())


@query(f"WITH RECURSIVE d AS (SELECT doc_id, {DOCUMENT} AS text FROM documents), {UNITS.format('d')}, t AS (SELECT doc_id, unit, array_to_string(s[f:e], ' ') AS content FROM u) {FAMILIES}")
def t27_unit_facts(spark, d):
    """Statements of each unit, so that a fact names the unit that it was read in."""
    told = read(spark, d, "documents").withColumn("text", F.expr(DOCUMENT))
    units = text.extraction_units(told, "doc_id").withColumn("at", F.struct("doc_id", "unit"))
    return extract.statements(units, "at", "content").select("at.doc_id", "at.unit", "family", "statement")


# --- names ------------------------------------------------------------------------------------------------------------


def _entities(spark, d):
    """Nations under a name each, a short alias each, and the names of their regions, which several nations share."""
    n, letter = read(spark, d, "nation"), F.expr("char(97 + n_nationkey)")
    names = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("N"), letter).alias("name"))
    own = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Z"), letter).alias("alias"))
    shared = n.join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.expr("initcap(substring_index(r_name, ' ', 1))").alias("alias"))
    return names, own.union(shared)


QUESTION = """CASE turn % 6 WHEN 0 THEN 'did N' || chr((97 + conv_id % 25)::INT) || ' meet Z' || chr((97 + turn % 26)::INT) || '?' WHEN 1 THEN 'was N' || chr((97 + conv_id % 25)::INT) || ' in Africa?' WHEN 2 THEN 'what of Z' || chr((97 + conv_id % 26)::INT) || ' or Z' || chr((97 + conv_id % 26)::INT) || '?'
WHEN 3 THEN 'nothing here' WHEN 4 THEN 'did Xx meet Asia?' ELSE 'did Yy meet N' || chr((97 + conv_id % 25)::INT) || '?' END"""
ENTITIES = """k AS (SELECT 'n' || chr((97 + n_nationkey)::INT) AS k, 0 AS rank, n_nationkey AS id FROM nation UNION ALL SELECT 'z' || chr((97 + n_nationkey)::INT), 1, n_nationkey FROM nation UNION ALL SELECT lower(split_part(r_name, ' ', 1)), 1, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT k, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM (SELECT *, min(rank) OVER (PARTITION BY k) AS least FROM k) WHERE rank = least GROUP BY 1)"""


@query(f"""WITH {ENTITIES}, q AS (SELECT conv_id, turn, list_distinct(regexp_extract_all({QUESTION}, '\\b[A-Z][a-z]+\\b')) AS m, regexp_extract_all({QUESTION}, '\\b[A-Z][a-z]+\\b') AS w FROM conversations),
b AS (SELECT conv_id, turn, len(m) AS n, x.id AS primary_id, y.id AS pair_id FROM q LEFT JOIN r x ON lower(w[1]) = x.k LEFT JOIN r y ON len(m) > 1 AND lower(w[2]) = y.k)
SELECT conv_id, turn, n >= 2 AS required, primary_id IS NOT NULL AND (n < 2 OR pair_id IS NOT NULL) AS verified, primary_id, pair_id, CASE WHEN n = 0 THEN 'no_subject_name' WHEN n = 1 AND primary_id IS NOT NULL THEN 'single_subject_resolved' WHEN n = 1 THEN 'single_subject_unresolved' WHEN primary_id IS NOT NULL AND pair_id IS NOT NULL THEN 'pair_subjects_resolved' WHEN primary_id IS NOT NULL THEN 'pair_counterpart_unresolved' WHEN pair_id IS NOT NULL THEN 'pair_primary_unresolved' ELSE 'pair_subjects_unresolved' END AS reason FROM b""")
def m16_pair_subjects(spark, d):
    """Whether the two nations that a turn asks about are known, by name or by an alias of one alone."""
    asked = read(spark, d, "conversations").withColumn("asked", F.expr(QUESTION.replace("::INT", "").replace("chr(", "char(")))
    return lookup.pair_binding(asked, *_entities(spark, d), ["conv_id", "turn"], "asked")


MOMENT = "2024-01-15 00:00:00"


@query(f"""WITH v AS (SELECT user_id AS id, event_type AS predicate, (props::JSON ->> '$.k')::BIGINT % 6 AS value, ts, event_id FROM events), g AS (SELECT *, lag(value) OVER w AS was FROM v WINDOW w AS (PARTITION BY id, predicate ORDER BY ts, event_id)),
f AS (SELECT id, predicate, value, ts AS valid_from, lead(ts) OVER (PARTITION BY id, predicate ORDER BY ts, event_id) AS valid_until FROM g WHERE value IS DISTINCT FROM was), u AS (SELECT DISTINCT user_id AS id FROM events),
a AS (SELECT 4 * id AS q, id, NULL AS b, 'current' AS kind, 'click' AS predicate, 'exact' AS binding FROM u UNION ALL SELECT 4 * id + 1, id, NULL, 'temporal', 'view', 'alias' FROM u UNION ALL SELECT 4 * u.id + 2, u.id, o.id, CASE WHEN o.id IS NULL THEN 'abstention' ELSE 'set' END, 'error', CASE WHEN o.id IS NULL THEN 'unknown' ELSE 'exact' END FROM u LEFT JOIN u o ON o.id = u.id + 1
UNION ALL SELECT 4 * id + 3, NULL, NULL, 'abstention', 'click', 'ambiguous' FROM u),
s AS (SELECT q, f.value, row_number() OVER (PARTITION BY q ORDER BY valid_from DESC, f.value) AS nth FROM a JOIN f USING (id, predicate) WHERE (kind = 'current' AND valid_until IS NULL) OR (kind = 'temporal' AND valid_from <= TIMESTAMP '{MOMENT}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{MOMENT}'))),
h AS (SELECT q, string_agg(x.value::VARCHAR, ',' ORDER BY x.value) AS value FROM a JOIN (SELECT DISTINCT id, predicate, value FROM f) x ON a.id = x.id AND a.predicate = x.predicate JOIN (SELECT DISTINCT id, predicate, value FROM f) y ON a.b = y.id AND y.predicate = x.predicate AND y.value = x.value WHERE kind = 'set' GROUP BY 1)
SELECT a.q, kind, binding, coalesce(s.value::VARCHAR, h.value) AS value FROM a LEFT JOIN s ON a.q = s.q AND nth = 1 LEFT JOIN h ON a.q = h.q""")
def r21_canonical_lookup(spark, d):
    """Four questions about each user: a value that holds (by name), one that held (by alias), a set shared with the next user, and a name that many users share."""
    events = read(spark, d, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("predicate"), (F.get_json_object("props", "$.k").cast("long") % 6).alias("value"))
    own = lifecycle.versions(events.withColumn("of", F.struct("user_id", "predicate")), "of", "value", "ts", "event_id")
    facts = own.select(F.col("of.user_id").alias("id"), "of.predicate", "value", "valid_from", "valid_until")
    users = events.select(F.col("user_id").alias("id")).distinct()
    named = lambda prefix, c=F.col("id"): F.concat(F.lit(prefix), c.cast("string"))
    entities, aliases = users.select("id", named("User ").alias("name")), users.select("id", named("u").alias("alias")).union(users.select("id", F.lit("someone")))
    none, moment = F.lit(None).cast("string"), F.lit(MOMENT).cast("timestamp_ntz")
    ask = lambda n, subject, other, predicate, at: users.select((4 * F.col("id") + n).alias("q"), subject.alias("subject"), other.alias("other"), F.lit(predicate).alias("predicate"), at.cast("timestamp_ntz").alias("at"))
    asked = ask(0, named("user "), none, "click", none).union(ask(1, named("U"), none, "view", moment)).union(ask(2, named("User "), named("User ", F.col("id") + 1), "error", none)).union(ask(3, F.lit("Someone"), none, "click", none))
    return lookup.canonical_lookup(asked, entities, aliases, facts, "q")


# --- neighbourhoods, support ------------------------------------------------------------------------------------------

SURE = "CASE role WHEN 'user' THEN 0.95 WHEN 'assistant' THEN 0.72 ELSE 0.35 END"


@query(f"""WITH u AS (SELECT conv_id * 1000 + turn AS unit, conv_id, role, length(text) % 97 AS chunk, turn, {SURE} AS sure FROM conversations), s AS (SELECT conv_id % 10 AS q, unit FROM u WHERE turn = 0),
o AS (SELECT q, s.unit, conv_id, chunk FROM s JOIN u USING (unit)), m AS (SELECT q, u.unit FROM o JOIN u ON o.conv_id = u.conv_id UNION SELECT q, u.unit FROM o JOIN u ON o.chunk = u.chunk)
SELECT q, unit, rank FROM (SELECT q, m.unit, row_number() OVER (PARTITION BY q ORDER BY sure DESC, turn DESC NULLS LAST, m.unit)::INT AS rank FROM m JOIN u USING (unit) WHERE (q, m.unit) NOT IN (SELECT q, unit FROM s)) WHERE rank <= 25""")
def r12_neighbourhood(spark, d):
    """Around the opening turns of each tenth of the conversations: turns of the same conversation or chunk, the surest and latest first."""
    units = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit"), "conv_id", (F.length("text") % 97).alias("chunk"), "turn", F.expr(SURE).alias("sure"))
    seeds = units.filter("turn = 0").select((F.col("conv_id") % 10).alias("q"), "unit")
    found = lookup.neighbourhood(units, seeds, "q", "unit", ["conv_id", "chunk"], [F.desc("sure"), F.desc_nulls_last("turn"), F.asc("unit")], 25)
    return found.select("q", "unit", "rank")


#: Terms, weighted patterns and what a row must match, by loader.
LOADERS = {
    "profile": (["that", "this", "from"], [(r"(?i)\b(?:and|with) the\b", 2.2), (r"[A-Z][a-z]+\.", 0.4)], None),
    "relationship": (["with", "and", "her"], [(r"(?i)\b(?:he|she|they)\b", 1.6), (r"(?i)\bher\b", 2.5)], r"(?i)\bthe\b"),
    "exact_detail": (["of", "in"], [(r"[0-9]{2,}", 3.0), (r"(?i)\bthe (?:and|of)\b", 1.0)], r"[0-9A-Z]"),
}


def _support_sql(name: str) -> str:
    terms, rules, needs = LOADERS[name]
    found = " + ".join(f"contains(lower(text), '{t}')::INT" for t in terms)
    weight = " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END" for p, w in rules)
    must = f" AND regexp_matches(text, '{needs}')" if needs else ""
    return f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, text, turn AS seen, 0 AS tier, 2.0 AS base FROM conversations UNION ALL SELECT doc_id, text, n_chars, 1, 1.8 FROM documents), m AS (SELECT *, {found} AS terms, {weight} AS weight FROM t),
b AS (SELECT id, tier, seen, round((terms + weight + base)::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY round((terms + weight + base)::DOUBLE, 6) DESC, tier) AS nth FROM m WHERE terms > 0{must}) SELECT id, tier, score FROM b WHERE nth = 1 ORDER BY score DESC, seen DESC, id LIMIT 60"""


def _support(spark, d, name: str):
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.col("turn").alias("at"))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("at"))
    terms, rules, needs = LOADERS[name]
    return lookup.focused_support([(turns, 2.0), (docs, 1.8)], "id", "text", "at", terms, rules, needs, 60)


@query(_support_sql("profile"))
def r13_profile_support(spark, d):
    return _support(spark, d, "profile")


@query(_support_sql("relationship"))
def r13_relationship_support(spark, d):
    return _support(spark, d, "relationship")


@query(_support_sql("exact_detail"))
def r13_exact_detail_support(spark, d):
    return _support(spark, d, "exact_detail")
