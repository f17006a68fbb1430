"""Queries of extraction rules, read models and the remaining joins and aggregations, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import scalar
from memlake.operators import evaluation, extract, graph, identity, lifecycle, readmodels, relational, retrieval, temporal, text
from memlake.plans.catalog import query, read, stamp
from memlake.plans.catalog_text import SENTENCES, SUPPLY, _hierarchy, _supply

# --- extraction -------------------------------------------------------------------------------------------------------


@query(r"""WITH d AS (SELECT conv_id, '# turn ' || turn || chr(10) || text AS md FROM conversations), j AS (SELECT conv_id, string_agg(md, chr(10) ORDER BY md) AS text FROM d GROUP BY 1)
SELECT conv_id, count(*) AS n_sections FROM (SELECT conv_id, unnest(regexp_extract_all(text, '(?m)^(#{1,6} )', 1)) AS h FROM j) GROUP BY 1""")
def t6_markdown_sections(spark, d):
    c = read(spark, d, "conversations").select("conv_id", F.concat(F.lit("# turn "), F.col("turn").cast("string"), F.lit("\n"), F.col("text")).alias("md"))
    joined = c.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("md")), "\n").alias("text"))
    found = extract.sections(joined, "conv_id").filter("level > 0")
    return found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_sections"))


@query(r"""WITH l AS (SELECT conv_id, turn, role, text FROM conversations WHERE length(text) > 0 AND regexp_matches(split_part(text, chr(10), 1), '^\S')) SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS nth, upper(left(role, 1)) || substr(role, 2) AS speaker FROM l""")
def t8_speaker_turns(spark, d):
    c = read(spark, d, "conversations").filter(F.length("text") > 0).filter(F.split("text", "\n")[0].rlike(r"^\S"))
    line = F.concat(F.initcap("role"), F.lit(": "), F.split("text", "\n")[0])
    scripts = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x.line), "\n").alias("text"))
    return extract.speaker_turns(scripts, "conv_id").select("conv_id", F.col("turn").alias("nth"), "speaker")


@query(rf"""WITH s AS (SELECT conv_id, turn, role, text, {SENTENCES.format('text')} AS s FROM conversations), u AS (SELECT conv_id, turn, 'turn' AS kind, 0 AS nth, text AS content FROM s UNION ALL SELECT conv_id, turn, 'sentence', unnest(range(0, len(s))), unnest(s) FROM s WHERE len(s) > 1)
SELECT conv_id, turn, kind, nth::INT AS nth, CASE WHEN len(list_distinct(regexp_extract_all(content, '(\b[A-Z][a-z]+\b)', 1))) > 1 THEN 0.82 ELSE 0.95 END::DOUBLE AS ownership FROM u""")
def t13_answerable_units(spark, d):
    return extract.answerable_units(read(spark, d, "conversations"), "conv_id", "turn", "role", "text").drop("speaker", "content")


@query(r"""WITH i AS (SELECT o_orderkey, 'due ' || strftime(o_orderdate, '%Y-%m-%d') || ' or ' || strftime(o_orderdate + INTERVAL 1 DAY, '%B %-d, %Y') AS note, o_orderdate FROM orders) SELECT o_orderkey, strftime(unnest([o_orderdate, o_orderdate + INTERVAL 1 DAY]), '%Y-%m-%d') AS day FROM i""")
def t15_explicit_dates(spark, d):
    o = read(spark, d, "orders")
    following = F.date_add(F.to_date("o_orderdate"), 1)
    note = F.concat(F.lit("due "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" or "), F.date_format(following, "MMMM d, yyyy"))
    return extract.explicit_dates(o.withColumn("note", note), "o_orderkey", "note").select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(r"""SELECT DISTINCT doc_id, kind, name FROM (SELECT doc_id, 'person' AS kind, unnest(regexp_extract_all(text, '\b(?:with|met|by|from) ([A-Z][a-z]+)\b', 1)) AS name FROM documents UNION ALL SELECT doc_id, 'place', unnest(regexp_extract_all(text, '\b(?:in|at|to) ([A-Z][a-z]+)\b', 1)) FROM documents UNION ALL SELECT doc_id, 'project', unnest(regexp_extract_all(text, '\b(?:project|repo|on) ([A-Z][A-Za-z0-9]+)\b', 1)) FROM documents)""")
def t21_mentions(spark, d):
    return extract.mentions(read(spark, d, "documents"), "doc_id")


@query("""WITH m AS (SELECT doc_id, 'place' AS kind, 'P' || (doc_id % 7) AS name FROM documents UNION ALL SELECT doc_id, 'person', 'Q' || (doc_id % 3) FROM documents) SELECT source AS subject, CASE kind WHEN 'place' THEN 'visited' ELSE 'with' END AS predicate, name AS object, max(CASE kind WHEN 'place' THEN 0.74 ELSE 0.82 END)::DOUBLE AS confidence, count(DISTINCT doc_id) AS n_documents FROM documents JOIN m USING (doc_id) GROUP BY 1, 2, 3""")
def t22_rule_edges(spark, d):
    docs = read(spark, d, "documents")
    one = lambda kind, letter, n: docs.select("doc_id", F.lit(kind).alias("kind"), F.concat(F.lit(letter), (F.col("doc_id") % n).cast("string")).alias("name"))
    return extract.rule_edges(docs.select("doc_id", F.col("source").alias("subject")), one("place", "P", 7).unionByName(one("person", "Q", 3)), "doc_id")


@query(rf"""WITH s AS (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents), u AS (SELECT doc_id, s, unnest(range(1, greatest(1, len(s) - 1) + 1, 3)) AS i FROM s WHERE len(s) > 0) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS unit, len(list_slice(s, i, i + 3))::INT AS n_sentences FROM u""")
def t27_overlap_units(spark, d):
    return extract.overlap_units(read(spark, d, "documents"), "doc_id").drop("content")


@query("""WITH a AS (SELECT lower(c_mktsegment) AS alias, c_mktsegment AS canonical FROM customer WHERE c_mktsegment < 'F' UNION SELECT 'user', 'Customer' UNION SELECT 'system', 'Host' UNION SELECT 'system', 'Machine'), k AS (SELECT alias, count(DISTINCT canonical) AS n, min(canonical) AS c FROM a GROUP BY 1) SELECT conv_id, turn, CASE WHEN n = 1 THEN c ELSE lower(trim(role)) END AS speaker, coalesce(n > 1, false) AS ambiguous FROM conversations LEFT JOIN k ON lower(trim(role)) = alias""")
def t29_canonical_speakers(spark, d):
    aliases = read(spark, d, "customer").filter("c_mktsegment < 'F'").select(F.lower("c_mktsegment").alias("alias"), F.col("c_mktsegment").alias("canonical")).distinct()
    more = spark.createDataFrame([("user", "Customer"), ("system", "Host"), ("system", "Machine")], "alias string, canonical string")
    return identity.canonical_speakers(read(spark, d, "conversations"), aliases.unionByName(more), "role").select("conv_id", "turn", "speaker", "ambiguous")


STATEMENTS = " UNION ".join(f"SELECT doc_id, '{name}' AS family, trim(unnest(regexp_extract_all(text, '{pattern}', 1))) AS statement FROM documents" for name, pattern in extract.STATEMENTS.items())


@query(STATEMENTS)
def t25_statements(spark, d):
    return extract.statements(read(spark, d, "documents"), "doc_id")


@query(rf"""WITH RECURSIVE s AS (SELECT doc_id, list_transform({SENTENCES.format('text')}, lambda x: length(x)) AS ls FROM documents),
c AS (SELECT doc_id, ls, 0 AS i, 0 AS unit, 0 AS first, 0::BIGINT AS size, false AS over, 0 AS u1, 0 AS f1, 0::BIGINT AS s1, false AS fills, 0 AS u2, 0 AS f2, 0::BIGINT AS s2 FROM s WHERE len(ls) > 0 UNION ALL
SELECT doc_id, ls, i + 1, u2 + fills::INT, CASE WHEN fills THEN i + 1 ELSE f2 END, CASE WHEN fills THEN 0 ELSE s2 END, over, unit, first, size, fills, u2, f2, s2
FROM (SELECT *, s2 >= 1296 AS fills FROM (SELECT doc_id, ls, i, unit, first, size, over, unit + over::INT AS u2, CASE WHEN over THEN i ELSE first END AS f2, CASE WHEN over THEN ls[i + 1] ELSE grown END AS s2
FROM (SELECT *, size > 0 AND grown > 1800 AS over FROM (SELECT doc_id, ls, i, unit, first, size, size + (size > 0)::INT + ls[i + 1] AS grown FROM c WHERE i < len(ls)))))),
e AS (SELECT doc_id, u1 AS unit, f1 AS first_sentence, i - 2 AS last_sentence, s1 AS n_chars FROM c WHERE over UNION ALL SELECT doc_id, u2, f2, i - 1, s2 FROM c WHERE fills UNION ALL SELECT doc_id, unit, first, len(ls) - 1, size FROM c WHERE i = len(ls) AND size > 0)
SELECT doc_id, unit, first_sentence, last_sentence::INT AS last_sentence, n_chars::INT AS n_chars FROM e""")
def m25_packed_units(spark, d):
    return text.pack_sentences(read(spark, d, "documents"), "doc_id")


# --- remaining joins, aggregations, windows, limits -------------------------------------------------------------------


@query("SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id) AS latest FROM events QUALIFY event_type = 'purchase' AND event_id = max(event_id) OVER (PARTITION BY user_id)")
def f1_current_rows(spark, d):
    e = read(spark, d, "events").withColumn("latest", F.max("event_id").over(Window.partitionBy("user_id")))
    return e.filter("event_type = 'purchase' and event_id = latest").select("user_id", "event_id", "latest")


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS t FROM documents) SELECT doc_id, len(t)::INT AS n_terms, list_has_any(t, ['license', 'copyright']) AS legal FROM t""")
def f5_array_predicates(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.array_distinct(scalar.tokens(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_terms"), F.arrays_overlap("t", F.array(F.lit("license"), F.lit("copyright"))).alias("legal"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS s, (o_orderdate + INTERVAL 3 DAY)::DATE AS e FROM orders), m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS ms FROM orders) SELECT o_orderkey AS node_id, (SELECT strftime(ms, '%Y-%m') FROM m WHERE ms <= s AND last_day(ms) >= e LIMIT 1) AS parent_id FROM o""")
def j8_interval_containment(spark, d):
    o = read(spark, d, "orders")
    inner = o.select(F.col("o_orderkey").alias("node_id"), F.to_date("o_orderdate").alias("start_day"), F.date_add(F.to_date("o_orderdate"), 3).alias("end_day"), F.lit(1).alias("k"))
    month = o.select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("start_day")).distinct()
    outer = month.select(F.date_format("start_day", "yyyy-MM").alias("node_id"), "start_day", F.last_day("start_day").alias("end_day"), F.lit(1).alias("k"))
    return relational.container_of(inner, outer, ["k"], 31).select("node_id", "parent_id")


@query("SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above FROM orders")
def j11_query_state(spark, d):
    o = read(spark, d, "orders")
    state = o.agg(F.avg("o_totalprice").alias("mean"))
    return o.crossJoin(F.broadcast(state)).select("o_orderkey", (F.col("o_totalprice") > F.col("mean")).alias("above"))


@query("SELECT s_suppkey, pos::BIGINT AS pos FROM (SELECT unnest([7, 3, 9, 1]) AS s_suppkey, unnest(range(0, 4)) AS pos) JOIN supplier USING (s_suppkey)")
def j13_value_order(spark, d):
    wanted = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (7, 3, 9, 1)))).alias("pos", "s_suppkey"))
    return read(spark, d, "supplier").join(F.broadcast(wanted), "s_suppkey").select("s_suppkey", F.col("pos").cast("long").alias("pos"))


@query("WITH m AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 5 = 0 AND c_custkey > 0 THEN c_custkey - 5 END AS merged FROM customer) SELECT coalesce(merged, node) AS canonical, count(*) AS n FROM orders JOIN m ON o_custkey = node GROUP BY 1")
def j14_redirect_join(spark, d):
    m = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when((F.col("c_custkey") % 5 == 0) & (F.col("c_custkey") > 0), F.col("c_custkey") - 5).alias("merged"))
    return read(spark, d, "orders").join(m, "o_custkey").groupBy(F.coalesce("merged", "o_custkey").alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SUPPLY} SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e")
def j16_mirrored(spark, d):
    return relational.mirrored(_supply(spark, d))


@query("SELECT (props::JSON ->> '$.k')::BIGINT % 10 AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def j17_json_fields(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, d, "events").groupBy((k % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT sha256(text) AS digest, count(DISTINCT lang) AS langs FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def a7_conflicts(spark, d):
    docs = read(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("n"))
    return docs.filter("n > 1").drop("n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def a8_top_groups(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("""WITH p AS (SELECT user_id, event_type, count(DISTINCT date_trunc('week', ts)) AS weeks, count(DISTINCT (props::JSON ->> '$.k')) AS sources FROM events GROUP BY 1, 2) SELECT user_id, event_type, weeks, sources FROM p WHERE weeks >= 3 AND sources >= 5""")
def a14_promotion(spark, d):
    e = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.countDistinct(F.date_trunc("week", "ts")).alias("weeks"), F.countDistinct(F.get_json_object("props", "$.k")).alias("sources"))
    return e.filter("weeks >= 3 and sources >= 5")


@query("SELECT doc_id, list_sum(list_transform(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda x: length(x)))::BIGINT AS n FROM documents")
def a15_array_sum(spark, d):
    return read(spark, d, "documents").select("doc_id", F.aggregate(scalar.tokens(F.col("text")), F.lit(None).cast("long"), lambda s, x: F.coalesce(s, F.lit(0)) + F.length(x)).alias("n"))


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer ORDER BY segment DESC NULLS LAST, c_acctbal DESC, c_custkey LIMIT 40")
def l1_sort_nulls_last(spark, d):
    c = read(spark, d, "customer").withColumn("segment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    return c.orderBy(F.desc_nulls_last("segment"), F.desc("c_acctbal"), "c_custkey").limit(40).select("c_custkey", "c_acctbal", "segment")


@query("""WITH c AS (SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200) SELECT o_orderkey FROM c ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def l3_fetch_then_rank(spark, d):
    recent = read(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200)
    return recent.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey")


@query("""SELECT DISTINCT coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_chars // 100 AS bucket FROM documents""")
def u5_null_safe_keys(spark, d):
    docs = read(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.floor(F.col("n_chars") / 100).alias("bucket"))
    return docs.dropDuplicates()


# --- retrieval and read models ----------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, source, list_has_any(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), ['the']) AS one, list_has_any(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), ['and']) AS two FROM documents) SELECT doc_id, CASE WHEN source = 'src1' THEN 1 WHEN one AND two THEN 0.85 WHEN one OR two THEN 0.55 ELSE 0 END::DOUBLE AS binding FROM t""")
def r10_subject_binding(spark, d):
    t = read(spark, d, "documents").withColumn("t", scalar.tokens(F.col("text")))
    n = F.array_contains("t", "the").cast("int") + F.array_contains("t", "and").cast("int")
    return t.select("doc_id", readmodels.subject_binding(F.col("source") == "src1", n, F.lit(2)).alias("binding"))


@query("""SELECT conv_id, turn, round(length(text) / 1000.0 + CASE WHEN turn % 3 = 0 THEN 1.2 WHEN turn % 3 = 1 THEN 1.05 ELSE 0.82 END + 0.95 + CASE role WHEN 'user' THEN 1.45 WHEN 'assistant' THEN 0.2 ELSE -1.2 END + 0.1 + 0, 4)::DOUBLE AS score FROM conversations""")
def r11_unit_score(spark, d):
    c = read(spark, d, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "turn").when(F.col("turn") % 3 == 1, "sentence").otherwise("fact_span")
    subject = F.when(F.col("role") == "user", "same").when(F.col("role") == "assistant", "possible").otherwise("other")
    score = readmodels.unit_score(F.length("text") / 1000.0, kind, F.lit(0.95), subject, F.lit(0.1), F.lit(0.0))
    return c.select("conv_id", "turn", F.round(score, 4).alias("score"))


@query("SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def r14_windowed_read(spark, d):
    return readmodels.windowed(read(spark, d, "events"), "ts", "2024-01-05", "2024-01-06").select("event_id", "event_type", stamp("ts").alias("at_ts"))


@query("""SELECT tier, subject, id FROM (SELECT 'order' AS tier, o_custkey AS subject, o_orderkey AS id FROM orders UNION ALL SELECT 'event', user_id, event_id FROM events) WHERE subject = 7""")
def r16_subject_rows(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("id"))
    e = read(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("id"))
    return readmodels.subject_rows({"order": o, "event": e}, "subject", 7).select("tier", "subject", "id")


@query("""SELECT event_id, round(CASE event_type WHEN 'purchase' THEN 0.55 WHEN 'signup' THEN 0.5 ELSE 0.45 END + 0.35 * (value / 100) + 0.08 * (event_id % 4), 8)::DOUBLE AS score FROM events""")
def r17_session_log_score(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "decision").when(F.col("event_type") == "signup", "summary").otherwise("event")
    return read(spark, d, "events").select("event_id", F.round(readmodels.session_log_score(kind, F.col("value") / 100, F.col("event_id") % 4), 8).alias("score"))


@query("""WITH b AS (SELECT layer, date_trunc(layer, ts)::DATE AS s, count(*) AS n FROM events, (SELECT unnest(['day', 'week', 'month', 'year']) AS layer) GROUP BY 1, 2),
n AS (SELECT layer || ':' || strftime(s, '%Y-%m-%d') AS node_id, layer, n AS n_events, s, CASE layer WHEN 'day' THEN s WHEN 'week' THEN (s + INTERVAL 6 DAY)::DATE WHEN 'month' THEN last_day(s) ELSE make_date(year(s), 12, 31) END AS e, CASE layer WHEN 'day' THEN 'week' WHEN 'week' THEN 'month' WHEN 'month' THEN 'year' END AS up FROM b),
p AS (SELECT n.*, (SELECT q.node_id FROM n q WHERE q.layer = n.up AND q.s <= n.s AND q.e >= n.e ORDER BY q.s DESC, q.e, q.node_id LIMIT 1) AS parent_id FROM n),
y AS (SELECT * FROM p WHERE layer = 'year' ORDER BY n_events DESC, node_id LIMIT 1), m AS (SELECT * FROM p WHERE layer = 'month' AND parent_id IN (SELECT node_id FROM y) ORDER BY n_events DESC, node_id LIMIT 2), ym AS (SELECT * FROM y UNION ALL SELECT * FROM m),
w AS (SELECT * FROM p WHERE layer = 'week' AND parent_id IN (SELECT node_id FROM m) AND (SELECT count(*) FROM ym) < 8 ORDER BY n_events DESC, node_id LIMIT 3), ymw AS (SELECT * FROM ym UNION ALL SELECT * FROM w),
d AS (SELECT * FROM p WHERE layer = 'day' AND parent_id IN (SELECT node_id FROM w) AND (SELECT count(*) FROM ymw) < 8 ORDER BY n_events DESC, node_id LIMIT 4) SELECT node_id, layer, n_events FROM ymw UNION ALL SELECT node_id, layer, n_events FROM d""")
def r19_summary_descent(spark, d):
    e = read(spark, d, "events")
    tree = temporal.nodes(e, "ts")
    sizes = temporal.rollup(e, "ts", "user_id", "event_type").select(F.concat_ws(":", "layer", F.date_format("bucket", "yyyy-MM-dd")).alias("node_id"), "n_events")
    links = temporal.parent_links(tree)
    out = readmodels.summary_descent(tree.join(sizes, "node_id"), links, ("year", "month", "week", "day"), {"year": 1, "month": 2, "week": 3, "day": 4}, 8, "n_events")
    return out.select("node_id", "layer", "n_events")


@query("""WITH s AS (SELECT doc_id, (text LIKE '%the%')::INT + (text LIKE '%que%')::INT AS support, (text LIKE '%!!%')::INT AS against FROM documents) SELECT doc_id, CASE WHEN against > 0 THEN 'contradicted' WHEN support >= 2 THEN 'supported' WHEN support = 1 THEN 'weak' ELSE 'missing' END AS grade FROM s""")
def r23_confidence_grade(spark, d):
    has = lambda s: F.col("text").contains(s).cast("int")
    return read(spark, d, "documents").select("doc_id", readmodels.confidence_grade(has("the") + has("que"), has("!!")).alias("grade"))


@query("""SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3 ORDER BY n_chars DESC, doc_id LIMIT 20""")
def r24_merged_tenants(spark, d):
    return readmodels.merged_tenants(read(spark, d, "documents"), "source", [F.desc("n_chars"), F.asc("doc_id")], 3, 20).select("source", "doc_id", "n_chars")


@query("""WITH e AS (SELECT *, coalesce(CASE WHEN event_type = 'purchase' THEN ts END, CASE WHEN event_type = 'view' THEN ts - INTERVAL 1 DAY END, ts - INTERVAL 2 DAY) AS eff FROM events) SELECT user_id, event_type, strftime(eff, '%Y-%m-%d %H:%M:%S') AS effective_at, n AS n_states FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY eff DESC, event_id) AS rn FROM e) WHERE rn = 1""")
def m1_task_states(spark, d):
    e = read(spark, d, "events")
    back = lambda kind, days: F.when(F.col("event_type") == kind, F.col("ts") - F.make_dt_interval(F.lit(days)))
    ts = F.coalesce(F.when(F.col("event_type") == "purchase", F.col("ts")), back("view", 1), F.col("ts") - F.make_dt_interval(F.lit(2)))
    return readmodels.task_states(e, "user_id", ts, "event_type", "event_id").withColumn("effective_at", stamp("effective_at"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events WHERE (props::JSON ->> '$.k') IS NOT NULL AND (props::JSON ->> '$.k')::INT BETWEEN 10 AND 20""")
def m2_json_span(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").filter(k.isNotNull() & k.between(10, 20)).select("event_id", k.alias("k"))


@query("""SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, source DESC, doc_id DESC) AS rn FROM (SELECT max(n_chars) AS n_chars, lang, source, max(doc_id) AS doc_id FROM documents GROUP BY lang, source)) WHERE rn = 1""")
def m3_latest_source(spark, d):
    g = read(spark, d, "documents").groupBy("lang", "source").agg(F.max("n_chars").alias("n_chars"), F.max("doc_id").alias("doc_id"))
    return readmodels.latest_source(g, "lang", F.col("n_chars"), "source").select("lang", "source", "doc_id")


@query(r"""SELECT doc_id FROM documents WHERE length(text) BETWEEN 8 AND 2400 AND regexp_matches(text, '[0-9]{3}') ORDER BY regexp_matches(text, '@') DESC, regexp_matches(text, '(?i)(?:^|[^a-z])(?:i|my|je|ich|yo)(?:[^a-z]|$)') DESC, doc_id LIMIT 80""")
def m7_exact_detail(spark, d):
    return readmodels.exact_detail(read(spark, d, "documents"), "doc_id", "[0-9]{3}", "@").select("doc_id")


@query("""WITH p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_quantity, l_linenumber, least(l_partkey % 50, l_suppkey % 50) AS a, greatest(l_partkey % 50, l_suppkey % 50) AS b FROM lineitem WHERE l_partkey % 50 <> l_suppkey % 50) SELECT a, b, l_returnflag, l_quantity, key FROM (SELECT *, l_orderkey * 10 + l_linenumber AS key, row_number() OVER (PARTITION BY a, b, l_returnflag ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) AS rn FROM p) WHERE rn = 1""")
def m11_pair_reports(spark, d):
    li = read(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 50).alias("y"), "l_returnflag", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"))
    return readmodels.pair_reports(li, "x", "y", "l_returnflag", "l_quantity", "key").select("a", "b", "l_returnflag", "l_quantity", "key")


@query("""SELECT user_id, event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, max(CASE WHEN event_id % 3 = 0 THEN 3 ELSE 1 END)::INT AS granularity, max(value) AS support FROM events GROUP BY 1, 2""")
def m17_bundles(spark, d):
    out = readmodels.bundles(read(spark, d, "events"), ["user_id", "event_type"], "ts", F.when(F.col("event_id") % 3 == 0, 3).otherwise(1), "value")
    return out.withColumn("first_at", stamp("first_at"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'mismatched_subject' WHEN event_id % 11 = 0 THEN 'mixed_subject' WHEN event_id % 13 = 0 THEN 'contradicted' WHEN event_id % 5 = 0 THEN 'missing_overlap' WHEN event_id % 4 < 2 THEN 'insufficient_support' WHEN NOT value > 5 THEN 'missing_anchor' ELSE 'adequate' END AS state FROM events""")
def m19_recovery_state(spark, d):
    i = F.col("event_id")
    state = readmodels.recovery_state(F.col("event_type") == "error", i % 11 == 0, i % 13 == 0, i % 5, i % 4, F.col("value") > 5)
    return read(spark, d, "events").select("event_id", state.alias("state"))


@query("""WITH e AS (SELECT p_type, p_name, min(p_partkey) AS id, min(p_retailprice) AS price, string_split(p_name, ' ')[-1] AS head FROM part GROUP BY 1, 2), g AS (SELECT DISTINCT id, p_brand, p_size FROM part JOIN e USING (p_type, p_name)), n AS (SELECT DISTINCT id, p_brand FROM g), dg AS (SELECT id, count(*) AS degree FROM n GROUP BY 1),
sh AS (SELECT x.id AS q, y.id AS cand, count(*) AS shared FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.id <> y.id GROUP BY 1, 2), sp AS (SELECT DISTINCT x.id AS q, y.id AS cand, 1 AS pred FROM g x JOIN g y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.id <> y.id),
c AS (SELECT x.id AS q, y.id AS cand, round(1 - levenshtein(x.p_name, y.p_name) / greatest(length(x.p_name), length(y.p_name)), 4) AS nm, x.head = y.head AS ks, x.price AS price_q, y.price AS price_c FROM e x JOIN e y ON x.p_type = y.p_type AND x.p_name <> y.p_name),
s AS (SELECT q, cand, nm, ks, round(0.42 * nm + 0.18 + 0.16 * coalesce(shared, 0) / (a.degree + b.degree - coalesce(shared, 0)) + 0.10 * coalesce(pred, 0) + 0.08 * ks::INT + 0.06 * (least(price_q, price_c) / greatest(price_q, price_c)), 4) AS sc FROM c JOIN dg a ON a.id = q JOIN dg b ON b.id = cand LEFT JOIN sh USING (q, cand) LEFT JOIN sp USING (q, cand) WHERE nm >= 0.55),
r AS (SELECT *, row_number() OVER w AS rn, lead(sc) OVER w AS nx FROM s WINDOW w AS (PARTITION BY q ORDER BY sc DESC, cand))
SELECT e.id AS q, cand AS candidate, CASE WHEN cand IS NULL THEN 'create' WHEN nx IS NOT NULL AND sc - nx < 0.12 THEN 'choose' WHEN sc >= 0.9 AND ks THEN 'attach' ELSE 'merge_prompt' END AS decision FROM e LEFT JOIN (FROM r WHERE rn = 1) k ON k.q = e.id""")
def m28_resolution(spark, d):
    """Names of a part type against each other: brands are the neighbours, a size under a brand the place, the last word the key, prices the time."""
    parts = read(spark, d, "part")
    entities = parts.groupBy("p_type", "p_name").agg(F.min("p_partkey").alias("id"), F.min("p_retailprice").alias("price")).withColumn("head", F.element_at(F.split("p_name", " "), -1))
    edges = parts.join(entities.select("p_type", "p_name", "id"), ["p_type", "p_name"])
    entities = entities.join(edges.groupBy("id").agg(F.countDistinct("p_brand").alias("degree")), "id")
    # the likeness is rounded to four places before it is compared
    alike = identity.alike_names(entities, "p_type", "p_name", 0.5499)
    a, b = (entities.select("p_type", *[F.col(c).alias(f"{n}_{side}") for c, n in (("p_name", "name"), ("price", "price"), ("head", "head"), ("degree", "degree"))], F.col("id").alias(side)) for side in "ab")
    pairs = identity.with_shared(alike.join(a, ["p_type", "name_a"]).join(b, ["p_type", "name_b"]), edges, "id", "p_brand", "p_size")
    price = F.least("price_a", "price_b") / F.greatest("price_a", "price_b")
    pairs = pairs.withColumns({"nm": F.round("lexical", 4), "same": F.col("head_a") == F.col("head_b")}).filter("nm >= 0.55")
    near = F.col("shared") / (F.col("degree_a") + F.col("degree_b") - F.col("shared"))
    score = identity.candidate_score(F.col("nm"), F.lit(1), near, F.col("same_predicate").cast("int"), F.col("same").cast("int"), price)
    pairs = pairs.withColumn("sc", F.round(score, 4))
    both = pairs.select(F.col("a").alias("q"), F.col("b").alias("cand"), "nm", "same", "sc").union(pairs.select("b", "a", "nm", "same", "sc"))
    decided = identity.decide(both, "q", "sc", "nm", "same", "cand")
    return entities.select(F.col("id").alias("q")).join(decided, "q", "left").select("q", "candidate", F.coalesce("decision", F.lit("create")).alias("decision"))


@query("""WITH w AS (SELECT event_id, user_id, event_type, ts FROM events), l AS (SELECT user_id, event_type, max(ts) AS locked FROM events WHERE event_id % 50 = 0 GROUP BY 1, 2) SELECT event_id FROM w LEFT JOIN l USING (user_id, event_type) WHERE locked IS NULL OR ts > locked""")
def k13_blocked_writes(spark, d):
    e = read(spark, d, "events")
    locks = e.filter("event_id % 50 = 0").select("user_id", "event_type", F.col("ts").alias("locked_at"))
    return readmodels.blocked_writes(e, locks, ["user_id", "event_type"], "ts").select("event_id")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events) SELECT user_id, string_agg(event_type || '=' || event_id, '; ' ORDER BY event_type) AS profile, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS as_of FROM l WHERE rn = 1 GROUP BY 1""")
def k9_profiles(spark, d):
    return readmodels.profile_snapshot(read(spark, d, "events"), "user_id", "event_type", "event_id", "ts", "event_id").withColumn("as_of", stamp("as_of"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS child, CASE WHEN s_suppkey > 0 THEN s_suppkey // 3 END AS parent FROM supplier), c AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e WHERE parent IS NOT NULL AND parent <> child UNION ALL SELECT c.node, e.parent, depth + 1 FROM c JOIN e ON c.ancestor = e.child WHERE depth < 6 AND e.parent IS NOT NULL), p AS (SELECT DISTINCT l_partkey AS who, l_suppkey AS place FROM lineitem)
SELECT DISTINCT p.who, p.place FROM p JOIN c ON c.ancestor = p.place JOIN p q ON q.who = p.who AND q.place = c.node""")
def g3_more_specific(spark, d):
    places = read(spark, d, "lineitem").select(F.col("l_partkey").alias("who"), F.col("l_suppkey").alias("place")).distinct()
    return graph.more_specific(places, graph.climb(_hierarchy(spark, d), "child", "parent"), "who", "place")


@query("""SELECT c_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def m12_top_by_subject(spark, d):
    c, o = read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), read(spark, d, "orders")
    grouped = c.join(o, c.c_custkey == o.o_custkey).groupBy("c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    return grouped.orderBy(F.desc("total"), "c_custkey").limit(10)


@query("""WITH w AS (SELECT event_id, ts, ts + to_days((event_id % 400)::INT) AS e FROM events) SELECT event_id, CASE WHEN event_id % 400 = 0 THEN 'broad' WHEN event_id % 400 <= 1 THEN 'day' WHEN event_id % 400 <= 45 THEN 'month' WHEN event_id % 400 <= 370 THEN 'year' ELSE 'broad' END AS granularity FROM w""")
def p3_window_granularity(spark, d):
    e = read(spark, d, "events").withColumn("e", F.col("ts") + F.make_dt_interval((F.col("event_id") % 400).cast("int")))
    return e.select("event_id", scalar.window_granularity(F.col("ts"), F.col("e")).alias("granularity"))


@query("""SELECT o_orderkey, CASE (month(o_orderdate) % 12) // 3 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'autumn' END AS season, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week FROM orders""")
def p10_seasons(spark, d):
    return read(spark, d, "orders").select("o_orderkey", scalar.season(F.col("o_orderdate")).alias("season"), F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd").alias("week"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS anchor FROM conversations""")
def p9_carry_forward(spark, d):
    c = read(spark, d, "conversations").withColumn("own", F.when(F.col("turn") % 3 == 0, F.col("role")))
    return c.select("conv_id", "turn", temporal.carry_forward(c, "conv_id", "turn", "own").alias("anchor"))


@query("""WITH r AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) SELECT (n // 3)::BIGINT AS bucket, count(*) AS users, round(avg(n), 4) AS mean FROM r GROUP BY 1""")
def e10_inbox_counts(spark, d):
    r = read(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return r.groupBy(F.floor(F.col("n") / 3).alias("bucket")).agg(F.count(F.lit(1)).alias("users"), F.round(F.avg("n"), 4).alias("mean"))


@query("""WITH r AS (SELECT d.doc_id, first_value(d.doc_id) OVER w AS keeper_id, row_number() OVER w AS nth FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WINDOW w AS (PARTITION BY d.source, d.lang, d.text ORDER BY CASE WHEN l.doc_id IS NOT NULL THEN 0 ELSE 1 END, d.doc_id)) SELECT keeper_id, doc_id AS duplicate_id FROM r WHERE nth > 1""")
def e9_near_duplicates(spark, d):
    labelled = read(spark, d, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    docs = read(spark, d, "documents").join(labelled, "doc_id", "left")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return identity.keepers_of_copies(docs, [F.col("source"), F.col("lang"), digest], [F.when(F.col("labelled"), 0).otherwise(1)], "doc_id")


@query("""SELECT label, count(*) AS n, round(avg(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS mean_square FROM embeddings GROUP BY 1""")
def r4_vector_norms(spark, d):
    return retrieval.centroid_similarity(read(spark, d, "embeddings"), "label")


@query("""WITH s AS (SELECT conv_id, role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY 1, 2) SELECT role, count(DISTINCT conv_id) AS conversations, sum(n)::BIGINT AS turns, sum(chars)::BIGINT AS chars FROM s GROUP BY 1""")
def m24_session_review(spark, d):
    return read(spark, d, "conversations").groupBy("role").agg(F.countDistinct("conv_id").alias("conversations"), F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("""WITH l AS (SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95, max(l_quantity) AS slowest, round(avg((l_discount > 0.05)::INT), 4) AS pass_rate, count(*) AS n FROM lineitem GROUP BY 1) SELECT * FROM l""")
def m30_pass_rates(spark, d):
    return evaluation.pass_rates(read(spark, d, "lineitem"), "l_returnflag", F.col("l_discount") > 0.05, "l_quantity")


@query("""SELECT source, count(*) AS total, count(*) FILTER (WHERE lang = 'en') AS covered, round(count(*) FILTER (WHERE lang = 'en') / count(*), 4) AS ratio FROM documents GROUP BY 1""")
def a19_namespace_coverage(spark, d):
    return lifecycle.coverage(read(spark, d, "documents"), "source", F.col("lang") == "en")
