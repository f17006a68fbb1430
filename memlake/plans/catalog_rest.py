"""Queries that compose operators: support loaders, dossiers, audits, consolidation, rebuilds, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import scalar
from memlake.operators import graph, identity, lifecycle, readmodels, relational
from memlake.plans.catalog import query, read, stamp


@query(r"""WITH a AS (SELECT doc_id, n_chars, 0 AS tier, 1.0 * regexp_matches(text, '[0-9]{3}')::INT + 0.5 * regexp_matches(text, '@')::INT AS bonus FROM documents WHERE regexp_matches(text, '(?i)license')), b AS (SELECT doc_id, n_chars, 1 AS tier, 1.0 * regexp_matches(text, '[0-9]{3}')::INT + 0.5 * regexp_matches(text, '@')::INT AS bonus FROM documents WHERE n_chars > 5000), u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, bonus DESC, n_chars DESC, doc_id) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT doc_id, tier, bonus::DOUBLE AS bonus FROM u WHERE rn = 1 ORDER BY tier, bonus DESC, n_chars DESC, doc_id LIMIT 30""")
def r13_support_loader(spark, d):
    docs = read(spark, d, "documents").withColumn("bonus", scalar.weighted_rules(F.col("text"), [("[0-9]{3}", 1.0), ("@", 0.5)])).select("doc_id", "n_chars", "text", "bonus")
    one, two = docs.filter(F.col("text").rlike("(?i)license")).drop("text"), docs.filter("n_chars > 5000").drop("text")
    return relational.merge_ranked(one, two, "doc_id", [F.desc("bonus"), F.desc("n_chars"), F.asc("doc_id")], 30).select("doc_id", "tier", "bonus")


@query("""WITH m AS (SELECT event_id, ts, (contains(props, '1')::INT + contains(event_type, 'c')::INT) AS terms FROM events WHERE event_type IN ('click', 'purchase')) SELECT event_id, terms FROM m WHERE terms > 0 ORDER BY terms DESC, ts, event_id LIMIT 40""")
def m5_anchor_read(spark, d):
    e = read(spark, d, "events").filter("event_type in ('click', 'purchase')")
    n = F.col("props").contains("1").cast("int") + F.col("event_type").contains("c").cast("int")
    return e.withColumn("terms", n).filter("terms > 0").orderBy(F.desc("terms"), "ts", "event_id").limit(40).select("event_id", "terms")


@query("""WITH f AS (SELECT user_id AS subject, event_type AS property, event_id, value FROM events), k AS (SELECT subject, property, list({'v': value, 'i': event_id} ORDER BY value DESC, event_id)[1:3] AS top, count(*) AS n FROM f GROUP BY 1, 2) SELECT subject, property, n, array_to_string(list_transform(top, lambda x: x.i::VARCHAR), ',') AS support FROM k""")
def m8_fact_keys(spark, d):
    f = read(spark, d, "events").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "event_type")))
    top = relational.top_per_group(f, ["user_id", "event_type"], [F.desc("value"), F.asc("event_id")], 3, "nth")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "event_id"))), lambda x: x.event_id.cast("string"))
    return top.groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("property")).agg(F.first("n").alias("n"), F.array_join(ids, ",").alias("support"))


@query("""WITH names AS (SELECT c_custkey AS id FROM customer WHERE c_name LIKE '%1' UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), v AS (SELECT o_custkey AS id, o_orderkey, o_orderdate AS s, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS e FROM orders)
SELECT v.id, o_orderkey FROM v WHERE id IN (SELECT id FROM names) AND (e IS NULL OR e >= TIMESTAMP '1996-01-01') AND s <= TIMESTAMP '1996-12-31'""")
def m9_observations(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    ids = c.filter("c_name like '%1'").select(F.col("c_custkey").alias("id")).union(c.filter("c_mktsegment = 'BUILDING'").select("c_custkey")).distinct()
    v = o.select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderdate").alias("s"), F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("e"))
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return v.join(ids, "id", "left_semi").filter(scalar.overlaps(F.col("s"), F.col("e"), day("1996-01-01"), day("1996-12-31"))).select("id", "o_orderkey")


@query("""SELECT c_nationkey AS subject, o_orderpriority AS kind, count(*) AS n, count(DISTINCT o_custkey) AS provenance, round(max(o_totalprice), 2) AS strongest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def m10_entity_reports(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.groupBy(F.col("c_nationkey").alias("subject"), F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("provenance"), F.round(F.max("o_totalprice"), 2).alias("strongest"))


@query("""WITH seeds AS (SELECT conv_id FROM conversations WHERE turn = 1 AND length(text) > 300) SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM seeds)""")
def m18_source_neighbourhood(spark, d):
    c = read(spark, d, "conversations")
    return c.join(c.filter("turn = 1 and length(text) > 300").select("conv_id"), "conv_id", "left_semi").select("conv_id", "turn")


@query("""WITH q AS (SELECT 'ann' AS k), t AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 98 WHEN p_type LIKE 'STANDARD%' THEN 80 WHEN list_has_any(string_split(p_type, ' '), ['BRUSHED', 'TIN']) THEN 45 ELSE 25 END AS score FROM part) SELECT p_partkey, score FROM t WHERE score > 25 ORDER BY score DESC, p_partkey LIMIT 60""")
def e2_correction_targets(spark, d):
    words = F.split("p_type", " ")
    score = F.when(F.col("p_brand") == "Brand#11", 98).when(F.col("p_type").like("STANDARD%"), 80).when(F.arrays_overlap(words, F.array(F.lit("BRUSHED"), F.lit("TIN"))), 45).otherwise(25)
    return read(spark, d, "part").withColumn("score", score).filter("score > 25").orderBy(F.desc("score"), "p_partkey").limit(60).select("p_partkey", "score")


@query("""WITH m AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 4 = 3 THEN c_custkey - 1 END AS target FROM customer), r AS (SELECT node, coalesce(target, node) AS canonical FROM m) SELECT canonical, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, count(DISTINCT node) AS merged FROM orders JOIN r ON o_custkey = node GROUP BY 1""")
def e4_merged_references(spark, d):
    merges = read(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 4 == 3, F.col("c_custkey") - 1).alias("target"))
    ends = graph.resolve_redirects(merges, "node", "target")
    joined = read(spark, d, "orders").join(ends.withColumnRenamed("node", "o_custkey"), "o_custkey")
    return joined.groupBy("canonical").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.countDistinct("o_custkey").alias("merged"))


@query("""WITH e AS (SELECT s_suppkey AS child, CASE WHEN s_suppkey > 0 THEN s_suppkey // 3 END AS parent FROM supplier) SELECT child, CASE WHEN parent IS NULL THEN 'root' WHEN parent = child THEN 'self' WHEN parent NOT IN (SELECT child FROM e) THEN 'missing_parent' WHEN parent > child THEN 'inverted' ELSE 'ok' END AS status FROM e""")
def e7_hierarchy_audit(spark, d):
    e = read(spark, d, "supplier").select(F.col("s_suppkey").alias("child"), F.when(F.col("s_suppkey") > 0, F.floor(F.col("s_suppkey") / 3)).alias("parent"))
    known = e.select(F.col("child").alias("parent"), F.lit(True).alias("known"))
    status = F.when(F.col("parent").isNull(), "root").when(F.col("parent") == F.col("child"), "self").when(F.col("known").isNull(), "missing_parent").when(F.col("parent") > F.col("child"), "inverted").otherwise("ok")
    return e.join(known, "parent", "left").select("child", status.alias("status"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS child, CASE WHEN s_suppkey > 0 THEN s_suppkey // 3 END AS parent FROM supplier), c AS (SELECT child AS node, parent AS at_node, 1 AS d FROM e WHERE parent IS NOT NULL AND parent <> child UNION ALL SELECT c.node, e.parent, d + 1 FROM c JOIN e ON c.at_node = e.child WHERE e.parent IS NOT NULL AND d < 10) SELECT node, max(d)::INT AS height FROM c GROUP BY 1""")
def g4_parent_chain(spark, d):
    e = read(spark, d, "supplier").select(F.col("s_suppkey").alias("child"), F.when(F.col("s_suppkey") > 0, F.floor(F.col("s_suppkey") / 3)).alias("parent"))
    return graph.climb(e, "child", "parent", 10).groupBy("node").agg(F.max("depth").alias("height"))


@query("""WITH f AS (SELECT c_custkey, o_orderstatus AS kind, o_orderkey, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, kind ORDER BY o_orderdate DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY c_custkey, kind) AS n FROM f) SELECT c_custkey, kind, o_orderkey AS latest, n FROM r WHERE rn = 1""")
def g11_dossier(spark, d):
    c, o = read(spark, d, "customer").filter("c_nationkey = 3"), read(spark, d, "orders")
    f = c.join(o, c.c_custkey == o.o_custkey).select("c_custkey", F.col("o_orderstatus").alias("kind"), "o_orderkey", "o_orderdate")
    f = f.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("c_custkey", "kind")))
    return relational.top_per_group(f, ["c_custkey", "kind"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("c_custkey", "kind", F.col("o_orderkey").alias("latest"), "n")


@query("""WITH c AS (SELECT user_id, event_type AS kind, ts, event_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS stage FROM events WHERE value > 2), k AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY stage, ts, event_id) AS before FROM c) SELECT user_id, kind, count(*) AS n FROM k WHERE kind IS DISTINCT FROM before GROUP BY 1, 2""")
def k2_consolidation(spark, d):
    stage = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    c = read(spark, d, "events").filter("value > 2").select("user_id", F.col("event_type").alias("kind"), F.struct(stage.alias("stage"), "ts").alias("at"), "event_id")
    return lifecycle.versions(c, "user_id", "kind", "at", "event_id").groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT 'document' AS kind, source AS owner, doc_id AS id, n_chars AS weight FROM documents UNION ALL SELECT 'conversation', role, conv_id * 1000 + turn, length(text) FROM conversations UNION ALL SELECT 'event', event_type, event_id, value::BIGINT FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY kind, owner ORDER BY weight DESC, id) AS rn FROM s) SELECT kind, owner, id, weight FROM r WHERE rn <= 2""")
def k11_projection_heads(spark, d):
    docs = read(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("source").alias("owner"), F.col("doc_id").alias("id"), F.col("n_chars").alias("weight"))
    conv = read(spark, d, "conversations").select(F.lit("conversation"), "role", F.col("conv_id") * 1000 + F.col("turn"), F.length("text").cast("long"))
    events = read(spark, d, "events").select(F.lit("event"), "event_type", "event_id", F.rint("value").cast("long"))
    return relational.top_per_group(docs.union(conv).union(events), ["kind", "owner"], [F.desc("weight"), F.asc("id")], 2)


@query("""WITH q AS (SELECT conv_id, min(turn) AS a, max(turn) AS b, count(DISTINCT role) AS roles FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN roles < 2 THEN 'unverified' WHEN a = b THEN 'single' ELSE 'verified' END AS binding FROM q""")
def m16_pair_binding(spark, d):
    q = read(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.countDistinct("role").alias("roles"))
    return q.select("conv_id", F.when(F.col("roles") < 2, "unverified").when(F.col("a") == F.col("b"), "single").otherwise("verified").alias("binding"))


@query("""WITH l AS (SELECT 'purchase' AS lane, user_id, event_id, ts FROM events WHERE event_type = 'purchase' AND value >= 5 UNION ALL SELECT 'media', user_id, event_id, ts FROM events WHERE event_type = 'view' AND contains(props, '7')) SELECT lane, user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_at FROM l""")
def m4_typed_lanes(spark, d):
    e = read(spark, d, "events")
    lane = lambda name, cond: e.filter(cond).select(F.lit(name).alias("lane"), "user_id", "event_id", stamp("ts").alias("seen_at"))
    return lane("purchase", "event_type = 'purchase' and value >= 5").unionByName(lane("media", F.expr("event_type = 'view' and contains(props, '7')")))


@query("""SELECT d.doc_id, d.source, l.quality, l.toxic, d.n_chars // 1000 AS thousands FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def s16_artifact_detail(spark, d):
    docs = read(spark, d, "documents")
    return docs.join(read(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic", F.floor(F.col("n_chars") / 1000).alias("thousands"))


@query(r"""SELECT conv_id, turn, regexp_extract(text, '^\s*(\S+)', 1) AS first_word, CASE WHEN regexp_matches(text, '^\s*(?:[-*]|\d+\.)\s') THEN 'task' WHEN regexp_matches(text, '\b(?:19|20)[0-9]{2}\b') THEN 'dated' ELSE 'note' END AS kind FROM conversations""")
def t16_task_lines(spark, d):
    return task_lines(read(spark, d, "conversations"))


def task_lines(turns):
    kind = F.when(F.col("text").rlike(r"^\s*(?:[-*]|\d+\.)\s"), "task").when(F.col("text").rlike(scalar.ascii_bounds(r"\b(?:19|20)[0-9]{2}\b")), "dated").otherwise("note")
    return turns.select("conv_id", "turn", F.regexp_extract("text", r"^\s*(\S+)", 1).alias("first_word"), kind.alias("kind"))


@query("""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def s2_benchmark_overlap(spark, d):
    # texts meet by the digests of their five-word runs: an equi-join; containment is then checked on the few pairs
    runs = lambda df, key: df.select(key, "text", F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 0).alias("w")).filter("size(w) >= 5")
    asked = runs(read(spark, d, "benchmark"), "item_id").select("item_id", F.col("text").alias("passage"), F.xxhash64(F.array_join(F.slice("w", 2, 4), " ")).alias("run"))
    docs = runs(read(spark, d, "documents"), "doc_id").select("doc_id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 4), " "))))).alias("run"))
    found = docs.join(asked.filter("passage is not null"), "run").filter(F.contains("text", "passage"))
    return found.select("item_id", "doc_id").distinct()


@query("""WITH s AS (SELECT doc_id, n_chars, source FROM documents), g AS (SELECT source, avg(n_chars) AS mean, stddev_samp(n_chars) AS sd FROM s GROUP BY 1) SELECT doc_id, round((n_chars - mean) / sd, 4) AS z FROM s JOIN g USING (source) WHERE sd > 0 AND abs(n_chars - mean) > 2 * sd""")
def a15_outliers(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "n_chars")
    of_source = docs.groupBy("source").agg(F.avg("n_chars").alias("mean"), F.stddev_samp("n_chars").alias("sd"))
    s = docs.join(of_source, "source")
    return s.filter("sd > 0 and abs(n_chars - mean) > 2 * sd").select("doc_id", F.round((F.col("n_chars") - F.col("mean")) / F.col("sd"), 4).alias("z"))


@query("""SELECT event_id, round(0.42 * (value / 10) + 0.18 * (event_id % 2) + 0.16 * 0.5 + 0.10 * (event_id % 3 = 0)::INT + 0.08 + 0.06 * 0.25, 6)::DOUBLE AS score FROM events""")
def m28_candidate_score(spark, d):
    i = F.col("event_id")
    score = identity.candidate_score(F.col("value") / 10, i % 2, F.lit(0.5), (i % 3 == 0).cast("int"), F.lit(1), F.lit(0.25))
    return read(spark, d, "events").select("event_id", F.round(score, 6).alias("score"))


@query("""SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'missing' WHEN n_chars >= 2000 THEN 'supported' WHEN n_chars >= 500 THEN 'weak' ELSE 'missing' END AS adequacy FROM documents""")
def r23_adequacy(spark, d):
    support = F.when(F.col("n_chars") >= 2000, 2).when(F.col("n_chars") >= 500, 1).otherwise(0)
    return read(spark, d, "documents").select("doc_id", readmodels.confidence_grade(support, F.lit(0)).alias("adequacy"))
