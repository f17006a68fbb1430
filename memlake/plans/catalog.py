"""Queries of the relational, temporal and lifecycle operators over the driver tables, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import scalar
from memlake.operators import relational, temporal
from memlake.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.read(spark, d, name)


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


NOW = "2024-02-01 00:00:00"

# --- scans, filters ---------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id LIMIT 100")
def s1_window_scan(spark, d):
    e = read(spark, d, "events").filter("event_type = 'purchase' and ts between timestamp_ntz'2024-01-08' and timestamp_ntz'2024-01-15'")
    return e.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "value")


@query("""WITH h AS (SELECT page_id, url, sha256(coalesce(html, '')) AS checksum FROM pages)
SELECT url, checksum, row_number() OVER (PARTITION BY url ORDER BY checksum) AS version FROM (SELECT DISTINCT url, checksum FROM h)""")
def s3_register_versions(spark, d):
    from memlake.operators.lifecycle import register

    pages = read(spark, d, "pages").select("url", F.coalesce("html", F.lit("")).alias("html"))
    none = spark.createDataFrame([], "url string, checksum string, version long")
    return register(none, pages, "url", "html").withColumn("version", F.col("version").cast("long"))


@query("""WITH a AS (SELECT o_custkey AS k, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1),
b AS (SELECT o_custkey AS k, max(o_orderstatus) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'deleted' WHEN a.s <> b.s THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def s5_snapshot_changes(spark, d):
    o = read(spark, d, "orders")
    part = lambda cond: o.filter(cond).groupBy("o_custkey").agg(F.max("o_orderstatus").alias("s"))
    return relational.snapshot_changes(part("o_orderdate < timestamp_ntz'1997-01-01'"), part("o_orderdate >= timestamp_ntz'1997-01-01'"), "o_custkey", "s")


@query("""WITH s AS (SELECT event_id, sha256(props) AS hash FROM events WHERE event_id % 3 <> 0), p AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN props || ' ' ELSE props END AS props FROM events)
SELECT p.event_id, CASE WHEN s.hash IS NULL THEN 'created' WHEN s.hash <> sha256(p.props) THEN 'updated' ELSE 'skipped' END AS outcome FROM p LEFT JOIN s USING (event_id)""")
def s9_overlap_pull(spark, d):
    e = read(spark, d, "events")
    stored = e.filter("event_id % 3 != 0").select("event_id", F.sha2(F.col("props").cast("binary"), 256).alias("hash"))
    pulled = e.withColumn("props", F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props")))
    return tables.overlap_pull(stored, pulled, "event_id", F.col("props"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS body FROM pages")
def s14_page_text(spark, d):
    return read(spark, d, "pages").select("page_id", tables.html_text(F.col("html")).alias("body"))


@query("""WITH v AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events)
SELECT user_id, event_id FROM v WHERE (until IS NULL OR until >= TIMESTAMP '2024-01-10') AND ts <= TIMESTAMP '2024-01-12'""")
def f2_interval_overlap(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = read(spark, d, "events").withColumn("until", F.lead("ts").over(w))
    bound = lambda s: F.lit(s).cast("timestamp_ntz")
    return v.filter(scalar.overlaps(F.col("ts"), F.col("until"), bound("2024-01-10"), bound("2024-01-12"))).select("user_id", "event_id")


@query("""SELECT a.event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) a WHERE a.event_type IS DISTINCT FROM a.before GROUP BY 1""")
def f3_null_safe_change(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").withColumn("before", F.lag("event_type").over(w))
    return e.filter(~F.col("event_type").eqNullSafe(F.col("before"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\b(?:license|licensed|copyright)\\b')")
def f4_regex_words(spark, d):
    return read(spark, d, "documents").filter(F.col("text").rlike(scalar.ascii_bounds(r"(?i)\b(?:license|licensed|copyright)\b"))).select("doc_id")


@query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')""")
def f6_exists_not_exists(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return c.join(o.filter("o_orderpriority = '1-URGENT'"), "c_custkey", "left_semi").join(o.filter("o_orderstatus = 'P'"), "c_custkey", "left_anti").select("c_custkey")


TERMS = ("the", "error", "license", "que", "der")


@query("SELECT doc_id, " + " + ".join(f"(contains(lower(text), '{t}'))::BIGINT" for t in TERMS) + " AS n_terms FROM documents")
def f7_term_matches(spark, d):
    text = F.lower("text")
    return read(spark, d, "documents").select("doc_id", sum((text.contains(t).cast("long") for t in TERMS), F.lit(0).cast("long")).alias("n_terms"))


RULES = [(r"(?i)\b(?:license|copyright)\b", -0.5), (r"[0-9]{3,}", 0.2), (r"@", -0.3), (r"(?i)\bthe\b", 0.4), (r"(?i)\b(?:que|les)\b", 0.4)]


@query("SELECT doc_id, round(1.0 " + " ".join(f"+ (CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END)" for p, w in RULES) + ", 4)::DOUBLE AS score FROM documents")
def f8_rule_score(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(scalar.weighted_rules(F.col("text"), RULES, 1.0), 4).alias("score"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("""SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def j1_provenance_chain(spark, d):
    o, c, n, r = (read(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    chain = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey, "left")
    return chain.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2""")
def j2_cooccurrence(spark, d):
    return relational.pair_counts(n=(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey"))


@query("""WITH a AS (SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1), c AS (SELECT user_id, count(*) AS signups FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id, c.user_id) AS user_id, coalesce(clicks, 0) AS clicks, coalesce(errors, 0) AS errors, coalesce(signups, 0) AS signups FROM a FULL JOIN b ON a.user_id = b.user_id FULL JOIN c ON coalesce(a.user_id, b.user_id) = c.user_id""")
def j3_outer_merge(spark, d):
    e = read(spark, d, "events")
    counts = [e.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias(name)) for kind, name in (("click", "clicks"), ("error", "errors"), ("signup", "signups"))]
    return relational.outer_merge(counts, ["user_id"]).na.fill(0)


@query("""WITH b AS (SELECT 'day' AS layer, date_trunc('day', ts)::DATE AS s FROM events UNION SELECT 'week', date_trunc('week', ts)::DATE FROM events UNION SELECT 'month', date_trunc('month', ts)::DATE FROM events UNION SELECT 'year', date_trunc('year', ts)::DATE FROM events),
n AS (SELECT layer || ':' || strftime(s, '%Y-%m-%d') AS node_id, layer, s, CASE layer WHEN 'day' THEN s WHEN 'week' THEN (s + INTERVAL 6 DAY)::DATE WHEN 'month' THEN last_day(s) ELSE make_date(year(s), 12, 31) END AS e, CASE layer WHEN 'day' THEN 'week' WHEN 'week' THEN 'month' WHEN 'month' THEN 'year' END AS up FROM b)
SELECT node_id, (SELECT p.node_id FROM n p WHERE p.layer = n.up AND p.s <= n.s AND p.e >= n.e ORDER BY p.s DESC, p.e, p.node_id LIMIT 1) AS parent_id FROM n WHERE up IS NOT NULL""")
def j4_parent_links(spark, d):
    return temporal.parent_links(temporal.nodes(read(spark, d, "events"), "ts"))


@query("""SELECT p.event_id, (SELECT v.event_id FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS view_as_of FROM events p WHERE p.event_type = 'purchase'""")
def j5_as_of(spark, d):
    e = read(spark, d, "events")
    views = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view"))
    return relational.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "view_ts", "view").select("event_id", "view_as_of")


@query("""SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS keeper, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1""")
def j6_keepers(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query("""WITH a AS (SELECT DISTINCT lang AS alias FROM documents) SELECT alias, count(*) AS n FROM (SELECT DISTINCT p.page_id, alias FROM pages p JOIN a ON list_contains(regexp_extract_all(lower(p.html), '[a-z]+'), alias)) GROUP BY 1""")
def j7_alias_in_text(spark, d):
    words = read(spark, d, "pages").select("page_id", F.explode(F.array_distinct(scalar.tokens(F.col("html"), "[a-z]+"))).alias("word"))
    aliases = read(spark, d, "documents").select(F.col("lang").alias("alias"), F.col("lang").alias("word")).distinct()
    return words.join(aliases, "word").groupBy("alias").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH top AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 20) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM top)""")
def j9_seeds_then_children(spark, d):
    o = read(spark, d, "orders")
    seeds = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")).orderBy(F.desc("t"), "o_custkey").limit(20)
    return o.join(seeds, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT 'label_document' AS reference, count(*) AS n FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents t WHERE t.doc_id = l.doc_id)
UNION ALL SELECT 'order_customer', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'customer_order', count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'part_line', count(*) FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey)""")
def j10_orphan_audit(spark, d):
    checks = [("labels", "documents", "doc_id", "doc_id", "label_document"), ("orders", "customer", "o_custkey", "c_custkey", "order_customer"), ("customer", "orders", "c_custkey", "o_custkey", "customer_order"), ("part", "lineitem", "p_partkey", "l_partkey", "part_line")]
    counts = [relational.orphans(read(spark, d, child), read(spark, d, parent), ck, pk, name).agg(F.lit(name).alias("reference"), F.count(F.lit(1)).alias("n")) for child, parent, ck, pk, name in checks]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("""WITH ids AS (SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = 1), m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), e AS (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey)
SELECT a, b FROM e WHERE a IN (SELECT id FROM ids) OR b IN (SELECT id FROM ids)""")
def j12_either_side(spark, d):
    edges = relational.pair_counts(n=(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey")).select("a", "b")
    ids = read(spark, d, "supplier").filter("s_nationkey = 1").select(F.col("s_suppkey").alias("id"))
    return relational.either_side(edges, "a", "b", ids, "id")


@query("""WITH s AS (SELECT conv_id, turn FROM conversations WHERE length(text) > 800) SELECT c.conv_id, c.turn, min(abs(c.turn - s.turn)) AS distance FROM conversations c JOIN s ON c.conv_id = s.conv_id GROUP BY 1, 2""")
def j15_nearest_seed(spark, d):
    from memlake.operators.retrieval import neighbours

    c = read(spark, d, "conversations")
    return neighbours(c.select("conv_id", "turn"), c.filter(F.length("text") > 800), "conv_id", "turn")


# --- aggregations, windows, limits, sets ------------------------------------------------------------------------------


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT event_type) FILTER (WHERE value > 5) AS kinds, round(sum(value), 4) AS total, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events GROUP BY 1""")
def a1_filtered_aggregates(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct(F.when(F.col("value") > 5, F.col("event_type"))).alias("kinds"),
        F.round(F.sum("value"), 4).alias("total"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"),
    )


@query("""SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path, arg_min(event_type, (ts, event_id)) AS first_kind FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1""")
def a4_ordered_arrays(spark, d):
    e = read(spark, d, "events").filter("event_type in ('signup', 'purchase')")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return e.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x.event_type), ">").alias("path"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_kind"))


@query("""SELECT c_nationkey, array_to_string(list_slice(list_sort(list(DISTINCT c_mktsegment)), 1, 3), ',') AS segments, count(DISTINCT c_mktsegment) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1""")
def a5_distinct_slice(spark, d):
    from memlake.operators.identity import role_conflicts

    return role_conflicts(read(spark, d, "customer").filter("c_acctbal > 0"), "c_nationkey", "c_mktsegment", 3).select("c_nationkey", F.col("roles").alias("segments"), F.col("n_roles").alias("n"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rn) AS top5 FROM r WHERE rn <= 5 GROUP BY 1""")
def a6_top_in_group(spark, d):
    top = relational.top_per_group(read(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5, "rn")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rn", "o_orderkey"))), lambda x: x.o_orderkey.cast("string"))
    return top.groupBy("o_custkey").agg(F.array_join(ordered, ",").alias("top5"))


@query("""SELECT 'events' AS part, event_type AS status, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'orders', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'documents', lang, count(*) FROM documents GROUP BY 2""")
def a9_status_rollup(spark, d):
    one = lambda t, c: read(spark, d, t).groupBy(F.lit(t).alias("part"), F.col(c).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return one("events", "event_type").unionByName(one("orders", "o_orderstatus")).unionByName(one("documents", "lang"))


@query("""WITH u AS (SELECT o_custkey AS k, max(o_orderdate) AS seen FROM orders GROUP BY 1 UNION ALL SELECT user_id, max(ts) FROM events GROUP BY 1) SELECT k, strftime(max(seen), '%Y-%m-%d %H:%M:%S') AS last_at FROM u GROUP BY 1""")
def a10_last_activity(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("at"))
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("ts").alias("at"))
    return o.unionByName(e).groupBy("k").agg(stamp(F.max("at")).alias("last_at"))


@query("""WITH e AS (SELECT user_id, event_type, (isodow(ts) - 1) AS weekday, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS day_part, date_trunc('week', ts) AS w FROM events WHERE ts > TIMESTAMP '2024-02-01' - INTERVAL 90 DAY AND ts <= TIMESTAMP '2024-02-01')
SELECT user_id, event_type, weekday::INT AS weekday, day_part, count(DISTINCT w) AS n_weeks, count(*) AS n_events FROM e GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT w) >= 3""")
def a13_weekly_routines(spark, d):
    return temporal.weekly_routines(read(spark, d, "events"), "ts", ["user_id", "event_type"], F.lit(NOW).cast("timestamp_ntz"))


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS slowest, count(*) AS n, round(avg((value > 5)::INT), 4) AS pass_rate FROM events GROUP BY 1""")
def a16_percentiles(spark, d):
    from memlake.operators.evaluation import pass_rates

    return pass_rates(read(spark, d, "events"), "event_type", F.col("value") > 5, "value")


@query("""SELECT source, count(*) AS total, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS covered, round(count(*) FILTER (WHERE l.doc_id IS NOT NULL) / count(*), 4) AS ratio FROM documents t LEFT JOIN labels l ON t.doc_id = l.doc_id GROUP BY 1""")
def a19_coverage(spark, d):
    from memlake.operators.lifecycle import coverage

    labelled = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    return coverage(labelled, "source", F.col("has").isNotNull())


@query("""SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY 1""")
def a20_string_aggregation(spark, d):
    return read(spark, d, "documents").select("lang", "source").distinct().groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


@query("""SELECT n_regionkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_regionkey, c_mktsegment), (n_regionkey), ())""")
def a17_grouping_sets(spark, d):
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).rollup("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


ROLLUP = " UNION ALL ".join(
    f"SELECT '{x}' AS layer, strftime(date_trunc('{x}', ts), '%Y-%m-%d') AS bucket, count(*) AS n_events, count(DISTINCT user_id) AS n_entities, count(DISTINCT event_type) AS n_kinds, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY 2"
    for x in temporal.LAYERS
)


@query(ROLLUP)
def k6_temporal_rollup(spark, d):
    out = temporal.rollup(read(spark, d, "events"), "ts", "user_id", "event_type")
    return out.select("layer", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "n_events", "n_entities", "n_kinds", stamp("first_at").alias("first_at"), stamp("last_at").alias("last_at"))


TOP_KINDS = " UNION ALL ".join(f"SELECT '{x}' AS layer, strftime(date_trunc('{x}', ts), '%Y-%m-%d') AS bucket, event_type, count(*) AS n FROM events GROUP BY 2, 3" for x in temporal.LAYERS)


@query(f"SELECT layer, bucket, event_type, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY layer, bucket ORDER BY n DESC, event_type)::INT AS rank FROM ({TOP_KINDS})) WHERE rank <= 3")
def w1_top_kinds(spark, d):
    return temporal.top_kinds(read(spark, d, "events"), "ts", "event_type").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, ts DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def w4_priority_keeper(spark, d):
    priority = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return relational.top_per_group(read(spark, d, "events"), ["user_id"], [priority.asc(), F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey""")
def w5_distinct_on(spark, d):
    return relational.top_per_group(read(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT doc_id, first_value(doc_id) OVER w AS keeper, row_number() OVER w AS copy FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id)""")
def w8_keeper_and_rank(spark, d):
    w = Window.partitionBy("digest").orderBy("doc_id")
    docs = read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    return docs.select("doc_id", F.first("doc_id").over(w).alias("keeper"), F.row_number().over(w).cast("long").alias("copy"))


@query("""SELECT doc_id, source, running FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents) WHERE running <= 20000""")
def l6_budget(spark, d):
    out = relational.within_budget(read(spark, d, "documents"), ["source"], [F.asc("doc_id")], F.col("n_chars"), 20_000)
    return out.select("doc_id", "source", F.col("running_size").alias("running"))


@query("""WITH p AS (SELECT o_orderkey, o_totalprice, 0 AS tier FROM orders WHERE o_orderpriority = '1-URGENT'), s AS (SELECT o_orderkey, o_totalprice, 1 AS tier FROM orders WHERE o_totalprice > 300000), u AS (SELECT * FROM p UNION ALL SELECT * FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY tier, o_totalprice DESC, o_orderkey) AS rn FROM u)
SELECT o_orderkey, tier FROM k WHERE rn = 1 ORDER BY tier, o_totalprice DESC, o_orderkey LIMIT 50""")
def l4_merge_ranked(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return relational.merge_ranked(o.filter("o_orderpriority = '1-URGENT'"), o.filter("o_totalprice > 300000"), "o_orderkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 50).select("o_orderkey", "tier")


@query("""SELECT p_partkey, p_name FROM part WHERE p_size > 40 UNION SELECT p_partkey, p_name FROM part WHERE p_brand LIKE '%3'""")
def u2_union_distinct(spark, d):
    p = read(spark, d, "part")
    return p.filter("p_size > 40").select("p_partkey", "p_name").union(p.filter("p_brand like '%3'").select("p_partkey", "p_name")).distinct()


@query("""SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT p_partkey FROM part WHERE p_size > 45""")
def u3_set_intersection(spark, d):
    li = read(spark, d, "lineitem")
    both = li.filter("l_suppkey = 1").select("l_partkey").intersect(li.filter("l_returnflag = 'R'").select("l_partkey"))
    return both.subtract(read(spark, d, "part").filter("p_size > 45").select(F.col("p_partkey").alias("l_partkey")))
