"""Operators on hand-made cases: planner goldens, sequential text operators, graph and lifecycle invariants, sources."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memlake.functions import scalar
from memlake.operators import evaluation, extract, graph, identity, lifecycle, relational, retrieval, temporal, text
from memlake.plans import planner
from memlake.sources import tables
from memlake.streaming import streams

NOW = datetime(2026, 3, 11, 15, 30)


def test_plan_limits_weights_and_variants():
    """Limits by intent, weights by scope of time, variants of terms."""
    timed, vague, plain = (planner.plan(q, NOW) for q in ("Who was I with in Chiang Mai in 2026?", "who came to dinner back then", "OpenClaw ingestion movies"))
    assert (timed.intent, timed.layers, timed.candidates, timed.summary_weight, timed.limits.below) == ("complex", ("year", "month", "week", "day"), 6, 1.3, {"day": 8, "week": 4, "month": 2})
    assert (vague.intent, vague.layers, vague.candidates, vague.row_weight, vague.limits.support) == ("hybrid", ("week", "day"), 5, 1.2, 6)
    assert (plain.intent, plain.layers, plain.candidates, plain.limits.tokens) == ("simple", (), 4, 80)
    assert plain.terms == ["OpenClaw", "ingestion", "movie", "film"]
    assert planner.query_terms("habits goals skills of NASA v1.2", planner.Window()) == ["v1.2", "NASA", "routine", "routines", "habit", "habits"]
    assert planner.plan("why did it fail", NOW).hierarchy_rows == 6
    assert planner.plan("June 12 2025", NOW).row_weight == 1.35


def test_alike_names_equal_all_pairs(spark):
    """Names that meet by their rarest letter pairs are those that a comparison of all finds; empty and null names too."""
    pick = random.Random(5)
    names = sorted({"".join(pick.choice("aab bc") for _ in range(pick.randint(0, 12))) for _ in range(300)})
    rows = spark.createDataFrame([(pick.randint(0, 1), n) for n in names] + [(0, None), (0, names[3])], "s int, n string")
    every = rows.distinct().select("s", F.col("n").alias("x")).join(rows.distinct().select("s", F.col("n").alias("y")), "s").filter("x < y")
    for least in (0.55, 0.84):
        want = {tuple(r) for r in every.filter(identity.name_likeness(F.col("x"), F.col("y")) >= least).collect()}
        got = [tuple(r) for r in identity.alike_names(rows, "s", "n", least).select("s", "name_a", "name_b").collect()]
        assert want and sorted(got) == sorted(want)


def test_shared_neighbours_of_given_pairs(spark):
    edges = spark.createDataFrame([(1, "x", "likes"), (1, "y", "knows"), (2, "x", "likes"), (2, "y", "owns"), (3, "z", "owns"), (2, "x", "owns")], "id int, n string, p string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert sorted(map(tuple, identity.with_shared(pairs, edges, "id", "n", "p").collect())) == [(1, 2, 2, True), (1, 3, 0, False)]


@pytest.mark.parametrize(
    ("question", "start", "end", "granularity"),
    [
        ("Who was I with in Chiang Mai in 2026?", "2026-01-01T00:00:00", "2026-12-31T23:59:59.999000", "year"),
        ("What did I do in June 2025?", "2025-06-01T00:00:00", "2025-06-30T23:59:59.999000", "month"),
        ("What happened on June 12 2025?", "2025-06-12T00:00:00", "2025-06-12T23:59:59.999000", "day"),
        ("what was said yesterday", "2026-03-10T00:00:00", "2026-03-10T23:59:59.999000", "day"),
        ("plans of last weekend", "2026-03-07T00:00:00", "2026-03-08T23:59:59.999000", "broad"),
        ("last week's work", "2026-03-02T00:00:00", "2026-03-08T23:59:59.999000", "broad"),
        ("3 months ago", "2025-12-01T00:00:00", "2025-12-31T23:59:59.999000", "month"),
        ("two weeks after June 12 2025?", "2025-06-26T00:00:00", "2025-06-26T23:59:59.999000", "day"),
        ("one month before March 31st, 2025", "2025-02-28T00:00:00", "2025-02-28T23:59:59.999000", "day"),
        ("winter 2024", "2024-12-01T00:00:00", "2025-02-28T23:59:59.999000", "broad"),
    ],
)
def test_time_windows(question, start, end, granularity):
    w = planner.infer_window(question, NOW)
    assert (w.start.isoformat(), w.inclusive_end.isoformat(), w.granularity) == (start, end, granularity)


def test_plans():
    made = planner.plan("Who was I with in Chiang Mai in 2026?", NOW)
    assert made.descend == ("month", "week", "day") and made.terms == ["Chiang", "Mai"]
    assert planner.plan("What did I do in June 2025?", NOW).descend == ("week", "day")
    none = planner.plan("Tell me about OpenClaw markdown ingestion", NOW)
    assert none.window.start is None and none.kind == "direct_fact" and "OpenClaw" in none.terms
    assert planner.plan("why did it fail in 2025", NOW).kind == "causal"
    assert planner.plan("who both know Ann", NOW).hops == 3
    assert planner.infer_window("February 31 2025", NOW).granularity == "year"


def test_search(spark):
    rows = spark.createDataFrame([(1, "red fox in the snow", datetime(2025, 6, 3)), (2, "red fox again", datetime(2025, 6, 9)), (3, "red fox", datetime(2024, 6, 9)), (4, "blue bird", datetime(2025, 6, 4))], "id int, text string, at timestamp")
    found = planner.search(spark, rows, "red fox in June 2025", NOW, "id", ts="at").collect()
    assert {r.id for r in found} == {1, 2} and [r["rank"] for r in found] == [1, 2]


def test_cut_long():
    body = "word " * 600
    spans = text.cut_long(body.strip())
    assert all(e - s <= 1200 for s, e in spans) and " ".join(body[s:e] for s, e in spans) == body.strip()
    assert text.cut_long("x" * 2500) == [(0, 1200), (1200, 2400), (2400, 2500)] and text.cut_long("") == []


def test_text_rows(spark):
    docs = spark.createDataFrame([(1, "# Title\r\n\r\nOne. Two! Three? Four.\n\nCaptured: now\n\nLast one"), (2, "")], "id int, text string")
    scenes = text.scenes(docs, "id")
    assert [r.scene_text for r in scenes.collect()] == ["One. Two! Three? Four.", "Last one"]
    assert [r.fragment_text for r in text.fragments(scenes, "id").orderBy("scene", "fragment").collect()] == ["One. Two! Three?", "Four.", "Last one"]


def test_topic_segments(spark):
    turns = [(1, 0, "a", "apples grow on trees"), (1, 1, "b", "apples are sweet"), (1, 2, "a", "engines need petrol"), (1, 3, "b", "petrol prices"), (2, 0, "a", "alone here")]
    got = text.topic_segments(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.first_turn, r.last_turn) for r in got) == [(1, 0, 1), (1, 2, 3)]


def test_secrets(spark):
    secrets = {
        "private_key": "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "openai_key": "sk-" + "a1" * 12, "github_token": "ghp_" + "b2" * 12,
        "database_url": "postgres://u:p@h/db", "jwt": ".".join(["eyJ" + "a" * 12, "b" * 12, "c" * 12]), "session_cookie": "session: " + "x" * 30, "oauth_secret": "client_secret=" + "y" * 24, "env_secret": "MY_API_KEY=abc",
    }
    df = spark.createDataFrame([(k, f"see {v} there") for k, v in secrets.items()] + [("none", "plain text")], "kind string, text string")
    for r in df.select("kind", scalar.redact(F.col("text")).alias("out"), scalar.secret_kinds(F.col("text")).alias("kinds"), scalar.privacy_tier(F.col("text")).alias("tier")).collect():
        assert r.kinds == ([] if r.kind == "none" else [r.kind])
        assert r.tier == ("normal" if r.kind == "none" else "secret_risk")
        assert r.kind == "none" or r.out == f"see [REDACTED:{r.kind}] there"


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "Bob: I met Ann in Paris on 2024-05-06.\nnoise\nAnn: I prefer tea. March 3, 2024 was fine. On 2024-13-01 not")], "id int, text string")
    assert [(r.speaker, r.turn) for r in extract.speaker_turns(docs, "id").collect()] == [("Bob", 0), ("Ann", 1)]
    assert sorted(str(r.day) for r in extract.explicit_dates(docs, "id").collect()) == ["2024-03-03", "2024-05-06"]
    assert [(r.family, r.statement) for r in extract.statements(docs, "id").collect()] == [("preference", "tea")]
    found = {(r.kind, r.name) for r in extract.mentions(docs, "id").collect()}
    assert ("person", "Ann") in found and ("place", "Paris") in found
    edges = extract.rule_edges(spark.createDataFrame([(1, "Bob")], "id int, subject string"), extract.mentions(docs, "id"), "id").collect()
    assert ("Bob", "with", "Ann", 0.82) in {(r.subject, r.predicate, r.object, r.confidence) for r in edges}


def test_transcripts_and_logs(spark):
    segments = {"segments": [{"start": 0, "end": 1.5, "text": "hi", "speaker": "A"}]}
    words = {"words": [{"word": "a", "start": 0, "end": 0.2, "speaker": "A"}, {"word": "b", "start": 0.2, "end": 0.4, "speaker": "A"}, {"word": "c", "start": 0.4, "end": 1, "speaker": "B"}]}
    rows = spark.createDataFrame([(1, json.dumps(segments)), (2, json.dumps(words)), (3, "broken")], "id int, payload string")
    got = sorted((r.id, r.nth, r.speaker, r.text, r.start_ms, r.end_ms) for r in extract.utterances(rows, "id", "payload").collect())
    assert got == [(1, 0, "A", "hi", 0, 1500), (2, 0, "A", "a b", 0, 400), (2, 1, "B", "c", 400, 1000)]
    lines = spark.createDataFrame([("s", '{"type": "user_message", "index": 1, "text": "go"}'), ("s", "{oops")], "session string, line string")
    events = {r.event_index: r for r in extract.session_events(lines, "session", "line").collect()}
    assert events[1].category == "user_message" and events[None].broken


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# hello")
    (tmp_path / "in" / "b.bin").write_text("no")
    assert [r.text for r in tables.text_files(spark, str(tmp_path / "in")).collect()] == ["# hello"]
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n{bad\n')
    read = tables.json_lines(spark, str(tmp_path / "log.jsonl"), "a int").collect()
    assert sorted(str(r.a) for r in read) == ["1", "None"]
    hook = spark.createDataFrame([('{"event_id": "e1", "event_time": "t", "event": {"channel": "c", "user": "u", "text": "hey"}}',), ('{"id": "d1", "content": "yo", "author": {"username": "z"}}',)], "value string")
    assert [(r.event_id, r.user, r.text) for r in tables.webhook_messages(hook).collect()] == [("e1", "u", "hey"), ("d1", "z", "yo")]
    days = spark.createDataFrame([(1, datetime(2024, 1, 2)), (2, datetime(2024, 1, 3))], "id int, ts timestamp")
    tables.write_by_day(days, "ts", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("d = 3").select("id").collect()[0].id == 2
    pages = spark.createDataFrame([(1, "one\ftwo"), (2, "a\n--- page 2 ---\nb"), (3, "whole")], "id int, text string")
    assert sorted((r.id, r.page, r.page_text) for r in tables.page_parts(pages, "id", "text").collect()) == [(1, 0, "one"), (1, 1, "two"), (2, 0, "a"), (2, 1, "b"), (3, 0, "whole")]
    assert spark.createDataFrame([("<p>a<script>x</script> &b</p>",)], "h string").select(tables.html_text(F.col("h")).alias("t")).first().t == "a &b"


def test_graph_cycles_and_chains(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    found = {(r.node, r.ancestor): r.depth for r in graph.climb(edges, "child", "parent").collect()}
    assert found[("d", "c")] == 3 and ("a", "a") not in found and len(found) == 9
    chain = [(i, i - 1 if i else None) for i in range(30)] + [(100, 101), (101, 100)]
    ends = {r.node: r.canonical for r in graph.resolve_redirects(spark.createDataFrame(chain, "n int, t int"), "n", "t").collect()}
    assert all(ends[i] == 0 for i in range(13)) and ends[29] is None and ends[100] is None


def test_versions_never_overlap(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("xy"), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(500)), i) for i, k in enumerate([1, 2, 3] * 60)]
    got = lifecycle.versions(spark.createDataFrame(rows, "k int, s string, at timestamp, i int"), "k", "s", "at", "i").orderBy("k", "version").collect()
    for a, b in zip(got, got[1:], strict=False):
        if a.k == b.k:
            assert a.valid_until == b.valid_from and a.s != b.s and b.version == a.version + 1
        else:
            assert a.valid_until is None and b.version == 1


def test_register_and_overlay(spark):
    stored = spark.createDataFrame([("u", "old", 3)], "uri string, checksum string, version int")
    new = lifecycle.register(stored, spark.createDataFrame([("u", "text"), ("u", "text"), ("v", "text")], "uri string, body string"), "uri", "body").collect()
    assert sorted((r.uri, r.version) for r in new) == [("u", 4), ("v", 1)]
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, t string")
    actions = spark.createDataFrame([(1, "delete", None, 1, False), (2, "redact", None, 1, False), (3, "delete", None, 1, False), (3, "delete", None, 2, True)], "k int, action string, label string, applied_at int, reverted boolean")
    assert sorted((r.k, r.t) for r in lifecycle.overlay(rows, actions, "k", "t").collect()) == [(2, "[REDACTED]"), (3, "c")]


def test_straddling_week_has_no_month(spark):
    events = spark.createDataFrame([(datetime(2024, 1, 31),), (datetime(2024, 1, 10),)], "ts timestamp_ntz")
    links = {r.node_id: r.parent_id for r in temporal.parent_links(temporal.nodes(events, "ts")).collect()}
    assert links["week:2024-01-29"] is None and links["week:2024-01-08"] == "month:2024-01-01" and links["day:2024-01-31"] == "week:2024-01-29"


def test_fusion_and_mmr(spark):
    one = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "q int, id int, rank int")
    two = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "q int, id int, rank int")
    fused = retrieval.reciprocal_rank_fusion([one, two], "q", "id").orderBy("rank").collect()
    assert [r.id for r in fused] == [2, 1, 3] and fused[0].rrf_score == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)
    pool = spark.createDataFrame([(0, 1, 1.0, ["a", "b"]), (0, 2, 0.95, ["a", "b"]), (0, 3, 0.8, ["c"])], "q long, id long, r double, t array<string>")
    assert [r.id for r in retrieval.mmr(pool, "q", "id", "r", "t").orderBy("rank").collect()] == [1, 3, 2]


def test_identity(spark):
    entities = spark.createDataFrame([(1, "Ann Lee", True), (2, "ann-lee", False), (3, "Bob", True)], "id int, name string, verified boolean")
    aliases = spark.createDataFrame([(3, "Ann Lee")], "id int, alias string")
    found = identity.candidates(spark.createDataFrame([("Ann Lee",)], "name string"), entities, aliases).orderBy("rank").collect()
    assert [(r.id, r.kind) for r in found] == [(1, 0), (2, 1), (3, 2)]
    names = spark.createDataFrame([(1, "anna"), (2, "anne"), (3, "bnna"), (4, "ann"), (5, "anneke")], "id int, name string")
    assert {(r.a, r.b) for r in identity.similar_names(names, "id", "name").collect()} == {(1, 2), (1, 4), (2, 4)}


def test_precision_recall_of_nothing(spark):
    none = spark.createDataFrame([], "c int, x string")
    some = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "c int, x string")
    assert tuple(evaluation.precision_recall(some, none, "c", "x").first()) == (1, 0.0, 1.0, 0.0)
    half = spark.createDataFrame([(1, "a")], "c int, x string")
    assert tuple(evaluation.precision_recall(half, some, "c", "x").first()) == (1, 1.0, 0.5, 0.667)


def test_as_of_and_budget(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, at int")
    right = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (2, 10, "z")], "k int, seen_at int, v string")
    assert sorted((r.k, r.at, r.v_as_of) for r in relational.as_of(left, right, "k", "at", "seen_at", "v").collect()) == [(1, 1, None), (1, 5, "y"), (2, 9, None)]
    rows = spark.createDataFrame([(1, i, 10) for i in range(5)], "g int, i int, n int")
    assert relational.within_budget(rows, ["g"], [F.asc("i")], F.col("n"), 25).count() == 2


def test_streams_are_exactly_once(spark, tmp_path):
    rows = spark.createDataFrame([(i % 10, datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(40)], "id int, ts timestamp")
    rows.repartition(4).write.parquet(str(tmp_path / "events"))
    stream = streams.source(spark, str(tmp_path / "events"), 1)
    assert streams.drain(streams.idempotent(stream, ["id"], "ts", "1 day")).count() == 10
    assert streams.sessions(rows, "id", "ts", "5 minutes").count() == 40
