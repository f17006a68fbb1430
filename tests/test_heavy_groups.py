"""Groups that one task should not hold: tiles of pairs, running totals, budgets; and a summary graph with cycles."""

from __future__ import annotations

import random
from collections import Counter, deque
from itertools import combinations

from pyspark.sql import functions as F

from memlake.operators import graph, relational


def test_pairs_in_tiles_equal_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, *range(1, 30)]), rng.randrange(400)) for _ in range(3000)] + [(None, 3)]
    groups: dict = {}
    for g, m in rows:
        groups.setdefault(g, set()).add(m)
    groups.pop(None)
    expected = Counter((g, *p) for g, ms in groups.items() for p in combinations(sorted(ms), 2))
    df = spark.createDataFrame(rows, "g long, m long")
    for tile in (7, 50, 10_000):
        assert Counter(map(tuple, relational.pairs_within(df, "g", "m", tile).select("g", "a", "b").collect())) == expected


def test_running_totals_across_parts(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "x", "y", None]), n, rng.randrange(9)) for n in range(1500)]
    got = {r.n: r.total for r in relational.running_total(spark.createDataFrame(rows, "g string, n long, size long").repartition(6), ["g"], [F.desc("n")], F.col("size"), "total").collect()}
    sums: Counter = Counter()
    for g, n, size in sorted(rows, key=lambda r: -r[1]):
        sums[g] += size
        assert got[n] == sums[g]
    assert len(got) == len(rows)


def test_expansion_counts_shared_nodes_once_and_keeps_its_budget(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(150)] + [(1, 1), (None, 2), (3, None)]
    below: dict = {}
    for p, c in edges:
        if p is not None and c is not None:
            below.setdefault(p, set()).add(c)
    for budget in (1, 5, 1000):
        expected = set()
        for seed in range(10):
            seen, level, distance = {seed: 0}, deque([seed]), 0
            while level:
                distance += 1
                fresh = sorted({c for n in level for c in below.get(n, ())} - seen.keys())[: budget + 1 - len(seen)]
                seen |= dict.fromkeys(fresh, distance)
                level = fresh
            expected |= {(seed, n, d) for n, d in seen.items() if d}
        got = graph.expand_down(spark.createDataFrame(edges, "p long, c long"), spark.range(10).withColumnRenamed("id", "seed"), "p", "c", budget, 60)
        assert set(map(tuple, got.collect())) == expected


def test_pairs_are_counted_once_for_all_sources_and_by_a_growing_number_of_tasks(spark, monkeypatch):
    rng = random.Random(4)
    rows = {name: [(rng.choice([None, 0, 0, *range(1, 40)]), rng.choice([None, *range(150)])) for _ in range(1500)] for name in ("one", "two")}
    expected: dict = {}
    for name, found in rows.items():
        groups: dict = {}
        for g, m in found:
            if g is not None and m is not None:
                groups.setdefault(g, set()).add(m)
        for ms in groups.values():
            for p in combinations(sorted(ms), 2):
                expected.setdefault(p, Counter())[name] += 1
    monkeypatch.setattr(relational, "PAIRS", 500)
    for tile in (9, 2048):
        got = relational.pair_counts(tile, **{name: (spark.createDataFrame(found, "g long, m long"), "g", "m") for name, found in rows.items()})
        assert {(r.a, r.b): Counter({k: n for k, n in (("one", r.one), ("two", r.two)) if n}) for r in got.collect()} == expected
        assert got.rdd.getNumPartitions() > 30


def _shuffled(plan):
    """Bytes that all exchanges of an executed plan have sent, before compression."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        return _shuffled(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
    own = plan.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_pairs_of_large_groups_are_not_sent_as_lists_of_partners(spark):
    """Partners listed for each member take n * n / 2 numbers of a group of n members, whatever their encoding."""
    n = 3000
    rows = spark.range(2 * n).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).alias("m"))
    for tile in (None, 2 * n):
        counts = relational.pair_counts(tile, one=(rows, "g", "m"), two=(rows.filter("g = 1"), "g", "m"))
        at = counts.agg(F.count(F.lit(1)), F.min("one"), F.max("one"), F.min("two"), F.max("two"), F.max("b"))
        assert tuple(at.collect()[0]) == (n * (n - 1) // 2, 2, 2, 1, 1, n - 1)
        assert 50_000 < _shuffled(at._jdf.queryExecution().executedPlan()) < 3_000_000


def test_pairs_of_members_of_any_kind(spark):
    rng = random.Random(5)
    kinds = {
        "long": [rng.choice([-1, 1]) * rng.choice([7, 10**6, 2**61 + 5]) * rng.randrange(1, 3) for _ in range(20)] + [2**63 - 1, -(2**63)],
        "int": [rng.randrange(-40, 40) for _ in range(30)],
        "bigint": [96_000 * n for n in range(25)],
        "string": ["é" * n for n in range(20)],
    }
    for kind, members in kinds.items():
        rows = [(rng.randrange(6), rng.choice(members)) for _ in range(300)]
        groups: dict = {}
        for g, m in rows:
            groups.setdefault(g, set()).add(m)
        expected = Counter(p for ms in groups.values() for p in combinations(sorted(ms), 2))
        for tile in (4, 2048):
            got = relational.pair_counts(tile, n=(spark.createDataFrame(rows, f"g long, m {kind}"), "g", "m"))
            assert {(r.a, r.b): r.n for r in got.collect()} == expected and got.schema["a"].dataType.simpleString() == kind.replace("long", "bigint")
    assert relational.pair_counts(n=(spark.createDataFrame([], "g long, m long"), "g", "m")).count() == 0


def test_mirrored_edges_are_made_in_one_pass(spark):
    edges = spark.createDataFrame([(1, 2, "x"), (None, 3, "y")], "a long, b long, w string")
    both = relational.mirrored(edges)
    assert sorted(map(tuple, both.collect()), key=repr) == sorted([(1, 2, "x"), (2, 1, "x"), (None, 3, "y"), (3, None, "y")], key=repr)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
