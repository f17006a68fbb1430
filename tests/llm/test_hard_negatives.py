"""Operator 13 against brute force, with ties, copies, hot labels, negative scores and odd rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from memlake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=5, percent=80):
    use = [(i, label, [max(-hn.LARGEST, min(hn.LARGEST, math.floor(256 * x))) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, of, q in use:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(q, w, strict=False)), i, label == of) for i, label, w in use if i != a]
        for p, i, _ in sorted(x for x in scored if x[2])[:k]:
            inside = sorted(x for x in scored if not x[2] and percent * -p <= 100 * -x[0] <= 100 * -p)
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(inside[:k])]
    return sorted(out)


def table(seed=3, n=400, spread=0.4, dims=8, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        label = 1 if rng.random() < 0.4 else rng.randrange(5)
        rows.append((rng.choice([i, i, i * 10, -i]) if i % 9 else i * 100, [scale * (x + rng.gauss(0, spread)) for x in c], label))
    return rows


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(tuple, hn.mine(df, F.col("vec_id") % 100 == 0, **options).collect()))


def test_equals_brute_force(spark, monkeypatch):
    rows = table()
    assert mined(spark, rows) == brute(rows) != []
    monkeypatch.setattr(hn, "GROUP_ROWS", 64)  # many row and anchor groups, many digits
    monkeypatch.setattr(hn, "GROUP_ANCHORS", 16)
    monkeypatch.setattr(hn, "DIGIT", 2)
    assert mined(spark, rows) == brute(rows)


def test_copies_ties_and_large_scores(spark):
    rng = random.Random(5)
    same = [0.5, -0.25, 0.75]
    rows = [(i, same if i % 3 else [x * rng.choice([1, 0.99, 0.9]) for x in same], rng.randrange(3)) for i in range(300)]
    rows += rows[:5] + [(100, [0.1, 0.2, 0.3], 2)]  # repeated rows, and another vector of an id
    assert mined(spark, rows) == brute(rows) != []
    big = table(seed=6, n=150, scale=9000.0)  # scores of over 2**40
    assert mined(spark, big) == brute(big) != []


def test_odd_rows(spark):
    rows = [(0, None, 1), (100, [1.0, None], 1), (200, [1.0, float("nan")], 1), (None, [1.0, 1.0], 1), (300, [1.0, 1.0], None), (400, [1.0, 0.5], 1), (1, [1.0, 0.5, 3.0], 1), (2, [1.0], 2), (3, [], 2), (500, [0.0, 0.0], 1), (600, [-1.0, -1.0], 1), (700, [1e300, -1e300], 3), (701, [1e300], 3), (4, [1e300], 2)]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, [(100, [1.0], 1)]) == [] == mined(spark, [(1, [1.0], 1)])
    empty = spark.createDataFrame([], SCHEMA + ", anchor long, slot int, q string")
    assert hn.mine(empty, F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("k, percent", [(1, 50), (3, 100), (40, 0)])
def test_parameters(spark, k, percent):
    rows = table(seed=8, n=150)
    assert mined(spark, rows, k=k, percent=percent) == brute(rows, k, percent)
