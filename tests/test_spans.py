"""Lanes and spans on written cases, scheduling and name distances against brute force."""

from __future__ import annotations

import itertools
import random

import pytest

from memlake.operators import identity, spans


def test_scheduling_is_the_best_choice():
    rng = random.Random(3)
    for _ in range(60):
        some = [(a := rng.randrange(20), a + rng.randrange(1, 8), float(rng.randrange(1, 9)), n) for n in range(8)]
        free = lambda c: all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(c, 2))
        best = max(sum(s[2] for s in c) for r in range(9) for c in itertools.combinations(some, r) if free(c))
        got = spans.scheduled(some)
        assert free(got) and sum(s[2] for s in got) == best
    assert spans.scheduled([]) == []


TEXT = "İ said: I don't like wet socks. Ann Lee had lunch with Bob Ray on 12 May 2024, then WATCHED Dune! rewatched it; whatched. I love tea"


def test_lanes(spark):
    rows = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "I love .")], "id long, text string")
    got = [tuple(r) for r in spans.typed_lanes(rows, ["id"], "text").collect()]
    assert [r[1:6] for r in got] == [
        ("preference", "dislikes", None, "wet socks", None), ("person_time", "met", "Ann Lee", "Bob Ray", "12 May 2024"), ("media", "watched", None, "Dune", None), ("preference", "likes", None, "tea", None),
    ]
    assert [TEXT[a:b] for *_, a, b in got] == ["I don't like wet socks", "had lunch with Bob Ray on 12 May 2024", "WATCHED Dune", "I love tea"]


def test_spans_cut_the_text(spark):
    text = "Ann works as a nurse and visited Rome, May 2024.\nShe was born in 1990; it costs 5\n\n Tomorrow she went to 2024-05-06 fairs"
    got = {(r.kind, text[r.starts : r.ends]) for r in spans.answerable_spans(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), ["id"], "text").collect()}
    assert got == {
        ("turn", text), ("sentence", "Ann works as a nurse and visited Rome, May 2024."), ("sentence", "She was born in 1990; it costs 5"), ("sentence", "Tomorrow she went to 2024-05-06 fairs"), ("date", "May 2024"), ("date", "1990"), ("date", "Tomorrow"),
        ("date", "2024-05-06"), ("event", "Ann works as a nurse and visited Rome"), ("fact", "She was born in 1990"), ("fact", "it costs 5"), ("event", "Tomorrow she went to 2024-05-06 fairs"),
    }


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_names_within_equal_all_pairs(spark, most):
    rng = random.Random(most)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(120)} | {"x", "xy", "xyzzy", "y"})
    rows = list(enumerate(names)) + [(500, names[0])]
    got = {(r.a, r.b, r.distance) for r in identity.names_within(spark.createDataFrame(rows, "id long, name string"), "id", "name", most).collect()}
    assert got == {(i, j, d) for (i, a), (j, b) in itertools.combinations(rows, 2) if a[0] == b[0] and (d := distance(a, b)) <= most}
