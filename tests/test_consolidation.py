"""Changes in groups that span parts, and the consolidation cascade against a plain fold."""

from __future__ import annotations

import random

import pytest

from memlake.operators import consolidation, relational


@pytest.mark.parametrize("seed", [1, 2])
def test_numbered_changes_with_a_hot_group(spark, seed):
    rng = random.Random(seed)
    rows = [(1 if rng.random() < 0.6 else rng.randrange(12), i, rng.choice(["a", "b", None])) for i in range(900)]
    rows += [(20, i, "same") for i in range(900, 1300)]
    got = {r.n: (r.before, r.is_change, r.version) for r in relational.numbered_changes(spark.createDataFrame(rows, "g long, n long, v string").repartition(5), ["g"], ["n"], "v").collect()}
    state = {}
    for g, n, v in rows:
        last, version, any_row = state.get(g, (None, 0, False))
        change = not any_row or v != last
        state[g] = (v, version + change, True)
        assert got[n] == (last, change, version + change)
    assert len(got) == len(rows)
    assert relational.numbered_changes(spark.createDataFrame([], "g long, n long, v string"), ["g"], ["n"], "v").count() == 0


CASES = [
    (1, "ann", "preference", "I really like green  Tea. I hate noise!", 1), (2, "ann", "preference", "I no longer like green tea", 3), (3, "ann", "preference", "I love green tea; I dislike noise", 2),
    (4, "ann", "goal", "My current goal is to run far.", 4), (5, "ann", "goal", "my goal is to rest", 5), (6, "ann", "plan", "I plan to move", 6), (7, "bob", "goal", "nothing stated", 1), (8, "bob", "skill", "I can swim", 2),
    (9, "bob", "skill", "I know how to swim.", 3), (10, "bob", "belief", "I think that rain is good", 1), (11, "bob", "belief", "I believe rain is bad", 2), (12, "bob", "constraint", "Never run tests; always run tests", 4),
    (13, "bob", "decision", "We decided on rust for the parser", 1), (14, "bob", "decision", "I decided to go for the parser", 2), (15, "bob", "style", "write in short lines", 1), (16, "bob", None, "I can fly", 1), (17, "bob", "plan", None, 1),
]


def test_cascade(spark):
    c = spark.createDataFrame(CASES, "id long, who string, family string, content string, at long").repartition(3)
    found = consolidation.consolidated(c, "who", "id", "family", "content", "at")
    got = {(r.id, r.nth): (r.key, r.value, r.decision, r.version) for r in found.collect()}
    assert got == {
        (1, 0): ("preference:green tea", "like", "ADD", 1), (1, 1): ("preference:noise", "dislike", "ADD", 1), (3, 0): ("preference:green tea", "like", "UPDATE", 1), (3, 1): ("preference:noise", "dislike", "UPDATE", 1),
        (2, 0): ("preference:green tea", "dislike", "SUPERSEDE", 2), (4, 0): ("goal:current", "run far", "ADD", 1), (5, 0): ("goal:current", "rest", "SUPERSEDE", 2), (6, 0): ("plan:current", "move", "ADD", 1),
        (8, 0): ("skill:swim", "stated", "ADD", 1), (9, 0): ("skill:swim", "stated", "UPDATE", 1), (10, 0): ("belief:rain", "good", "ADD", 1), (11, 0): ("belief:rain", "bad", "SUPERSEDE", 2),
        (12, 0): ("constraint:run tests", "never", "ADD", 1), (12, 1): ("constraint:run tests", "always", "SUPERSEDE", 2), (13, 0): ("decision:the parser", "rust", "ADD", 1), (14, 0): ("decision:the parser", "go", "SUPERSEDE", 2),
        (15, 0): ("style:short lines", "stated", "ADD", 1),
    }
    left = {(r.who, r.key): (r.value, r.confirmed) for r in consolidation.memories(found, "who", "at").filter("status = 'active'").collect()}
    assert left["ann", "preference:green tea"] == ("dislike", 0) and left["bob", "skill:swim"] == ("stated", 1) and left["ann", "goal:current"] == ("rest", 0)
    outcomes = {r.id: (r.status, r.promoted, r.superseded) for r in consolidation.candidate_outcomes(c, found, "id").collect()}
    assert len(outcomes) == 17 and outcomes[12] == ("accepted", 2, 1) and outcomes[3] == ("accepted", 0, 0) and {outcomes[i] for i in (7, 16, 17)} == {("rejected", 0, 0)}
