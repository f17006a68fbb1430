"""Names within a few edits: blocks and tiles of any size give all pairs, and no pair is shuffled."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from memlake.operators import identity
from memlake.plans import catalog_memory


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def names_of(rng, n):
    """Dense short names, near copies of long ones (beyond the letters of a block), letters of two, three and four bytes."""
    made = ["".join(rng.choice("abéß") for _ in range(rng.randrange(1, 8))) for _ in range(n)]
    for start in ("a" * 70, "é日本𝒜" * 20, "x", "𝒜b"):
        for _ in range(6):
            text = list(start)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.randrange(2)] = rng.choice(["", "q", "日", "qq"])
            made.append("".join(text))
    return made


@pytest.mark.parametrize("most", [0, 2, 3])
def test_tiles_give_every_pair_once(spark, monkeypatch, most):
    rng = random.Random(most)
    rows = list(enumerate(names_of(rng, 110))) + [(3, "ab"), (3, "abb"), (900, "AB"), (901, "ab"), (None, "ab"), (902, None), (903, ""), (900, "AB")]
    known = sorted({(i, n.lower()) for i, n in rows if i is not None and n})
    expected = sorted((i, j, a, b, d) for (i, a), (j, b) in combinations(known, 2) if i != j and a[0] == b[0] and (d := distance(a, b)) <= most)
    df = spark.createDataFrame(rows, "id long, name string")
    for side, pairs in ((8192, 1 << 24), (9, 50)):
        monkeypatch.setattr(identity, "SIDE", side)
        monkeypatch.setattr(identity, "PAIRS", pairs)
        got = identity.names_within(df, "id", "name", most)
        assert sorted((r.a, r.b, r.name_a, r.name_b, r.distance) for r in got.collect()) == expected
    assert got.rdd.getNumPartitions() > 5


def test_no_names_no_pairs(spark):
    assert identity.names_within(spark.createDataFrame([], "id long, name string"), "id", "name", 2).collect() == []


@pytest.mark.parametrize("most", [2, 3])
def test_pairs_are_not_shuffled(spark, most):
    """Every row that is shuffled is a name on its way to a tile, so a task's memory and the shuffle don't grow with the pairs."""
    query = {2: catalog_memory.e5_names_within_2, 3: catalog_memory.e5_names_within_3}[most]
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    measured = re.search("FlatMapGroupsInArrow|levenshtein", plan)
    assert measured and "Exchange" not in plan[: measured.start()] and "levenshtein" not in plan


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_distances_near_the_diagonal(most):
    rng = random.Random(most)
    for l, m in ((0, 0), (0, most), (1, 1), (4, 4 + most), (6, 6), (7, 8), (300, 301)):
        xs, ys = ([[rng.randrange(3) for _ in range(n)] for _ in range(6)] for n in (l, m))
        ys += [(x + [0] * m)[:m] for x in xs]
        x, y = np.divmod(np.arange(len(xs) * len(ys)), len(ys))
        codes = [np.array(c, np.uint8).reshape(len(c), n).T for c, n in ((xs, l), (ys, m))]
        for i, j, d in zip(x, y, identity._distances(*codes, x, y, most), strict=True):
            want = distance(xs[i], ys[j])
            assert d == want if want <= most else d > most


@pytest.mark.parametrize("chunk", [5, 1 << 18])
@pytest.mark.parametrize("longer", [None, 0, 1, 2])
def test_few_pairs_of_like_letters_are_measured(monkeypatch, chunk, longer):
    """Anagrams agree in all letters: neighbours rule most of them out, in chunks of any size, and no near pair."""
    rng, most, measured = random.Random(7), 2, [0]
    xs = ["t" + "".join(rng.sample("abcdefghijkl", 12)) for _ in range(60)]
    ys = [] if longer is None else [x + "q" * longer if longer else x[:5] + x[6:] + "q" for x in xs[:40]] + ["t" + "".join(rng.sample("abcdefghijkl", 12)) + "q" * longer for _ in range(40)]
    xs += [x[:4] + x[5] + x[4] + x[6:] for x in xs[:30]]
    table = pa.table({"id": list(range(len(xs + ys))), "n": xs + ys, "left": [True] * len(xs) + [False] * len(ys)})
    exact = identity._distances

    def counted(x_codes, y_codes, x, y, most):
        measured[0] += len(x)
        return exact(x_codes, y_codes, x, y, most)

    monkeypatch.setattr(identity, "CHUNK", chunk)
    monkeypatch.setattr(identity, "_distances", counted)
    key = tuple(pa.scalar(v) for v in ("t", 13, 13 + (longer or 0), 0, 0 if longer is None else 1))
    got = [(r["a"], r["b"], r["distance"]) for b in identity._near_in_tile(most)(key, iter(table.to_batches())) for r in b.to_pylist()]
    pairs = list(combinations(range(len(xs)), 2)) if longer is None else [(i, len(xs) + j) for i in range(len(xs)) for j in range(len(ys))]
    names = xs + ys
    assert sorted(got) == [(i, j, d) for i, j in pairs if (d := distance(names[i], names[j])) <= most]
    assert got and measured[0] < len(pairs) / 10


def test_names_travel_with_ids_of_32_bytes(spark):
    assert {len(r.id) for r in catalog_memory._names(spark, "/root/testdata/sf0.001").collect()} == {32}
