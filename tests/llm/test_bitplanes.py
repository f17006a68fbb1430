"""Bit-sliced comparison against plain popcounts, at bucket sizes from 1 to 10,000."""

from __future__ import annotations

import numpy as np
import pytest

from memlake.llm import simhash
from memlake.llm.bitplanes import Comparison, close_pairs as close, spanning_links


def labels(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def family(rng, n, flips, centres=1):
    """Distinct words scattered around some centres."""
    middle = rng.integers(0, 1 << 64, centres, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(n):
        bits = rng.choice(64, rng.integers(0, flips + 1), replace=False).astype(np.uint64)
        out[i] = middle[i % centres] ^ np.bitwise_or.reduce(np.uint64(1) << bits, initial=np.uint64(0))
    return np.unique(out)


def close_pairs(values, radius):
    for i in range(len(values) - 1):
        for j in i + 1 + np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius):
            yield i, int(j)


@pytest.mark.parametrize("sizes, flips, centres", [([1, 2, 3, 5, 63, 64, 65], 3, 2), ([700], 4, 1), ([300, 40, 900], 6, 40), ([2500], 3, 3), ([10_000], 2, 1)])
def test_spanning_links_equal_brute_force(sizes, flips, centres):
    rng = np.random.default_rng(sum(sizes))
    parts = [family(rng, n, flips, centres) for n in sizes]
    values, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
    found = list(spanning_links(sizes, lambda at: Comparison((values[at].view(np.uint8).reshape(-1, 8), 1, 4))))
    a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    assert (np.bitwise_count(values[a] ^ values[b]) <= 4).all()
    begin = np.cumsum(sizes) - sizes
    want = [(s + i, s + j) for s, p in zip(begin, parts, strict=True) for i, j in close_pairs(p, 4)]
    assert labels(len(values), zip(a, b, strict=True)) == labels(len(values), want)
    assert len(a) <= 3 * len(values)


@pytest.mark.parametrize("sizes", [[150], [60, 20, 1, 69]])
def test_digits_and_close_pairs(sizes):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (1, 20), np.uint8)
    codes = np.where(rng.random((150, 20)) < 0.2, rng.integers(0, 256, (150, 20), np.uint8), base)
    four = np.stack([codes & 15, codes >> 4], axis=2).reshape(150, 40)
    label, bucket = rng.integers(0, 3, 150), np.repeat(np.arange(len(sizes)), sizes)
    got = {(int(x), int(y)) for a, b in close(np.array(sizes), lambda at: Comparison((codes[at], 4, 12)), label) for x, y in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if (four[i] != four[j]).sum() <= 12 and label[i] != label[j] and bucket[i] == bucket[j]}
    assert got


def test_large_buckets_are_dealt_again(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([family(rng, 3000, 6, 30), rng.integers(0, 1 << 64, 200, np.uint64)])
    values = np.unique(values)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    want = labels(len(values), close_pairs(values, 4))
    for limit in (50, 10_000):
        found = [(place[r.a], place[r.b]) for r in simhash.links(df, limit=limit).collect()]
        assert labels(len(values), found) == want
