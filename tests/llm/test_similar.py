"""The pipeline's near-duplicate stage against exact similarity of all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from memlake.llm import simhash, similar


def exact_sets(rows):
    out = {}
    for i, t in rows:
        own = (t or "").lower().split()
        out[i] = {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()
    return out


def groups_of(rows):
    sets = exact_sets(rows)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * both >= 4 * either:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: find(i) for i in ids}


def edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def test_stage_keeps_one_of_each_similar_group(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        rows.append(base)
        # about 5 shingles change with a word: similarities on both sides of 0.8, where fingerprints differ in many bits
        rows += [edited(rng, base, max(1, round(len(base) * share))) for share in (0.008, 0.015, 0.02, 0.022, 0.03, 0.05)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, None), (901, ""), (902, "one two"), (903, "One  two")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {g for g in groups_of(rows).values()}
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert got == want
    assert len({r.doc_id for r in simhash.keep_one(docs, width=5).collect()} - want) > 20


def test_odd_inputs(spark):
    schema = "doc_id long, text string, node long, n string"
    rows = [(None, "no id " * 9, 1, "x"), (None, None, 1, "x"), (1, "same words here " * 9, 1, "x"), (1, "same words here " * 9, 1, "x"), (1, "other words " * 9, 1, "x")]
    kept = similar.keep_one(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "node", "n"] and kept.count() == 4
    assert similar.keep_one(spark.createDataFrame([], schema)).count() == 0
