"""Operator 11 is trained and calibrated on every labelled candidate, however few one task holds."""

from __future__ import annotations

from collections import Counter

import numpy as np
from test_secret_scan import SCHEMA, corpus

from memlake.llm import secret_scan as ss


def test_no_candidate_is_left_out(spark, monkeypatch):
    rows = ss.labelled(ss.scan(spark.createDataFrame(corpus(n=200), SCHEMA)))
    every = Counter(map(tuple, rows.filter("fold < 2").select("region", "lead", "size", "secret").collect()))
    n = {secret: sum(k[3] == secret for k in every) for secret in (False, True)}
    shards = ss.dealt(rows.filter("fold < 2"), n, 40).collect()
    assert {(r.region, r.lead, r.size, r.secret) for r in shards} == set(every)
    frequent = max(n, key=n.get)
    assert sum(r.secret == frequent for r in shards) == n[frequent] and max(Counter((r.shard, r.secret) for r in shards).values()) <= 80
    assert all({r.secret for r in shards if r.shard == i} == {False, True} for i in {r.shard for r in shards})
    seen = set()
    monkeypatch.setattr(ss.Network, "gradients", lambda net, regions, labels, weights: seen.update(int(r[0]) for r in regions) or [np.zeros_like(v) for v in net.values()])
    ss.train(ss.Network.new(), [np.array([i]) for i in range(200)], np.arange(200) % 10 == 0, 1)
    assert seen == set(range(200))
    monkeypatch.undo()
    net = ss.Network.new()
    assert sum(r.n for r in ss.counted(rows.filter("fold = 2"), net).collect()) == rows.filter("fold = 2").count()


def test_threshold_of_counts_is_that_of_rows():
    rng = np.random.default_rng(1)
    logit, labels = np.round(rng.normal(0, 2, 500), 1), rng.integers(0, 2, 500)
    logit = logit + 2 * labels
    bins, at = np.unique(np.stack([np.round(logit * 10), labels], axis=1), axis=0, return_inverse=True)
    counts = np.bincount(at.reshape(-1)).astype(float)
    one = ss.calibrated(ss.Network.new(), logit, np.ones(500), labels, np.zeros(500), 0.9)
    two = ss.calibrated(ss.Network.new(), bins[:, 0] / 10, counts, bins[:, 1], np.zeros(len(bins)), 0.9)
    np.testing.assert_allclose([*one.calibration, *one.thresholds], [*two.calibration, *two.thresholds])


def test_several_shards_find_secrets_and_are_repeatable(spark):
    docs = spark.createDataFrame(corpus(n=150), SCHEMA)
    nets = [ss.fitted(ss.scan(d), 600, 0.98) for d in (docs, docs.repartition(7))]
    assert nets[0].thresholds == nets[1].thresholds and all((a == b).all() for a, b in zip(nets[0].values(), nets[1].values(), strict=True))
    found = [c | {"value": t[c["start"] : c["end"]]} for _, t in corpus(seed=77, n=200) for c in ss.candidates(t, ss.base_spans(t))]
    chance = nets[0].chances([ss.symbols(c["region"], c["lead"], c["end"] - c["start"]) for c in found])
    hit = np.array([p >= nets[0].thresholds[ss.shape_of(c["value"])] for p, c in zip(chance, found, strict=True)])
    truth = np.array([c["secret"] for c in found])
    assert hit[truth].mean() >= 0.9 and hit[~truth].mean() <= 0.1
