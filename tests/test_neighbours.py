"""Exact neighbours have no bound on the number of queries."""

from __future__ import annotations

import numpy as np

from memlake.operators import retrieval


def test_more_queries_than_one_driver_would_take(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-4, 5, (10_500, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = df.filter("vec_id % 50 = 0")
    found = retrieval.nearest_vectors(rows, df.withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", k=3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    ids = np.arange(0, len(vectors), 50)
    sims = np.round(unit @ unit[ids].T, 6)
    assert len(got) == 3 * len(vectors)
    for q in range(len(vectors)):
        other = ids != q
        best = np.lexsort((ids[other], -sims[q][other]))[:3]
        assert [got[q, n + 1] for n in range(3)] == [(ids[other][b], sims[q][other][b]) for b in best]
