"""Nearest neighbours with more lists than fit a small index, and with vectors of odd lengths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from memlake.llm import ann


def test_recall_with_many_lists(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 16))
    points = (centres[rng.integers(0, 300, 6000)] + 0.35 * rng.normal(size=(6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, list_vectors=4).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -2
        hits += len(found & set(np.argsort(-score)[:5].tolist()))
    assert len(got) == 120 and hits / 600 >= 0.9


def test_a_vector_of_another_length_takes_no_part(spark):
    for odd in range(200, 260, 20):  # whichever is first in hash order
        rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(20)] + [(odd, [1.0])]
        found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0).collect()
        assert len(found) == 20 and odd not in {r.vec_id for r in found}
