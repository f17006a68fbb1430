"""BM25 over the texts themselves: against plain Python, by many tasks, and without an index built for one use."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from memlake.operators import lexical, retrieval
from memlake.plans import catalog


def test_scores_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIRS", 40)
    rng = random.Random(5)
    texts = {i: " ".join(rng.choices(["a", "b", "c d", "E-f"], k=rng.randrange(1, 9))) for i in range(60)} | {60: None, 61: "", 62: "a"}
    asked = {0: "A b", 1: "c c e", 2: None, 3: "", 4: "none", 5: "f none"}
    words = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in texts.items() if t is not None}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for t in words.values() for w in set(t))
    expected = {}
    for q, t in asked.items():
        found = []
        for i, own in words.items():
            hits = set(re.findall("[a-z0-9]+", (t or "").lower())) & set(own)
            score = sum(math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in hits)
            if hits:
                found.append((-round(score, 6), i))
        expected |= {(q, n): (i, -s) for n, (s, i) in enumerate(sorted(found)[:7], 1)}
    docs, questions = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(asked.items()), "item_id long, text string")
    got = retrieval.bm25(docs, questions, "doc_id", "item_id", k=7)
    assert {(r.item_id, r["rank"]): (r.doc_id, pytest.approx(r.score, abs=1e-6)) for r in got.collect()} == expected


@pytest.mark.parametrize("name", ["r2_bm25", "r3_provider_fallback", "r5_rank_fusion"])
def test_no_index_is_built_for_one_search(spark, tmp_path, monkeypatch, name):
    def build(*_):
        raise AssertionError("an index of all postings for a few questions")

    monkeypatch.setattr(lexical, "build", build)
    spark.createDataFrame([(1, "one two three", "en", "src0", 13), (2, None, "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "two four")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()] == [1]
