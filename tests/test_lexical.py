"""The stored index against the direct searches, with many small blocks, ties, common terms and odd rows."""

from __future__ import annotations

import random

import pytest

from memlake.operators import lexical, retrieval

WORDS = [f"w{i}" for i in range(300)]


def texts(seed=1, n=500):
    rng = random.Random(seed)
    weight = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [(i, " ".join(["the", *rng.choices(WORDS, weight, k=rng.choice([3, 8, 30, 200]))])) for i in range(n)]
    return rows + [(n + i, rows[7][1]) for i in range(30)] + [(n + 30, None), (n + 31, ""), (n + 32, "-- !!")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["the", *rng.sample(WORDS, rng.randrange(1, 6))])) for i in range(40)] + [(40, "the"), (41, "the w0 w0"), (42, ""), (43, None), (44, "unknown terms"), (45, texts()[7][1])]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("k", [1, 10, 64, 200])
def test_bm25_equals_the_direct_search(spark, docs, asked, k, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    lexical.build(docs, "doc_id", "text", str(tmp_path / "index"))
    index = lexical.LexicalIndex(spark, str(tmp_path / "index"), "doc_id")
    expected = set(map(tuple, retrieval.bm25(docs, asked, "doc_id", "item_id", k=k).select("item_id", "doc_id", "score", "rank").collect()))
    got = set(map(tuple, index.bm25(asked, "item_id", k=k).select("item_id", "doc_id", "score", "rank").collect()))
    assert got == expected
    if k <= 10:  # most blocks of the common term are skipped
        known = index.asked(asked, "item_id", "text")
        read = index.candidates(known, k).count()
        every = known.join(index.blocks, "term").select("query", "block").distinct().count()
        assert read < every / 2


def test_search_equals_the_direct_search(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 16)
    lexical.build(docs, "doc_id", "text", str(tmp_path / "index"))
    index = lexical.LexicalIndex(spark, str(tmp_path / "index"), "doc_id")
    said = ["the w0", '"the w0" w1', "w0 w1 w2 OR w5 -w0", "w9 -the", "the", "w250 the w0", '"w1 w0"', "nothing w0", "w3 -nothing", '"w0 w0" OR w17 w2 -w1 -w3']
    queries = spark.createDataFrame([(i, s, ["SRC1"] if i % 2 else []) for i, s in enumerate(said)], "item_id long, said string, hints array<string>")
    owned = docs.selectExpr("*", "concat('src', doc_id % 50) as source")
    options = {"query_text": "said", "owner": "source", "hints": "hints", "k": 25}
    expected = set(map(tuple, retrieval.lexical_search(owned, queries, "doc_id", "item_id", **options).select("item_id", "doc_id", "score", "rank").collect()))
    assert set(map(tuple, index.search(owned, queries, "item_id", **options).select("item_id", "doc_id", "score", "rank").collect())) == expected


def test_one_index_a_content(spark, docs, asked, monkeypatch):
    built = []
    own = lexical.build
    monkeypatch.setattr(lexical, "build", lambda *a: (built.append(a[-1]), own(*a)))
    few = docs.filter("doc_id < 50")
    first = lexical.LexicalIndex.of(few, "doc_id").bm25(asked, "item_id").count()
    assert lexical.LexicalIndex.of(few.repartition(5), "doc_id").bm25(asked, "item_id").count() == first and len(built) == 1
    lexical.LexicalIndex.of(few.filter("doc_id > 0"), "doc_id")
    assert len(built) == 2


def test_empty_table(spark, asked):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lexical.LexicalIndex.of(empty, "doc_id").bm25(asked, "item_id").count() == 0
