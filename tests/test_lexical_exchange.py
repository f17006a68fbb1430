"""What the lexical queries exchange, and hints on owners of many units."""

from __future__ import annotations

from memlake.operators import retrieval
from memlake.operators.lexical import LexicalIndex


def test_a_ranking_is_stored_and_hints_take_an_owners_first_units(spark):
    docs = spark.createDataFrame([(i, f"alpha beta {'gamma' if i % 7 == 0 else 'delta'}", "Owner" if i % 2 else "other") for i in range(1, 400)] + [(3, "alpha", "owner")], "doc_id long, text string, source string")
    asked = spark.createDataFrame([(1, "gamma", ["OWNER"]), (2, "nothing", ["owner", "other"]), (3, "gamma", [])], "item_id long, text string, hints array<string>")
    args = {"owner": "source", "hints": "hints", "k": 5}
    got = retrieval.lexical_search(docs.dropDuplicates(["doc_id"]), asked, "doc_id", "item_id", **args)
    best = {q: [r.doc_id for r in sorted(got.filter(f"item_id = {q}").collect(), key=lambda r: r["rank"])] for q in (1, 2, 3)}
    assert best == {1: [7, 14, 21, 28, 35], 2: [1, 2, 3, 4, 5], 3: [7, 14, 21, 28, 35]}
    # fewer hits than k: hints fill up, also where an owner's first units are hits themselves, and with rows of one key
    few = spark.createDataFrame([(i, "gamma" if i in (1, 5) else "x", "o") for i in (1, 1, 2, 2, 3, 5, 9)], "doc_id long, text string, source string")
    one = spark.createDataFrame([(1, "gamma", ["o"])], "item_id long, text string, hints array<string>")
    hits = retrieval.lexical_search(few, one, "doc_id", "item_id", **(args | {"k": 4})).collect()
    assert [r.doc_id for r in sorted(hits, key=lambda r: r["rank"])] == [1, 5, 2, 3]
    ranked = LexicalIndex.of(docs.dropDuplicates(["doc_id"]), "doc_id").bm25(asked, "item_id")
    plan = ranked._jdf.queryExecution().optimizedPlan()
    assert "Window" not in plan.toString() and int(str(plan.stats().sizeInBytes())) < 1 << 20
