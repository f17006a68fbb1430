"""Binding by name, stored values, neighbourhoods and extraction units on written cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import lookup, text


def entities(spark):
    return spark.createDataFrame([(1, "Ann"), (2, "Bob"), (3, "Cy")], "id long, name string"), spark.createDataFrame([(1, "Annie"), (2, "Chief"), (3, "Chief"), (3, "Bob")], "id long, alias string")


def test_pair_binding(spark):
    said = ["did Ann meet Bob?", "did Ann meet Chief", "did Zed meet Annie", "did Zed meet Yan", "what of Annie", "what of Zed or Zed", "nothing", None]
    got = {r.q: (r.required, r.verified, r.primary_id, r.pair_id, r.reason) for r in lookup.pair_binding(spark.createDataFrame(list(enumerate(said)), "q long, text string"), *entities(spark), ["q"], "text").collect()}
    assert got[0] == (True, True, 1, 2, "pair_subjects_resolved")  # an own name goes before another's alias
    assert got[1] == (True, False, 1, None, "pair_counterpart_unresolved") and got[2] == (True, False, None, 1, "pair_primary_unresolved")
    assert got[3][4] == "pair_subjects_unresolved" and got[4] == (False, True, 1, None, "single_subject_resolved") and got[5][4] == "single_subject_unresolved" and got[6][4] == "no_subject_name"
    assert len(got) == 8


def test_canonical_lookup(spark):
    facts = spark.createDataFrame([(1, "home", "Rome", 1, 5), (1, "home", "Oslo", 5, None), (2, "home", "Oslo", 2, None), (2, "home", "Rome", 0, 2), (3, "home", "Bern", 0, None)], "id long, predicate string, value string, valid_from long, valid_until long")
    asked = [(0, "ann", None, "home", None), (1, "ANNIE", None, "home", 4), (2, "Ann", "bob", "home", None), (3, "Chief", None, "home", None), (4, "Ann", "Zed", "home", None), (5, "Ann", None, "work", None), (6, None, None, "home", None), (7, "cy", None, "home", -1)]
    got = {r.q: (r.kind, r.binding, r.value) for r in lookup.canonical_lookup(spark.createDataFrame(asked, "q long, subject string, other string, predicate string, at long"), *entities(spark), facts, "q").collect()}
    assert got == {
        0: ("current", "exact", "Oslo"), 1: ("temporal", "alias", "Rome"), 2: ("set", "exact", "Oslo,Rome"), 3: ("abstention", "ambiguous", None), 4: ("abstention", "unknown", None), 5: ("current", "exact", None), 6: ("abstention", None, None),
        7: ("temporal", "exact", None),
    }


def test_neighbourhood_by_several_links(spark):
    units = spark.createDataFrame([(1, "a", 1, 0.9), (2, "a", 2, 0.5), (3, "b", 1, 0.7), (4, "b", 2, 0.8), (5, None, None, 0.99)], "unit long, memory string, chunk long, sure double")
    seeds = spark.createDataFrame([("q", 1), ("r", 5)], "query string, unit long")
    got = lookup.neighbourhood(units, seeds, "query", "unit", ["memory", "chunk"], [F.desc("sure"), F.asc("unit")], 5)
    assert [(r.query, r.unit, r["rank"]) for r in got.orderBy("rank").collect()] == [("q", 3, 1), ("q", 2, 2)]


def test_extraction_units_overlap(spark):
    sentences = ["a" * 700 + ".", "b" * 700 + ".", "c" * 500 + ".", "d" * 2000 + ".", "e."]
    got = text.extraction_units(spark.createDataFrame([(1, " ".join(sentences)), (2, None), (3, "")], "id long, text string"), "id").orderBy("unit").collect()
    assert [(r.first_sentence, r.last_sentence, r.n_chars, r.status) for r in got] == [(0, 1, 1403, "ready"), (1, 2, 1203, "ready"), (2, 2, 501, "ready"), (3, 3, 2001, "needs_split_review"), (4, 4, 2, "ready")]
    assert got[1].content == " ".join(sentences[1:3])
