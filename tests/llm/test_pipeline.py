"""The pipeline on the smallest tables: stages equal their operators, columns stay, every id is packed."""

from __future__ import annotations

import pytest

import corpus_pipeline
from memlake.llm import common, quality_rules, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.table(spark, SMALL, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.stored(stage(spark, out[-1], SMALL), f"test-{name.replace(' ', '-')}"))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing sources", "packing"]
    for df in stages[1:-1]:
        assert df.schema.names == stages[0].schema.names


def test_stages_take_effect(spark, stages):
    docs, good, lines, one, mixed, packed = stages
    trusted = common.table(spark, SMALL, "labels").filter("quality = 1")
    kept = {r.doc_id for r in quality_rules.quality(docs, trusted).filter("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    assert {r.doc_id for r in one.collect()} <= {r.doc_id for r in lines.collect()} <= kept
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in one.collect()}
    words = lambda df: sum(len(r.text.encode().split()) for r in df.collect())
    assert words(mixed) == pytest.approx(1.5 * words(one), rel=0.02)
    rows = packed.collect()
    assert all(r.length <= 4096 for r in rows) and {r.doc_id for r in rows} == {r.doc_id for r in mixed.collect()}


def test_queries_are_registered(spark):
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
