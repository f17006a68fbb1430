"""The whole line dedup of the query and the pipeline: no bound on how common a shared line is."""

from __future__ import annotations

import random

import corpus_pipeline
from memlake.llm import line_dedup


def kept(spark, rows):
    """What the pipeline's stage leaves of each document (none: all of it went)."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()}


def own(i):
    return f"own words of document number {i} alone"


def test_a_common_passage_goes_however_common(spark):
    passage = "one passage of many words that thirty documents have in common"
    got = kept(spark, [(i, f"{own(i)}\n{passage}\nend {i}") for i in range(30)])
    assert got[0] == f"{own(0)}\n{passage}\nend 0"
    assert all(got[i] == f"{own(i)}\nend {i}" for i in range(1, 30))


def test_repeated_and_short_lines_go(spark):
    refrain = "a refrain of at least five words\nand another line of many words"
    verse = "short\nlines only\n\nof a\nverse"
    got = kept(spark, [(1, f"{refrain}\n{refrain}"), (2, f"{refrain}\n{refrain}"), (3, verse), (4, f"{own(4)}\n{verse}"), (5, own(5)), (6, f"{own(5)}\nx\n{own(5)}")])
    assert got == {1: f"{refrain}\n{refrain}", 3: verse, 4: own(4), 5: own(5), 6: "x"}


def test_blocks_in_any_order_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        first, later = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        words = [(0, 1, 2, 3, 5, 9)[x] for x in later]
        gone = set()
        for s in range(len(later)):
            for e in range(s + 1, len(later) + 1):
                if sum(words[s:e]) >= 5 and any(first[i : i + e - s] == later[s:e] for i in range(len(first))):
                    gone.update(range(s, e))
        got = set(line_dedup.whole_blocks(first, later, words))
        # blank lines and lines under five words beside a block that went may stay
        assert got <= gone
        runs = [(s, e) for s, e in zip(*line_dedup.runs(words), strict=True) if any(first[i : i + e - s] == later[s:e] for i in range(len(first)))]
        assert all(got.issuperset(range(s, e)) for s, e in runs)


def test_alignment_without_unique_lines():
    found = line_dedup.patience([9, 1, 1, 2, 2, 8], [7, 1, 1, 2, 2, 6])
    assert found == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_later_holders_of_a_line_count(spark):
    line, other = "a long line of more than five words", "and another line of as many words"
    block = f"title\n{line}\nfoot"
    rows = [(1, f"{own(1)}\n{line}\n{own(11)}"), (2, f"{own(2)}\n{block}"), (3, f"{own(3)}\n{block}")]
    # the same with so many holders of the line that it is common
    rows += [(i, f"{own(i)}\n{other}\n{own(1000 + i)}") for i in range(100, 120)]
    rows += [(i, f"{own(i)}\nhead\n{other}\nend") for i in (200, 201)]
    got = kept(spark, rows)
    assert got[2] == f"{own(2)}\ntitle\nfoot" and got[3] == own(3)
    assert got[119] == f"{own(119)}\n{own(1119)}"
    assert got[200] == f"{own(200)}\nhead\nend" and got[201] == own(201)
