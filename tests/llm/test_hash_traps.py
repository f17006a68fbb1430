"""Words and lines on which a polynomial modulo 2**64 collides whatever its base: those in the order of Thue and Morse."""

from __future__ import annotations

import numpy as np
import pytest

from memlake.llm import quality_rules, recompression, words


def pair(n):
    bits = np.array([bin(i).count("1") & 1 for i in range(n)], np.uint8)
    return bytes(bits + 97).decode(), bytes(1 - bits + 97).decode()


@pytest.mark.parametrize("n", [1024, 4096, 65_536])
def test_long_words_and_lines(spark, n):
    a, b = pair(n)
    data = np.frombuffer(f"{a}\n{b}\n{a}".encode(), np.uint8)
    counts = quality_rules.base_counts(data, np.array([0, len(data)]))
    assert counts["n_dup_lines"].tolist() == [1]
    data = np.frombuffer(f"{a} x y\n{b} x y".encode(), np.uint8)
    assert quality_rules.base_counts(data, np.array([0, len(data)]))["n_repeat_words"].tolist() == [0]
    start, end, _ = words.word_bounds(data, np.array([0, len(data)]))
    names = words.long_names(data, start, end)
    assert names[0] != names[3] and names[1] == names[4]
    tail = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a} {tail}"), (4, f"{tail} {b}"), (5, f"{tail} {b} z")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in recompression.dedup(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 20, 4: 0, 5: 20}


def test_equal_names_are_told_apart_by_words(monkeypatch):
    monkeypatch.setattr(words, "long_names", lambda data, start, end: np.zeros(len(start), np.uint64))
    text = [" ".join([x] * 20) + " " for x in "aba"]
    data, size = np.frombuffer("".join(text).encode(), np.uint8), np.array([40, 40, 40])
    ones, zeros = np.ones(3, np.int64), np.zeros(3, np.int64)
    covered = recompression._firsts(20)(zeros.astype(np.uint64), zeros, ones, zeros, data, np.array([0, 40, 80]), size)
    assert covered[:, 0].tolist() == [False, False, True]
