"""Operator 12 against brute force: all pairs by edit distance, chains of forms, odd rows and very long words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from memlake.llm import spelling

SCHEMA = "doc_id long, text string"


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def brute(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    form, out = {}, []
    for w, n in count.items():
        near = [x for x in count if one_edit(w, x)]
        best = min(near, key=lambda x: (-count[x], x), default=None)
        form[w] = (len(near), best if best is not None and count[best] >= 10 * n else None)
    for w, n in count.items():
        root = w
        while form[root][1] is not None:
            root = form[root][1]
        out.append((w, form[w][1], root, n, form[w][0], count[form[w][1]] if form[w][1] else None))
    return sorted(out, key=repr)


def typo(rng, w):
    i, c = rng.randrange(len(w)), rng.choice("abcé\u00d7ÿ")
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w.upper(), w + w[-1]])


def corpus(seed=2):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abéz") for _ in range(rng.randrange(6, 11))) for _ in range(60)]
    docs = []
    for i in range(250):
        text = [rng.choice(base[:20]) if rng.random() < 0.6 else typo(rng, rng.choice(base)) for _ in range(60)]
        docs.append((i * 7919, rng.choice([" ", ", ", "_", "\u0153", "1"]).join(text)))
    long = "ab" * 3000 + "z"
    return [*docs, docs[0], docs[0], (None, docs[1][1]), (5, None), (6, ""), (7, f"{long} {long} {long[:-1]} {long[:-1]} {'q' * 5000} {'q' * 5000} {'q' * 5001} {'q' * 5001}"), (8, "Ā" * 9 + " ŸŸŸŸŸŸŸŸ 日本語日本語日本語")]


def found(spark, docs, **options):
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    return sorted(map(tuple, spelling.variants(spelling.word_counts(df), **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"shard_words": 37, "batch_bytes": 4000}])
def test_equals_brute_force(spark, options):
    docs = corpus()
    expected = brute(docs)
    assert found(spark, docs, **options) == expected
    assert any(r[1] for r in expected)


def test_chains_of_forms(spark):
    # each 11 times as frequent as the one before
    chain, docs = ["kettles", "kettlea", "kettlba", "kettzba"], []
    for i, w in enumerate(chain):
        docs += [(100 + i, " ".join([w] * (2 * 11**i)))]
    counts = spelling.word_counts(spark.createDataFrame(docs, SCHEMA), alter=None)
    got = {r.word: (r.form, r.root) for r in spelling.variants(counts).collect()}
    assert got == {"kettles": ("kettlea", "kettzba"), "kettlea": ("kettlba", "kettzba"), "kettlba": ("kettzba", "kettzba"), "kettzba": (None, "kettzba")}


def test_trie_holds_its_words():
    rng = random.Random(9)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))).encode() for _ in range(400)})
    trie = spelling.Trie.of(names, np.arange(len(names)))
    again = spelling.Trie.unpacked(trie.packed())
    assert [again.word(i).encode() for i in range(len(names))] == names
    word, other = spelling.near_words(again, names)
    pairs = list(zip(word.tolist(), other.tolist(), strict=True))
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if one_edit(a.decode(), b.decode())}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", word string, n long")
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    rows = spark.createDataFrame([(1, "kitchen kitchen kitchens kitchens", "x", 3)], SCHEMA + ", word string, n long")
    assert {r.word: r.n_near for r in spelling.variants(spelling.word_counts(rows, alter=None)).collect()} == {"kitchen": 1, "kitchens": 1}
