"""Operators against versions that share no code with them, on skewed, odd and empty tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memlake.llm import common, line_dedup, mixing, packing, quality_rules, similar, simhash, toxicity, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, source="s", first=0):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts, first)], SCHEMA)


def test_quality_verdict_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    good = [" ".join(word("abcde") for _ in range(80)) for _ in range(12)]
    junk = [" ".join(word("vwxyz") for _ in range(80)) for _ in range(12)]
    mixed = [" ".join(word("abcxyz") for _ in range(60)) for _ in range(12)]
    texts = good + junk + mixed + ["", None]
    trusted = {0, 1, 2, 3, 4, 5}
    grams = lambda t: [t.encode()[i : i + 4] for i in range(len(t.encode()) - 3)]

    def bucket(g):  # the hash decides which n-grams share a count; everything else is counted here
        return int(words.byte_hashes(np.frombuffer(g, np.uint8)).all_of(4)[0]) >> 48

    raw, of_trusted = Counter(), Counter()
    for i, t in enumerate(texts):
        own = Counter(map(bucket, grams(t or "")))
        raw += own
        if i in trusted:
            of_trusted += own
    n = 1 << 16
    ratio = lambda b: math.log((of_trusted[b] + 1) / (sum(of_trusted.values()) + n)) - math.log((raw[b] + 1) / (sum(raw.values()) + n))
    want = {}
    for i, t in enumerate(texts):
        own = [ratio(bucket(g)) for g in grams(t or "")]
        own_words = (t or "").split()
        windows = Counter(zip(own_words, own_words[1:], own_words[2:]))
        repeated = {k for p in range(len(own_words) - 2) if windows[tuple(own_words[p : p + 3])] > 1 for k in (p, p + 1, p + 2)}
        failed = len(own_words) < 50 or 100 * len(repeated) > 50 * len(own_words)
        want[i] = not failed and (sum(own) / len(own) if own else 0.0) >= quality_rules.THRESHOLD
    trusted_rows = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    got = {r.doc_id: r.kept for r in quality_rules.quality(table(spark, texts), trusted_rows).collect()}
    assert got == want and any(want.values()) and not all(want[i] for i in range(36))


def aligned_by_recursion(a, b):
    """Patience diff, written as its definition: unique common lines, the longest increasing run of them, then the gaps."""

    def go(a0, a1, b0, b1):
        if a0 >= a1 or b0 >= b1:
            return []
        if a[a0] == b[b0]:
            return [(a0, b0), *go(a0 + 1, a1, b0 + 1, b1)]
        if a[a1 - 1] == b[b1 - 1]:
            return [*go(a0, a1 - 1, b0, b1 - 1), (a1 - 1, b1 - 1)]
        unique = [(i, b.index(a[i], b0, b1)) for i in range(a0, a1) if a[a0:a1].count(a[i]) == 1 and b[b0:b1].count(a[i]) == 1]
        if not unique:
            return []  # lines are unique here, so nothing is common
        chains = []
        for i, j in unique:
            chains.append(max([c for c in chains if c[-1][1] < j], key=len, default=[]) + [(i, j)])
        chain, out, at = max(chains, key=len), [], (a0, b0)
        for i, j in chain:
            out += [*go(at[0], i, at[1], j), (i, j)]
            at = (i + 1, j + 1)
        return out + go(at[0], a1, at[1], b1)

    return go(0, len(a), 0, len(b))


def test_alignment_equals_its_definition():
    rng = random.Random(9)
    for _ in range(300):
        a = rng.sample(range(30), rng.randrange(1, 20))
        b = rng.sample(range(30), rng.randrange(1, 20))
        want, got = aligned_by_recursion(a, b), line_dedup.patience(a, b)
        # lines are unique here; longest chains may tie, so their length and validity count
        assert len(got) == len(want) and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_toxicity_features_equal_brute_force():
    texts = ["You are a total m0ron, MORON!!", "your kind words help", "", "an idiot said so; then later on he came to you", "x-ray can't s.t.o.p U"]
    lexicon = toxicity.Lexicon(np.array([toxicity._name("moron")], np.uint64), np.array([3.5]))
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = lexicon.features(np.frombuffer(data, np.uint8), offsets)
    plain = str.maketrans("01345" "7@$", "oieas" "tas")
    for text, row in zip(texts, got, strict=True):
        own = text.split()
        read = [w.lower().translate(plain) for w in own]
        insult = [any(r.startswith(x) or x[: toxicity.PREFIXES[k]] == r for k in range(4) for x in toxicity.INSULTS if r[: toxicity.PREFIXES[k]] == x[: toxicity.PREFIXES[-1]]) for r in read]
        learned = [any(r[:n] == "moron" for n in toxicity.PREFIXES) for r in read]
        hits = [x or y for x, y in zip(insult, learned, strict=True)]
        bare = [w.lower()[:-1] if w and w[-1] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else w.lower() for w in own]
        addressed = [w in toxicity.SECOND_PERSON for w in bare]
        near = max((1 / (1 + abs(i - j)) for i in range(len(own)) if hits[i] for j in range(len(own)) if addressed[j]), default=0.0)
        letters = sum(c.isascii() and c.isalpha() for c in text)
        want = {
            "log_words": math.log1p(len(own)), "log_hits": math.log1p(sum(hits)), "hit_density": sum(hits) / max(1, len(own)), "nearness": near, "second_person": sum(addressed) / max(1, len(own)),
            "capitals": sum(c.isupper() for c in text) / max(letters, 1e-9) if letters else 0.0, "exclamations": text.count("!") / max(1, len(text)), "most_strength": 3.5 if any(learned) else 0.0,
        }
        for name, value in want.items():
            assert row[toxicity.FEATURES.index(name)] == pytest.approx(value), (text, name)


def test_equal_rows_fill_all_groups_of_a_packing(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    packed = packing.pack(docs)
    groups = packed.groupBy((F.col("sequence_id") / (1 << 32)).cast("long").alias("g")).count().collect()
    assert len(groups) == 5 and max(r["count"] for r in groups) < 2 * 4096 and packed.count() == 20_000
    spots = packed.groupBy("sequence_id").agg(F.min("offset").alias("low"), F.max("offset").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.low == 0 and r.high == r.n - 1 for r in spots)


def test_repeated_rows_are_taken_by_all_their_amounts(spark):
    rows = [(1, "one two three four five six seven", "en", "a", 33)] * 40 + [(2, "alpha beta gamma", "en", "b", 16)] * 3 + [(i, f"word{i} and more", "en", "b", 15) for i in range(10, 40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs, block_words=3, shard_words=40)
    took = mixing.take(docs, block_words=3, shard_words=40)
    assert sum(len(r.text.split()) for r in took.collect()) == mixed.agg(F.sum("taken")).first()[0]


def test_null_ids_meet_only_where_they_share_lines(spark):
    line = "a line of more than five words in all"
    texts = [f"own words of {i} alone here\n{line if i < 5 else i}" for i in range(400)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    for whole in (False, True):
        known = line_dedup.profiles(docs)
        if whole:
            assert line_dedup.whole_pairs(common.stored(known, "test")).count() <= 10
        left = [r.text for r in line_dedup.drop_lines(docs, whole=whole).collect()]
        assert sum(line in t for t in left) == 1 and len(left) == 400


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    odd = [(None, None), (None, "no id at all " * 20), (1, "same words here " * 20), (1, "same words here " * 20), (1, "other words " * 30), (2, None), (3, ""), (4, "x" * 3000 + " long word " * 40)]
    docs = spark.createDataFrame([(i, t, "en", "s" if i else None, len(t or ""), "x") for i, t in odd], SCHEMA + ", row string")
    for rows in (docs, docs.limit(0)):
        assert quality_rules.keep_good(rows, spark.createDataFrame([], "doc_id long")).columns == docs.columns
        assert simhash.keep_one(rows).count() == (5 if rows is docs else 0)
        assert similar.keep_one(rows).columns == docs.columns
        assert mixing.take(rows).columns == docs.columns
    folder = str(tmp_path)
    docs.drop("row").limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
