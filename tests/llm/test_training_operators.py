"""Each operator against a brute-force version, and on the odd inputs that its docstring defines."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from memlake.llm import ann, components, line_dedup, mixing, packing, quality_rules, recompression, simhash, suffix_dedup, token_counts, tokens, toxicity, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", ",", "."]) for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, repeats, and the odd cases: null, empty, blank, long, accented texts."""
    rng = random.Random(seed)
    passage, line = text(rng, 60), text(rng, 12)
    rows = []
    for i in range(60):
        body = text(rng, rng.randrange(1, 160), 5000)
        if i % 4 == 1:
            body = body + " " + passage + " " + text(rng, 10)
        if i % 7 == 2:
            body = body + "\n" + line + "\n" + text(rng, 9)
        rows.append(body)
    rows += [rows[3], rows[3], rows[5] + " tail", " ".join(rows[7].split()[:-1]), "a " * 300, "ab" * 400, "é" * 250, passage * 3, None, "", " \n\t ", "one", "x" * 99, "x" * 100, "x" * 101, "\x00" * 150]
    rows += [text(rng, 20_000, 3000)]
    return [(i, t, "en", f"src{i % 5}" if i % 11 else None, len(t or "")) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, a null id, two rows of one id, and columns whose names operators use themselves."""
    rows = [(1, "same words here " * 20), (1, "same words here " * 20), (1, "other words " * 30), (None, "no id at all " * 20), (None, None), (2, None), (3, "")]
    return spark.createDataFrame([(i, t, "en", "s", 1, 5, True, "x") for i, t in rows], SCHEMA + ", row long, keep boolean, bucket string")


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_words_and_hashes():
    texts = ["a bb  ccc", "", None, "\td e\n", "é x"]
    import pyarrow as pa

    data, offsets = words.text_bytes(pa.array(texts))
    start, end, doc = words.word_bounds(data, offsets)
    assert [(int(d), data[s:e].tobytes().decode()) for s, e, d in zip(start, end, doc, strict=True)] == [(0, "a"), (0, "bb"), (0, "ccc"), (3, "d"), (3, "e"), (4, "é"), (4, "x")]
    again = np.frombuffer(b"zz bb ccc", np.uint8)
    assert words.byte_hashes(data)(np.array([2]), np.array([4]))[0] == words.byte_hashes(again)(np.array([3]), np.array([5]))[0]
    keys = np.array([5, 3, 9, 1, 7, 8], np.uint64)
    assert words.window_min(keys, 3).tolist() == [3, 1, 1, 1]


# --- 1 and 8 ----------------------------------------------------------------------------------------------------------


def covered(units: list[tuple[int, list]], width: int) -> dict[int, list[bool]]:
    seen, out = set(), {}
    for i, own in units:
        gone = [False] * len(own)
        for p in range(len(own) - width + 1):
            key = tuple(own[p : p + width])
            if key in seen:
                gone[p : p + width] = [True] * width
            seen.add(key)
        out[i] = gone
    return out


def test_suffix_dedup_equals_brute_force(spark, docs):
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.orderBy("doc_id").collect()]
    gone = covered([(i, list(t)) for i, t in texts], 100)
    expected = []
    for i, t in texts:
        kept = bytes(b for b, g in zip(t, gone[i], strict=True) if not g)
        spans = sum(g and (p == 0 or not gone[i][p - 1]) for p, g in enumerate(gone[i]))
        expected.append((i, len(t), sum(gone[i]), spans, hashlib.sha256(kept).hexdigest()))
    got = rows_of(suffix_dedup.dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(expected, key=repr)
    assert sum(x[2] for x in got) > 1000


def test_suffix_rounds_sort_suffixes(tmp_path):
    rng = np.random.default_rng(3)
    strings = rng.integers(0, 3, (40, 30)).astype(np.uint8)
    for column, order, lcp in suffix_dedup.common_prefix_rounds(strings, str(tmp_path), 30):
        suffixes = [bytes(strings[i, column:]) for i in order]
        assert suffixes == sorted(suffixes)
        for i in range(1, len(order)):
            same = next((k for k, (a, b) in enumerate(zip(suffixes[i - 1], suffixes[i], strict=True)) if a != b), len(suffixes[i]))
            assert lcp[i] == same


def test_recompression_equals_brute_force(spark, docs):
    texts = [(r.doc_id, (r.text or "").encode().split()) for r in docs.orderBy("doc_id").collect()]
    gone = covered(texts, 20)
    expected = []
    for i, t in texts:
        kept = b" ".join(w for w, g in zip(t, gone[i], strict=True) if not g)
        expected.append((i, len(t), sum(gone[i]), hashlib.sha256(kept).hexdigest()))
    got = rows_of(recompression.dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(expected, key=repr)
    assert sum(x[2] for x in got) > 500


def test_recompression_is_consistent():
    rng = np.random.default_rng(0)
    passage = rng.integers(0, 4, 40).astype(np.uint64)
    names = []
    for n in (3, 8):
        own = np.concatenate([rng.integers(0, 4, n).astype(np.uint64), passage, rng.integers(0, 4, 5).astype(np.uint64)])
        run, at = recompression.merge_runs(own, np.zeros(len(own), int))
        pair, then = recompression.merge_pairs(run, np.zeros(len(run), int))
        starts = at[then]
        inside = (starts >= n + recompression.MARGIN) & (starts < n + 40 - recompression.MARGIN - recompression.LONGEST)
        names.append(list(zip((starts[inside] - n).tolist(), pair[inside].tolist(), strict=True)))
    assert names[0] == names[1] and names[0]


@pytest.mark.parametrize("dedup", [suffix_dedup.dedup, recompression.dedup])
def test_dedup_odd_inputs(spark, odd, empty, dedup):
    got = dedup(odd).select("doc_id", "n_removed", "kept_sha256").collect()
    assert len(got) == odd.count() and dedup(empty).count() == 0
    same = [tuple(r) for r in got if r.doc_id == 1]
    assert max(Counter(same).values()) == 2  # a repeated row is the same document
    assert len(dedup(odd.limit(0)).columns) > 0


# --- 2 ----------------------------------------------------------------------------------------------------------------


def toxic_corpus(spark, n=1200):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            own.insert(rng.randrange(len(own)), rng.choice(["zorgal", "zorgalen", "blegh", "blegher"]))
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_accuracy(spark):
    docs, labels = toxic_corpus(spark)
    got = toxicity.score(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_odd_inputs(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, none).count() == 0
    got = toxicity.score(odd, none).collect()
    assert len(got) == odd.count() and all(r.score == 0 for r in got)
    insult = spark.createDataFrame([(9, "you 1diot"), (10, "fine")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(insult, none).collect()} == {9: 1, 10: 0}


# --- 3 ----------------------------------------------------------------------------------------------------------------


def test_patience_aligns():
    assert line_dedup.patience([1, 2, 3, 9, 4, 5], [7, 1, 2, 8, 3, 4, 5, 5]) == [(0, 1), (1, 2), (2, 4), (4, 5), (5, 7)]
    assert line_dedup.patience([], [1]) == [] and line_dedup.patience([1, 1], [2, 2]) == []
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))


def lines_removed(rows):
    """The operator's rules, one pair of documents after the other."""
    parsed = {i: line_dedup.line_digests(t) for i, t in rows}
    once = {i: {x for x, n in Counter(line for line, long in zip(*p, strict=True) if long).items() if n == 1} for i, p in parsed.items()}
    having: dict[int, list[int]] = {}
    for i in sorted(once):
        for x in once[i]:
            having.setdefault(x, []).append(i)
    gone: dict[int, set[int]] = {i: set() for i in parsed}
    for i in parsed:
        shared: dict[int, list[int]] = {}
        for x in once[i]:
            if len(having[x]) > 1 and having[x][0] < i:
                shared.setdefault(having[x][0], []).append(len(having[x]))
        for first, documents in shared.items():
            if min(documents) <= line_dedup.RARE_DOCUMENTS or len(documents) >= line_dedup.SHARED_LINES:
                gone[i].update(line_dedup.common_blocks(parsed[first][0], *parsed[i]))
    return {i: len(g) for i, g in gone.items()}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    lines = [text(rng, rng.randrange(1, 12), 900) for _ in range(160)]
    common = [text(rng, 8) for _ in range(4)]
    rows = []
    for i in range(70):
        at = rng.randrange(140)
        own = lines[at : at + rng.randrange(1, 9)] if i % 3 else [text(rng, 7, 4000)]
        rows.append((i, "\n".join([*own, *rng.sample(common, i % 4)])))
    rows.append((70, rows[1][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(docs).collect()}
    assert got == lines_removed(rows) and sum(got.values()) > 20
    assert got[70] >= 1


def test_line_dedup_odd_inputs(spark, odd, empty):
    assert line_dedup.dedup(empty).count() == 0 and line_dedup.dedup(odd).count() == odd.count()
    assert line_dedup.drop_lines(odd).columns == odd.columns
    assert line_dedup.drop_lines(empty).count() == 0


# --- 4 ----------------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights, total, most):
    left, out = dict(sizes), {}
    while left:
        weight = sum(weights[s] for s in left)
        over = [s for s in left if (total - sum(out.values())) * weights[s] / weight > most * left[s]]
        if not over:
            rest = total - sum(out.values())
            return out | {s: rest * weights[s] / weight for s in left}
        for s in over:
            out[s] = most * left.pop(s)
    return out


@pytest.mark.parametrize("shard_words", [500, 1 << 17])
def test_mixing_meets_targets(spark, docs, shard_words):
    got = mixing.mix(docs, shard_words=shard_words).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes: Counter = Counter()
    for r in got:
        sizes[r.source] += r.size
    assert {r.doc_id: r.size for r in got} == {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    expected = water_fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken: Counter = Counter()
    for r in got:
        assert r.target == pytest.approx(expected[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 24 + 0.01 * expected[s]
    again = mixing.mix(docs.repartition(7), shard_words=shard_words).select("doc_id", "taken").collect()
    assert dict(map(tuple, again)) == {r.doc_id: r.taken for r in got}


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(4)
    votes = [(f"s{i}", 0, float(rng.randrange(1, 1000)), float(rng.randrange(20, 200))) for i in range(25)]
    scale = 300 / sum(v for _, _, v, _ in votes)  # as many seats as votes
    votes = [(s, n, v * scale, most) for s, n, v, most in votes]
    shards = spark.createDataFrame(votes, "source_key string, shard long, votes double, most double")
    got = {r.source_key: r.quota for r in mixing.apportion(shards).collect()}
    seats: Counter = Counter()
    for _ in range(300):
        seats[min((-v / (2 * seats[s] + 1), s) for s, _, v, most in votes if seats[s] < most)[1]] += 1
    assert got == {s: seats[s] for s, *_ in votes}


def test_mixing_take_and_odd_inputs(spark, docs, odd, empty):
    amounts = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    taken: Counter = Counter()
    for r in mixing.take(docs).collect():
        taken[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in amounts.items() if v} == dict(taken)
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).count() == odd.count()
    assert mixing.take(odd).columns == odd.columns


# --- 5 and 6 ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


ODD_TEXTS = ["", " ", "a<|endoftext|>b c", "<|startoftext|>", "x́ ́y", "İSTANBUL ΣΣΣ.", "don't we'Re I'LL 's 't", "\x1c\x1da\x85b\xa0c", "e\ńx", "１２ 12345 !!??##", "a" * 500 + " b", "한글 한", "​﻿a", "'r e 're ’s", "½ x² ª"]


def test_word_cache_equals_library(library):
    encoder = tokens.encoder("word_bpe_49k.json")
    for t in [*ODD_TEXTS, *[r[1] for r in corpus()]]:
        assert encoder.ids([t or ""])[0].tolist() == library(t)
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        assert tokens.encoder(name).count(["plain text", ""])[0] > 0


def test_token_counts_and_cache(spark, docs, library, tmp_path):
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = {r.doc_id: r for r in token_counts.count_tokens(docs, cache).collect()}
        for r in docs.collect():
            n = len(library(r.text))
            assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 2048)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()  # the second run appends nothing


def test_token_counts_odd_inputs(spark, odd, empty, tmp_path):
    assert token_counts.count_tokens(empty, str(tmp_path / "a")).count() == 0
    assert token_counts.count_tokens(odd, str(tmp_path / "b")).count() == odd.count()


def test_packing_round_trip(spark, docs, library):
    got = packing.pack(docs, size=512).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {i: np.asarray([*library(t), 2], "<u4") for i, t in texts.items()}
    seen: Counter = Counter()
    sequences: dict[int, list] = {}
    for r in got:
        own = ids[r.doc_id]
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(own)
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(map(len, ids.values()))
    assert len(sequences) <= total / 512 * 1.02 + 1


def test_tightest_fit_is_best_fit():
    rng = random.Random(3)
    lengths = sorted((rng.randrange(1, 100) for _ in range(300)), reverse=True)
    left: list[int] = []
    for n in lengths:
        fits = [(x, i) for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(100 - n)
    windows, offsets = packing.best_fit_decreasing(lengths, 100)
    assert len(set(windows)) == len(left)
    used: Counter = Counter()
    for w, o, n in zip(windows, offsets, lengths, strict=True):
        assert o == used[w]
        used[w] += n
    assert sorted(100 - u for u in used.values()) == sorted(left)


def test_packing_odd_inputs(spark, odd, empty):
    assert packing.pack(empty).count() == 0
    got = packing.pack(odd).collect()
    assert sum(r.length == 1 and r.doc_tokens == 1 for r in got) == 3  # null and empty texts are the separator


# --- 7 ----------------------------------------------------------------------------------------------------------------


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(30, 16))
    vectors = (centers[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    vectors[100:400] = vectors[100]  # one very common vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    x = vectors.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q, rows in found.items():
        assert len(rows) == 5 and all(i != q for i, _ in rows)
        assert all(s == pytest.approx(x[q] @ x[i], abs=1e-12) for i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        score = x @ x[q]
        score[q] = -2
        hits += sum(s >= np.sort(score)[-5] - 1e-12 for _, s in rows)
    assert len(found) == 60 and hits / 300 >= 0.9
    assert [i for i, _ in found[100]] == [101, 102, 103, 104, 105]


def test_ann_odd_inputs(spark):
    schema = "vec_id long, embedding array<float>, v string, first int"
    odd = [(0, [1.0, 0.0], "a", 1), (1, [0.0, 0.0], "a", 1), (2, None, "a", 1), (3, [float("nan"), 1.0], "a", 1), (4, [None, 1.0], "a", 1), (5, [float("inf"), 1.0], "a", 1), (6, [2.0, 0.0], "a", 1), (None, [1.0, 1.0], "a", 1), (50, [0.0, 1.0], "a", 1), (50, [0.0, 1.0], "a", 1)]
    got = ann.nearest(spark.createDataFrame(odd, schema), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in got) == [(0, 1, 6, 1.0), (0, 2, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 6, 0.0)]
    assert ann.nearest(spark.createDataFrame([], schema), F.lit(True)).count() == 0


# --- 9 ----------------------------------------------------------------------------------------------------------------


def base_of(t):
    t = t or ""
    own = t.encode().split()
    lines, seen, dup = t.encode().split(b"\n"), set(), 0
    for line in lines:
        if line.split():
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    again = {i + k for i in range(len(own) - 2) if grams[tuple(own[i : i + 3])] > 1 for k in range(3)}
    chars = sum(len(w.decode()) for w in own)
    return len(own), chars, sum(t.count(c) for c in "#*$%&|<>"), dup, len(again)


def test_quality_base_counts_equal_brute_force(spark, docs):
    trusted = docs.filter("doc_id % 2 = 0").select("doc_id")
    got = {r.doc_id: r for r in quality_rules.quality(docs, trusted).collect()}
    for r in docs.collect():
        own = got[r.doc_id]
        expected = base_of(r.text)
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert own.base_failed == failed and own.kept == (not failed and own.llr >= quality_rules.THRESHOLD)
    assert base_of("x #a\nx #a\n\n") == (4, 6, 2, 1, 0)


def test_quality_rejects_what_is_unlike_trusted(spark):
    rng = random.Random(1)
    good = [(i, text(rng, 120, 800)) for i in range(80)]
    junk = [(100 + i, " ".join(f"{rng.choice('ABCDE')}!!{rng.randrange(9)}##" for _ in range(120))) for i in range(20)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    trusted = docs.filter("doc_id < 40").select("doc_id")
    kept = {r.doc_id: r.kept for r in quality_rules.quality(docs, trusted).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in junk)
    assert {r.doc_id for r in quality_rules.keep_good(docs, trusted).collect()} == {i for i, k in kept.items() if k}


def test_quality_odd_inputs(spark, odd, empty):
    ids = odd.select("doc_id")
    assert quality_rules.quality(empty, ids).count() == 0 and quality_rules.quality(odd, ids.limit(0)).count() == odd.count()
    assert quality_rules.keep_good(odd, ids).columns == odd.columns


# --- 10 ---------------------------------------------------------------------------------------------------------------


def simhash_of(t, width=4):
    own = (t or "").encode().lower().split()
    if not own:
        return 0
    grams = [b" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1))]
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(spark, docs):
    rows = [r for r in docs.collect() if len(r.text or "") < 20_000]
    fp = {r.doc_id: simhash_of(r.text) for r in rows}
    ids = sorted(fp)
    group = union_find(ids, [(a, b) for a in ids for b in ids if a < b and bin(fp[a] ^ fp[b]).count("1") <= 4])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    for i in ids:
        assert got[i].fp & (1 << 64) - 1 == fp[i] and got[i].component_id == group[i]
    assert any(group[i] != i for i in ids)
    spark_hash = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0] & (1 << 64) - 1
    assert simhash.fingerprint("A b  C d") == spark_hash


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(1, 2), (2, 1), (3, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for pair in links for n in pair} - {3}
    assert got == {n: c for n, c in union_find(nodes, [x for x in links if x != (3, 3)]).items()}


def test_simhash_odd_inputs(spark, odd, empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_duplicates(odd).count() == odd.count()
    kept = simhash.keep_one(odd)
    # the two texts of doc_id 1 are groups of their own, though their smallest doc_id is the same
    rows, groups = simhash.grouped(odd, simhash.RADIUS, simhash.SHINGLE_WORDS)
    assert kept.columns == odd.columns and kept.count() == groups.select("component").distinct().count() == len({r.component_id for r in simhash.near_duplicates(odd).collect()}) + 1


def test_packing_keeps_large_ids_beside_a_null(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None]
    docs = spark.createDataFrame([(i, "some words", "en", "s", 10) for i in ids], SCHEMA)
    assert {r.doc_id for r in packing.pack(docs).collect()} == set(ids)


def test_each_content_is_encoded_once(spark, library, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "the same row again", "en", "s", 1)] * 500 + [(2, "another", "en", "s", 1), (3, "the same  row again", "en", "s", 1)], SCHEMA).repartition(4)
    assert {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, cache).collect()} == {(1, len(library("the same row again"))), (2, len(library("another"))), (3, len(library("the same row again")))}
    assert spark.read.parquet(cache).count() == 2


def test_another_split_pattern_is_left_to_the_library(tmp_path):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    assert tokens.splits_at_spaces(path)
    other = tmp_path / "other.json"
    with open(path, encoding="utf-8") as f:
        other.write_text(f.read().replace("'s|'t|", "'t|'s|", 1), encoding="utf-8")
    assert not tokens.splits_at_spaces(str(other))
