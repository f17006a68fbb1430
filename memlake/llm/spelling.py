"""Operator 12: grouping spelling variants by tries of the vocabulary and Levenshtein automata of distance one.

Words are counted where the texts lie and summed. The vocabulary, range-partitioned by word, becomes compact tries of
bounded size: nodes in breadth-first order, so that a letter and the place of its first child are all a node needs. Tries
are broadcast in batches of at most ``BATCH_BYTES``; the driver holds one batch at a time. In a task the distance-one automata of some
thousand words walk a trie together, depth-first: the state without an error follows a word's own path, and at each of
its nodes the automaton may replace or insert a letter (a child other than the word's next letter) or delete one. What has made its
error must match the rest of its word, which one edge look-up a letter decides. Of equal letters the last one is deleted
and new ones come after them, so each neighbour is accepted once. A word's neighbours are reduced in the task to their
count and the best one, so a word gives one row a batch however many it has.

Defined cases: a null text has no words, a null doc_id is empty in the hash that alters words; a word of one letter
altered away is no word; rows that repeat count each time; equal counts are decided by code-point order; words may be as
long as a text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import common

#: Words of a trie, bytes of the tries that are broadcast together, words that walk together, distinct words counted before they are sent.
SHARD_WORDS, BATCH_BYTES, WALKERS, COUNTED = 1 << 16, 32 << 20, 4096, 1 << 17
#: Words that a task looks up: what parallelism follows from.
TASK_WORDS = 16_384
_FIELDS = ("text", "ends", "n", "label", "start", "word_at")
_TYPES = {"text": "u1", "ends": "<i4", "n": "<i8", "label": "u1", "start": "<i4", "word_at": "<i4"}


def word_counts(docs: DataFrame, least: int = 7, alter: int | None = 31) -> DataFrame:
    """word, n of runs of letters with A-Z lower-cased and ``least`` code points or more.

    A run whose hash with its doc_id is divisible by ``alter`` loses the letter that the hash points to (None: none does).
    """
    run = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows():
            found = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return found

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                # every letter has one byte here, whatever else the text holds becomes a sign between words
                runs = Counter(run.findall(text.as_py().encode("latin-1", "replace").lower()))
                if alter is None:
                    total.update(runs)
                else:
                    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for w, n in runs.items():
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), before)
                        if h % alter == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least:
                                continue
                        total[w] += n
                if len(total) > COUNTED:
                    yield rows()
        yield rows()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _common_prefixes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the beginning that each word shares with the one before it."""
    out = np.zeros(len(size), np.int64)
    open_ones = np.arange(1, len(size))
    at = 0
    while len(open_ones):
        a, b = open_ones - 1, open_ones
        long = (size[a] > at) & (size[b] > at)
        open_ones = open_ones[long]
        open_ones = open_ones[data[start[open_ones - 1] + at] == data[start[open_ones] + at]]
        at += 1
        out[open_ones] = at
    return out


class Trie:
    """Words in ascending order as a trie in breadth-first order; node 0 is the root."""

    def __init__(self, **arrays: np.ndarray):
        self.text, self.ends, self.n, self.label, self.start, self.word_at = (arrays[f] for f in _FIELDS)
        # an edge is parent * 256 + letter; in breadth-first order they ascend
        parent = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        self.edges = parent * 256 + self.label[1:]

    @staticmethod
    def of(found: list[bytes], n: np.ndarray) -> Trie:
        size = np.array([len(w) for w in found], np.int64)
        text, ends = np.frombuffer(b"".join(found), np.uint8), np.cumsum(size)
        shared = _common_prefixes(text, ends - size, size)
        new = size - shared
        owner = np.repeat(np.arange(len(found)), new)
        first = np.cumsum(new) - new
        depth = shared[owner] + 1 + np.arange(new.sum()) - first[owner]
        # nodes in order of words, then of depth; their places in breadth-first order
        order = np.argsort(depth, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        parent = np.concatenate([[0], place[:-1]])
        # a word leaves the path of those before it at the last node of that depth
        key = depth[order] * len(order) + order
        branch = np.searchsorted(key, shared * len(order) + first) - 1
        parent[first] = np.where(shared > 0, place[order[np.maximum(branch, 0)]], 0)
        label = np.zeros(len(order) + 1, np.uint8)
        label[place] = text[(ends - size)[owner] + depth - 1]
        start = np.concatenate([[1], 1 + np.cumsum(np.bincount(parent, minlength=len(order) + 1))])
        word_at = place[first + new - 1]
        return Trie(text=text, ends=ends.astype("<i4"), n=n.astype("<i8"), label=label, start=start.astype("<i4"), word_at=word_at.astype("<i4"))

    def packed(self) -> dict[str, bytes]:
        return {f: getattr(self, f).tobytes() for f in _FIELDS}

    @staticmethod
    def unpacked(row) -> Trie:
        return Trie(**{f: np.frombuffer(row[f], _TYPES[f]) for f in _FIELDS})

    def word(self, i: int) -> str:
        return self.text[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes().decode("latin-1")

    def ending(self) -> np.ndarray:
        """Of each node the word that ends there, or -1."""
        out = np.full(len(self.label), -1, np.int64)
        out[self.word_at] = np.arange(len(self.word_at))
        return out

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by this letter, or 0."""
        edge = node * 256 + letter
        at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
        return np.where(self.edges[at] == edge, at + 1, 0)


def near_words(trie: Trie, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``found``, word of the trie) of every pair at edit distance exactly one."""
    # two zeros after each word, so that its next two letters can always be read
    data = np.frombuffer(b"".join(w + b"\0\0" for w in found), np.uint8)
    size = np.array([len(w) for w in found], np.int64)
    begin = np.cumsum(size + 2) - size - 2
    ending, accepted = trie.ending(), []
    # a frame: words, their nodes, letters of the word that are read, whether the error was made
    stack = [(np.arange(len(found)), np.zeros(len(found), np.int64), np.zeros(len(found), np.int64), False)]
    while stack:
        word, node, read, erred = stack.pop()
        letter = data[begin[word] + read].astype(np.int64)
        child = np.where(letter > 0, trie.child(node, letter), 0)
        on = child > 0
        if erred:
            done = (letter == 0) & (ending[node] >= 0)
            if done.any():
                accepted.append((word[done], ending[node[done]]))
            if on.any():
                stack.append((word[on], child[on], read[on] + 1, True))
            continue
        if on.any():
            stack.append((word[on], child[on], read[on] + 1, False))
        gone = (letter > 0) & (data[begin[word] + read + 1] != letter)
        kids = trie.start[node + 1] - trie.start[node]
        each = np.repeat(np.arange(len(word)), kids)
        kid = trie.start[node][each] + np.arange(len(each)) - np.repeat(np.cumsum(kids) - kids, kids)
        other = trie.label[kid] != letter[each]
        each, kid = each[other], kid[other].astype(np.int64)
        replaced = letter[each] > 0
        states = [(word[gone], node[gone], read[gone] + 1), (word[each], kid, read[each]), (word[each[replaced]], kid[replaced], read[each[replaced]] + 1)]
        stack.append((*map(np.concatenate, zip(*states, strict=True)), True))
    if not accepted:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*accepted, strict=True)))


def tries(vocabulary: DataFrame, shard_words: int) -> DataFrame:
    """Tries of consecutive ranges of the vocabulary, each of at most ``shard_words`` words."""
    shards = max(1, -(-vocabulary.count() // shard_words))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[bytes, int]] = []

        def row():
            packed = Trie.of([w for w, _ in kept], np.array([n for _, n in kept], np.int64)).packed()
            return pa.RecordBatch.from_pylist([packed | {"first": kept[0][0].decode("latin-1"), "bytes": sum(map(len, packed.values()))}], pa.schema([("first", pa.string()), ("bytes", pa.int64()), *[(f, pa.binary()) for f in _FIELDS]]))

        for batch in batches:
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                kept.append((w.encode("latin-1"), n))
                if len(kept) == shard_words:
                    yield row()
                    kept.clear()
        if kept:
            yield row()

    sorted_words = vocabulary.repartitionByRange(shards, "word").sortWithinPartitions("word")
    return sorted_words.mapInArrow(build, "first string, bytes long, " + ", ".join(f"{f} binary" for f in _FIELDS))


def batches_of(sizes: list[tuple[str, int]], most: int) -> Iterator[list[str]]:
    """Names of tries, in their order, in batches of at most ``most`` bytes (one trie at least)."""
    batch, total = [], 0
    for name, size in sizes:
        if batch and total + size > most:
            yield batch
            batch, total = [], 0
        batch.append(name)
        total += size
    if batch:
        yield batch


def neighbours(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """word, n_near, form, form_n: how many words are at distance one, and the most frequent of them."""
    spark = vocabulary.sparkSession
    shards = common.stored(tries(vocabulary, shard_words), "spelling-tries")
    # a name and a size for each trie
    sizes = sorted((r["first"], r["bytes"]) for r in shards.select("first", "bytes").collect())
    path = common.new_path(spark, "spelling-near")
    schema = "word string, n_near long, form string, form_n long"
    spark.createDataFrame([], schema).write.parquet(path)
    for names in batches_of(sizes, batch_bytes):
        batch = shards.filter(F.col("first").between(names[0], names[-1])).select("first", *_FIELDS).collect()
        shared = spark.sparkContext.broadcast([r.asDict() for r in sorted(batch, key=lambda r: r["first"])])

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            walked = [Trie.unpacked(r) for r in shared.value]
            for batch in batches:
                for at in range(0, batch.num_rows, WALKERS):
                    names = batch.column("word").slice(at, WALKERS).to_pylist()
                    own = [w.encode("latin-1") for w in names]
                    near, best, form = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), [None] * len(own)
                    for trie in walked:  # in ascending order, so the first of equal counts is the smallest word
                        word, other = near_words(trie, own)
                        order = np.lexsort((other, -trie.n[other], word))
                        word, other = word[order], other[order]
                        near += np.bincount(word, minlength=len(own))
                        first = np.flatnonzero(np.diff(word, prepend=-1))
                        for w, o, n in zip(word[first].tolist(), other[first].tolist(), trie.n[other[first]].tolist(), strict=True):
                            if n > best[w]:
                                best[w], form[w] = n, trie.word(o)
                    some = np.flatnonzero(near)
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some.tolist()], pa.string()), pa.array(near[some]), pa.array([form[i] for i in some.tolist()], pa.string()), pa.array(best[some])], ["word", "n_near", "form", "form_n"])

        vocabulary.select("word").mapInArrow(search, schema).write.mode("append").parquet(path)
        shared.unpersist()
    found = spark.read.schema(schema).parquet(path).groupBy("word")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame, ratio: int, most: int) -> DataFrame:
    """word, root: forms (word, form) followed to the last, by doubling. Counts grow by ``ratio`` at each step, so the longest chain
    is known from the largest count."""
    steps = int(math.log(max(most, 1), ratio)) + 1 if ratio > 1 else most
    known = common.stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(steps.bit_length()):
        further = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        known = common.stored(known.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return known


def variants(counts: DataFrame, least_n: int = 2, ratio: int = 10, shard_words: int = SHARD_WORDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of counts (word, n) with at least ``least_n`` occurrences: the form is the near word of largest n, where
    that is at least ``ratio`` times the word's own."""
    vocabulary = common.stored(counts.filter(F.col("n") >= least_n), "spelling-counts")
    size = vocabulary.agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("most")).first()
    tasks = max(common.partitions(vocabulary.sparkSession), -(-size.words // TASK_WORDS))
    vocabulary = common.stored(vocabulary.repartition(tasks, "word"), "spelling-words")
    near = neighbours(vocabulary, shard_words, batch_bytes)
    enough = F.col("form_n") >= ratio * F.col("n")
    joined = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    joined = common.stored(joined, "spelling-forms")
    ends = roots(joined.filter("form is not null"), ratio, size.most or 0)
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
