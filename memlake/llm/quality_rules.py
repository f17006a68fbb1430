"""Operator 9: quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted, one on trusted documents and one on the whole raw corpus. A
document's score is the mean log ratio of its n-grams, so length does not count; documents whose score falls below a
threshold are rejected, each by the same comparison. Base rules (too few words, too much repetition) reject first.

Both passes are scans: a task adds up its counts in one vector of 2**16 buckets and sends only these, so what is
shuffled is bounded by the number of tasks, and the model (two vectors of fixed size) is all that reaches the driver.

Defined cases: a null or empty text has no words, fails the base rules and scores 0; rows that repeat are each judged
and each counted; an empty table gives no rows; without trusted documents every score is 0, so base rules alone
decide; other columns are ignored; a null doc_id is returned as null and is never trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import common, words

BUCKET_BITS = 16
#: Bytes in an n-gram.
NGRAM = 4
#: Ids of trusted documents that are broadcast at most (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Mean log ratio per n-gram, in nats, under which a document is unlike the trusted ones.
THRESHOLD = -0.5
SCORES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def repeated_words(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word lies in a three-word window that its document has twice or more; words are numbers of classes."""
    covered = np.zeros(len(word) + 2, bool)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    if len(at):
        parts = np.stack([doc[at], word[at], word[at + 1], word[at + 2]], axis=1)
        keys = words.mix(words.mix(words.mix(words.mix(parts[:, 0].astype(np.uint64)) + parts[:, 1].astype(np.uint64)) + parts[:, 2].astype(np.uint64)) + parts[:, 3].astype(np.uint64))
        window = words.classes(keys, lambda i, first: (parts[i] == parts[first]).all(axis=1))
        if window is None:
            window = np.unique(parts, axis=0, return_inverse=True)[1].reshape(-1)
        again = at[np.bincount(window)[window] > 1]
        for i in range(3):
            covered[again + i] = True
    return covered[: len(word)]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each document of a slice; equal lines and windows are told by their bytes, not by hashes."""
    n_docs = len(offsets) - 1
    start, end, doc = words.word_bounds(data, offsets)
    at = words.spans_per_document(doc, n_docs)
    whole = data.tobytes()
    return {
        "n_words": np.diff(at),
        "word_chars": per_document(~words._SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_document(_SYMBOL[data], offsets),
        "n_dup_lines": np.array([repeated_lines(whole[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64),
        "n_repeat_words": per_document(repeated_words(words.word_classes(data, start, end), doc), at),
    }


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document index) of every n-gram that lies in one document."""
    if len(data) < NGRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buckets = (words.byte_hashes(data).all_of(NGRAM) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(buckets)]
    own = offsets[doc + 1] - np.arange(len(buckets)) >= NGRAM
    return buckets[own], doc[own]


def ngram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, n_raw, n_trusted over all documents; ``trusted`` has the doc_id of trusted ones.

    The raw corpus is counted where it lies. Trusted texts are found by their ids, sent to all tasks where these are few.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for part in words.slices(batches):
            total += np.bincount(ngram_buckets(*words.text_bytes(part.column("text")))[0], minlength=1 << BUCKET_BITS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    good = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    counted = [df.select("text").mapInArrow(count, "bucket long, n long").select("bucket", *[F.col("n") if i == k else F.lit(0).cast("long") for k in (0, 1)]) for i, df in enumerate((texts, good))]
    both = counted[0].union(counted[1]).toDF("bucket", "n_raw", "n_trusted")
    return both.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_trusted").alias("n_trusted"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(trusted share / raw share) by bucket, with add-one smoothing; a vector of 2**16, whatever the corpus."""
    raw, good = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    for bucket, n_raw, n_good in counts.select("bucket", "n_raw", "n_trusted").collect():
        raw[bucket], good[bucket] = n_raw, n_good
    if not good.sum():
        return np.zeros(1 << BUCKET_BITS)
    return np.log((good + 1) / (good + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())


def _judged(part: pa.RecordBatch, ratios: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts and mean log ratio of a slice's documents."""
    data, offsets = words.text_bytes(part.column("text"))
    buckets, doc = ngram_buckets(data, offsets)
    n = np.bincount(doc, minlength=part.num_rows)
    total = np.bincount(doc, weights=ratios[buckets], minlength=part.num_rows)
    return base_counts(data, offsets), total / np.maximum(n, 1)


def base_failed(n_words, n_repeat_words):
    """Too few words, or more than half of them repeated; on arrays and on columns."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, base_failed, llr and kept of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(ngram_counts(docs, trusted)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            counts, llr = _judged(part, shared.value)
            arrays = [pa.array(np.asarray(x, np.int64)) for x in counts.values()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays, pa.array(llr)], [x.split()[0] for x in SCORES.split(", ")])

    scores = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).mapInArrow(judge, SCORES)
    scores = scores.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return scores.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``quality`` keeps; text moves nowhere."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(ngram_counts(docs, trusted)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            counts, llr = _judged(part, shared.value)
            good = ~base_failed(counts["n_words"], counts["n_repeat_words"]) & (llr >= threshold)
            yield part.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
