"""Operator 2: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows outside the held-out fold are dealt into three disjoint parts: one finds the lexicon (word beginnings that
toxic documents have far more often), one trains the trees, one calibrates. Each part uses at most ``sample`` rows, those
of smallest hash. Features are densities of lexicon words in several strengths, nearness of second-person words to them,
rates of capitals, punctuation and obfuscated spellings, and length; they and the trees' scores are computed for every
whole text. Labels, language, source and doc_id are inputs of no score.

Defined cases: a null or empty text has the features of no words and is scored like any other; rows that repeat are each
scored; a null doc_id is held out and returned as null; with too few labels of either kind the score is 0.75 where a
word of the built-in list occurs and 0 elsewhere; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm import common, words

#: Labelled rows that each part (lexicon, trees, calibration) uses at most.
SAMPLE = 20_000
#: Entries of the learned lexicon at most, and documents that an entry needs.
ENTRIES, ENTRY_DOCUMENTS = 4096, 5
#: Lower confidence bound of an entry's log odds ratio: to be in the lexicon, and to count as strong.
WEAK, STRONG = 2.0, 3.0
#: Bytes of the word beginnings that can be entries.
PREFIXES = (4, 5, 6, 8)
#: Common insults, so that a lexicon exists before any label does.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "imbecile", "jerk", "filth", "vermin", "dumb", "freak", "coward")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "toi", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "euch", "usted", "ustedes", "vosotros", "ti", "te", "su")
FEATURES = (
    "log_words", "log_hits", "hit_density", "strong_density", "log_strong", "most_strength", "mean_strength", "log_distinct", "insult_density", "log_insults",
    "nearness", "second_person", "capitals", "punctuation", "exclamations", "obfuscated",
)


def _lower_table(pairs: str = "") -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for a, b in zip(pairs[0::2], pairs[1::2], strict=True):
        table[ord(a)] = ord(b)
    return table


#: Lower case, and digits or signs that stand for letters read as these.
_PLAIN = _lower_table("0o1i3e4a5s7t@a$s")
_LOWER = _lower_table()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def _name(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words.byte_hashes(data)(np.array([0]), np.array([len(data)]))[0])


def _beginnings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row for each word: the names of its beginnings (a shorter word's is the word itself)."""
    named = words.byte_hashes(data)
    return np.stack([named(start, np.minimum(end, start + n)) for n in PREFIXES], axis=1)


class Lexicon:
    """Names of entries with their strengths; of fixed size at most, so it may be broadcast."""

    def __init__(self, names: np.ndarray, strengths: np.ndarray):
        order = np.argsort(names)
        self.names, self.strengths = names[order], strengths[order]
        self.insults = np.sort(np.array([_name(w[: max(PREFIXES)]) for w in INSULTS], np.uint64))
        self.second_person = np.sort(np.array([_name(w) for w in SECOND_PERSON], np.uint64))

    @staticmethod
    def _find(sorted_names: np.ndarray, names: np.ndarray) -> np.ndarray:
        if not len(sorted_names):
            return np.full(names.shape, -1)
        at = np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)
        return np.where(sorted_names[at] == names, at, -1)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of FEATURES for each document of a slice."""
        n_docs = len(offsets) - 1
        start, end, doc = words.word_bounds(data, offsets)
        n_words = np.bincount(doc, minlength=n_docs)
        per_word = lambda x: np.bincount(doc, weights=x, minlength=n_docs)
        share = lambda x, of: x / np.maximum(of, 1)

        begin = _beginnings(_PLAIN[data], start, end)
        at = self._find(self.names, begin)
        strength = np.where(at >= 0, self.strengths[at] if len(self.strengths) else 0.0, 0.0).max(axis=1, initial=0.0)
        insult = (self._find(self.insults, begin) >= 0).any(axis=1)
        hit = (strength > 0) | insult
        lower = words.byte_hashes(_LOWER[data])
        # a word may carry a sign at its end
        bare = end - _PUNCTUATION[data[np.maximum(end - 1, 0)]].astype(np.int64) if len(end) else end
        addressed = self._find(self.second_person, lower(start, np.maximum(bare, start))) >= 0

        # nearness: 1 / (1 + words between a hit and the nearest second-person word of its document), the largest
        nearness = np.zeros(n_docs)
        hits, others = np.flatnonzero(hit), np.flatnonzero(addressed)
        if len(hits) and len(others):
            right = np.searchsorted(others, hits)
            for side in (np.maximum(right - 1, 0), np.minimum(right, len(others) - 1)):
                near = others[side]
                value = np.where(doc[near] == doc[hits], 1.0 / (1 + np.abs(near - hits)), 0.0)
                np.maximum.at(nearness, doc[hits], value)

        distinct = np.zeros(n_docs)
        if len(hits):
            pairs = np.unique(np.stack([doc[hits].astype(np.uint64), begin[hits, 1]], axis=1), axis=0)
            distinct = np.bincount(pairs[:, 0].astype(np.int64), minlength=n_docs).astype(float)
        most = np.zeros(n_docs)
        np.maximum.at(most, doc, strength)

        # obfuscated: a sign or digit between letters of a word
        letter = _LETTER[data]
        inner = np.zeros(len(data), bool)
        if len(data) > 2:
            inner[1:-1] = letter[:-2] & ~letter[1:-1] & letter[2:] & ~words._SPACE[data[1:-1]] & (data[1:-1] != 39) & (data[1:-1] != 45)
        total = np.concatenate([[0], np.cumsum(inner)])
        obfuscated = total[end] - total[start] > 0
        rate = lambda table: share(np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets]).astype(float), np.diff(offsets))
        sums = [per_word(hit), per_word(strength >= STRONG), per_word(strength), per_word(insult)]
        letters = rate(_LETTER)
        columns = {
            "log_words": np.log1p(n_words), "log_hits": np.log1p(sums[0]), "hit_density": share(sums[0], n_words), "strong_density": share(sums[1], n_words), "log_strong": np.log1p(sums[1]),
            "most_strength": most, "mean_strength": share(sums[2], n_words), "log_distinct": np.log1p(distinct), "insult_density": share(sums[3], n_words), "log_insults": np.log1p(sums[3]),
            "nearness": nearness, "second_person": share(per_word(addressed), n_words), "capitals": rate(_UPPER) / np.maximum(letters, 1e-9), "punctuation": rate(_PUNCTUATION),
            "exclamations": rate(np.arange(256) == 33), "obfuscated": share(per_word(obfuscated), n_words),
        }
        return np.stack([columns[name] for name in FEATURES], axis=1).astype(float)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out fold."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...], sample: int) -> DataFrame:
    """Texts and ``toxic`` of at most ``sample`` labelled rows of these folds; ids are broadcast, their number is bounded."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.filter(fold(F.col("doc_id")).isin(*folds)).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    found = _texts(docs).join(F.broadcast(some), "doc_id")
    # of rows with one id the same one in every run: the one of the smallest digest
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.sha2(F.col("text").cast("binary"), 256), "text", "toxic")).alias("x"))
    return one.select("doc_id", "x.text", "x.toxic")


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Word beginnings whose log odds ratio between toxic and other documents is surely high."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            data, offsets = words.text_bytes(part.column("text"))
            start, end, doc = words.word_bounds(data, offsets)
            names = _beginnings(_PLAIN[data], start, end)
            toxic = part.column("toxic").to_numpy() == 1
            # each entry once a document
            pairs = np.unique(np.stack([np.repeat(doc.astype(np.uint64), names.shape[1]), names.reshape(-1)], axis=1), axis=0)
            name, back = np.unique(pairs[:, 1], return_inverse=True)
            of_toxic = toxic[pairs[:, 0].astype(np.int64)]
            counts = [np.bincount(back, weights=w, minlength=len(name)).astype(np.int64) for w in (of_toxic, ~of_toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *map(pa.array, counts)], ["name", "t", "o"])

    totals = {bool(r.toxic): r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_other = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_other:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    found = rows.mapInArrow(count, "name long, t long, o long").groupBy("name").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).filter(F.col("t") >= ENTRY_DOCUMENTS)
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("o") + 0.5) / (n_other + 1))
    sure = odds - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("o") + 0.5))
    best = found.withColumn("strength", sure).filter(F.col("strength") >= WEAK).orderBy(F.desc(F.col("t") * F.col("strength")), "name").limit(ENTRIES).collect()
    return Lexicon(np.array([r.name for r in best], np.int64).view(np.uint64), np.array([r.strength for r in best], float))


def with_features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows`` with a ``features`` vector in place of text."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    others = [c for c in rows.columns if c != "text"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            found = shared.value.features(*words.text_bytes(part.column("text")))
            offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.ListArray.from_arrays(offsets, found.reshape(-1))], [*others, "f"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(compute, ", ".join([*[f"{c} {kinds[c]}" for c in others], "f array<double>"]))
    return out.select(*others, array_to_vector("f").alias("features"))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    parts = [labelled(docs, labels, folds, sample) for folds in ((1, 2), (3,), (4,))]
    lexicon = learn_lexicon(common.stored(parts[0], "toxicity-lexicon"))
    train, calibrate = (common.stored(with_features(p.select("toxic", "text"), lexicon), "toxicity-train") for p in parts[1:])
    everything = with_features(_texts(docs), lexicon)
    raw = F.col("raw")
    if train.select("toxic").distinct().count() < 2:
        insults = vector_to_array("features")[FEATURES.index("log_insults")]
        scored = everything.withColumn("score", F.when(insults > 0, 0.75).otherwise(0.0))
    else:
        trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2, seed=1, maxBins=64).fit(train)
        chance = vector_to_array("probability")[1]
        scored = trees.transform(everything).withColumn("raw", chance)
        held = trees.transform(calibrate).select("toxic", chance.alias("raw"))
        if held.select("toxic").distinct().count() == 2:
            isotonic = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="calibrated").fit(held)
            # the raw score decides between documents of one calibrated step, and moves none across the threshold
            mixed = 0.999 * F.col("calibrated") + 0.001 * raw
            sided = F.when(F.col("calibrated") >= 0.5, F.greatest(F.lit(0.5), mixed)).otherwise(F.least(F.lit(0.499999), mixed))
            scored = isotonic.transform(scored.drop("prediction")).withColumn("score", sided)
        else:
            scored = scored.withColumn("score", raw)
    scored = scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
