"""Near-duplicates of Jaccard similarity 0.8 or more on word shingles, for the pipeline's near-duplicate stage.

Operator 10 links SimHash fingerprints at a few bits. At similarity 0.8 these differ in about 10 of 64 bits, where no
blocks of a fingerprint are both selective and surely equal, so candidates meet in bands of minimum hashes instead
(BANDS keys of BAND_ROWS hashes). Inside a bucket, as in operator 10, bit planes are compared with carry-save counters:
first the SimHash fingerprints at a radius within which hardly a pair of that similarity fails to be, then codes of four bits
of each of MINIMA minimum hashes, which tell 0.8 from 0.7. Links that span what is close are confirmed with exact shingle
sets. As such a link may fail where another pair of its bucket would not, buckets whose members have not all come together
then get their members' sets, and every close pair that is still apart is compared there; only what joins two groups
leaves the task, so a group gives links in proportion to its members. A bucket of more than LIMIT nodes is compared in blocks.

The nodes are distinct shingle sets, so exact copies of any number are one node. Defined cases are those of
``simhash``; texts without a word have equal (empty) sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import common, simhash, words
from memlake.llm.bitplanes import Comparison, close_pairs, spanning_links
from memlake.llm.components import components

WIDTH = 5
#: Similarity as a fraction, so that it is compared in whole numbers.
SHARED, OF = 4, 5
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 25 = 5e-5.
BANDS, BAND_ROWS = 25, 5
#: Minimum hashes of a code; the bands use the first of them.
MINIMA = 250
#: Most differing SimHash bits, and most differing digits of the codes. At similarity 0.8 about 10 of 64 bits and 47 of 250 digits
#: differ, with standard deviations of 3 and 6.2; at 0.7 it is 70 digits.
RADIUS, DIGITS = 24, 65
#: Nodes of a bucket that are compared together.
LIMIT = 2048
#: Shingles whose permutations are in memory at a time.
PASS = 2048

_rng = np.random.default_rng(simhash.SEED)
_FLIP = _rng.integers(0, 1 << 64, MINIMA, np.uint64)
_ODD = _rng.integers(0, 1 << 64, MINIMA, np.uint64) | np.uint64(1)
_FOLD = _rng.integers(0, 1 << 64, BAND_ROWS, np.uint64) | np.uint64(1)


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of a text's word shingles, in their order and with repeats."""
    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(own))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(own) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], simhash.SEED) for s, e in spans), np.uint64)


def simhash_of(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of shingle hashes, one unsigned long."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), simhash.PASS):
        part = hashes[at : at + simhash.PASS]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def minima(distinct: np.ndarray) -> np.ndarray:
    """The least value of a shingle set under each permutation."""
    least = np.full(MINIMA, ~np.uint64(0))
    for at in range(0, len(distinct), PASS):
        np.minimum(least, ((distinct[at : at + PASS, None] ^ _FLIP) * _ODD).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of minimum hashes."""
    bands = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    return words.mix(words.mix(bands * _FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def digits(least: np.ndarray) -> bytes:
    """Four bits of each minimum, two to a byte."""
    four = (words.mix(least) >> np.uint64(60)).astype(np.uint8)
    return (four[0::2] | four[1::2] << 4).tobytes()


def profiles(docs: DataFrame) -> DataFrame:
    """order (doc_id, null: last), row, node (digest of the shingle set), fp, n (shingles), code and bands."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            node, fp, n, code, bands = [], [], [], [], []
            for t in batch.column("text"):
                hashes = shingle_hashes(t.as_py())
                own = np.unique(hashes)
                least = minima(own)
                node.append(xxhash.xxh64_intdigest(own.tobytes(), simhash.SEED))
                fp.append(simhash_of(hashes)[0])
                n.append(len(own))
                code.append(digits(least))
                bands.append(band_keys(least).view(np.int64))
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            arrays = [batch.column("order"), batch.column("row"), longs(node), longs(fp), pa.array(n, pa.int64()), pa.array(code, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["order", "row", "node", "fp", "n", "code", "bands"])

    rows = common.keyed(docs).select(F.coalesce("doc_id", F.lit(common.MAX_LONG)).alias("order"), "row", "text")
    return rows.mapInArrow(each, "order long, row long, node long, fp long, n long, code binary, bands array<long>")


def shingle_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node and its sorted shingles, from the texts of the chosen rows (node, row): most texts meet no other, so sets are
    taken again where they are needed instead of being kept."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            sets = [np.unique(shingle_hashes(t.as_py())).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    texts = common.keyed(docs).select("row", "text").join(chosen, "row").select("node", "text")
    return texts.mapInArrow(each, "node long, shingles array<long>")


def alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return OF * np.minimum(n, m) >= SHARED * np.maximum(n, m)


def _members(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray], object]:
    """Sizes of the buckets of a batch, columns of their members, and what compares members at given positions."""
    column = batch.column("members")
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    of = {k: values.field(k).to_numpy(zero_copy_only=False) for k in ("node", "fp", "n", "label")}
    code = np.frombuffer(b"".join(values.field("code").to_pylist()), np.uint8).reshape(len(values), -1)
    return np.diff(offsets), of | {"values": values}, lambda at: Comparison((of["fp"][at].view(np.uint8).reshape(-1, 8), 1, RADIUS), (code[at], 4, DIGITS))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def candidates(buckets: DataFrame) -> DataFrame:
    """Distinct pairs a < b of nodes of a bucket's ``members`` (node, fp, n, code, label): links enough to span what is close."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, of, tests = _members(batch)
            for a, b in spanning_links(sizes, tests):
                own = alike(of["n"][a], of["n"][b])
                yield _pairs(of["node"][a[own]], of["node"][b[own]])

    return buckets.select("members").mapInArrow(each, "a long, b long").distinct()


def joining(buckets: DataFrame) -> DataFrame:
    """Pairs a < b, similar enough, that join what is still apart in a bucket: its ``members`` have their ``shingles`` too.

    Close pairs of different labels are compared where they are; only those that join two labels are given out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, of, tests = _members(batch)
            sets, bucket = of["values"].field("shingles"), np.repeat(np.arange(len(sizes)), sizes)
            joined: dict[tuple[int, int], tuple[int, int]] = {}

            def root(x: tuple[int, int]) -> tuple[int, int]:
                while x in joined:  # noqa: B023
                    x = joined[x]  # noqa: B023
                return x

            found = []
            for a, b in close_pairs(sizes, tests, of["label"]):
                own = alike(of["n"][a], of["n"][b])
                for x, y in zip(a[own].tolist(), b[own].tolist(), strict=True):
                    i, j = root((int(bucket[x]), int(of["label"][x]))), root((int(bucket[y]), int(of["label"][y])))
                    if i != j and similar_sets(sets[x].values.to_numpy(), sets[y].values.to_numpy()):
                        joined[max(i, j)] = min(i, j)
                        found.append((x, y))
            if found:
                x, y = np.array(found).T
                yield _pairs(of["node"][x], of["node"][y])

    return buckets.select("members").mapInArrow(each, "a long, b long").distinct()


def similar_sets(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return OF * both >= SHARED * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are similar enough."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar_sets(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first, second = (sets.select(F.col("node").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(each, "a long, b long")


def in_blocks(entries: DataFrame, limit: int) -> DataFrame:
    """Entries (bucket, node) of buckets with more than one node, as (bucket, block, node) with at most two times ``limit``
    nodes in a block: a larger bucket's nodes are dealt by hash, and each two of its deals are a block."""
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = common.stored(sizes.select("bucket", F.ceil(F.col("n") / limit).cast("int").alias("deals")), "similar-sizes")
    deal = F.pmod(F.xxhash64("node", F.lit(3)), "deals").cast("int")
    met = entries.join(sizes, "bucket").withColumn("deal", deal).withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("deals") - 1))))
    # the deals themselves come with the others wherever there are others
    met = met.filter("deals = 1 or other != deal")
    return met.select("bucket", F.concat_ws("/", F.least("deal", "other"), F.greatest("deal", "other")).alias("block"), "node")


def groups(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """order, row and group (the smallest node reachable by pairs of the similarity) of every row of ``docs``."""
    known = common.stored(profiles(docs), "similar-profiles")
    nodes = known.groupBy("node").agg(F.min("row").alias("row"), F.first("bands").alias("bands"))
    entries = common.stored(nodes.select(F.explode("bands").alias("bucket"), "node"), "similar-entries")
    members = in_blocks(entries, limit).groupBy("bucket", "block").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    # nodes that share many bands are one bucket
    members = members.groupBy("nodes").agg(F.count(F.lit(1)).alias("bands")).select(F.monotonically_increasing_id().alias("bucket"), "nodes")
    members = common.stored(members.select("bucket", F.explode("nodes").alias("node")), "similar-members")
    met = members.select("node").distinct()
    chosen = common.stored(nodes.select("node", "row").join(met, "node", "left_semi"), "similar-chosen")
    codes = known.join(chosen, ["node", "row"]).select("node", "fp", "n", "code").dropDuplicates(["node"])
    sets = common.stored(codes.join(shingle_sets(docs, chosen).dropDuplicates(["node"]), "node"), "similar-sets")
    # rows of their own, so that Spark can split a large bucket's join
    members = common.stored(members.join(sets.select("node", "fp", "n", "code"), "node"), "similar-members")
    # as many partitions as the session has, though their rows are few: the work is in comparing them
    even = lambda df: df.repartition(common.partitions(docs.sparkSession), "bucket").groupBy("bucket")
    alone = even(members.withColumn("label", F.col("node"))).agg(F.collect_list(F.struct("node", "fp", "n", "code", "label")).alias("members"))
    links = common.stored(confirmed(common.stored(candidates(alone), "similar-pairs"), sets), "similar-links")
    label = components(links)
    labelled = members.join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    labelled = common.stored(labelled, "similar-labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    apart = labelled.join(mixed, "bucket", "left_semi").join(sets.select("node", "shingles"), "node")
    apart = even(apart).agg(F.collect_list(F.struct("node", "fp", "n", "code", "label", "shingles")).alias("members"))
    label = components(links.union(joining(apart)))
    return known.select("order", "row", "node").join(label, "node", "left").select("order", "row", F.coalesce("component", "node").alias("group"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, one of each group of near-duplicates: the smallest doc_id."""
    chosen = groups(docs).groupBy("group").agg(F.min(F.struct("order", "row")).alias("x")).select("x.row")
    keyed = docs.select(F.struct("*").alias("d"), common.row_key(docs).alias("row"))
    return keyed.join(chosen, "row").dropDuplicates(["row"]).select("d.*")
