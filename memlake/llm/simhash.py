"""Operator 10: SimHash near-duplicates with bit-sliced comparison.

Fingerprints of distinct value are the nodes, so exact copies of any number are one node. Two fingerprints that differ
in at most ``radius`` bits agree on at least two of ``radius + 2`` blocks, so each pair of blocks is a bucket key and no
link is lost; a large bucket is dealt again by further blocks. Inside a bucket, of whatever size, fingerprints are
stored vertically, a machine word holding one bit of 64 of them (see ``bitplanes``): distances are carry-save counters over the
planes, and words are left once every lane has passed the radius. Only links that span a bucket's components are
emitted, so a tight group of any size gives about one link a member. Components then follow from alternating star rounds.

Defined cases: a null or empty text has fingerprint zero, linked like any other; texts of fewer words than a shingle
are one shingle; rows that repeat share a component; a null doc_id is its own row, takes the component of its
fingerprint, and comes after every number (a component of null ids alone has none); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm import common
from memlake.llm.bitplanes import Comparison, spanning_links
from memlake.llm.components import components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Shingles whose bits are counted in one numpy pass.
PASS = 1 << 16
#: Members of a bucket from which it is dealt again by more bits, and how often that is done at most.
LIMIT, FINEST = 2048, 4


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(first)
    for at in range(0, n, PASS):
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(first[at : at + PASS], last[at : at + PASS], strict=True)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, row and fp (signed 64 bits) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(found.view(np.int64))], ["doc_id", "row", "fp"])

    return common.keyed(docs).select("doc_id", "row", "text").mapInArrow(each, "doc_id long, row long, fp long")


def block_masks(free: int, n_blocks: int, agreed: int) -> list[int]:
    """Masks of every ``agreed`` of ``n_blocks`` blocks into which the bits of ``free`` are cut."""
    bits = [b for b in range(64) if free >> b & 1]
    edges = [round(i * len(bits) / n_blocks) for i in range(n_blocks + 1)]
    blocks = [sum(1 << b for b in bits[s:e]) for s, e in zip(edges, edges[1:], strict=False)]
    return [sum(some) for some in combinations(blocks, agreed)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed_by(masks: list[int]) -> Column:
    """A bucket (mask, key) for each mask: the fingerprint's bits there."""
    return F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks])


def split_buckets(entries: DataFrame, radius: int, limit: int = LIMIT) -> Iterator[DataFrame]:
    """The same entries (mask, key, fp) in buckets of at most ``limit`` members.

    A larger bucket is dealt again by radius + 1 blocks of the bits that its mask leaves, of which two fingerprints
    within the radius agree on one at least, and so on. After FINEST times 17 bits or fewer are left, which bounds a
    bucket whatever the table.
    """
    masks = block_masks((1 << 64) - 1, radius + 2, 2)
    for level in range(FINEST + 1):
        sizes = entries.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        large = common.stored(sizes.filter(F.col("n") > limit), "simhash-large") if level < FINEST else None
        if large is None or not large.limit(1).count():
            yield entries
            return
        yield entries.join(large, ["mask", "key"], "left_anti")
        finer = {m: [m | more for more in block_masks(~m & ((1 << 64) - 1), radius + 1, 1)] for m in masks}
        by_mask = F.create_map(*[x for m, some in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in some]))])
        entries = entries.join(large, ["mask", "key"], "left_semi").select("fp", F.explode(by_mask[F.col("mask")]).alias("mask"))
        entries = common.stored(entries.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"), "simhash-entries")
        masks = sorted({f for some in finer.values() for f in some})


def links(distinct: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that keep every component together."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            values = values[offsets[0] : offsets[-1]]
            for a, b in spanning_links(np.diff(offsets), lambda at: Comparison((values[at].view(np.uint8).reshape(-1, 8), 1, radius))):  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(values[a]), pa.array(values[b])], ["a", "b"])

    entries = distinct.select("fp", F.explode(keyed_by(block_masks((1 << 64) - 1, radius + 2, 2))).alias("x")).select("x.mask", "x.key", "fp")
    found = None
    for part in split_buckets(entries, radius, limit):
        # a bucket is one array: its members are distinct fingerprints, and their number is bounded
        buckets = part.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
        some = buckets.mapInArrow(compare, "a long, b long")
        found = some if found is None else found.union(some)
    return found


def grouped(docs: DataFrame, radius: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows; and fp, first (smallest doc_id) and component (one of its fingerprints) of each distinct one."""
    rows = common.stored(fingerprints(docs, width), "fingerprints")
    nodes = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    found = components(links(nodes.select("fp"), radius))
    return rows, nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, row, fp and component_id (the smallest doc_id reachable) of every row of ``docs``."""
    rows, groups = grouped(docs, radius, width)
    smallest = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(groups.join(smallest, "component").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, one of each group of near-duplicates: the smallest doc_id."""
    rows, groups = grouped(docs, radius, width)
    # by component, not by its smallest doc_id, which two components share where ids repeat
    named = rows.join(groups.select("fp", "component"), "fp").select("component", F.struct(F.coalesce("doc_id", F.lit(common.MAX_LONG)).alias("order"), "row").alias("own"))
    chosen = named.groupBy("component").agg(F.min("own").alias("first")).select("first.row")
    keyed = docs.select(F.struct("*").alias("d"), common.row_key(docs).alias("row"))
    return keyed.join(chosen, "row").dropDuplicates(["row"]).select("d.*")
