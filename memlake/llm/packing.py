"""Operator 6: packing token sequences by best-fit decreasing.

A document's ids end with a separator id. Overlong documents are first cut into full windows; what is left of each
document is placed, longest first, in the open window that it fits most tightly, which a segment tree over remaining
capacities finds. Only lengths and checksums are shuffled, never ids. Groups of some thousand pieces, dealt by a hash,
are packed independently: a group wastes part of one window at most, and no group grows with the input.

Defined cases: a null or empty text is the separator alone; rows that repeat are each packed; an empty table gives no
rows; other columns are ignored; a null doc_id is returned as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import common, tokens

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces that are packed together.
GROUP_PIECES = 4096


class TightestFit:
    """Segment tree over capacities 0..size: counts open windows by what they have left; finds the smallest that fits."""

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._count = [0] * (2 * self._leaves)
        self._open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, left: int, window: int) -> None:
        self._open[left].append(window)
        node = self._leaves + left
        while node:
            self._count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(remaining capacity, window) of the tightest open window of at least this capacity, removed from the tree."""
        count, node = self._count, self._leaves + length
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        left = node - self._leaves
        while node:
            count[node] -= 1
            node >>= 1
        return left, self._open[left].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each length; lengths come longest first."""
    tree, used, windows, offsets = TightestFit(size), 0, [], []
    for n in lengths:
        found = tree.take(n)
        if found is None:
            left, window, used = size, used, used + 1
        else:
            left, window = found
        windows.append(window)
        offsets.append(size - left)
        if left > n:
            tree.add(left - n, window)
    return windows, offsets


def pieces(docs: DataFrame, tokenizer: str, size: int, separator: int) -> DataFrame:
    """Full windows of each document and what is left, with checksums of their ids; ids stay in the task."""
    end = np.asarray([separator], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(encoder.ids_bytes(text.as_py()) + end)
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    out.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", size: int = 4096, separator: int = 2) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; each sequence holds at most ``size`` ids."""
    cut = common.stored(pieces(docs, tokenizer, size, separator), "pieces")
    groups = cut.count() // GROUP_PIECES + 1

    def place(group: tuple, rows: pa.Table) -> pa.Table:
        # Arrow throughout: pandas would make doubles of ids that a null stands beside
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])).drop_columns("group")
        windows, offsets = best_fit_decreasing(rows.column("length").to_pylist(), size)
        rows = rows.append_column("sequence_id", pa.array(np.asarray(windows, np.int64) + (int(group[0].as_py()) << 32)))
        return rows.append_column("offset", pa.array(np.asarray(offsets, np.int64)))

    # a piece's place in the table tells equal pieces apart, so that repeated rows are dealt to all groups
    dealt = cut.withColumn("place", F.monotonically_increasing_id()).withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "place"), F.lit(groups))).drop("place")
    return dealt.groupBy("group").applyInArrow(place, f"{PIECE}, sequence_id long, offset long").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
