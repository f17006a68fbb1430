"""Operator 1: removing every byte of 100-byte strings that also start earlier, by column-wise BWT construction.

Super-windows (see ``repeats``) of one anchor are strings aligned on it, so equal 100-byte strings stand in equal
columns. A bucket's strings are a collection to which each round adds one symbol per string, from the last column to
the first: the symbols that precede the sorted suffixes are that column of the collection's BWT, a stable distribution
by symbol (the LF step) orders the longer suffixes, and common prefixes with the neighbour above follow as one plus a
range minimum. Columns lie transposed in one external file that is read once, backwards column by column, and the order
and common prefixes of a round are a file that the next round reads from front to back. After a hundred rounds,
neighbours with a common prefix of 100 or more are occurrences of one string.

A bucket's key is what all windows of half a super-window share, some 62 bytes around the anchor, so texts that have a
short phrase in common do not meet over it.

Whole documents can't be inserted symbol by symbol here: it takes as many rounds over a growing BWT as the longest one
has bytes. Cutting at anchors bounds the rounds by 176 and lets buckets work in parallel, and loses no occurrence.

Defined cases: a null or empty text has nothing to remove; texts under 100 bytes stay whole; a row that repeats another
(same doc_id and text) is the same document and gets the same result; rows of one doc_id with other texts are ordered
by a hash of the text; a null doc_id comes after all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memlake.llm import repeats, words

WIDTH = 100
#: Bytes of an anchor; the windows of one anchor are at most WIDTH - GRAM + 1.
GRAM = 24
NONE = np.uint64((1 << 64) - 1)


def _halves(found: repeats.SuperWindows, cut: int) -> tuple[repeats.SuperWindows, np.ndarray]:
    """Super-windows split by how far before their anchor windows begin: ``cut`` or more (early), or less.

    The windows of a half share about 62 bytes in place of the anchor's 24, so a phrase that many documents have in
    other surroundings no longer brings all of them together.
    """
    n_early = np.clip(found.anchor - cut + 1 - found.start, 0, found.count)
    parts = np.stack([n_early, found.count - n_early], axis=1).reshape(-1)
    both = found.take(np.repeat(np.arange(len(found.key)), 2))
    early = np.tile([True, False], len(found.key))
    both.start = both.start + np.where(early, 0, np.repeat(n_early, 2))
    both.count = parts
    some = parts > 0
    return both.take(some), early[some]


def _scan(width: int, gram: int):
    def scan(data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        if n < width:
            none = np.zeros(0, np.int64)
            return repeats.SuperWindows(none.astype(np.uint64), none, none, none, none), (data, offsets)
        hashes = words.byte_hashes(data)
        symbols = hashes.all_of(gram)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        place = np.arange(n - width + 1)
        at = doc[: len(place)]
        valid = offsets[at + 1] - place >= width
        found = repeats.super_windows(symbols, valid, 0, width - gram + 1, at, place - offsets[at])
        found, early = _halves(found, (width - gram + 1) // 2)
        # what all windows of a half share: from its last start to the end of its first window
        anchor = found.anchor + offsets[found.doc]
        cut = (width - gram + 1) // 2
        begin = np.where(early, anchor - cut, anchor)
        end = np.where(early, anchor + gram, anchor - cut + 1 + width)
        found.context(hashes(begin, end) + early.astype(np.uint64))
        return found, (data, offsets)

    return scan


def _contents(width: int):
    def contents(scan, some: repeats.SuperWindows, which) -> tuple[bytes, np.ndarray]:
        data, offsets = scan
        begin = offsets[some.doc] + some.start
        size = some.count + width - 1
        # gather all strings with one index array
        ends = np.cumsum(size)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
        return data[index].tobytes(), size

    return contents


def common_prefix_rounds(strings: np.ndarray, folder: str, columns_from: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, order, lcp) of each round, from the last column to the first, for columns below ``columns_from``.

    ``strings``: a row of symbols for each string. ``order`` sorts the strings' suffixes from that column on;
    ``lcp[i]`` is the common prefix of suffixes order[i - 1] and order[i].
    """
    m, n_columns = strings.shape
    columns, state = f"{folder}/columns", f"{folder}/state"
    np.ascontiguousarray(strings.T).tofile(columns)
    with open(state, "wb") as out:
        np.arange(m, dtype=np.int32).tofile(out)
        np.zeros(m, np.uint8).tofile(out)
    with open(columns, "rb") as symbols:
        for column in reversed(range(n_columns)):
            symbols.seek(column * m)
            inserted = np.fromfile(symbols, np.uint8, m)
            with open(state, "rb") as last:
                order, lcp = np.fromfile(last, np.int32, m), np.fromfile(last, np.uint8, m)
            bwt = inserted[order]
            step = np.argsort(bwt, kind="stable")
            order, sorted_bwt = order[step], bwt[step]
            longer = np.zeros(m, np.uint8)
            same = np.flatnonzero(sorted_bwt[1:] == sorted_bwt[:-1]) + 1
            if len(same):
                # the minimum over (previous place, own place] of the last round's common prefixes
                pairs = np.empty(2 * len(same), np.int64)
                pairs[0::2], pairs[1::2] = step[same - 1] + 1, step[same] + 1
                least = np.minimum.reduceat(np.append(lcp, np.uint8(255)), pairs)[0::2]
                longer[same] = np.minimum(least, 254) + 1
            with open(state, "wb") as out:
                order.tofile(out)
                longer.tofile(out)
            if column < columns_from:
                yield column, order, longer


def _firsts(width: int, gram: int):
    most = width - gram + 1

    def firsts(keys, starts, counts, anchors, data, offsets, sizes) -> np.ndarray:
        """Strings come in document order, so of a class the smallest index is the first occurrence."""
        m = len(keys)
        left = (most - 1) - (anchors - starts)  # column of a string's first window; its anchor is in column most - 1
        strings = np.zeros((m, most - 1 + width), np.uint8)
        for at in range(0, m, 8192):  # index arrays are eight times the size of what they gather
            size = sizes[at : at + 8192]
            ends = np.cumsum(size)
            within = np.arange(ends[-1]) - np.repeat(ends - size, size)
            row = np.arange(len(size)) * strings.shape[1] + left[at : at + 8192]
            strings[at : at + 8192].reshape(-1)[np.repeat(row, size) + within] = data[np.repeat(offsets[at : at + 8192], size) + within]
        covered = np.zeros((m, most), bool)
        with tempfile.TemporaryDirectory() as folder:
            for column, order, lcp in common_prefix_rounds(strings, folder, most):
                has = (left <= column) & (column < left + counts)
                kind = np.cumsum(lcp < width)
                real = has[order]
                index, kind = order[real], kind[real]
                if not len(index):
                    continue
                heads = np.flatnonzero(np.diff(kind, prepend=-1))
                first = np.repeat(np.minimum.reduceat(index, heads), np.diff(np.append(heads, len(index))))
                later = index[index != first]
                covered[later, column - left[later]] = True
        return covered

    return firsts


def scheme(width: int = WIDTH, gram: int = GRAM) -> repeats.Scheme:
    return repeats.Scheme(_scan(width, gram), _contents(width), _firsts(width, gram))


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, row, kept (bytes that stay), n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    if not gram < width <= 200 or width - gram > 150:
        raise ValueError("gram < width <= 200 and width - gram <= 150 are supported")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            data, offsets = words.text_bytes(part.column("text"))
            runs = part.column("runs").to_pylist()
            keep = part.column("keep").to_pylist()
            out = []
            for i in range(part.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                if keep[i] and not runs[i]:
                    kept, n_removed, n_spans = own.tobytes(), 0, 0
                else:
                    pairs = np.array([(r["start"], r["n"]) for r in runs[i] or ()], np.int64).reshape(-1, 2)
                    gone = repeats.window_mask(len(own), width, keep[i], (pairs[:, 0], pairs[:, 1]))
                    kept, n_removed = own[~gone].tobytes(), int(gone.sum())
                    n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out.append((kept, len(own), n_removed, n_spans, hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *columns], ["doc_id", "row", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeats.covered_windows(docs, scheme(width, gram)).select("doc_id", "row", "text", "keep", "runs")
    return found.mapInArrow(cut, "doc_id long, row long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
