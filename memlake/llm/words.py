"""Vectorised text scanning inside tasks: word bounds, O(1) substring hashes and window minima.

Every function works on the concatenated UTF-8 bytes of a slice of documents, so one numpy call covers
thousands of documents. Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Bytes of text that one numpy pass handles at a time; bounds a worker's memory whatever the Arrow batch holds.
SLICE_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix((np.arange(256, dtype=U64) + U64(1)) * U64(_BASE))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown on demand and kept per worker."""
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 2)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U64)
    return _powers


class Substrings:
    """Hashes of arbitrary substrings of ``data`` from one prefix sum; equal bytes get equal hashes anywhere."""

    def __init__(self, values: np.ndarray):
        power, self._inverse = _power_tables(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * power[: len(values)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(U64))

    def all_of(self, width: int) -> np.ndarray:
        """The hash of every substring of this width, by start."""
        n = len(self._sums) - width
        return mix((self._sums[width:] - self._sums[:n]) * self._inverse[:n] + U64(width))


def byte_hashes(data: np.ndarray) -> Substrings:
    return Substrings(_BYTE_VALUE[data])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``limit`` text bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < n:
            to = int(np.searchsorted(total, total[at] + limit, "right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of every word; words never cross documents."""
    inside = ~_SPACE[data]
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys, by doubling."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def classes(keys: np.ndarray, same) -> np.ndarray | None:
    """A number for each class of equal keys, or None where ``same(i, first)`` (of each item and the first of its class)
    finds that equal keys stand for different things."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return back if same(np.arange(len(keys)), first[back]).all() else None


def word_classes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each distinct word of a slice; hashes bring words together, their bytes decide."""
    size = end - start

    def same(i: np.ndarray, first: np.ndarray) -> np.ndarray:
        if (size[i] != size[first]).any():
            return np.zeros(1, bool)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return data[np.repeat(start, size) + within] == data[np.repeat(start[first], size) + within]

    found = classes(byte_hashes(data)(start, end), same)
    if found is None:
        whole, known = data.tobytes(), {}
        found = np.array([known.setdefault(whole[s:e], len(known)) for s, e in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
    return found


def long_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of words: equal words have equal names in every task.

    The polynomial modulo 2**64 names words of up to 64 bytes; as there are longer strings on which it collides whatever
    its base, XXH3 names these.
    """
    out = byte_hashes(data)(start, end)
    for i in np.flatnonzero(end - start > 64).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), 11)
    return out


def spans_per_document(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Offsets of each document's items in arrays that are ordered by document."""
    return np.searchsorted(doc, np.arange(n_docs + 1))
