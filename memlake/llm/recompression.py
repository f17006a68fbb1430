"""Operator 8: removing every word of 20-word windows that also start earlier, by recompression.

Recompression rewrites a text in rounds: a maximal run of two equal symbols becomes one symbol, then a pair whose first
symbol falls in the left and whose second falls in the right half of the alphabet becomes one. Names and halves are
digests of what a symbol stands for, so every task gives equal runs and pairs the same name everywhere and a round needs
no dictionary to be shuffled. What happens inside a word sequence depends on at most ``MARGIN`` words to either side,
so equal windows carry the same high-level symbols inside. The smallest of these, with the words beside it, anchors the
window (see ``repeats``): symbols that stand only once in the corpus are done with, the shared ones bring their windows
together, and the windows' words verify what names say, so no chance of names is in the result.

Longer runs stay single words, as a window inside one can't see where it ends. Defined cases: a null or empty text has
no words; texts under 20 words stay whole; a row that repeats another (same doc_id and text) is the same document and
gets the same result; rows of one doc_id with other texts are ordered by a hash of the text; a null doc_id comes after
all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memlake.llm import repeats, words

U64 = np.uint64
WIDTH = 20
#: Words beside a place that decide whether a symbol of the last round begins there, and most words of such a symbol.
MARGIN, LONGEST = 4, 4
NONE = U64((1 << 64) - 1)
RUN, PAIR = U64(0x52554E), U64(0x50414952)


def merge_runs(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, starts) after maximal runs of exactly two equal symbols of a document became one symbol each."""
    n = len(names)
    same = np.zeros(n + 2, bool)  # same[i + 1]: symbol i equals symbol i + 1 in the same document
    same[1:n] = (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])
    head = same[1 : n + 1] & ~same[0:n] & ~same[2 : n + 2]
    gone = np.zeros(n, bool)
    gone[1:] = head[:-1]
    out = np.where(head, words.mix(names ^ RUN), names)
    keep = np.flatnonzero(~gone)
    return out[keep], keep


def merge_pairs(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, starts) after each pair of a left-half and a right-half symbol became one symbol."""
    left = (words.mix(names ^ PAIR) & U64(1)).astype(bool)
    head = np.zeros(len(names), bool)
    head[:-1] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
    gone = np.zeros(len(names), bool)
    gone[1:] = head[:-1]
    out = names.copy()
    at = np.flatnonzero(head)
    out[at] = words.mix(words.mix(names[at] ^ PAIR) + names[at + 1])
    keep = np.flatnonzero(~gone)
    return out[keep], keep


def _scan(width: int):
    first = MARGIN
    reach = width - 2 * MARGIN - LONGEST + 1
    if reach < LONGEST:
        raise ValueError(f"a window needs at least {2 * MARGIN + 2 * LONGEST - 1} words")

    def scan(data: np.ndarray, offsets: np.ndarray):
        start, end, doc = words.word_bounds(data, offsets)
        n = len(start)
        if n < width:
            none = np.zeros(0, np.int64)
            return repeats.SuperWindows(none.astype(U64), none, none, none, none), None
        word_names = words.long_names(data, start, end)
        run_names, run_at = merge_runs(word_names, doc)
        names, pair_at = merge_pairs(run_names, doc[run_at])
        at = run_at[pair_at]  # word where each symbol begins
        symbols = np.full(n, NONE)
        # the smallest name is sought by its high bits; a symbol never looks like a place where none begins
        symbols[at] = np.minimum(names, NONE - U64(1 << 40))
        place = np.arange(n - width + 1)
        valid = doc[width - 1 :] == doc[: len(place)]
        unit = np.arange(n) - np.searchsorted(doc, doc)
        found = repeats.super_windows(symbols, valid, first, reach, doc, unit)
        begin = np.searchsorted(doc, np.arange(len(offsets) - 1))
        # words that lie beside the anchor in all its windows
        anchor = begin[found.doc] + found.anchor
        found.context(words.Substrings(word_names)(anchor - MARGIN, anchor + LONGEST + MARGIN))
        return found, (data, start, end, begin)

    return scan


def _contents(width: int):
    def contents(scan, some: repeats.SuperWindows, which) -> tuple[bytes, np.ndarray]:
        """The words of each super-window, a blank after each."""
        if scan is None or not len(some.key):
            return b"", np.zeros(len(some.key), np.int64)
        data, start, end, begin = scan
        first = begin[some.doc] + some.start
        n_words = some.count + width - 1
        total = np.cumsum(n_words)
        word = np.arange(total[-1]) + np.repeat(first - (total - n_words), n_words)
        size = end[word] - start[word] + 1
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(start[word] - (ends - size), size)
        out = data[np.minimum(place, len(data) - 1)]
        out[ends - 1] = 32
        return out.tobytes(), np.diff(np.concatenate([[0], ends])[np.concatenate([[0], total])])

    return contents


def _firsts(width: int):
    def firsts(keys, starts, counts, anchors, data, offsets, sizes) -> np.ndarray:
        """Super-windows come in document order; of equal windows the first one stays. Names bring windows together, their
        words decide.

        Within a document an earlier anchor has the earlier windows, so the order of entries is that of starts.
        """
        ends = np.cumsum(sizes)
        within = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        data = data[np.repeat(offsets, sizes) + within]
        start, end, _ = words.word_bounds(data, np.array([0, len(data)]))
        names = words.Substrings(words.long_names(data, start, end))
        n_words = counts + width - 1
        entry = np.repeat(np.arange(len(keys)), counts)
        nth = np.arange(len(entry)) - (np.cumsum(counts) - counts)[entry]
        window = (np.cumsum(n_words) - n_words)[entry] + nth
        # a class: anchor name, its place in the window, words
        kind = words.mix(names(window, window + width) + words.mix(keys[entry] ^ (anchors[entry] - starts[entry] - nth).astype(U64)))
        order = np.argsort(kind, kind="stable")
        new = np.ones(len(kind), bool)
        new[1:] = kind[order[1:]] != kind[order[:-1]]
        first = np.empty(len(kind), np.int64)
        first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = first != np.arange(len(kind))
        begin, size = start[window], end[window + width - 1] - start[window]
        equal = repeats._equal(data, begin, begin[first], size, size[first], later)
        wrong = np.flatnonzero(later & ~equal)
        if len(wrong):  # other words of the same name: told apart by the words themselves
            text = data.tobytes()
            seen: dict[tuple, int] = {}
            for i in np.flatnonzero(np.isin(kind, kind[wrong])).tolist():
                equal[i] = seen.setdefault((int(kind[i]), text[begin[i] : begin[i] + size[i]]), i) != i
            later = later & ~np.isin(kind, kind[wrong]) | equal
        covered = np.zeros((len(keys), int(counts.max())), bool)
        covered[entry[later], nth[later]] = True
        return covered

    return firsts


def scheme(width: int = WIDTH) -> repeats.Scheme:
    return repeats.Scheme(_scan(width), _contents(width), _firsts(width))


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, row, kept (words that stay, joined by one space), n_words, n_removed, kept_sha256 of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches):
            out = []
            for text, keep, runs in zip(part.column("text"), part.column("keep").to_pylist(), part.column("runs").to_pylist(), strict=True):
                own = text.as_py().encode("utf-8", "surrogatepass").split()
                n = len(own)
                if not keep or runs:
                    pairs = np.array([(r["start"], r["n"]) for r in runs or ()], np.int64).reshape(-1, 2)
                    gone = repeats.window_mask(n, width, keep, (pairs[:, 0], pairs[:, 1]))
                    own = [own[i] for i in np.flatnonzero(~gone).tolist()]
                kept = b" ".join(own)
                out.append((kept, n, n - len(own), hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.binary(), pa.int64(), pa.int64(), pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *columns], ["doc_id", "row", "kept", "n_words", "n_removed", "kept_sha256"])

    found = repeats.covered_windows(docs, scheme(width)).select("doc_id", "row", "text", "keep", "runs")
    return found.mapInArrow(cut, "doc_id long, row long, kept binary, n_words long, n_removed long, kept_sha256 string")
