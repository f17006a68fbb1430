"""Bit-sliced comparison of fingerprints: vertical bit planes, carry-save counters, blocks left once all lanes are past.

A code is a row of bits, read as digits of ``digit_bits`` bits; two codes are within a radius if at most so many of
their digits differ. Plane b holds bit b of all codes, 64 to a machine word, so one operation on words compares a code
with 64 others. An element of a comparison is one code against one word of lanes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ONES = ~np.uint64(0)
#: Lanes of small buckets that are compared together.
BATCH = 4096


class Planes:
    """Codes (a row of bytes each) stored vertically, and each code's own bits as masks of whole words."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        bits = np.zeros((-(-n // 64) * 64, codes.shape[1] * 8), np.uint8)
        bits[:n] = np.unpackbits(codes, axis=1, bitorder="little")
        self.n = n
        self.planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
        self.own = np.ascontiguousarray(bits[:n].T).astype(np.uint64) * ONES

    def lanes(self, which: np.ndarray) -> np.ndarray:
        """These lanes (booleans) as words."""
        out = np.zeros(self.planes.shape[1] * 64, bool)
        out[: self.n] = which
        return np.packbits(out, bitorder="little").view(np.uint64)

    def within(self, radius: int, digit_bits: int, query: np.ndarray, word: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The elements (query code, word of lanes) with the lanes of ``alive`` that are within the radius.

        A digit differs where any of its planes does; carry-save counters add these up for all lanes, and elements
        whose lanes have all passed the radius leave the comparison.
        """
        digits = [np.zeros(len(query), np.uint64) for _ in range((radius + 1).bit_length() + 1)]
        # so many digits at most between two looks, else a counter of a lane within the radius could wrap
        pause = (1 << len(digits)) - 1 - radius
        last = len(self.planes) // digit_bits - 1
        for d in range(last + 1):
            carry = self.planes[d * digit_bits][word] ^ self.own[d * digit_bits][query]
            for b in range(d * digit_bits + 1, (d + 1) * digit_bits):
                carry |= self.planes[b][word] ^ self.own[b][query]
            for i, digit in enumerate(digits):
                digits[i], carry = digit ^ carry, digit & carry
            if d % pause == pause - 1 or d == last or d % 16 == 15:
                over, equal = np.zeros(len(query), np.uint64), np.full(len(query), ONES)
                for i in reversed(range(len(digits))):
                    if radius >> i & 1:
                        equal &= digits[i]
                    else:
                        over |= equal & digits[i]
                        equal &= ~digits[i]
                alive = alive & ~over
                keep = np.flatnonzero(alive)
                if len(keep) < len(query):
                    query, word, alive, digits = query[keep], word[keep], alive[keep], [x[keep] for x in digits]
                    if not len(keep):
                        break
        return query, word, alive


class Comparison:
    """Codes compared by one or more (codes, digit_bits, radius): within all of them."""

    def __init__(self, *tests: tuple[np.ndarray, int, int]):
        self.tests = [(Planes(codes), digit_bits, radius) for codes, digit_bits, radius in tests]
        self.n = self.tests[0][0].n

    def pairs(self, query: np.ndarray, word: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, lane) of all lanes found within."""
        for planes, digit_bits, radius in self.tests:
            query, word, alive = planes.within(radius, digit_bits, query, word, alive)
            if not len(query):
                break
        at, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return query[at], word[at] * 64 + lane


def _small(comparison: Comparison, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs a < b of lanes of one bucket, for buckets of at most 64 lanes that stand side by side."""
    n = comparison.n
    query = np.arange(n)
    word = np.concatenate([query // 64, query // 64 + 1])
    query = np.concatenate([query, query])
    # only where the word has a lane of the query's bucket after it
    end = np.searchsorted(bucket, bucket, "right")[query]
    some = (word * 64 < end) & (end > query + 1)
    query, word = query[some], word[some]
    a, b = comparison.pairs(query, word, np.full(len(query), ONES))
    own = (b < n) & (b > a)
    a, b = a[own], b[own]
    own = bucket[a] == bucket[b]
    return a[own], b[own]


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs a < b enough to keep what they connect together: a tight group leaves one link a member.

    A pair goes if b's smallest partner is linked with a, as that link or what stands for it stays.
    """
    if not len(a):
        return a, b
    first = np.full(n, n)
    np.minimum.at(first, b, a)
    other = first[b]
    there = np.isin(other * n + a, a * n + b)
    keep = (other == a) | ~there
    return a[keep], b[keep]


def _relabel(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): each component has its smallest label."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        label = to[label]
    return label


def _large(comparison: Comparison) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one bucket, 64 codes at a time against the lanes still of another component.

    A lane that was a query itself has met all others, and lanes of a query's own component need no comparison.
    """
    n = comparison.n
    label, met = np.arange(n), np.zeros(n, bool)
    while not met.all():
        query = np.flatnonzero(~met)[:64]
        others = ~met if (label[query] != label[query[0]]).any() else ~met & (label != label[query[0]])
        words = comparison.tests[0][0].lanes(others)
        word = np.flatnonzero(words)
        if not len(word):
            met[query] = True
            if not (~met).any() or (label[~met] == label[query[0]]).all():
                break
            continue
        a, b = comparison.pairs(np.repeat(query, len(word)), np.tile(word, len(query)), np.tile(words[word], len(query)))
        own = label[a] != label[b]
        a, b = np.minimum(a[own], b[own]), np.maximum(a[own], b[own])
        if len(a):
            # of a lane's links the first, and those between queries that only share lanes
            keep = _spanning_of_block(a, b, label)
            yield a[keep], b[keep]
            label = _relabel(label, a[keep], b[keep])
        met[query] = True


def _spanning_of_block(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Positions of links enough to join the labels that all of them join."""
    chosen = []
    while True:
        x, y = label[a], label[b]
        differ = np.flatnonzero(x != y)
        if not len(differ):
            return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        # one link for each label that hangs on a smaller one
        high, low = np.maximum(x[differ], y[differ]), np.minimum(x[differ], y[differ])
        order = np.lexsort((low, high))
        _, first = np.unique(high[order], return_index=True)
        some = differ[order[first]]
        chosen.append(some)
        label = _relabel(label, a[some], b[some])


def _batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of more than one member: those of at most 64 together, about BATCH lanes at a time, others alone."""
    small = np.flatnonzero((sizes <= 64) & (sizes > 1))
    if len(small):
        total = np.cumsum(sizes[small])
        yield from np.split(small, np.flatnonzero(np.diff(total // BATCH)) + 1)
    yield from np.flatnonzero(sizes > 64).reshape(-1, 1)


def _positions(buckets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the members of these buckets, and the bucket of each."""
    starts = np.cumsum(sizes) - sizes
    return np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in buckets]), np.repeat(buckets, sizes[buckets])


def spanning_links(sizes: np.ndarray, tests) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of links between members of one bucket, enough to keep every component of each bucket together.

    Buckets of ``sizes`` members stand side by side; ``tests(positions)`` gives the Comparison of these members.
    """
    for buckets in _batches(sizes):
        at, bucket = _positions(buckets, sizes)
        for a, b in _large(tests(at)) if len(buckets) == 1 and len(at) > 64 else [_spanning(*_small(tests(at), bucket), len(at))]:
            yield at[a], at[b]


def close_pairs(sizes: np.ndarray, tests, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of all close pairs of one bucket whose labels differ, 64 codes or a batch of buckets at a time."""
    for buckets in _batches(sizes):
        at, bucket = _positions(buckets, sizes)
        own, comparison = label[at], tests(at)
        for a, b in _all(comparison) if len(buckets) == 1 and len(at) > 64 else [_small(comparison, bucket)]:
            differ = own[a] != own[b]
            yield at[a[differ]], at[b[differ]]


def _all(comparison: Comparison) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, comparison.n, 64):
        query = np.arange(at, min(comparison.n, at + 64))
        words = comparison.tests[0][0].lanes(np.arange(comparison.n) > at)
        word = np.flatnonzero(words)
        a, b = comparison.pairs(np.repeat(query, len(word)), np.tile(word, len(query)), np.tile(words[word], len(query)))
        yield a[b > a], b[b > a]
