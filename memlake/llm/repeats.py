"""Finding windows (of bytes or of words) that also start earlier, over a whole corpus: the part operators 1 and 8 share.

A window's anchor is the smallest of the symbols that lie well inside it, so equal windows have equal anchors at equal
places wherever they stand. Consecutive windows of one anchor form a super-window. Then

1. exact copies of a whole text are told apart by digest; only the first copy goes on;
2. the anchors of all super-windows meet in buckets by their symbol, and those that occur once are done;
3. the others meet again with their contents, where the operator's own method finds each window's first occurrence;
4. what is covered goes back to its document.

Texts are shuffled once, by row, and the exchange serves all three passes over them. What meets in a bucket is sent in
blocks of numpy arrays, one row for each bucket and some megabytes of text. Equal keys, and equal super-windows, of one
block are sent once, so a passage that a third of all documents share costs one entry a block, not one a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import common, words

U64 = np.uint64
#: Text bytes whose records are sent together, in slices.
BLOCK_SLICES = 12
#: Text bytes for which there is a bucket; what meets in a bucket is up to three times as much, in one worker's memory.
TEXT_OF_BUCKET = 64 << 20
#: A document order for rows without doc_id: after all others.
_ROWS = "doc_id long, row long, text string, keep boolean"


@dataclass
class SuperWindows:
    """Of a slice: anchor symbol, document index, first window start (in units of the document) and number of windows."""

    key: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray

    def nth(self) -> np.ndarray:
        """Each one's number within its document."""
        first = np.searchsorted(self.doc, self.doc)
        return np.arange(len(self.doc)) - first

    def context(self, hashes: np.ndarray) -> None:
        """Tells anchors apart by more than their symbol: by what surrounds them in each of their windows."""
        self.key = words.mix(self.key ^ hashes)

    def take(self, which: np.ndarray) -> SuperWindows:
        return SuperWindows(self.key[which], self.doc[which], self.start[which], self.count[which], self.anchor[which])


@dataclass
class Scheme:
    """What differs between operators.

    ``scan(data, offsets)`` gives a slice's SuperWindows and whatever ``contents`` needs; ``contents(scan, which)``
    gives for these super-windows one bytes object of fixed or self-describing records and their bounds in it;
    ``firsts(entries)`` is called with all super-windows of a bucket and gives for each a boolean row: is the window
    covered, that is, not the first of its class.
    """

    scan: Callable
    contents: Callable
    firsts: Callable


def super_windows(symbols: np.ndarray, valid: np.ndarray, first: int, width: int, doc: np.ndarray, unit: np.ndarray) -> SuperWindows:
    """Windows by unit position, grouped by their anchor.

    ``symbols`` has a symbol for each position (all ones: none starts here); a window at p is anchored by the smallest
    of positions p + first to p + first + width - 1, the leftmost of equals. ``valid`` marks the windows that exist,
    ``doc`` and ``unit`` give each position's document and place in it.
    """
    n = len(valid)
    # the position takes the low 32 bits, so the leftmost of symbols with equal high bits is the smallest key
    bits = U64(32)
    at = np.arange(len(symbols), dtype=U64)
    lowest = words.window_min(((symbols >> bits) << bits) | at, width)[first : first + n]
    anchor = (lowest & ((U64(1) << bits) - U64(1))).astype(np.int64)
    place = np.flatnonzero(valid)
    anchor = anchor[place]
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(place)))
    p = place[head]
    return SuperWindows(symbols[anchor[head]], doc[p], unit[p], count, unit[p] + (anchor[head] - p))


def _by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    for s, e in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
        yield int(bucket[s]), [c[order[s:e]] for c in columns]


def _batch(names: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    for part in words.slices(batches):
        held.append(part)
        if len(held) == BLOCK_SLICES:
            yield held
            held = []
    if held:
        yield held


_KEYS = "bucket int, decided boolean, keys binary, rows binary, nths binary"


def _send_keys(scheme: Scheme, buckets: np.ndarray):
    """Anchors of kept documents, by bucket; those that repeat within a block are decided here and sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            keys, rows, nths = [], [], []
            for part in block:
                part = part.filter(part.column("keep"))
                if not part.num_rows:
                    continue
                found, _ = scheme.scan(*words.text_bytes(part.column("text")))
                keys.append(found.key)
                rows.append(part.column("row").to_numpy()[found.doc])
                nths.append(found.nth())
            if not keys:
                continue
            key, row, nth = np.concatenate(keys), np.concatenate(rows), np.concatenate(nths).astype(np.int32)
            _, first, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            again = count[back] > 1
            out = []
            # decided: occurs twice in this block; its key is still sent once, for the sake of other blocks
            for b, (r, n) in _by_bucket(buckets[row[again].view(U64) % U64(len(buckets))], [row[again], nth[again]]):
                out.append((b, True, b"", r.tobytes(), n.tobytes()))
            answer = np.where(again[first], np.int32(-1), nth[first])
            for b, (k, r, n) in _by_bucket(buckets[key[first] % U64(len(buckets))], [key[first], row[first], answer]):
                out.append((b, False, k.tobytes(), r.tobytes(), n.tobytes()))
            yield _batch(["bucket", "decided", "keys", "rows", "nths"], out, [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()])

    return run


def _joined(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype)


def _repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, nth) of the super-windows whose anchor occurs in another one too."""
    keys, rows, nths = [], [], []
    out = lambda row, nth: pa.RecordBatch.from_arrays([pa.array(row), pa.array(nth)], ["row", "nth"])
    for batch in batches:
        done = batch.filter(batch.column("decided"))
        yield out(_joined(done.column("rows"), np.int64), _joined(done.column("nths"), np.int32))
        rest = batch.filter(pc.invert(batch.column("decided")))
        keys.append(_joined(rest.column("keys"), U64))
        rows.append(_joined(rest.column("rows"), np.int64))
        nths.append(_joined(rest.column("nths"), np.int32))
    if not keys:
        return
    key, row, nth = np.concatenate(keys), np.concatenate(rows), np.concatenate(nths)
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    found = order[same[1:] | same[:-1]]
    found = found[nth[found] >= 0]
    yield out(row[found], nth[found])


_CONTENTS = "bucket int, keys binary, order binary, rows binary, starts binary, counts binary, anchors binary, sizes binary, contents binary"
_COLUMNS = [("keys", U64), ("order", np.int64), ("rows", np.int64), ("starts", np.int32), ("counts", np.int16), ("anchors", np.int32)]
_COVERED = "row long, start int, n int"


def _covered_batch(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["row", "start", "n"])


def _send_contents(scheme: Scheme, buckets: np.ndarray, by_id: bool):
    """The flagged super-windows with their contents, by bucket; of equal ones in a block the first alone.

    What the block decides itself (all windows of a later equal super-window are covered) is sent as a covered run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            held: list[list[np.ndarray]] = []
            parts: list[bytes] = []
            sizes: list[np.ndarray] = []
            digests: list[np.ndarray] = []
            for part in block:
                flagged = part.column("nths")
                if not part.num_rows:
                    continue
                found, scan = scheme.scan(*words.text_bytes(part.column("text")))
                first = np.searchsorted(found.doc, np.arange(part.num_rows))
                lengths = np.diff(flagged.offsets.to_numpy())
                offset = flagged.offsets.to_numpy()[0]
                which = np.sort(first.repeat(lengths) + flagged.values.to_numpy()[offset : offset + lengths.sum()])
                some = found.take(which)
                doc_ids = part.column("doc_id").fill_null(common.MAX_LONG).to_numpy()
                content, size = scheme.contents(scan, some, which)
                held.append([some.key, doc_ids[some.doc], part.column("row").to_numpy()[some.doc], some.start.astype(np.int32), some.count.astype(np.int16), some.anchor.astype(np.int32)])
                parts.append(content)
                sizes.append(size)
                ends = np.cumsum(size, dtype=np.int64)
                digests.append(words.byte_hashes(np.frombuffer(content, np.uint8))(ends - size, ends))
            if not held:
                continue
            key, order, row, start, count, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
            size = np.concatenate(sizes).astype(np.int32)
            data = np.frombuffer(b"".join(parts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            # equal super-windows: same anchor symbol, place, number of windows and contents
            digest = np.concatenate(digests) ^ words.mix(key + count.astype(U64) * U64(131) + (anchor - start).astype(U64))
            by = np.lexsort((start, row, order, digest))
            later = np.zeros(len(by), bool)
            later[1:] = digest[by][1:] == digest[by][:-1]
            same_bytes = _equal(data, offsets[by][1:], offsets[by][:-1], size[by][1:], size[by][:-1], later[1:])
            later[1:] &= same_bytes
            gone = by[later]
            out = []
            sent = [key, order[:0] if by_id else order, row, start, count, anchor, size]
            for b, (r, s, n) in _by_bucket(buckets[row[gone].view(U64) % U64(len(buckets))], [row[gone], start[gone], count[gone]]):
                out.append((b, b"", b"", r.tobytes(), s.tobytes(), n.tobytes(), b"", b"", b""))
            left = np.sort(by[~later])
            spot = buckets[key[left] % U64(len(buckets))]
            for b, (which,) in _by_bucket(spot, [left]):
                out.append((b, *(c[which].tobytes() if len(c) else b"" for c in sent), b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in which)))
            yield _batch([x.split()[0] for x in _CONTENTS.split(", ")], out, [pa.int32()] + [pa.binary()] * 8)

    return run


def _equal(data, a, b, size_a, size_b, ask) -> np.ndarray:
    """Whether the asked pairs of byte strings are equal; compared as padded rows, some thousands at a time."""
    out = np.zeros(len(a), bool)
    asked = np.flatnonzero(ask & (size_a == size_b))
    for at in range(0, len(asked), 8192):
        i = asked[at : at + 8192]
        width = int(size_a[i].max()) if len(i) else 0
        column = np.arange(width)
        inside = column < size_a[i][:, None]
        x = data[np.minimum(a[i][:, None] + column, len(data) - 1)]
        y = data[np.minimum(b[i][:, None] + column, len(data) - 1)]
        out[i] = ~((x != y) & inside).any(axis=1)
    return out


def _find_covered(scheme: Scheme, by_id: bool):
    """Runs of covered window starts, by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {name: [] for name, _ in _COLUMNS}
        sizes, data = [], []
        for batch in batches:
            ready = pc.equal(pc.binary_length(batch.column("keys")), 0)
            done = batch.filter(ready)
            yield _covered_batch(_joined(done.column("rows"), np.int64), _joined(done.column("starts"), np.int32), _joined(done.column("counts"), np.int16))
            rest = batch.filter(pc.invert(ready))
            for name, dtype in _COLUMNS:
                held[name].append(_joined(rest.column(name), dtype))
            sizes.append(_joined(rest.column("sizes"), np.int32))
            data.append(_joined(rest.column("contents"), np.uint8))
        if not sizes or not sum(map(len, sizes)):
            return
        got = {name: np.concatenate(x) for name, x in held.items()}
        if by_id:
            got["order"] = got["rows"]
        size, data = np.concatenate(sizes).astype(np.int64), np.concatenate(data)
        offset = np.concatenate([[0], np.cumsum(size)])[:-1]
        # earlier first: by document, then by place; rows of one doc_id but other texts by their key
        by = np.lexsort((got["anchors"], got["rows"], got["order"]))
        got = {name: x[by] for name, x in got.items()}
        covered = scheme.firsts(got["keys"], got["starts"], got["counts"].astype(np.int64), got["anchors"], data, offset[by], size[by])
        edge = np.zeros((len(covered), covered.shape[1] + 2), np.int8)
        edge[:, 1:-1] = covered
        step = np.diff(edge, axis=1)
        which, begin = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)
        yield _covered_batch(got["rows"][which], got["starts"][which] + begin, end - begin)

    return run


def covered_windows(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, row, text, keep and ``runs`` (array of (start, n)) of every row.

    ``keep`` is false for a later exact copy, all of whose windows are covered.
    """
    spark = docs.sparkSession
    n = common.partitions_for(docs, TEXT_OF_BUCKET)
    buckets = np.array(common.even_keys(spark, n), np.int64)
    rows = common.keyed(docs)
    # unique ids are the rows' keys, which say the order as well and take half the room
    by_id = common.ids_are_unique(docs)
    order = F.coalesce("doc_id", F.lit(common.MAX_LONG))
    first = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min(F.struct(order.alias("order"), "row")).alias("first"))
    keepers = first.select(F.col("first.row").alias("row"), F.lit(True).alias("keep"))
    texts = rows.repartition(n, "row").join(keepers.hint("shuffle_hash"), "row", "left").select("doc_id", "row", "text", F.coalesce("keep", F.lit(False)).alias("keep"))

    sent = texts.mapInArrow(_send_keys(scheme, buckets), _KEYS)
    flagged = sent.repartition(n, "bucket").mapInArrow(_repeated_keys, "row long, nth int")
    flagged = flagged.groupBy("row").agg(F.collect_set("nth").alias("nths"))

    asked = texts.join(flagged.hint("shuffle_hash"), "row").filter("keep").select("doc_id", "row", "text", "nths")
    contents = asked.mapInArrow(_send_contents(scheme, buckets, by_id), _CONTENTS).repartition(n, "bucket")
    covered = contents.mapInArrow(_find_covered(scheme, by_id), _COVERED).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return texts.join(covered.hint("shuffle_hash"), "row", "left")


def window_mask(n_units: int, width: int, keep: bool, runs) -> np.ndarray:
    """Which units of a document some covered window covers. runs: (starts, counts)."""
    if not keep:
        return np.full(n_units, n_units >= width)
    edge = np.zeros(n_units + 1, np.int64)
    starts, counts = runs
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + counts - 1 + width, 1)
    return np.cumsum(edge[:-1]) > 0
