"""Operator 13: hard negatives by distributed radix selection on integer scores.

Components become integers, so a score is an exact integer inner product. Rows are packed into blocks and blocks into
row groups; anchors are dealt into anchor groups; a cell is one row group against one anchor group, of bounded size.

1. Each cell offers its best rows of an anchor's own label, and the best of all cells are the anchor's positives.
2. A positive with score p opens the window of scores from ``percent`` percent of p up to p. Each cell counts the rows of other
   labels in every window by the leading digit of the score's place there; the summed histogram, read from the top,
   says in which bucket the kth score lies. That bucket is the next window, and so on digit by digit until it is one
   score wide: the kth best score. Windows that hold at most k rows need no further digit.
3. Only rows at or above the kth score are gathered; of those at it, the k smallest ids of each cell.

Histograms and not rows are shuffled in step 2, so a score that a third of all rows share is one count.

Defined cases: a null id, label or vector, and null or non-finite components take no part; an anchor's other rows are
those of another id; rows that repeat are rows of their own, and so is each anchor; missing components of shorter
vectors count as 0; integers beyond +-2**25 are held there, so that sums over 4096 components fit a long; a positive
below 0 has an empty window; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm import common

#: Rows of a block and of a row group, anchors of an anchor group: a cell's two sides in a worker's memory.
BLOCK_ROWS, GROUP_ROWS, GROUP_ANCHORS = 4096, 1 << 17, 4096
#: Bits of a digit of the selection.
DIGIT = 8
#: Components are held within this.
LARGEST = 1 << 25
_BLOCK = "block long, n int, ids binary, labels binary, width int, q binary"
_ANCHOR = "anchor long, anchor_id long, label long, q binary"
#: An anchor's windows: of each positive the lowest and highest score still looked at, and how many are wanted there.
_WINDOWS = "lo array<long>, hi array<long>, need array<int>"


def quantised(column: pa.Array, scale: float) -> np.ndarray:
    """A row of integers floor(scale * x) for each vector, zeros after the end of shorter ones."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale), -LARGEST, LARGEST)
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if most < 1 << 53:  # doubles are exact, and fast
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<i4").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(n, -1).astype(np.int64)


def blocks_of(rows: DataFrame, scale: float) -> DataFrame:
    """Rows (vec_id, label, v) packed: one row for up to BLOCK_ROWS of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids, labels = (part.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in ("vec_id", "label"))
                q = quantised(part.column("v"), scale)
                yield pa.RecordBatch.from_pylist([{"block": 0, "n": len(ids), "ids": ids.tobytes(), "labels": labels.tobytes(), "width": q.shape[1], "q": _packed(q)}], pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("q", pa.binary())]))

    return rows.mapInArrow(pack, _BLOCK).withColumn("block", F.monotonically_increasing_id())


def anchors_of(rows: DataFrame, scale: float) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = quantised(batch.column("v"), scale)
            data = pa.array([_packed(x) for x in q], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(q), np.int64)), batch.column("vec_id"), batch.column("label"), data], ["anchor", "anchor_id", "label", "q"])

    return rows.mapInArrow(pack, _ANCHOR).withColumn("anchor", F.monotonically_increasing_id())


class Grid:
    """Row groups against anchor groups; every pass over the cells starts here."""

    def __init__(self, blocks: DataFrame, anchors: DataFrame):
        spark = blocks.sparkSession
        size = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("rows")).first()
        self.row_groups = max(1, -(-(size.rows or 0) // GROUP_ROWS), min(size.blocks, common.partitions(spark)))
        self.anchor_groups = -(-anchors.count() // GROUP_ANCHORS) or 1
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        self.blocks = blocks.withColumn("row_group", F.pmod(F.xxhash64("block"), F.lit(self.row_groups)).cast("int")).withColumn("anchor_group", every(self.anchor_groups))
        self._every_row_group = every(self.row_groups)

    def cells(self, anchors: DataFrame, work: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
        """``work(anchor table, their integers, block ids, block labels, scores)`` of each block of each cell."""
        dealt = anchors.withColumn("anchor_group", F.pmod(F.xxhash64("anchor"), F.lit(self.anchor_groups)).cast("int")).withColumn("row_group", self._every_row_group)

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            found = work(left.combine_chunks(), right) if left.num_rows and right.num_rows else None
            return schema.empty_table() if found is None else pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema, strict=True)], schema=schema)

        keys = ("anchor_group", "row_group")
        return dealt.groupBy(*keys).cogroup(self.blocks.groupBy(*keys)).applyInArrow(cell, ddl)


def _scored(anchors: pa.Table, blocks: pa.Table) -> Iterator[tuple]:
    """(anchors' places from, to, block ids, block labels, scores) in pieces of bounded size."""
    for i in range(blocks.num_rows):
        n, ids, labels, q = (blocks.column(c)[i].as_py() for c in ("n", "ids", "labels", "q"))
        ids, labels, rows = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), _unpacked(q, n)
        for at in range(0, anchors.num_rows, 512):
            data = anchors.column("q").slice(at, 512).to_pylist()
            width = max(len(x) for x in data)
            own = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in data), "<i4").reshape(len(data), -1).astype(np.int64)
            yield at, at + len(data), ids, labels, scores(own, rows)


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each row, ties to the smaller id."""
    order = np.lexsort((ids, -score, row))
    nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    return order[nth < k]


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _lists(table: pa.Table, name: str, k: int, fill: int) -> np.ndarray:
    """A row of k numbers for each list, filled up at its end."""
    return np.array([x + [fill] * (k - len(x)) for x in table.column(name).to_pylist()], np.int64).reshape(-1, k)


def positives(grid: Grid, anchors: DataFrame, k: int) -> DataFrame:
    """anchor, slot, positive_id, positive_score: the k best other rows of an anchor's label."""

    def work(left: pa.Table, right: pa.Table):
        places, own, label = _numbers(left, "anchor"), _numbers(left, "anchor_id"), _numbers(left, "label")
        kept = [np.zeros(0, np.int64)] * 3
        for at, to, ids, labels, found in _scored(left, right):
            fits = (label[at:to, None] == labels) & (own[at:to, None] != ids)
            if len(ids) > k:
                ranked = np.where(fits, found, np.iinfo(np.int64).min)
                fits &= found >= np.partition(ranked, len(ids) - k, axis=1)[:, len(ids) - k, None]
            row, col = np.nonzero(fits)
            new = [row + at, found[row, col], ids[col]]
            new = [x[_best(*new, k)] for x in new]
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            if len(kept[0]) > 8 * k * len(places):
                kept = [x[_best(*kept, k)] for x in kept]
        kept = [x[_best(*kept, k)] for x in kept]
        return places[kept[0]], kept[2], kept[1]

    schema = pa.schema([("anchor", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
    offered = grid.cells(anchors, work, schema, "anchor long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    return offered.withColumn("slot", F.row_number().over(order) - 1).filter(F.col("slot") < k)


def _with_windows(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """Anchors that have open windows (anchor, slot, lo, hi, need), as arrays by slot."""
    one = F.sort_array(F.collect_list(F.struct("slot", "lo", "hi", "need")))
    arrays = windows.groupBy("anchor").agg(one.alias("w")).select("anchor", "w.slot", "w.lo", "w.hi", "w.need")
    return anchors.join(arrays, "anchor")


def _in_windows(left: pa.Table, right: pa.Table, k: int) -> Iterator[tuple]:
    """(anchor's place, window's place, offset from the window's lower end, score, id) of rows of other labels in windows."""
    own, label = _numbers(left, "anchor_id"), _numbers(left, "label")
    lo, hi = _lists(left, "lo", k, 0), _lists(left, "hi", k, -1)
    open_ones = lo <= hi
    least, most = np.where(open_ones, lo, np.iinfo(np.int64).max).min(axis=1), np.where(open_ones, hi, np.iinfo(np.int64).min).max(axis=1)
    for at, to, ids, labels, found in _scored(left, right):
        row, col = np.nonzero((found >= least[at:to, None]) & (found <= most[at:to, None]) & (label[at:to, None] != labels) & (own[at:to, None] != ids))
        score, row, ids_here = found[row, col], row + at, ids[col]
        for w in range(lo.shape[1]):
            inside = (score >= lo[row, w]) & (score <= hi[row, w])
            yield row[inside], w, score[inside] - lo[row[inside], w], score[inside], ids_here[inside]


def digit_shift(lo: Column, hi: Column) -> Column:
    """Bits below the leading digit of a window's places."""
    return F.greatest(F.lit(0), F.length(F.bin(hi - lo)) - DIGIT)


def histogram(grid: Grid, anchors: DataFrame, k: int) -> DataFrame:
    """anchor, slot, bucket, n over all cells, for anchors with windows."""

    def work(left: pa.Table, right: pa.Table):
        places, slots = _numbers(left, "anchor"), _lists(left, "slot", k, 0)
        lo, hi = _lists(left, "lo", k, 0), _lists(left, "hi", k, -1)
        span = np.maximum(hi - lo, 0)
        bits = np.array([[int(x).bit_length() for x in row] for row in span.tolist()], np.int64).reshape(span.shape)
        shift = np.maximum(0, bits - DIGIT)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for row, w, offset, _, _ in _in_windows(left, right, k):
            key, n = np.unique(((row * k + w) << DIGIT) + (offset >> shift[row, w]), return_counts=True)
            keys, counts = np.concatenate([keys, key]), np.concatenate([counts, n])
            if len(keys) > 1 << 21:
                keys, counts = _summed(keys, counts)
        keys, counts = _summed(keys, counts)
        at = keys >> DIGIT
        return places[at // k], slots[at // k, at % k], keys & ((1 << DIGIT) - 1), counts

    schema = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])
    found = grid.cells(anchors, work, schema, "anchor long, slot int, bucket int, n long")
    return found.groupBy("anchor", "slot", "bucket").agg(F.sum("n").alias("n"))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(keys, return_inverse=True)
    return key, np.bincount(back, weights=counts, minlength=len(key)).astype(np.int64)


def refined(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows (anchor, slot, lo, hi, need) narrowed to the bucket that holds the need-th best row, with ``need`` less what lies
    above it. A window whose rows are no more than wanted is narrowed to its lowest score and needs nothing more."""
    down = Window.partitionBy("anchor", "slot").orderBy(F.desc("bucket"))
    state = windows.join(counts, ["anchor", "slot"]).withColumn("from_top", F.sum("n").over(down))
    state = state.withColumn("all", F.sum("n").over(Window.partitionBy("anchor", "slot")))
    # the first bucket from the top that reaches what is needed, or else the last one that has rows
    hit = state.filter(F.col("from_top") >= F.least("need", "all")).withColumn("nth", F.row_number().over(down)).filter("nth = 1")
    shift = digit_shift(F.col("lo"), F.col("hi"))
    base = F.col("lo") + F.call_function("shiftleft", F.col("bucket").cast("long"), shift)
    top = F.least(F.col("hi"), base + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1)
    few, above = F.col("all") <= F.col("need"), F.col("from_top") - F.col("n")
    return hit.select(
        "anchor", "slot", F.when(few, F.col("lo")).otherwise(base).alias("lo"), F.when(few, F.col("lo")).otherwise(top).alias("hi"),
        F.when(few, F.col("need")).otherwise(F.col("need") - above).cast("int").alias("need"),
    )


def gathered(grid: Grid, anchors: DataFrame, k: int) -> DataFrame:
    """anchor, slot, negative_id, negative_score of the rows at or above the kth score, at most k of each cell and window."""

    def work(left: pa.Table, right: pa.Table):
        places, slots = _numbers(left, "anchor"), _lists(left, "slot", k, 0)
        kept = [np.zeros(0, np.int64)] * 3
        for row, w, _, score, ids in _in_windows(left, right, k):
            new = [row * k + w, score, ids]
            new = [x[_best(*new, k)] for x in new]
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            if len(kept[0]) > 1 << 21:
                kept = [x[_best(*kept, k)] for x in kept]
        kept = [x[_best(*kept, k)] for x in kept]
        at = kept[0]
        return places[at // k], slots[at // k, at % k], kept[2], kept[1]

    schema = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])
    return grid.cells(anchors, work, schema, "anchor long, slot int, negative_id long, negative_score long")


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, k: int = 5, percent: int = 80, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and each of its k positives.

    A positive's negatives are the k best rows of other labels whose score is from ``percent`` percent of the positive's up to it.
    """
    v, finite = F.col(vector_column).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    blocks = common.stored(blocks_of(rows.select("vec_id", "label", "v"), scale), "negatives-blocks")
    anchors = common.stored(anchors_of(rows.filter("asks").select("vec_id", "label", "v"), scale), "negatives-anchors")
    grid = Grid(blocks, anchors)
    pairs = common.stored(positives(grid, anchors, k), "negatives-positives")
    # 100 * score >= percent * p, without leaving 64 bits
    p = F.col("positive_score")
    lo = F.expr(f"(positive_score div 100) * {percent} + ((positive_score % 100) * {percent} + 99) div 100")
    first = pairs.filter(p >= 0).select("anchor", "slot", lo.alias("lo"), p.alias("hi"), F.lit(k).alias("need"))
    windows, least = common.stored(first, "negatives-windows"), []
    while True:
        widest = windows.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
        if widest is None:
            break
        counts = histogram(grid, _with_windows(anchors, windows), k)
        windows = common.stored(refined(windows, counts), "negatives-windows")
        least.append(windows.filter("lo = hi").select("anchor", "slot", F.col("lo").alias("kth")))
        windows = windows.filter("lo < hi")
    if not least:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    kth = least[0]
    for more in least[1:]:
        kth = kth.unionByName(more)
    last = first.select("anchor", "slot", "hi").join(kth, ["anchor", "slot"]).select("anchor", "slot", F.col("kth").alias("lo"), "hi", F.lit(k).alias("need"))
    found = gathered(grid, _with_windows(anchors, common.stored(last, "negatives-last")), k)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = ranked.join(pairs, ["anchor", "slot"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
