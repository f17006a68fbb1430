"""Operator 3: line dedup by pairwise alignment of documents that share rare lines.

Every long enough line that occurs once in its document votes for the pair of the first document that has it and the
document at hand. A pair is aligned when they share a rare line (one of few documents), or several lines, however
common: so a group of thousands of near copies is found as well, each through its first document, and pairs grow with
lines, not with the square of a group. Pairs are aligned by patience diff (unique common lines, longest increasing
sequence, then the gaps; a longest common subsequence where no line is unique), and common blocks that hold a long enough line are deleted from the later document.
Decisions are made on the input, not on what is left.

The query and the pipeline ask for the whole job (``whole``): every voter pairs a document with its first holder,
however common it is. Voters are runs of lines that hold five words in all (a long line alone, or short ones together;
a line without blanks is one word), whatever their count in the document, and a common block of as many words is deleted,
also where it comes twice or in another order. Windows of 2, 4, 8... lines vote as well, so that a document meets the first
holder of more than a line, and a run of few documents pairs each with all before it. The default keeps the two bounds above and unique long lines.

Only line digests are shuffled until the end, when deleted lines return to their text by row.

Defined cases: a null or empty text has no lines to delete and stays as it is (null becomes empty); a line is compared
without blanks at its ends; a row that repeats another (same doc_id and text) is the same document and loses nothing to
it; rows of one doc_id with other texts are not aligned with each other; a null doc_id comes after all others, null ones
in the order of a hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm import common
from memlake.llm.words import Substrings, mix, slices

#: Words of a line that may bring documents together, or make a common block worth deleting.
LINE_WORDS = 5
#: Documents with a line for it to count as rare, and lines that bring two documents together without a rare one.
RARE_DOCUMENTS = 10
SHARED_LINES = 3
#: Pairs of one earlier document that are aligned together, about.
PART = 128


def line_digests(text: str, words: int = LINE_WORDS) -> tuple[list[int], list[bool]]:
    """A signed 64-bit digest of each \\n-split line without blanks at its ends, and whether it is long enough."""
    lines = [line.strip() for line in text.encode("utf-8", "surrogatepass").split(b"\n")]
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)).view(np.int64)
    return values.tolist(), [len(line.split()) >= words for line in lines]


def longest_common(a: list[int], b: list[int], gap: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Aligned positions of a longest common subsequence inside a gap, by bit-parallel rows."""
    a0, a1, b0, b1 = gap
    shared = set(a[a0:a1]) & set(b[b0:b1])
    left, right = ([k for k in range(s, e) if x[k] in shared] for x, s, e in ((a, a0, a1), (b, b0, b1)))
    where: dict[int, int] = {}
    for j, k in enumerate(right):
        where[b[k]] = where.get(b[k], 0) | 1 << j
    row = full = (1 << len(right)) - 1
    rows = []
    for k in left:
        match = row & where[a[k]]
        row = ((row + match) | (row - match)) & full
        rows.append(row)
    out = []
    i, j = len(left) - 1, len(right) - 1
    while i >= 0 and j >= 0:
        if a[left[i]] == b[right[j]]:
            out.append((left[i], right[j]))
            i, j = i - 1, j - 1
        elif rows[i] >> j & 1:
            j -= 1
        else:
            i -= 1
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, increasing in both, by patience diff."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        unique = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in place]
        # longest increasing subsequence of places in b
        tails: list[int] = []
        ends: list[int] = []
        before: list[int] = []
        for n, (_, j) in enumerate(unique):
            k = bisect_left(tails, j)
            before.append(ends[k - 1] if k else -1)
            tails[k : k + 1] = [j]
            ends[k : k + 1] = [n]
        chain = []
        n = ends[-1] if ends else -1
        while n >= 0:
            chain.append(unique[n])
            n = before[n]
        if not chain:
            out += longest_common(a, b, (a0, a1, b0, b1))
            continue
        chain.reverse()
        for (i, j), (next_i, next_j) in zip(chain, [*chain[1:], (a1, b1)], strict=True):
            out.append((i, j))
            todo.append((i + 1, next_i, j + 1, next_j))
        todo.append((a0, chain[0][0], b0, chain[0][1]))
    return sorted(out)


def blocks(first: list[int], later: list[int]) -> Iterator[list[int]]:
    """Places in ``later`` of each aligned block."""
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(first, later), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            yield block
            block = []
        block.append(j)
        last = (i, j)


def common_blocks(first: list[int], later: list[int], long_enough: list[bool]) -> list[int]:
    """Places in ``later`` of aligned blocks that hold a long enough line."""
    return [x for block in blocks(first, later) if any(long_enough[x] for x in block) for x in block]


def runs(words: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the shortest run of lines from each line with words that holds LINE_WORDS words in all."""
    total = np.concatenate([[0], np.cumsum(words)])
    start = np.flatnonzero(words)
    end = np.searchsorted(total, total[start] + LINE_WORDS)
    return start[end < len(total)], end[end < len(total)]


def run_digests(lines: list[int] | np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Substrings(mix(np.array(lines, np.int64).view(np.uint64)))(start, end).view(np.int64)


def whole_blocks(first: list[int], later: list[int], words: list[int]) -> list[int]:
    """Places in ``later`` of the lines that stand in a block common with ``first`` of LINE_WORDS words in all.

    What one alignment finds is taken out, and the rest aligned again, for blocks that come twice or in another order.
    Where alignment finds no more, a common run that is left is extended to its block.
    """
    rest: list = list(later)
    gone: set[int] = set()
    start, end = (x.tolist() for x in runs(words))
    first_at: dict[tuple, int] = {}
    lengths = {e - s for s, e in zip(start, end, strict=True)}
    for n in lengths:
        for i in range(len(first) - n + 1):
            first_at.setdefault(tuple(first[i : i + n]), i)
    todo = [(s, e) for s, e in zip(start, end, strict=True) if tuple(later[s:e]) in first_at]
    aligned = bool(todo)
    while todo:
        found = [x for block in blocks(first, rest) if sum(words[x] for x in block) >= LINE_WORDS for x in block] if aligned else []
        aligned = bool(found)
        if not found:
            s, e = todo[0]
            i, j = first_at[tuple(later[s:e])] + e - s, e
            while i < len(first) and j < len(rest) and first[i] == rest[j]:
                i, j = i + 1, j + 1
            found = list(range(s, j))
            i, j = first_at[tuple(later[s:e])] - 1, s - 1
            while i >= 0 and j >= 0 and first[i] == rest[j]:
                found.append(j)
                i, j = i - 1, j - 1
        gone.update(found)
        for x in found:
            rest[x] = (x,)  # equal to no line
        todo = [(s, e) for s, e in todo if not gone.issuperset(range(s, e))]
    return sorted(gone)


def base_runs(lines: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests, offsets) of the distinct shortest runs (``runs``) of each of several documents."""
    total = np.concatenate([[0], np.cumsum(words)])
    start = np.flatnonzero(words)
    end = np.searchsorted(total, total[start] + LINE_WORDS)
    doc = np.searchsorted(offsets, start, "right") - 1
    inside = end <= offsets[doc + 1]
    start, end, doc = start[inside], end[inside], doc[inside]
    digest = run_digests(lines, start, end)
    order = np.lexsort((digest, doc))
    digest, doc = digest[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1])
    return digest[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def profiles(docs: DataFrame) -> DataFrame:
    """order (doc_id, null: last), row, lines, long (whether each line is long enough), words and base (digests of the
    shortest runs) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [[line.strip() for line in t.as_py().encode("utf-8", "surrogatepass").split(b"\n")] for t in batch.column("text")]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            flat = [line for x in own for line in x]
            lines = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat)).view(np.int64)
            words = np.fromiter((len(line.split()) for line in flat), np.int32, len(flat))
            base, at = base_runs(lines, words, offsets)
            lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(x)) for o, x in ((offsets, lines), (offsets, words >= LINE_WORDS), (offsets, words), (at, base))]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("row"), *lists], ["order", "row", "lines", "long", "words", "base"])

    rows = common.keyed(docs).select(F.coalesce("doc_id", F.lit(common.MAX_LONG)).alias("order"), "row", "text")
    return rows.mapInArrow(each, "order long, row long, lines array<long>, long array<boolean>, words array<int>, base array<long>")


def windows(lines: np.ndarray, words: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Digests of windows of 2, 4, 8... lines from where a shared run starts: the lines around a run say which of its many
    holders have more of its block. A window can't be shared where the run that it starts with is not."""
    start, end = runs(words)
    met = np.isin(run_digests(lines, start, end), shared)
    start, end = start[met], end[met]
    found = [np.zeros(0, np.int64)]
    size = 2
    while size <= len(lines):
        longer = (end - start < size) & (start + size <= len(lines))
        found.append(np.unique(run_digests(lines, start[longer], start[longer] + size)))
        size *= 2
    return np.concatenate(found)


def window_votes(rows: DataFrame) -> DataFrame:
    """order, row and line (digest) of the windows of rows with their ``shared`` runs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                found = [windows(*(x.values.to_numpy() for x in own)) for own in zip(*(batch.column(c) for c in ("lines", "words", "shared")), strict=True)]
                at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([batch.column("order").take(at), batch.column("row").take(at), pa.array(np.concatenate(found))], ["order", "row", "line"])

    return rows.select("order", "row", "lines", "words", "shared").mapInArrow(each, "order long, row long, line long")


def met_lines(cast: DataFrame) -> DataFrame:
    """The votes (order, row, line) of lines with more than one document, with how many and the first of them."""
    shared_lines = cast.groupBy("line").agg(F.count(F.lit(1)).alias("documents"), F.min(F.struct("order", "row")).alias("first")).filter("documents > 1")
    # a table of its own, so that Spark can split the join where very many documents have a line
    return cast.join(common.stored(shared_lines, "shared-lines"), "line")


def earlier(first: str) -> Column:
    """Whether the document of the struct ``first`` (order, row) comes before that of ``order`` and ``row``."""
    return F.expr(f"{first}.order < order or (order = {common.MAX_LONG} and {first}.order = order and {first}.row < row)")


def whole_pairs(known_rows: DataFrame) -> DataFrame:
    """row and first_row of all pairs to align: a document with the first one of each of its voters, however common, and
    with every earlier one of its rare runs."""
    met = common.stored(met_lines(known_rows.select("order", "row", F.explode("base").alias("line"))), "line-met")
    own = met.groupBy("row").agg(F.collect_list("line").alias("shared"))
    wider = met_lines(common.stored(window_votes(known_rows.join(own, "row")), "line-windows"))
    with_first = met.unionByName(wider).filter(earlier("first")).select("row", F.col("first.row").alias("first_row"))
    # with two holders the other one is the first
    few = met.filter((F.col("documents") > 2) & (F.col("documents") <= RARE_DOCUMENTS))
    others = few.select("line", F.struct("order", "row").alias("other"))
    with_all = few.join(others, "line").filter(earlier("other")).select("row", F.col("other.row").alias("first_row"))
    return with_first.union(with_all).distinct()


def whole_deleted_lines(docs: DataFrame) -> DataFrame:
    """row and ``gone`` of the rows that lose any line, without a bound on how common a shared line is."""
    known = common.stored(profiles(docs), "line-profiles")
    if not common.ids_are_unique(docs):
        known = common.stored(known.dropDuplicates(["row"]), "line-rows")
    return aligned(common.stored(whole_pairs(known), "line-pairs"), known, "words", whole_blocks)


def aligned(pairs: DataFrame, known: DataFrame, weigh: str, blocks_of) -> DataFrame:
    """row and ``gone`` of the later documents (row) of pairs with an earlier one (first_row).

    The lines of an earlier document go to its pairs once for each PART of them, however many there are.
    """
    counts = pairs.groupBy("first_row").agg(F.count(F.lit(1)).alias("n"))
    parts = common.stored(counts.select("first_row", F.ceil(F.col("n") / PART).alias("parts")), "line-parts")
    dealt = pairs.join(parts, "first_row").withColumn("part", F.pmod(F.xxhash64("row", F.lit(9)), "parts"))
    dealt = dealt.join(known.select("row", "lines", weigh), "row")
    later = dealt.groupBy("first_row", "part").agg(F.collect_list(F.struct("row", "lines", weigh)).alias("later"))
    both = later.join(known.select(F.col("row").alias("first_row"), F.col("lines").alias("first_lines")), "first_row").select("first_lines", "later")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, several in zip(batch.column("first_lines"), batch.column("later"), strict=True):
                first, several = first.as_py(), several.values
                for at in range(0, len(several), 64):  # lists become Python objects a few documents at a time
                    some = several.slice(at, 64).to_pylist()
                    gone = [blocks_of(first, x["lines"], x[weigh]) for x in some]
                    yield pa.RecordBatch.from_arrays([pa.array([x["row"] for x in some], pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["row", "gone"])

    found = both.mapInArrow(align, "row long, gone array<int>").select("row", F.explode("gone").alias("place"))
    return found.groupBy("row").agg(F.collect_set("place").alias("gone"))


def deleted_lines(docs: DataFrame, rare: int = RARE_DOCUMENTS, shared: int = SHARED_LINES, whole: bool = False) -> DataFrame:
    """row and ``gone`` (places of deleted lines) of the rows that lose any."""
    if whole:
        return whole_deleted_lines(docs)
    known = common.stored(profiles(docs), "line-profiles")
    known_rows = known.dropDuplicates(["row"])
    # lines that occur once in their document
    line = known_rows.select("order", "row", F.explode(F.arrays_zip("lines", "long")).alias("x")).filter("x.long").select("order", "row", F.col("x.lines").alias("line"))
    once = line.groupBy("row", "line").agg(F.count(F.lit(1)).alias("n"), F.first("order").alias("order")).filter("n = 1").select("order", "row", "line")
    shared_lines = once.groupBy("line").agg(F.count(F.lit(1)).alias("documents"), F.min(F.struct("order", "row")).alias("first")).filter("documents > 1")
    # a table of its own, so that Spark can split the join where very many documents have a line
    shared_lines = common.stored(shared_lines, "shared-lines")
    votes = once.join(shared_lines, "line").filter(earlier("first")).withColumn("first_row", F.col("first.row"))
    pairs = votes.groupBy("row", "first_row").agg(F.count(F.lit(1)).alias("n"), F.min("documents").alias("rarest")).filter((F.col("rarest") <= rare) | (F.col("n") >= shared))
    return aligned(common.stored(pairs.select("row", "first_row"), "line-pairs"), known_rows, "long", common_blocks)


def dedup(docs: DataFrame, rare: int = RARE_DOCUMENTS, shared: int = SHARED_LINES, whole: bool = False) -> DataFrame:
    """doc_id, row, kept (the lines that stay, joined by \\n), n_lines, n_removed, kept_sha256 of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text"), batch.column("gone").to_pylist(), strict=True):
                lines = text.as_py().split("\n")
                drop = set(gone or ())
                kept = "\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text.as_py()
                out.append((kept, len(lines), len(drop), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, [pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns], ["doc_id", "row", "kept", "n_lines", "n_removed", "kept_sha256"])

    marked = common.keyed(docs).join(deleted_lines(docs, rare, shared, whole).hint("shuffle_hash"), "row", "left").select("doc_id", "row", "text", "gone")
    return marked.mapInArrow(cut, "doc_id long, row long, kept string, n_lines long, n_removed long, kept_sha256 string")


def drop_lines(docs: DataFrame, rare: int = RARE_DOCUMENTS, shared: int = SHARED_LINES, whole: bool = False) -> DataFrame:
    """``docs`` with their columns, without deleted lines (n_chars follows the text); documents left without a word go."""
    marked = docs.select(F.struct("*").alias("d"), common.row_key(docs).alias("row"))
    joined = marked.join(deleted_lines(docs, rare, shared, whole).hint("shuffle_hash"), "row", "left")
    lines = F.split("d.text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    kept = joined.select("d.*", F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(left).alias("text left"), F.col("gone").isNotNull().alias("was cut"))
    out = {"text": F.col("text left")} | ({"n_chars": F.when(F.col("was cut"), F.length("text left")).otherwise(F.col("n_chars")).cast("long")} if "n_chars" in docs.columns else {})
    return kept.filter(~F.col("was cut") | F.col("text left").rlike(r"[^\x20\x09-\x0D]")).select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
