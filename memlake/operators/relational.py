"""Joins, windows, sets and limits that the memory operators are made of."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.session import stored


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; ``rank`` keeps the place in that column. Spark prunes before its shuffle."""
    name = rank or "nth in group"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


#: Members of a group that are paired in one task: larger groups are cut into tiles.
TILE = 2048


#: Different pairs of one run of members, which a task counts, on average: this bounds its hash table.
PAIRS = 1_000_000


#: One member in so many is asked how often its pairs are met.
ASKED = 64


#: Rows that one task makes lists of on average.
ROWS = 2_000_000


INTEGERS = ("tinyint", "smallint", "int", "bigint")


#: Keys of large groups up to this number are sent to every task.
FEW = 100_000


def _grouped(df: DataFrame, group: str, member: str, tile: int) -> tuple[DataFrame, DataFrame | None, dict[str, int]]:
    """The groups of up to ``tile`` rows as lists (g, ms); the distinct members of the others (g, m, and n of them) or None; and figures of both.

    Only larger groups need their own distinct and count, so most rows are shuffled once, by their group. ``df`` is read up to five times.
    """
    one = df.select(F.col(group).alias("g"), F.col(member).alias("m")).filter("g is not null and m is not null")
    sizes = one.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rows, found = sizes.agg(F.sum("n"), F.count_if(F.col("n") > tile)).first()
    large = None
    if found:
        keys = stored(sizes.filter(F.col("n") > tile).select("g"), "large")
        keys = F.broadcast(keys) if found <= FEW else keys
        members = stored(one.join(keys, "g", "left_semi").distinct(), "members")
        counts = members.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        large = members.join(F.broadcast(counts) if found <= FEW else counts, "g")
        one = one.join(keys, "g", "left_anti")
    parts = max(df.sparkSession.sparkContext.defaultParallelism, (rows or 0) // ROWS + 1)
    lists = stored(one.repartition(parts, "g").groupBy("g").agg(F.sort_array(F.collect_set("m")).alias("ms")), "lists")
    # a group's pairs are counted at its members, twice each
    of = [lists.select(F.size("ms").alias("n"), F.explode("ms").alias("m"), F.lit(0).alias("large"))] + ([large.select("n", "m", F.lit(1).alias("large"))] if found else [])
    partners = F.col("n").cast("long") - 1
    figures = [F.sum(partners), F.sum(partners * F.col("large")), F.max("n"), F.approx_count_distinct("m"), F.min("m"), F.max("m")]
    twice, in_large, most, members, least, last = reduce(DataFrame.unionByName, of).agg(*figures).first()
    return lists, large, {"pairs": (twice or 0) // 2, "large": (in_large or 0) // 2, "most": most or 0, "members": members, "least": least, "last": last}


def _repeated(lists: list[DataFrame]) -> float:
    """How often a pair is met in the lists, about: 1 or more, from all pairs of one member in ``ASKED``. It sizes tasks and changes no result."""
    asked = [one.select("ms", F.explode(F.filter("ms", lambda m: F.pmod(F.xxhash64(m), F.lit(ASKED)) == 0)).alias("x")).select("x", F.explode("ms").alias("y")) for one in lists]
    met, different = reduce(DataFrame.unionByName, asked).filter("x <> y").agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("x", "y"), 0.02)).first()
    return max(1.0, met / max(1, different))


def _meeting(lists: DataFrame, large: DataFrame | None, tile: int, width: int) -> DataFrame:
    """g, lead, ms: the first members of ``ms`` are of one run; each is paired with all that come after it, or with all after the first ``lead``, where that is not 0.

    A run is ``width`` numbers in a row, or one member of another type. Members are in the order of a digest of their run, the same in all groups, so a
    pair is always made by the same run. A group gives a row for each run, however many of the run it holds. Groups over ``tile`` members
    are cut into tiles by ranges of that digest, and every two tiles of a group meet; no row holds more than about two tiles.
    """
    run = _run(lists.schema["ms"].dataType.elementType.simpleString(), width)
    digest = lambda m: F.xxhash64(run(m))
    ordered = lambda ms: F.transform(F.sort_array(F.transform(ms, lambda m: F.struct(digest(m).alias("h"), m.alias("m")))), lambda s: s["m"]).alias("ms")

    def runs(df: DataFrame, ms: str, *more: str) -> DataFrame:
        """A row for the first member of each run."""
        at = df.select("g", ms, *more, F.posexplode(ms).alias("i", "x"))
        return at.filter((F.col("i") == 0) | (run(F.get(ms, F.col("i") - 1)) != run(F.col("x"))))

    def tails(df: DataFrame) -> DataFrame:
        return runs(df, "ms").filter(F.col("i") + 1 < F.size("ms")).select("g", F.lit(0).alias("lead"), F.slice("ms", F.col("i") + 1, F.size("ms")).alias("ms"))

    inside = lists.filter(F.size("ms") > 1).select("g", ordered(F.col("ms")))
    if large is None:
        return tails(inside)
    share = digest(F.col("m")) / F.lit(2.0**64) + 0.5
    dealt = large.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("own", F.least(F.col("tiles") - 1, F.floor(share * F.col("tiles")).cast("int")))
    tiles = stored(dealt.groupBy("g", "own", "tiles").agg(F.collect_list("m").alias("ms")).select("g", "own", "tiles", ordered(F.col("ms"))), "tiles")
    inside = inside.unionByName(tiles.select("g", "ms"))
    # a pair of tiles is named by the lower and the upper one
    lower = tiles.filter("own < tiles - 1").select("g", F.col("ms").alias("xs"), F.col("own").alias("low"), F.explode(F.expr("sequence(own + 1, tiles - 1)")).alias("high"))
    upper = tiles.filter("own > 0").select("g", F.col("ms").alias("ys"), F.explode(F.expr("sequence(0, own - 1)")).alias("low"), F.col("own").alias("high"))
    across = runs(lower.join(upper, ["g", "low", "high"]), "xs", "ys").withColumn("xs", F.filter("xs", lambda x: run(x) == run(F.col("x"))))
    return tails(inside).unionByName(across.select("g", F.size("xs").alias("lead"), F.concat("xs", "ys").alias("ms")))


def _run(kind: str, width: int) -> Callable[[Column], Column]:
    return (lambda m: F.call_function("div", m, F.lit(width))) if kind in INTEGERS else (lambda m: m)


def _dealt(run: Column, kind: str, tasks: int) -> Column:
    """The task of a run: neighbouring runs have different tasks, and every ``tasks`` runs begin at another one, so regular gaps between keys do no harm."""
    turn = F.pmod(F.xxhash64(F.call_function("div", run, F.lit(tasks)) if kind in INTEGERS else run), F.lit(tasks))
    return (F.pmod(F.pmod(run, F.lit(tasks)) + turn, F.lit(tasks)) if kind in INTEGERS else turn).cast("int")


def _made(rows: DataFrame, width: int, *kept: str) -> DataFrame:
    """The kept columns, and x and y, of each pair that rows of ``_meeting`` make."""
    run = _run(rows.schema["ms"].dataType.elementType.simpleString(), width)
    at = rows.select(*kept, "lead", "ms", F.posexplode("ms").alias("i", "x")).filter((run(F.col("x")) == run(F.get("ms", F.lit(0)))) & (F.col("i") + 1 < F.size("ms")))
    after = F.slice("ms", F.when(F.col("lead") > 0, F.col("lead") + 1).otherwise(F.col("i") + 2), F.size("ms"))
    return at.select(*kept, "x", F.explode(after).alias("y"))


def pairs_within(df: DataFrame, group: str, member: str, tile: int | None = None) -> DataFrame:
    """Distinct unordered member pairs of each group with ``a < b``; no task pairs more than ``tile`` with ``tile`` members at once."""
    lists, large, _ = _grouped(df, group, member, tile or TILE)
    pairs = _made(_meeting(lists, large, tile or TILE, 1), 1, "g")
    return pairs.select(F.col("g").alias(group), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def pair_counts(tile: int | None = None, **sources: tuple[DataFrame, str, str]) -> DataFrame:
    """a, b (``a < b``) and by each source's name how many of its groups hold both. A source: rows, group column, member column.

    A run of members (neighbouring keys) travels with one list of its partners in a group to one of twice as many tasks as there are ``PAIRS`` different pairs; the
    pairs themselves are made and counted there, so they are never shuffled and a task's table does not grow with the input. A run is as wide as gives
    it ``PAIRS`` different pairs on average (fewer, if that leaves cores idle), and twice that from one group at most; where keys are far apart it has one member. Whole numbers travel as ints where they fit.
    All pairs of one run, in the order of a digest, are counted in one task. Rows are read again and again: give stored ones where they are dear.
    """
    if len({rows.schema[member].dataType.simpleString() for rows, _, member in sources.values()}) > 1:
        raise ValueError("members of several types")
    tile = tile or TILE
    found = {name: _grouped(*source, tile) for name, source in sources.items()}
    figures = [f for _, _, f in found.values()]
    total, most, members = sum(f["pairs"] for f in figures), max(f["most"] for f in figures), max(f["members"] for f in figures)
    context = next(iter(sources.values()))[0].sparkSession.sparkContext
    in_large = sum(f["large"] for f in figures)
    different = max(1, in_large + int((total - in_large) / _repeated([lists for lists, _, _ in found.values()])))
    share = max(1, min(PAIRS * total // different, total // (2 * context.defaultParallelism)))
    width = max(1, min(share * members // max(1, total), 2 * PAIRS // max(1, most - 1)))
    listed = reduce(DataFrame.unionByName, [_meeting(lists, large, tile, width).withColumn("source", F.lit(i).cast("tinyint")) for i, (lists, large, _) in enumerate(found.values())])
    kind = listed.schema["ms"].dataType.elementType.simpleString()
    if kind == "bigint" and all(f["least"] is None or -(2**31) <= f["least"] and f["last"] < 2**31 for f in figures):
        listed = listed.withColumn("ms", F.col("ms").cast("array<int>"))
    tasks = 2 * total // share + 1
    task = _dealt(_run(kind, width)(F.get("ms", F.lit(0))), kind, tasks).alias("task")
    pairs = _made(listed.select(task, "source", "lead", "ms").repartitionById(tasks, "task"), width, "task", "source")
    counts = [F.count_if(F.col("source") == i).alias(name) for i, name in enumerate(sources)] if len(sources) > 1 else [F.count(F.lit(1)).alias(*sources)]
    return pairs.groupBy("task", "x", "y").agg(*counts).select(F.least("x", "y").cast(kind).alias("a"), F.greatest("x", "y").cast(kind).alias("b"), *sources)


def mirrored(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each edge in both directions, in one pass over the edges."""
    both = F.explode(F.array(F.struct(F.col(a).alias("from"), F.col(b).alias("to")), F.struct(F.col(b).alias("from"), F.col(a).alias("to")))).alias("an edge's ends")
    ends = {a: F.col("an edge's ends")["from"].alias(a), b: F.col("an edge's ends")["to"].alias(b)}
    return edges.select("*", both).select(*[ends.get(c, F.col(f"`{c}`")) for c in edges.columns])


def outer_merge(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of several frames on null-free keys, keys coalesced."""
    return reduce(lambda x, y: x.join(y, keys, "full_outer"), frames)


def container_of(inner: DataFrame, outer: DataFrame, key: list[str], bucket_days: int = 370) -> DataFrame:
    """For each inner interval the outer one that contains it: the latest start, then the earliest end.

    Intervals have node_id, start_day, end_day (inclusive dates). Outer ones are dealt to the coarse time buckets they
    touch, inner ones to the bucket of their start, so the range condition is a residual of an equi-join.
    """
    bucket = lambda day: F.floor(F.unix_date(day) / bucket_days)
    spread = outer.select(
        *key, F.col("node_id").alias("parent_id"), F.col("start_day").alias("parent_start"), F.col("end_day").alias("parent_end"),
        F.explode(F.sequence(bucket(F.col("start_day")), bucket(F.col("end_day")))).alias("bucket"),
    )
    found = inner.withColumn("bucket", bucket(F.col("start_day"))).join(spread, [*key, "bucket"], "left")
    inside = (F.col("parent_start") <= F.col("start_day")) & (F.col("parent_end") >= F.col("end_day"))
    found = found.withColumns({c: F.when(inside, F.col(c)) for c in ("parent_id", "parent_start", "parent_end")})
    best = top_per_group(found, [*key, "node_id"], [F.desc_nulls_last("parent_start"), F.asc_nulls_last("parent_end"), F.asc_nulls_last("parent_id")])
    return best.select(*inner.columns, "parent_id")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """The latest ``value`` at or before each left row's time, in one pass: both sides in one ordered window."""
    side, seen, at = "as of side", "as of value", "as of time"  # names that no table has
    tagged = left.select("*", F.lit(1).alias(side), F.lit(None).cast(right.schema[value].dataType).alias(seen), F.col(left_time).alias(at))
    events = right.select(F.col(key), F.col(right_time).alias(at), F.col(value).alias(seen), F.lit(0).alias(side))
    both = tagged.unionByName(events, allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy(at, side).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"{value}_as_of", F.last(seen, ignorenulls=True).over(before)).filter(F.col(side) == 1).drop(side, seen, at)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, reference: str) -> DataFrame:
    """Rows whose reference points nowhere, labelled by the reference's name."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti").select(F.lit(reference).alias("reference"), F.col(child_key).alias("key"))


def either_side(df: DataFrame, left: str, right: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows where either column is one of the ids: two equi-joins in place of an OR."""
    ids = ids.select(F.col(id_column)).distinct()
    one = df.join(ids, df[left] == ids[id_column], "left_semi")
    other = df.join(ids, df[right] == ids[id_column], "left_semi").join(ids, df[left] == ids[id_column], "left_anti")
    return one.unionByName(other)


def running_total(df: DataFrame, group: list[str], order: list[Column], size: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``size`` over each group's rows up to this one, in a total order, without putting a group into one task.

    Rows are range-partitioned by group and order and summed inside their part; a group that began in earlier parts starts from
    its totals there, which is a row for each part at most.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.withColumn("own size", size).repartitionByRange(n, *group, *order).withColumn("part", F.spark_partition_id()), "running")
    totals = placed.groupBy("part", *group).agg(F.sum("own size").alias("total"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.sum("total").over(before)).filter("start is not null").select("part", *[F.col(g).alias(f"group {g}") for g in group], "start")
    same = [placed["part"] == starts["part"], *[placed[g].eqNullSafe(starts[f"group {g}"]) for g in group]]
    inside = Window.partitionBy(placed["part"], *[placed[g] for g in group]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(starts), same, "left")
    return joined.select(*[placed[c] for c in df.columns], (F.sum("own size").over(inside) + F.coalesce("start", F.lit(0))).alias(name))


def within_budget(df: DataFrame, group: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each group, in order, while their running size stays within the budget."""
    return running_total(df, group, order, size, "running_size").filter(F.col("running_size") <= budget)


def merge_ranked(primary: DataFrame, secondary: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """Rows of both, each key once, primary ones first."""
    both = primary.withColumn("tier", F.lit(0)).unionByName(secondary.withColumn("tier", F.lit(1)))
    return top_per_group(both, [key], [F.col("tier"), *order]).orderBy("tier", *order).limit(limit)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """key and change: new, changed, deleted or same."""
    both = before.select(key, F.col(state).alias("was")).join(after.select(key, F.col(state).alias("now")), key, "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return both.select(key, change.alias("change"))


def ranked_with_total(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in a global order with their place and how many rows there are; only ``limit`` rows meet in one task."""
    total = df.agg(F.count(F.lit(1)).alias("total_count"))
    top = df.orderBy(*order).limit(limit)
    # one row of totals, and a window over the few rows that are left
    return top.withColumn("rank_order", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(total))


def best_scored(df: DataFrame, score: str, at: str, kind: str, key: str, limit: int) -> DataFrame:
    """The best rows: by score, then the later ones, then kind and key as text."""
    return df.orderBy(F.desc(score), F.desc_nulls_last(at), F.concat_ws(":", kind, F.col(key).cast("string"))).limit(limit)


def numbered_changes(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``before`` (the value of the row before, in its group), ``is_change`` (first, or another value) and ``version`` (changes
    so far), without putting a group into one task.

    Rows are range-partitioned by group and order, which together name a row, and looked at inside their part. A group that goes on in the
    next part hands over its last value and its changes; that is one row for each part.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *group, *order).withColumn("part", F.spark_partition_id()), "changes")
    inside = Window.partitionBy("part", *group).orderBy(*order)
    seen = placed.select("*", F.lag(value).over(inside).alias("before"), (F.row_number().over(inside) == 1).alias("opens"))
    whole = F.struct(*group)
    # the last row of each part, and the group that its first row belongs to
    ends = seen.groupBy("part").agg(F.min(whole).alias("first group"), F.max(whole).alias("last group"), F.max_by(F.struct(value), F.struct(*group, *order)).alias("last"))
    along = Window.orderBy("part")  # a row for each part
    handed = ends.withColumns({"earlier group": F.lag("last group").over(along), "earlier": F.lag("last").over(along)})
    handed = handed.filter(F.col("earlier group") == F.col("first group")).select("part", *[F.col("first group")[g].alias(g) for g in group], F.col("earlier")[value].alias("handed"), F.lit(True).alias("goes on"))
    seen = seen.join(F.broadcast(handed), ["part", *group], "left").withColumn("goes on", F.coalesce("goes on", F.lit(False)) & F.col("opens"))
    before = F.when(F.col("goes on"), F.col("handed")).otherwise(F.col("before"))
    first = F.col("opens") & ~F.col("goes on")
    seen = seen.withColumn("before", before).withColumn("is_change", first | ~F.col(value).eqNullSafe(F.col("before"))).drop("opens", "goes on", "handed")
    counted = seen.withColumn("version", F.count_if("is_change").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # of each part's last group, which may go on, the changes up to the end of the part
    totals = counted.groupBy("part", *group).agg(F.max("version").alias("n")).join(F.broadcast(ends.select("part", *[F.col("last group")[g].alias(g) for g in group])), ["part", *group])
    upto = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = totals.withColumn("offset", F.sum("n").over(upto)).select("part", *group, "offset")
    following = ends.withColumn("from", F.lag("part").over(along)).select("part", "from", *[F.col("first group")[g].alias(g) for g in group])
    offsets = following.join(offsets.withColumnRenamed("part", "from"), ["from", *group]).select("part", *group, "offset")
    out = counted.join(F.broadcast(offsets), ["part", *group], "left")
    return out.withColumn("version", (F.col("version") + F.coalesce("offset", F.lit(0))).cast("int")).drop("part", "offset")
