"""Entity resolution: candidates, conflicts, scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.relational import top_per_group
from memlake.session import stored

#: ``names_within``: names of a block (of up to ``LETTERS`` letters; fewer of longer ones), pairs of a task, pairs looked at together.
SIDE, LETTERS, PAIRS, CHUNK = 16384, 64, 1 << 26, 1 << 18


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def candidates(asked: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities for each asked name: exact name (0), name key (1), alias (2); verified ones first, then the id.

    asked: name. entities: id, name, verified. aliases: id, alias.
    """
    with_key = asked.select("name", name_key(F.col("name")).alias("key"))
    exact = with_key.join(entities.select("id", "name", "verified"), "name").select("name", "id", "verified", F.lit(0).alias("kind"))
    by_key = with_key.join(entities.select("id", name_key(F.col("name")).alias("key"), "verified"), "key").select("name", "id", "verified", F.lit(1).alias("kind"))
    by_alias = with_key.join(aliases.select("id", name_key(F.col("alias")).alias("key")).join(entities.select("id", "verified"), "id"), "key").select("name", "id", "verified", F.lit(2).alias("kind"))
    found = exact.unionByName(by_key).unionByName(by_alias).groupBy("name", "id").agg(F.min("kind").alias("kind"), F.max("verified").alias("verified"))
    by = Window.partitionBy("name").orderBy(F.asc("kind"), F.desc("verified"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(by))


def similar_names(names: DataFrame, key: str, name: str, most: int = 1) -> DataFrame:
    """Pairs of names within an edit distance, of the same first letter.

    Deleting one letter from both of two names at distance one leaves a common string, so names meet by these
    deletions: an equi-join, whatever letter is common.
    """
    if most != 1:
        raise ValueError("deletion keys are exact for distance 1")
    own = names.select(F.col(key).alias("id"), F.lower(F.col(name)).alias("n")).distinct()
    cut = F.transform(F.sequence(F.lit(1), F.length("n")), lambda i: F.concat(F.substring("n", F.lit(1), i - 1), F.substring("n", i + 1, F.length("n"))))
    keys = own.filter("length(n) > 0").select("id", "n", F.explode(F.array_distinct(F.concat(F.array("n"), cut))).alias("k"))
    left, right = keys.select(F.col("id").alias("a"), F.col("n").alias("name_a"), "k"), keys.select(F.col("id").alias("b"), F.col("n").alias("name_b"), "k")
    pairs = left.join(right, "k").filter("a < b").select("a", "b", "name_a", "name_b").distinct()
    near = pairs.filter((F.substring("name_a", 1, 1) == F.substring("name_b", 1, 1)) & (F.levenshtein("name_a", "name_b") <= most))
    return near.withColumn("distance", F.levenshtein("name_a", "name_b"))


def names_within(names: DataFrame, key: str, name: str, most: int) -> DataFrame:
    """a, b, name_a, name_b, distance of all pairs of names within ``most`` edits that begin with the same letter.

    Names of one first letter and length are dealt to blocks of about ``SIDE``, and every two blocks whose lengths differ by
    ``most`` at most meet in a tile of their own, so each pair meets once and no pair is shuffled. Exact: a pair is measured
    unless its letters or their neighbours show that it is further apart. The work is a few nanoseconds for each pair of like length, the
    memory of a task that of one tile, and tasks are one for about ``PAIRS`` pairs.
    """
    own = names.select(F.col(key).alias("id"), F.lower(F.col(name)).alias("n")).filter("id is not null and length(n) > 0").distinct()
    own = stored(own.select("id", "n", F.substring("n", 1, 1).alias("first"), F.length("n").alias("l")), "names-within")
    groups = own.groupBy("first", "l").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.expr(f"ceil(size * greatest(l, {LETTERS}) / {SIDE * LETTERS})"))
    other = groups.select("first", F.col("l").alias("m"), F.col("size").alias("other"), F.col("blocks").alias("places"))
    meet = groups.join(other, "first").filter(F.col("m").between(F.col("l"), F.col("l") + most))
    pairs = meet.agg(F.sum(F.col("size").cast("double") * F.col("other"))).first()[0] or 0
    tasks = max(own.sparkSession.sparkContext.defaultParallelism, int(pairs) // PAIRS + 1)
    dealt = own.join(groups.select("first", "l", "blocks"), ["first", "l"]).withColumn("block", F.expr("pmod(xxhash64(id, n), blocks)")).drop("blocks")
    meet, tile = meet.select("first", "l", "m", "blocks", "places"), ["first", "l", "m", "i", "j"]
    # of two blocks of one length the lower one is at the left; a block meets itself as a left side alone
    left = dealt.withColumnRenamed("block", "i").join(meet, ["first", "l"]).withColumn("j", F.explode(F.expr("sequence(if(l = m, i, 0), places - 1)")))
    right = dealt.withColumnsRenamed({"block": "j", "l": "m"}).join(meet, ["first", "m"]).filter("l < m or j > 0").withColumn("i", F.explode(F.expr("sequence(0, if(l = m, greatest(j, 1), blocks) - 1)")))
    sides = left.select(*tile, "id", "n", F.lit(True).alias("left")).union(right.select(*tile, "id", "n", F.lit(False).alias("left")))
    kind = own.schema["id"].dataType.simpleString()
    found = sides.repartition(tasks, *tile).groupBy(*tile).applyInArrow(_near_in_tile(most), f"a {kind}, b {kind}, name_a string, name_b string, distance int")
    return found.filter("a <> b")


def _near_in_tile(most: int):
    """The near pairs of a tile's two sides, the smaller (id, name) first, in batches."""

    def near(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, l, m, i, j = (x.as_py() for x in key)
        rows = pa.Table.from_batches(list(batches)).select(["id", "n", "left"]).sort_by([("id", "ascending"), ("n", "ascending")]).combine_chunks()
        ids, names, at_left = rows["id"].combine_chunks(), rows["n"].combine_chunks(), rows["left"].to_numpy()
        alone = l == m and i == j
        xs, ys = np.flatnonzero(at_left), np.flatnonzero(at_left if alone else ~at_left)
        texts = names.to_pylist()
        x_codes, y_codes = (np.array([texts[k] for k in at], f"U{n}").view(np.uint32).reshape(len(at), n) for at, n in ((xs, l), (ys, m)))
        # all begin with the same letter, which costs no edit
        x_signs, y_signs = ((_letters(c[:, 1:]), _neighbours(c)) for c in (x_codes, y_codes))
        x_codes, y_codes = (np.ascontiguousarray(c.T) for c in _small(x_codes[:, 1:], y_codes[:, 1:]))
        for x, y in _alike(x_signs, y_signs, most, m - l, alone):
            distance = _distances(x_codes, y_codes, x, y, most)
            close = np.flatnonzero(distance <= most)
            x, y = xs[x[close]], ys[y[close]]
            a, b = pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))
            yield pa.RecordBatch.from_arrays([ids.take(a), ids.take(b), names.take(a), names.take(b), pa.array(distance[close].astype(np.int32))], ["a", "b", "name_a", "name_b", "distance"])

    return near


def _alike(x_signs: tuple[np.ndarray, ...], y_signs: tuple[np.ndarray, ...], most: int, longer: int, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs, by their numbers at either side, whose letters and neighbours don't show that they are further apart than ``most``, about ``CHUNK`` at a time. alone: x < y."""
    (x_letters, x_neighbours), (y_letters, y_neighbours) = x_signs, y_signs
    if not len(y_letters):
        return
    # an edit in place changes two letters' counts, any other one; and four or three of the neighbours
    most_letters, most_neighbours = min(64, 2 * most - longer), min(64, 4 * most - longer)
    step = max(1, CHUNK // len(y_letters))
    room = step * len(y_letters) + 7
    differ, count, few, held = np.empty(room, np.uint64), np.empty(room, np.uint8), np.empty(room, bool), []
    for begin in range(0, len(x_letters), step):
        rows, first = x_letters[begin : begin + step, None], begin if alone else 0
        wide = len(y_letters) - first
        size = len(rows) * wide
        whole = -(-size // 8) * 8
        np.bitwise_xor(rows, y_letters[first:], out=differ[:size].reshape(len(rows), wide))
        np.less_equal(np.bitwise_count(differ[:size], out=count[:size]), most_letters, out=few[:size])
        few[size:whole] = False
        eights = np.flatnonzero(few[:whole].view(np.uint64))  # most pairs are passed over eight at a time
        at = np.flatnonzero(few[:whole].reshape(-1, 8)[eights])
        x, y = np.divmod(eights[at >> 3] * 8 + (at & 7), wide)
        x, y = x + begin, y + first
        near = np.bitwise_count(x_neighbours[x] ^ y_neighbours[y]) <= most_neighbours
        near = np.flatnonzero(near & (x < y) if alone else near)
        held.append((x[near], y[near]))
        if begin + step >= len(x_letters) or sum(len(x) for x, _ in held) >= CHUNK:
            yield tuple(np.concatenate(side) for side in zip(*held, strict=True))
            held = []


def _letters(codes: np.ndarray) -> np.ndarray:
    """64 bits of each name: of 32 classes of letters whether the name has one and whether it has two."""
    bits = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        bit = np.uint64(1) << (column % 32 * 2).astype(np.uint64)
        bits |= np.where(bits & bit, bit << np.uint64(1), bit)
    return bits


def _neighbours(codes: np.ndarray) -> np.ndarray:
    """64 bits of each name: of 64 classes of two letters side by side, the last letter and the end among them, whether the name has one."""
    bits = np.zeros(len(codes), np.uint64)
    following = np.concatenate([codes[:, 1:], np.zeros((len(codes), 1), codes.dtype)], axis=1)
    for column, after in zip(codes.T.astype(np.uint64), following.T.astype(np.uint64), strict=True):
        bits |= np.uint64(1) << ((column * np.uint64(31) + after) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58))
    return bits


def _small(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of both sides by their number among those that occur."""
    known, numbers = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    numbers = numbers.astype(np.min_scalar_type(len(known)))
    return numbers[: x.size].reshape(x.shape), numbers[x.size :].reshape(y.shape)


def _distances(x_codes: np.ndarray, y_codes: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of the names x and y (columns of codes), right up to ``most``: the cells near the table's diagonal, for all pairs at once."""
    l, m = len(x_codes), len(y_codes)
    kind = np.min_scalar_type(l + m + most + 2)
    one, far = kind.type(1), np.full(len(x), most + 1, kind)
    row = [np.full(len(x), d, kind) if 0 <= d <= m else far for d in range(-most, most + 1)]  # cell d of row i is column i + d
    y_letters = {}
    for i in range(1, l + 1):
        x_letter, above, row = x_codes[i - 1][x], row, []
        for d in range(-most, most + 1):
            if (j := i + d) <= 0 or j > m:
                row.append(np.full(len(x), i, kind) if j == 0 else far)
                continue
            if j not in y_letters:
                y_letters[j] = y_codes[j - 1][y]
            cell = above[d + most] + (x_letter != y_letters[j])
            if d < most:
                np.minimum(cell, above[d + most + 1] + one, out=cell)
            if d > -most:
                np.minimum(cell, row[-1] + one, out=cell)
            row.append(cell)
        y_letters.pop(i - most, None)
    return row[m - l + most]


def name_likeness(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def alike_names(names: DataFrame, scope: str, name: str, least: float = 0.6) -> DataFrame:
    """scope, name_a, name_b, lexical: different names of one scope with a likeness of ``least`` (over one half) or more.

    An edit changes two of a name's letter pairs at most (counted with their repeats, both ends marked), so alike names
    of length up to n have n * (2 * least - 1) + 1 in common. Each name is therefore sent under its rarest pairs only, as
    many as it can lack and one more: an equi-join that misses nothing and leaves the common pairs out.
    """
    if not 0.5 < least <= 1:
        raise ValueError("likeness over one half, up to 1")
    own = names.select(scope, F.col(name).alias("n")).filter("n is not null").distinct()
    marked = F.concat(F.lit("\x01"), "n", F.lit("\x02"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("n") + 1), lambda i: F.substring(marked, i, F.lit(2)))
    nth = lambda g, i: F.concat(g, F.size(F.filter(F.slice("pairs", F.lit(1), i + 1), lambda x: x == g)).cast("string"))
    grams = own.withColumn("pairs", pairs).select(scope, "n", F.explode(F.transform("pairs", nth)).alias("gram"))
    common = grams.groupBy(scope, "gram").agg(F.count(F.lit(1)).alias("names"))
    rarest = Window.partitionBy(scope, "n").orderBy("names", "gram")
    # rounding down what two names must share is safe against errors of the product
    needed = F.greatest(F.lit(1), F.ceil(F.length("n") * F.lit(2 * least - 1) + 1 - 1e-9))
    sent = grams.join(common, [scope, "gram"]).withColumn("nth", F.row_number().over(rarest)).filter(F.col("nth") <= F.length("n") + 2 - needed)
    left, right = (sent.select(scope, "gram", F.col("n").alias(f"name_{side}")) for side in "ab")
    met = left.join(right, [scope, "gram"]).filter("name_a < name_b").select(scope, "name_a", "name_b").distinct()
    return met.withColumn("lexical", name_likeness(F.col("name_a"), F.col("name_b"))).filter(F.col("lexical") >= least)


def with_shared(pairs: DataFrame, edges: DataFrame, node: str, neighbour: str, predicate: str) -> DataFrame:
    """Pairs (a, b) with the number of neighbours that both have and whether one of these has the same predicate to both.

    The edges of the given pairs meet, not all nodes of a neighbour, so a neighbour of many costs nothing more.
    """
    own = edges.groupBy(node, neighbour).agg(F.collect_set(predicate).alias("predicates"))
    a, b = (own.select(F.col(node).alias(side), F.col(neighbour).alias("neighbour"), F.col("predicates").alias(f"predicates_{side}")) for side in "ab")
    met = pairs.select("a", "b").join(a, "a").join(b, ["b", "neighbour"])
    shared = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max(F.arrays_overlap("predicates_a", "predicates_b")).alias("same_predicate"))
    return pairs.join(shared, ["a", "b"], "left").withColumns({"shared": F.coalesce("shared", F.lit(0)), "same_predicate": F.coalesce("same_predicate", F.lit(False))})


def conflict_confidence(lexical: Column, shared: Column, shared_predicate: Column, profile: Column) -> Column:
    graph = F.least(F.lit(0.4), 0.16 * shared + F.when(shared_predicate, 0.08).otherwise(0.0))
    return F.round(F.least(F.lit(0.99), 0.68 * lexical + graph + 0.1 * profile), 4)


def is_conflict(lexical: Column, shared: Column, confidence: Column) -> Column:
    alike = (lexical >= 0.84) | ((lexical >= 0.72) & (shared >= 1)) | ((lexical >= 0.6) & (shared >= 2))
    return alike & (confidence >= 0.72)


def candidate_score(name: Column, kind: Column, neighbours: Column, place: Column, source: Column, time: Column) -> Column:
    return 0.42 * name + 0.18 * kind + 0.16 * neighbours + 0.10 * place + 0.08 * source + 0.06 * time


def decide(scored: DataFrame, query: str, score: str, name_score: str, same_key: str, order: str) -> DataFrame:
    """Decision for each query over its candidates: choose between close ones, attach a sure one, ask to merge, or create.

    Candidates under .55 in both name and total score don't count.
    """
    kept = scored.withColumn("kept", (F.col(name_score) >= 0.55) | (F.col(score) >= 0.55))
    w = Window.partitionBy(query).orderBy(F.desc("kept"), F.desc(score), F.asc(order))
    best = kept.withColumns({"next_score": F.lead(F.when(F.col("kept"), F.col(score))).over(w), "nth": F.row_number().over(w)}).filter("nth = 1")
    decision = (
        F.when(~F.col("kept"), "create")
        .when(F.col("next_score").isNotNull() & (F.col(score) - F.col("next_score") < 0.12), "choose")
        .when((F.col(score) >= 0.9) & F.col(same_key), "attach")
        .otherwise("merge_prompt")
    )
    return best.select(query, F.when(F.col("kept"), F.col(order)).alias("candidate"), decision.alias("decision"))


def role_conflicts(roles: DataFrame, entity: str, role: str, most: int = 6) -> DataFrame:
    """Entities with more than one role, and the first of their roles in order."""
    found = roles.groupBy(entity).agg(F.countDistinct(role).alias("n_roles"), F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_set(role)).alias("all"))
    return found.filter("n_roles > 1").select(entity, "n_roles", "n_rows", F.array_join(F.slice("all", 1, most), ",").alias("roles"))


def alias_ledger(mentions: DataFrame, alias: str, ts: str, least: int = 2) -> DataFrame:
    """Evidence of each alias: mentions, first and last seen, established from ``least`` on."""
    found = mentions.groupBy(alias).agg(F.count(F.lit(1)).alias("n_mentions"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    return found.withColumn("status", F.when(F.col("n_mentions") >= least, "established").otherwise("tentative"))


def canonical_speakers(turns: DataFrame, aliases: DataFrame, speaker: str) -> DataFrame:
    """Speakers mapped by an alias table (alias, canonical); an alias of several canonicals is ambiguous and kept as it is."""
    known = aliases.groupBy(F.lower("alias").alias("key")).agg(F.countDistinct("canonical").alias("n"), F.min("canonical").alias("canonical"))
    joined = turns.withColumn("key", F.lower(F.trim(speaker))).join(known, "key", "left")
    return joined.withColumns({"speaker": F.when(F.col("n") == 1, F.col("canonical")).otherwise(F.col("key")), "ambiguous": F.coalesce(F.col("n") > 1, F.lit(False))}).drop("key", "n", "canonical")


def correction_targets(corrections: DataFrame, entities: DataFrame, aliases: DataFrame, scope: str, limit: int = 12) -> DataFrame:
    """scope, id, score: entities that a correction (source, canonical) of their scope may mean, best first.

    Names and aliases (``key``) meet a correction by equal key or by a shared word of three letters or more, never all by
    all. Own names score 100 (canonical) or 95 (source), verified aliases 98 or 96, others 80 or 75; shared words alone
    give 35 for a name, 45 for a verified alias and 25 for another.
    """
    names = entities.select(scope, "id", "key", F.lit("name").alias("kind")).union(aliases.select(scope, "id", "key", F.when(F.col("verified"), "verified").otherwise("alias")))
    long_words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: F.length(w) >= 3)
    asked = corrections.select(scope, "source", "canonical", F.array_distinct(F.concat(long_words(F.col("source")), long_words(F.col("canonical")))).alias("words"))
    by_word = asked.select(scope, "source", "canonical", F.explode("words").alias("meet"))
    by_name = asked.select(scope, "source", "canonical", F.explode(F.array("source", "canonical")).alias("meet"))
    met_words = names.select("*", F.explode(F.array_distinct(F.split("key", r"\s+"))).alias("meet")).join(by_word, [scope, "meet"])
    met_names = names.select("*", F.col("key").alias("meet")).join(by_name, [scope, "meet"])
    own, verified = F.col("kind") == "name", F.col("kind") == "verified"
    pick = lambda name, sure, other: F.when(own, name).when(verified, sure).otherwise(other)
    score = F.when(F.col("key") == F.col("canonical"), pick(100, 98, 80)).when(F.col("key") == F.col("source"), pick(95, 96, 75)).otherwise(pick(35, 45, 25))
    scored = met_words.unionByName(met_names).groupBy(scope, "id").agg(F.max(score).alias("score"))
    return top_per_group(scored, [scope], [F.desc("score"), F.asc("id")], limit)


def keepers_of_copies(rows: DataFrame, group: list[Column], priority: list[Column], key: str) -> DataFrame:
    """(keeper_id, duplicate_id): of each group the first row by priority, and every other one, by one aggregate."""
    named = rows.select(*[c.alias(f"group {i}") for i, c in enumerate(group)], F.struct(*[c.alias(f"p{i}") for i, c in enumerate(priority)], F.col(key).alias("id")).alias("own"))
    columns = [f"group {i}" for i in range(len(group))]
    first = named.groupBy(*columns).agg(F.min("own").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return named.join(first, columns).filter("own.id != keeper.id").select(F.col("keeper.id").alias("keeper_id"), F.col("own.id").alias("duplicate_id"))
