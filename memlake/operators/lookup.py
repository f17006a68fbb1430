"""Looking up subjects by name: pair binding, stored canonical values, neighbours of seeds, focused support rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.scalar import ascii_bounds, weighted_rules
from memlake.operators.relational import top_per_group

NAME = r"(\b[A-Z][a-z]+\b)"


def resolved(names: DataFrame, entities: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """name, id, status of distinct names: exact (an entity's own name), alias, ambiguous (several entities, no id) or unknown.

    entities: id, name. aliases: id, alias. Names meet in lower case; an own name goes before aliases.
    """
    asked = names.select(F.col(name).alias("name")).filter("name is not null").distinct().withColumn("k", F.lower(F.trim("name")))
    known = entities.select("id", F.lower(F.trim("name")).alias("k"), F.lit(0).alias("rank")).union(aliases.select("id", F.lower(F.trim("alias")).alias("k"), F.lit(1).alias("rank")))
    found = known.groupBy("k", "rank").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    best = found.groupBy("k").agg(F.min(F.struct("rank", "n", "id")).alias("x")).select("k", "x.*")
    status = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").when(F.col("rank") == 0, "exact").otherwise("alias")
    return asked.join(best, "k", "left").select("name", F.when(F.col("n") == 1, F.col("id")).alias("id"), status.alias("status"))


def pair_binding(asked: DataFrame, entities: DataFrame, aliases: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, required, verified, primary_id, pair_id, reason of each question: whether the two subjects that it names are known.

    The first two different capitalised names are the pair; a question with one name needs that one alone.
    """
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(ascii_bounds(NAME)), F.lit(1)))
    named = asked.select(*key, names.alias("names")).select(*key, F.size("names").alias("n"), F.get("names", F.lit(0)).alias("first"), F.get("names", F.lit(1)).alias("second"))
    both = named.select(F.col("first").alias("name")).union(named.select("second"))
    ids = resolved(both, entities, aliases, "name").filter("id is not null").select("name", "id")
    out = named.join(ids.select(F.col("name").alias("first"), F.col("id").alias("primary_id")), "first", "left").join(ids.select(F.col("name").alias("second"), F.col("id").alias("pair_id")), "second", "left")
    one, other, pair = F.col("primary_id").isNotNull(), F.col("pair_id").isNotNull(), F.col("n") >= 2
    reason = (
        F.when(F.col("n") == 0, "no_subject_name").when(~pair & one, "single_subject_resolved").when(~pair, "single_subject_unresolved").when(one & other, "pair_subjects_resolved")
        .when(one, "pair_counterpart_unresolved").when(other, "pair_primary_unresolved").otherwise("pair_subjects_unresolved")
    )
    return out.select(*key, pair.alias("required"), (one & (other | ~pair)).alias("verified"), "primary_id", "pair_id", reason.alias("reason"))


def canonical_lookup(asked: DataFrame, entities: DataFrame, aliases: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """key, kind, binding, value of each question about a stored value.

    asked: key, subject, other, predicate, at. facts: id, predicate, value, valid_from, valid_until (null: still holds). A question with
    ``other`` asks for the set of values that both have had (joined by commas), one with ``at`` for the value that held then, any other one
    for the value that holds. A subject that several entities may be, or that is unknown, makes it an abstention.
    """
    names = resolved(asked.select(F.col("subject").alias("name")).union(asked.select("other")), entities, aliases, "name")
    one = names.select(F.col("name").alias("subject"), F.col("id").alias("a"), F.col("status").alias("binding"))
    two = names.select(F.col("name").alias("other"), F.col("id").alias("b"), F.col("status").alias("other binding"))
    bound = asked.join(one, "subject", "left").join(two, "other", "left")
    lost = F.col("a").isNull() | (F.col("other").isNotNull() & F.col("b").isNull())
    kind = F.when(lost, "abstention").when(F.col("other").isNotNull(), "set").when(F.col("at").isNotNull(), "temporal").otherwise("current")
    bound = bound.select(key, "a", "b", "predicate", "at", kind.alias("kind"), F.when(F.col("a").isNull() | F.col("other").isNull(), F.col("binding")).otherwise(F.col("other binding")).alias("binding"))
    rows = facts.select(F.col("id").alias("a"), "predicate", "value", "valid_from", "valid_until")
    holds = F.when(F.col("kind") == "current", F.col("valid_until").isNull()).otherwise((F.col("valid_from") <= F.col("at")) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("at"))))
    single = bound.filter("kind in ('current', 'temporal')").join(rows, ["a", "predicate"]).filter(holds)
    single = top_per_group(single, [key], [F.desc("valid_from"), F.asc("value")]).select(key, F.col("value").cast("string").alias("value"))
    had = rows.select("a", "predicate", "value").distinct()
    shared = bound.filter("kind = 'set'").join(had, ["a", "predicate"]).join(had.withColumnRenamed("a", "b"), ["b", "predicate", "value"])
    shared = shared.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("value"))
    return bound.join(single.union(shared), key, "left").select(key, "kind", "binding", "value")


def neighbourhood(units: DataFrame, seeds: DataFrame, query: str, key: str, links: list[str], order: list[Column], limit: int) -> DataFrame:
    """query and the ``limit`` best units that share one of ``links`` with a seed of the query, seeds left out.

    One equi-join a link, and distinct pairs of what they find.
    """
    own = seeds.select(query, key).join(units.select(key, *links), key)
    met = reduce(DataFrame.union, [own.select(query, link).filter(F.col(link).isNotNull()).distinct().join(units.select(key, link), link).select(query, key) for link in links]).distinct()
    others = met.join(seeds.select(query, key), [query, key], "left_anti")
    return top_per_group(others.join(units, key), [query], order, limit, "rank")


def focused_support(tiers: list[tuple[DataFrame, float]], key: str, text: str, at: str, terms: list[str], rules: list[tuple[str, float]], needs: str | None, limit: int) -> DataFrame:
    """key, tier, score of the rows that hold one of the terms (and match ``needs``): a tier's base, one for each term, and the rules' weights; the
    best row of a key, then the ``limit`` best, latest first among equals."""
    matched = lambda c: reduce(lambda x, y: x + y, [F.contains(F.lower(c), F.lit(t.lower())).cast("int") for t in terms])
    parts = []
    for n, (rows, base) in enumerate(tiers):
        hits = rows.select(key, F.col(at).alias("at"), F.col(text).alias("text"), matched(F.col(text)).alias("terms")).filter("terms > 0")
        hits = hits.filter(F.col("text").rlike(ascii_bounds(needs))) if needs else hits
        parts.append(hits.select(key, F.lit(n).alias("tier"), "at", F.round(F.col("terms") + weighted_rules(F.col("text"), rules, base), 6).alias("score")))
    best = top_per_group(reduce(DataFrame.union, parts), [key], [F.desc("score"), F.asc("tier")])
    return best.orderBy(F.desc("score"), F.desc("at"), F.asc(key)).limit(limit).select(key, "tier", "score")
