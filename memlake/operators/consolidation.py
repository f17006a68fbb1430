"""Candidates to memories: eight families of statements, taken oldest first, each meeting what was accepted before it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.scalar import ascii_bounds
from memlake.operators.relational import numbered_changes


@dataclass(frozen=True)
class Family:
    """How a family's statements are read: a pattern, the groups that name what is stated and how, and whether a subject
    holds one statement of the family at a time."""

    pattern: str
    about: int = 1
    how: int = 0
    single: bool = False


FAMILIES = {
    "preference": Family(r"(?i)\bI (no longer like|don't like|dislike|hate|really like|like|love|prefer) ([^.!?;\n]+)", 2, 1),
    "skill": Family(r"(?i)\bI (?:can|know how to) ([^.!?;\n]+)"),
    "decision": Family(r"(?i)\b(?:I|we) decided (?:to|on) ([^.!?;\n]+) for ([^.!?;\n]+)", 2, 1),
    "constraint": Family(r"(?i)\b(always|never) ([^.!?;\n]+)", 2, 1),
    "style": Family(r"(?i)\bwrite (?:in|with) ([^.!?;\n]+)", 1, 0),
    "goal": Family(r"(?i)\bmy (?:current |main )?goal is to ([^.!?;\n]+)", 0, 1, True),
    "plan": Family(r"(?i)\bI plan to ([^.!?;\n]+)", 0, 1, True),
    "belief": Family(r"(?i)\bI (?:think|believe) (?:that )?([A-Za-z0-9 ]+?) is ([^.!?;\n]+)", 1, 2),
}
#: Ways of saying that something is not liked.
DISLIKES = ("no longer like", "don't like", "dislike", "hate")


def plain(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def candidate_statements(candidates: DataFrame, family: str, content: str) -> DataFrame:
    """``candidates`` with a row for each statement that their family's pattern finds: nth, key, value. Candidates without one are left out."""
    per_family = []
    for name, f in FAMILIES.items():
        pattern = F.lit(ascii_bounds(f.pattern))
        group = lambda g, p=pattern: F.regexp_extract_all(content, p, F.lit(g))
        about = F.transform(group(f.about), plain) if f.about else F.transform(group(f.how), lambda _: F.lit("current"))
        how = F.transform(group(f.how), plain) if f.how else F.transform(group(f.about), lambda _: F.lit("stated"))
        if name == "preference":
            how = F.transform(how, lambda x: F.when(x.isin(*DISLIKES), "dislike").otherwise("like"))
        # arrays are null for candidates of other families, which explode drops
        per_family.append((F.col(family) == name, F.arrays_zip(about.alias("about"), how.alias("how"))))
    found = F.when(per_family[0][0], per_family[0][1])
    for condition, value in per_family[1:]:
        found = found.when(condition, value)
    rows = candidates.select("*", F.posexplode(found).alias("nth", "said"))
    return rows.withColumns({"key": F.concat(F.col(family), F.lit(":"), F.col("said.about")), "value": F.col("said.how")}).drop("said")


def consolidated(candidates: DataFrame, subject: str, key: str, family: str, content: str, at: str) -> DataFrame:
    """Every statement of every candidate, oldest first, with what became of it.

    decision: ADD (nothing active under its key), UPDATE (the active memory says the same and is confirmed) or SUPERSEDE (it says
    otherwise and is closed). ``version`` numbers the memories of a subject and key; a row that adds one carries its validity.
    What is active when a statement comes is what the last one before it left, so the cascade is one look at the row before.
    """
    said = candidate_statements(candidates.select(subject, key, family, content, at), family, content).drop(content)
    rows = numbered_changes(said, [subject, "key"], [at, key, "nth"], "value")
    decision = F.when(~F.col("is_change"), "UPDATE").when(F.col("version") == 1, "ADD").otherwise("SUPERSEDE")
    return rows.withColumn("decision", decision).drop("is_change")


def memories(decisions: DataFrame, subject: str, at: str) -> DataFrame:
    """The memories that the decisions leave: value, validity, how often confirmed, and whether still active."""
    own = Window.partitionBy(subject, "key").orderBy("version")
    one = decisions.groupBy(subject, "key", "version").agg(F.min(at).alias("valid_from"), F.first("value").alias("value"), (F.count(F.lit(1)) - 1).alias("confirmed"), F.max(at).alias("last_confirmed_at"))
    until = F.lead("valid_from").over(own)
    return one.withColumn("valid_until", until).withColumn("status", F.when(until.isNull(), "active").otherwise("superseded"))


def candidate_outcomes(candidates: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """status of each candidate (accepted, or rejected where no statement could be read) and how many memories it promoted and superseded."""
    added = F.count_if(F.col("decision") != "UPDATE").alias("promoted")
    found = decisions.groupBy(key).agg(added, F.count_if(F.col("decision") == "SUPERSEDE").alias("superseded"), F.count(F.lit(1)).alias("n_statements"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return candidates.select(key).join(found, key, "left").select(key, F.when(F.col("n_statements") > 0, "accepted").otherwise("rejected").alias("status"), zero("n_statements"), zero("promoted"), zero("superseded"))
