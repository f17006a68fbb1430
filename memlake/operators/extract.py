"""Rules over text: turns, sections, dates, mentions, statements, answerable units, transcripts, session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.scalar import ascii_bounds, sentences

MONTH_NAMES = "january|february|march|april|may|june|july|august|september|october|november|december"
#: Statement families: a name, and a pattern with what is stated as its first group.
STATEMENTS = {
    "preference": r"(?i)\bI (?:really )?(?:prefer|like|love|hate) ([^.!?\n]+)",
    "goal": r"(?i)\bI (?:want|plan|hope|intend) to ([^.!?\n]+)",
    "skill": r"(?i)\bI (?:can|know how to) ([^.!?\n]+)",
    "belief": r"(?i)\bI (?:think|believe) (?:that )?([^.!?\n]+)",
}
#: Cue phrases before a name, by the kind of what is named.
MENTIONS = {
    "person": r"\b(?:with|met|by|from) ([A-Z][a-z]+)\b",
    "place": r"\b(?:in|at|to) ([A-Z][a-z]+)\b",
    "project": r"\b(?:project|repo|on) ([A-Z][A-Za-z0-9]+)\b",
}
EDGE_RULES = {"person": ("with", 0.82), "place": ("visited", 0.74), "project": ("works_on", 0.65)}


def speaker_turns(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``Speaker: text`` lines of a document as numbered turns."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^[A-Z][A-Za-z .'-]{0,40}:\s+\S"))
    rows = docs.select(key, F.posexplode(lines).alias("turn", "line"))
    return rows.select(key, "turn", F.regexp_extract("line", r"^([^:]+):", 1).alias("speaker"), F.trim(F.regexp_replace("line", r"^[^:]+:\s+", "")).alias("text"))


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Heading-delimited parts of a Markdown text, front matter dropped; text before a heading has none."""
    body = F.regexp_replace(F.col(text), r"^---\n[\s\S]*?\n---\n", "")
    parts = F.filter(F.split(body, r"(?m)^(?=#{1,6} )"), lambda p: F.length(F.trim(p)) > 0)
    rows = docs.select(key, F.posexplode(parts).alias("section", "part"))
    heading = F.regexp_extract("part", r"^#{1,6} ([^\n]*)", 1)
    return rows.select(key, "section", F.nullif(F.trim(heading), F.lit("")).alias("heading"), F.length(F.regexp_extract("part", "^#{0,6}", 0)).alias("level"), F.trim(F.regexp_replace("part", r"^#{1,6} [^\n]*\n?", "")).alias("body"))


def dates_in(text: Column) -> Column:
    """Array of the ISO dates and month-day-year dates of a text; what is no day is dropped."""
    iso = F.regexp_extract_all(text, F.lit(ascii_bounds(r"\b((?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})\b")), F.lit(1))
    named = F.regexp_extract_all(F.lower(text), F.lit(ascii_bounds(rf"\b((?:{MONTH_NAMES}) [0-9]{{1,2}},? (?:19|20)[0-9]{{2}})\b")), F.lit(1))
    iso_day = F.transform(iso, lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date"))
    named_day = F.transform(named, lambda x: F.try_to_timestamp(F.initcap(F.regexp_replace(x, ",", "")), F.lit("MMMM d yyyy")).cast("date"))
    return F.array_distinct(F.array_compact(F.concat(iso_day, named_day)))


def explicit_dates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each date that a text names (see ``dates_in``)."""
    return docs.select(key, F.explode(dates_in(F.col(text))).alias("day"))


def statements(docs: DataFrame, key: str, text: str = "text", families: dict[str, str] = STATEMENTS) -> DataFrame:
    """(key, family, statement) of every match of the statement families."""
    found = F.array(*[F.struct(F.lit(name).alias("family"), F.regexp_extract_all(text, F.lit(ascii_bounds(p)), F.lit(1)).alias("all")) for name, p in families.items()])
    return docs.select(key, F.explode(found).alias("f")).select(key, "f.family", F.explode("f.all").alias("statement")).withColumn("statement", F.trim("statement")).distinct()


def mentions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Distinct (key, kind, name) by cue phrases."""
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(text, F.lit(ascii_bounds(p)), F.lit(1)).alias("names")) for kind, p in MENTIONS.items()])
    return docs.select(key, F.explode(found).alias("m")).select(key, "m.kind", F.explode("m.names").alias("name")).distinct()


def rule_edges(subjects: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Edges of each document's subject to what it mentions, with the predicate and confidence of the mention's kind."""
    rules = F.create_map(*[x for kind, (p, w) in EDGE_RULES.items() for x in (F.lit(kind), F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")))])
    joined = subjects.join(found, key).withColumn("rule", rules[F.col("kind")]).filter(F.col("subject") != F.col("name"))
    return joined.groupBy("subject", F.col("rule.p").alias("predicate"), F.col("name").alias("object")).agg(F.max("rule.w").alias("confidence"), F.countDistinct(key).alias("n_documents"))


def ownership(speaker: Column, n_mentioned: Column) -> Column:
    """Confidence that a sentence belongs to its speaker, or else to who is mentioned."""
    return F.when(speaker.isNotNull(), F.when(n_mentioned > 1, 0.82).otherwise(0.95)).when(n_mentioned == 1, 0.72).when(n_mentioned > 1, 0.35).otherwise(0.2)


def answerable_units(turns: DataFrame, conv: str, turn: str, speaker: str, text: str) -> DataFrame:
    """Turn and sentence units with their ownership; a turn of one sentence gives the turn alone."""
    named = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(ascii_bounds(r"(\b[A-Z][a-z]+\b)")), F.lit(1))))
    own = turns.select(conv, turn, F.col(speaker).alias("speaker"), F.col(text).alias("content"), sentences(F.col(text)).alias("s"))
    whole = own.select(conv, turn, F.lit("turn").alias("kind"), F.lit(0).alias("nth"), "speaker", "content")
    parts = own.filter(F.size("s") > 1).select(conv, turn, F.lit("sentence").alias("kind"), F.posexplode("s").alias("nth", "content"), "speaker").select(*whole.columns)
    units = whole.unionByName(parts)
    return units.withColumn("ownership", ownership(F.col("speaker"), F.size(F.array_distinct(F.regexp_extract_all("content", F.lit(ascii_bounds(r"(\b[A-Z][a-z]+\b)")), F.lit(1))))))


def overlap_units(docs: DataFrame, key: str, text: str = "text", size: int = 4) -> DataFrame:
    """Units of ``size`` sentences, each beginning with the last sentence of the one before."""
    own = docs.select(key, sentences(F.col(text)).alias("s")).filter(F.size("s") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("s") - 1), F.lit(size - 1))
    return own.select(key, F.posexplode(F.transform(starts, lambda i: F.slice("s", i, size))).alias("unit", "part")).select(key, "unit", F.size("part").alias("n_sentences"), F.array_join("part", " ").alias("content"))


def utterances(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Utterances of transcript JSON: segments as they are, or words of one speaker in a row."""
    schema = "struct<segments: array<struct<start: double, end: double, text: string, speaker: string>>, words: array<struct<word: string, start: double, end: double, speaker: string>>>"
    parsed = rows.select(key, F.from_json(payload, schema).alias("p"))
    segments = parsed.filter("p.segments is not null").select(key, F.posexplode("p.segments").alias("nth", "s")).select(key, "nth", "s.speaker", "s.text", (F.col("s.start") * 1000).cast("long").alias("start_ms"), (F.col("s.end") * 1000).cast("long").alias("end_ms"))
    words = parsed.filter("p.segments is null and p.words is not null").select(key, F.posexplode("p.words").alias("at", "w"))
    own = Window.partitionBy(key).orderBy("at")
    runs = words.withColumn("new", (~F.col("w.speaker").eqNullSafe(F.lag("w.speaker").over(own))).cast("int")).withColumn("run", F.sum("new").over(own))
    joined = runs.groupBy(key, "run").agg(F.first("w.speaker").alias("speaker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "w.word"))), lambda x: x.word), " ").alias("text"), (F.min("w.start") * 1000).cast("long").alias("start_ms"), (F.max("w.end") * 1000).cast("long").alias("end_ms"))
    return segments.unionByName(joined.withColumn("nth", (F.col("run") - 1).cast("int")).drop("run"))


def session_events(lines: DataFrame, session: str, line: str) -> DataFrame:
    """Events of a JSON-lines session log, in order, with a category of their type."""
    kind = F.coalesce(F.get_json_object(line, "$.type"), F.lit("unknown"))
    category = F.when(kind.rlike("(?i)user"), "user_message").when(kind.rlike("(?i)assistant"), "assistant_message").when(kind.rlike("(?i)(?:exec|shell|command)"), "shell_command").when(kind.rlike("(?i)(?:edit|patch)"), "file_edit").otherwise("unknown")
    return lines.select(session, F.get_json_object(line, "$.index").cast("int").alias("event_index"), kind.alias("event_type"), category.alias("category"), F.get_json_object(line, "$.role").alias("role"), F.get_json_object(line, "$.text").alias("text"), F.get_json_object(line, "$").isNull().alias("broken"))
