"""Texts and conversations to rows: scenes, fragments, sentences, units, segments, mentions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.scalar import ascii_bounds, collapse, sentences

# Cues and stop words that results must share.
METADATA_LINE = r"^(?i:Captured|Namespace intent|Source channel)\s*:"
SURPRISE_CUE = r"(?i)\b(?:actually|anyway|but|changed|decided|however|instead|later|meanwhile|suddenly|surprised|turns out|unexpectedly)\b"
NAME_STOP_WORDS = (
    "What", "When", "Where", "Why", "How", "Which", "Who",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
)
# Fixed values end.


def scenes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Blank-line paragraphs, white space collapsed, without headings and metadata paragraphs."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), r"^\s+|\s+$", "")
    parts = F.transform(F.split(clean, "\n{2,}"), collapse)
    is_metadata = lambda p: (F.length(p) == 0) | p.rlike(r"^#\s") | p.rlike(METADATA_LINE)
    kept = F.filter(parts, lambda p: ~is_metadata(p))
    return docs.select(key, F.posexplode(kept).alias("scene", "scene_text"))


def fragments(scene_rows: DataFrame, key: str, size: int = 3) -> DataFrame:
    """Groups of ``size`` sentences of a scene."""
    own = scene_rows.withColumn("s", sentences(F.col("scene_text"))).filter(F.size("s") > 0)
    groups = F.transform(F.sequence(F.lit(1), F.size("s"), F.lit(size)), lambda i: F.array_join(F.slice("s", i, size), " "))
    return own.select(key, "scene", F.posexplode(groups).alias("fragment", "fragment_text"))


def sentence_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(sentences(F.col(text))).alias("nth", "sentence"))


def cut_long(text: str, most: int = 1200, soft: float = 0.6) -> list[tuple[int, int]]:
    """Spans of at most ``most`` characters of a trimmed text, ended at the last blank beyond ``soft`` of them."""
    spans, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + most)
        if end < n:
            blank = text.rfind(" ", at, end + 1)
            if blank > at + int(most * soft):
                end = blank
        piece = text[at:end]
        lead = len(piece) - len(piece.lstrip())
        if piece.strip():
            spans.append((at + lead, at + len(piece.rstrip())))
            at = spans[-1][1]
            while at < n and text[at].isspace():
                at += 1
        else:
            at = end + 1
    return spans


def oversized_parts(docs: DataFrame, key: str, text: str = "text", most: int = 1200) -> DataFrame:
    """Parts of long texts with their character spans; a cursor decides each cut, so it runs in Arrow batches."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, s, e) for k, t in zip(pdf[key], pdf["t"], strict=True) for i, (s, e) in enumerate(cut_long(t, most))]
            yield pd.DataFrame(rows, columns=[key, "part", "char_start", "char_end"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.trim(F.coalesce(F.col(text), F.lit(""))).alias("t")).mapInPandas(cut, f"{key} {kind}, part int, char_start int, char_end int")


BLANKS = " \t\n\r\f\v"


def _spans(docs: DataFrame, key: str, text: str, name: str, cut) -> DataFrame:
    """A row for each span that ``cut`` finds in a text; a cursor decides each cut, so it runs in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, s, e) for k, t in zip(pdf[key], pdf["t"], strict=True) for i, (s, e) in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=[key, name, "char_start", "char_end"])

    kind = docs.schema[key].dataType.simpleString()
    clean = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return docs.select(key, clean.alias("t")).mapInPandas(run, f"{key} {kind}, {name} int, char_start int, char_end int")


def cut_budget(text: str, most: int, soft: float = 0.45) -> list[tuple[int, int]]:
    """Spans of at most ``most`` characters, ended at the last blank line, line or sentence end beyond ``soft`` of them."""
    spans, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + most)
        if end < n:
            # a mark may begin at the limit itself
            mark = max(text.rfind(m, at, end + len(m)) for m in ("\n\n", "\n", ". "))
            if mark > at + int(most * soft):
                end = mark + (text[mark] == ".")
        piece = text[at:end]
        if piece.strip(BLANKS):
            spans.append((end - len(piece.lstrip(BLANKS)), at + len(piece.rstrip(BLANKS))))
        at = max(end, at + 1)
    return spans or [(0, 0)]


def budget_parts(docs: DataFrame, key: str, text: str = "text", most: int = 4200) -> DataFrame:
    """Parts of texts within a character budget, with their spans (see ``cut_budget``); a text without any has (0, 0)."""
    return _spans(docs, key, text, "part", lambda t: cut_budget(t, most))


def cut_lines(text: str, most: int = 3000) -> list[tuple[int, int]]:
    """Spans of whole lines, closed before they pass ``most`` characters with their line ends; the last only if not blank."""
    spans, start, at = [], 0, 0
    for line in text.split("\n"):
        end = at + len(line) + 1
        if at > start and end - start > most:
            spans.append((start, at))
            start = at
        at = end
    if text[start:].strip(BLANKS):
        spans.append((start, len(text)))
    return spans or [(0, 0)]


def line_records(docs: DataFrame, key: str, text: str = "text", most: int = 3000) -> DataFrame:
    """Records of whole lines with their spans (see ``cut_lines``)."""
    return _spans(docs, key, text, "record", lambda t: cut_lines(t, most))


def calendar_lines(text: Column) -> Column:
    """A calendar export as an array of sentences, one for each event that says what it is."""

    def line(event: Column) -> Column:
        field = lambda name: F.nullif(F.trim(F.regexp_extract(event, rf"(?im)^{name}(?:;[^:\n]*)?:([^\r\n]+)", 1)), F.lit(""))
        start = F.regexp_replace(field("DTSTART"), r"^(\d{4})(\d{2})(\d{2}).*$", "$1-$2-$3")
        said = F.format_string("Calendar event: %s on %s.", F.coalesce(field("SUMMARY"), F.lit("Untitled event")), F.coalesce(start, F.lit("an unknown date")))
        more = [F.concat(F.lit(f"{label}: "), field(name), F.lit(".")) for label, name in (("Details", "DESCRIPTION"), ("Location", "LOCATION"))]
        return F.when(field("SUMMARY").isNotNull() | field("DESCRIPTION").isNotNull(), F.concat_ws(" ", said, *more))

    events = F.split(text, "(?i)BEGIN:VEVENT")
    return F.array_compact(F.transform(F.slice(events, 2, F.greatest(F.lit(0), F.size(events) - 1)), line))


def task_sentences(text: Column) -> Column:
    """A task list export (JSON) as an array of sentences, one for each task with a title."""
    tasks = F.from_json(text, "tasks array<struct<title string, status string, project string, due string>>").tasks
    tasks = F.filter(F.coalesce(tasks, F.array()), lambda t: F.length(F.trim(t.title)) > 0)

    def line(t: Column) -> Column:
        status = F.coalesce(F.trim(t.status), F.lit("open"))
        done = F.when(status.rlike("(?i)^(?:done|completed|closed)$"), "I completed").otherwise("I need to")
        more = [F.when(F.length(F.trim(t[name])) > 0, F.concat(F.lit(f"{name.capitalize()}: "), F.trim(t[name]), F.lit("."))) for name in ("project", "due")]
        return F.concat_ws(" ", F.concat(done, F.lit(" "), F.trim(t.title), F.lit(".")), F.concat(F.lit("Status: "), status, F.lit(".")), *more)

    return F.transform(tasks, line)


def pack_sentences(docs: DataFrame, key: str, text: str = "text", most: int = 1800, enough: float = 0.72) -> DataFrame:
    """Greedy units of consecutive sentences: closed at ``enough`` of ``most`` characters or before passing it."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, own in zip(pdf[key], pdf["s"], strict=True):
                unit, first, size = 0, 0, 0
                for i, length in enumerate(own):
                    grown = size + (1 if size else 0) + length
                    if size and grown > most:
                        rows.append((k, unit, first, i - 1, size))
                        unit, first, grown = unit + 1, i, length
                    size = grown
                    if size >= most * enough:
                        rows.append((k, unit, first, i, size))
                        unit, first, size = unit + 1, i + 1, 0
                if size:
                    rows.append((k, unit, first, len(own) - 1, size))
            yield pd.DataFrame(rows, columns=[key, "unit", "first_sentence", "last_sentence", "n_chars"])

    kind = docs.schema[key].dataType.simpleString()
    lengths = docs.select(key, F.transform(sentences(F.coalesce(F.col(text), F.lit(""))), lambda s: F.length(s)).alias("s"))
    return lengths.mapInPandas(pack, f"{key} {kind}, unit int, first_sentence int, last_sentence int, n_chars int")


def extraction_units(docs: DataFrame, key: str, text: str = "text", most: int = 1800, enough: float = 0.72, overlap: int = 1) -> DataFrame:
    """key, unit, first_sentence, last_sentence, n_chars, status and content: consecutive sentences up to ``enough`` of ``most`` characters, or
    before passing it; the next unit begins ``overlap`` sentences before the end. A longer sentence is a unit to be looked at."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, own in zip(pdf[key], pdf["s"], strict=True):
                first, unit = 0, 0
                while first < len(own):
                    size, end = len(own[first]), first + 1
                    while size < int(most * enough) and end < len(own) and size + 1 + len(own[end]) <= most:
                        size, end = size + 1 + len(own[end]), end + 1
                    rows.append((k, unit, first, end - 1, size, "needs_split_review" if size > most else "ready", " ".join(own[first:end])))
                    first, unit = max(end - overlap, first + 1), unit + 1
            yield pd.DataFrame(rows, columns=[key, "unit", "first_sentence", "last_sentence", "n_chars", "status", "content"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, sentences(F.coalesce(F.col(text), F.lit(""))).alias("s")).mapInPandas(pack, f"{key} {kind}, unit int, first_sentence int, last_sentence int, n_chars int, status string, content string")


def conversation_units(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", size: int = 4, stride: int = 2) -> DataFrame:
    """Windows of ``size`` turns every ``stride``, with at least three turns and two speakers."""
    listed = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(speaker).alias("s")))).alias("all")).filter(F.size("all") >= 3)
    windows = listed.select(conv, F.explode(F.sequence(F.lit(0), F.size("all") - 1, F.lit(stride))).alias("at"), "all").withColumn("w", F.slice("all", F.col("at") + 1, size))
    speakers = F.array_sort(F.array_distinct(F.col("w.s")))
    kept = windows.filter((F.size("w") >= 3) & (F.size(speakers) >= 2))
    nth = F.row_number().over(Window.partitionBy(conv).orderBy("at")) - 1
    return kept.select(conv, nth.alias("unit"), F.array_min("w.t").alias("first_turn"), F.array_max("w.t").alias("last_turn"), F.size("w").alias("n_turns"), F.array_join(speakers, ",").alias("speakers"))


def answered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """One row a turn; with the turn before as prompt if another speaker ended it on a question."""
    own = Window.partitionBy(conv).orderBy(turn)
    asked = (F.lag(speaker).over(own) != F.col(speaker)) & F.lag(text).over(own).rlike(r"\?\s*$")
    marked = turns.withColumns({"asked": F.coalesce(asked, F.lit(False)), "before_turn": F.lag(turn).over(own), "before_speaker": F.lag(speaker).over(own)})
    return marked.select(conv, turn, F.when(F.col("asked"), F.col("before_turn")).otherwise(F.col(turn)).alias("span_start"), F.when(F.col("asked"), F.col("before_speaker")).alias("prompt_speaker"))


def topic_terms(text: Column, least: int = 4) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9'-]{2,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= least))


def topic_segments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Segments of turns: a new one starts, after two turns, at a turn that shares no term with the segment so far or
    that has a surprise cue; segments of one turn are dropped.

    The terms gathered so far are state carried from turn to turn, so each conversation is walked in order.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        rows: list[list] = []
        current: list[int] = []
        terms: set[str] = set()
        speakers: set[str] = set()

        def close() -> None:
            if len(current) >= 2:
                rows.append([pdf["conv"].iloc[0], len(rows), current[0], current[-1], len(current), ",".join(sorted(speakers)), len(terms)])

        for at, who, own, cue in zip(pdf["turn"], pdf["speaker"], pdf["terms"], pdf["cue"], strict=True):
            new = set(own)
            if len(current) >= 2 and ((terms and new and not terms & new) or cue):
                close()
                current, terms, speakers = [], set(), set()
            current.append(at)
            terms |= new
            speakers.add(who)
        close()
        return pd.DataFrame(rows, columns=["conv", "segment", "first_turn", "last_turn", "n_turns", "speakers", "n_terms"])

    ready = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(speaker).alias("speaker"), topic_terms(F.col(text)).alias("terms"), F.col(text).rlike(ascii_bounds(SURPRISE_CUE)).alias("cue"))
    out = "conv long, segment int, first_turn long, last_turn long, n_turns int, speakers string, n_terms int"
    return ready.groupBy("conv").applyInPandas(walk, out).withColumnRenamed("conv", conv)


def capitalized_names(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(ascii_bounds(r"(\b[A-Z][a-z]+\b)")), F.lit(1))
    kept = F.array_except(F.array_distinct(found), F.array(*map(F.lit, NAME_STOP_WORDS)))
    return F.array_distinct(F.transform(kept, F.lower))


def source_kind(uri: Column) -> Column:
    """Routing by the first rule that fits."""
    lower = F.lower(uri)
    return (
        F.when(lower.rlike(r"\.(?:png|jpe?g|gif|webp)(?:$|\?)"), "image").when(lower.rlike(r"\.(?:mp3|wav|m4a)(?:$|\?)"), "audio").when(lower.rlike(r"\.pdf(?:$|\?)"), "pdf")
        .when(lower.rlike(r"\.(?:md|markdown)(?:$|\?)"), "markdown").when(lower.rlike(r"^https?://"), "web").otherwise("text")
    )
