"""Spans of texts found by one automaton of all cue phrases: typed lanes, and answerable spans with offsets.

The automaton is built once and broadcast; a text is read once however many phrases there are. Offsets count code
points, and ``substring(text, starts + 1, ends - starts)`` is the span.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cue phrases by lane, with what is said of the object that follows; {who} cues name a person first.
LANES: dict[str, dict[str, str]] = {
    "media": {"watched": "watched", "watching": "watched", "listened to": "heard", "listening to": "heard", "finished reading": "read", "started reading": "reading", "playing the game": "played"},
    "preference": {"i like": "likes", "i love": "likes", "i prefer": "prefers", "i dislike": "dislikes", "i hate": "dislikes", "i don't like": "dislikes", "i no longer like": "dislikes"},
    "person_time": {"met with": "met", "had lunch with": "met", "had dinner with": "met", "called": "called", "visited": "visited", "travelled with": "travelled_with"},
}
#: Cues of clauses that state a fact or tell an event, and how sure a span of each kind is.
CLAUSES: dict[str, tuple[str, ...]] = {
    "event": ("visited", "went to", "moved to", "joined", "started working", "met with", "travelled to", "graduated from", "got married"),
    "fact": ("works as", "works at", "lives in", "was born", "is called", "belongs to", "is married to", "is allergic to", "costs"),
}
SURE = {"date": 0.78, "event": 0.76, "fact": 0.74}
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
#: Ways to write a time, each of which may lie inside another.
DATES = tuple(
    re.compile(rf"(?<![A-Za-z0-9])(?:{p})(?![A-Za-z0-9])")
    for p in (r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}", rf"[0-9]{{1,2}} {_MONTH} (?:19|20)[0-9]{{2}}", rf"{_MONTH} [0-9]{{1,2}}, (?:19|20)[0-9]{{2}}", rf"{_MONTH} (?:19|20)[0-9]{{2}}", r"(?:19|20)[0-9]{2}", r"(?i:yesterday|today|tomorrow|last (?:week|month|year))")
)
_LOWER = {c: c + 32 for c in range(65, 91)}
_END = re.compile(r"[.!?;,\n]")
_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|\n|$)")
_WHO = re.compile(r"([A-Z][A-Za-z'-]*(?: [A-Z][A-Za-z'-]*)*) $")


def automaton(phrases: dict[str, tuple]) -> ahocorasick.Automaton:
    """Of phrases in lower case, with what each stands for."""
    out = ahocorasick.Automaton()
    for phrase, meaning in phrases.items():
        out.add_word(phrase, (phrase, meaning))
    out.make_automaton()
    return out


def cues(found: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, meaning) of every phrase that stands alone in the text, whatever the case of A-Z."""
    if not len(found):
        return
    for last, (phrase, meaning) in found.iter(text.translate(_LOWER)):
        start, end = last + 1 - len(phrase), last + 1
        if not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
            yield start, end, meaning


def scheduled(spans: list[tuple]) -> list[tuple]:
    """Of spans (start, end, weight, ...) those that do not overlap and weigh most together; of equal choices the one that
    ends first. By the usual recurrence over ends, so n log n."""
    spans = sorted(spans, key=lambda s: (s[1], s[0], *map(str, s[3:])))
    ends, best = [s[1] for s in spans], [0.0]
    before = [bisect_right(ends, s[0], 0, i) for i, s in enumerate(spans)]
    for i, s in enumerate(spans):
        best.append(max(best[-1], best[before[i]] + s[2]))
    out, i = [], len(spans)
    while i:
        if best[i] > best[i - 1]:
            out.append(spans[i - 1])
            i = before[i - 1]
        else:
            i -= 1
    return out[::-1]


def dates(text: str) -> list[tuple[int, int]]:
    """Times that do not overlap: of ways to read the same place the longest."""
    return [s[:2] for s in scheduled([(m.start(), m.end(), float(m.end() - m.start()) ** 2) for p in DATES for m in p.finditer(text)])]


def clause(text: str, start: int, end: int) -> tuple[int, int]:
    """The part between signs around a place, without blanks at its ends."""
    left = max((m.end() for m in _END.finditer(text, max(0, start - 2000), start)), default=max(0, start - 2000))
    stop = _END.search(text, end)
    right = stop.start() if stop else len(text)
    while left < right and text[left].isspace():
        left += 1
    while right > left and text[right - 1].isspace():
        right -= 1
    return left, right


def _spanned(rows: DataFrame, keys: list[str], text: str, columns: str, find: Callable[[str], list[tuple]], schema: pa.Schema) -> DataFrame:
    kinds = dict(rows.select(*keys).dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, value in enumerate(batch.column("spanned text").to_pylist()):
                for row in find(value):
                    at.append(i)
                    found.append(row)
            taken = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
            values = zip(*found, strict=True) if found else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([*taken, *[pa.array(v, f.type) for v, f in zip(values, schema, strict=True)]], [*keys, *schema.names])

    ddl = ", ".join([*[f"{k} {kinds[k]}" for k in keys], columns])
    return rows.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("spanned text")).mapInArrow(work, ddl)


def typed_lanes(rows: DataFrame, keys: list[str], text: str, lanes: dict[str, dict[str, str]] = LANES) -> DataFrame:
    """keys, lane, predicate, subject, object, time_hint, starts, ends of what the lanes' cues introduce.

    The object runs from the cue to the next sign, without a time at its end; subject is the capitalised name before the cue (null:
    the speaker). Cues inside others' objects count too. A null text has no rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(automaton({cue: (lane, predicate) for lane, own in lanes.items() for cue, predicate in own.items()}))

    def find(value: str) -> list[tuple]:
        out, times = [], None
        for start, end, (lane, predicate) in cues(shared.value, value):
            times = dates(value) if times is None else times
            stop = _END.search(value, end)
            stop = stop.start() if stop else len(value)
            # a time that begins in the object, or whose comma ends it, is the hint
            hint = next(((a, b) for a, b in times if end <= a < stop), None)
            said = value[end : hint[0] if hint else stop]
            said = re.sub(r"\s+(?:on|in|at|since|until)?\s*$", "", said).strip()
            if said:
                who = _WHO.search(value[max(0, start - 80) : start])
                out.append((lane, predicate, who[1] if who and who[1] not in ("I", "We") else None, said, value[slice(*hint)] if hint else None, start, max(end + value[end:].find(said) + len(said), hint[1] if hint else 0)))
        return sorted(out, key=lambda r: (r[5], r[0]))

    fields = [("lane", pa.string()), ("predicate", pa.string()), ("subject", pa.string()), ("object", pa.string()), ("time_hint", pa.string()), ("starts", pa.int32()), ("ends", pa.int32())]
    return _spanned(rows, keys, text, "lane string, predicate string, subject string, object string, time_hint string, starts int, ends int", find, pa.schema(fields))


def answerable_spans(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, kind (turn, sentence, date, event, fact), starts, ends, sure of the spans that can answer a question.

    Fact and event clauses that overlap compete by length and sureness; readings of one date by length. A null or empty text
    has no spans.
    """
    shared = rows.sparkSession.sparkContext.broadcast(automaton({cue: (kind,) for kind, own in reversed(CLAUSES.items()) for cue in own}))

    def find(value: str) -> list[tuple]:
        if not value:
            return []
        out = [("turn", 0, len(value), 1.0)]
        for m in _SENTENCE.finditer(value):
            start, end = m.span()
            while start < end and value[start].isspace():
                start += 1
            while end > start and value[end - 1].isspace():
                end -= 1
            if end > start:
                out.append(("sentence", start, end, 0.7))
        out += [("date", a, b, SURE["date"]) for a, b in dates(value)]
        clauses = {(*clause(value, a, b), kind) for a, b, (kind,) in cues(shared.value, value)}
        out += [(kind, a, b, SURE[kind]) for a, b, _, kind in scheduled([(a, b, (b - a) * SURE[kind], kind) for a, b, kind in clauses])]
        return out

    return _spanned(rows, keys, text, "kind string, starts int, ends int, sure double", find, pa.schema([("kind", pa.string()), ("starts", pa.int32()), ("ends", pa.int32()), ("sure", pa.float64())]))
