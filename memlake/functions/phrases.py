"""What a time phrase means: its class, the days it covers, and the questions it can answer. Column functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# Counts in words; "few" is three.
COUNTS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "couple": 2, "few": 3}
#: Days of the end of a month.
END_DAYS = 7

_MONTH = rf"({'|'.join(MONTHS)})"
_AMOUNT = rf"\b(\d+|{'|'.join(COUNTS)})\s+(minute|hour|day|week|month|year)s?\b"
_CLOCK = r"\b([1-9]|1[0-2])(?::([0-5]\d))?\s*(am|pm)\b"
_YEAR = r"((?:19|20)\d{2})"

Days = Callable[[Column, Column], tuple[Column, Column]]


def _part(phrase: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(phrase, pattern, group)


def _looked_up(word: Column, values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), word)


def _count(phrase: Column) -> Column:
    word = _part(phrase, _AMOUNT, 1)
    return F.coalesce(F.try_to_number(word, F.lit("999999999")).cast("int"), _looked_up(word, COUNTS))


def _month_number(phrase: Column, pattern: str) -> Column:
    return _looked_up(_part(phrase, pattern, 1), {m: i for i, m in enumerate(MONTHS, 1)})


def _one(day: Column) -> tuple[Column, Column]:
    return day, day


def _whole_month(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "month"), F.last_day(day)


def _made(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")


def _iso_day(p: Column, on: Column):
    return _one(F.try_to_date(_part(p, _ISO, 0), "yyyy-MM-dd"))


def _named_month(p: Column, on: Column):
    return _whole_month(_made(_part(p, _MONTH_YEAR, 2), _month_number(p, _MONTH_YEAR), F.lit(1)))


def _named_day(p: Column, on: Column):
    return _one(_made(F.year(on), _month_number(p, _MONTH_DAY), _part(p, _MONTH_DAY, 2)))


def _near_day(p: Column, on: Column):
    return _one(F.when(p.rlike(r"\byesterday\b"), F.date_sub(on, 1)).otherwise(on))


def _month_end(p: Column, on: Column):
    last = F.last_day(_made(F.year(on), _month_number(p, _END_OF), F.lit(1)))
    return F.date_sub(last, END_DAYS - 1), last


def _last_month(p: Column, on: Column):
    return _whole_month(F.add_months(on, -1))


def _ago(p: Column, on: Column):
    n, unit = _count(p), _part(p, _AMOUNT, 2)
    days = F.when(unit == "day", n).when(unit == "week", 7 * n).otherwise(0)
    months = F.when(unit == "month", n).when(unit == "year", 12 * n).otherwise(0)
    return _one(F.date_sub(F.add_months(on, -months), days))


_ISO = r"\b((?:19|20)\d{2})-(\d{2})-(\d{2})\b"
_MONTH_YEAR = rf"\b{_MONTH}\s+{_YEAR}\b"
_MONTH_DAY = rf"\b{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?\b"
_END_OF = rf"\bend of {_MONTH}\b"


@dataclass(frozen=True)
class Rule:
    """One class of phrases: pattern, class, what anchors it, precision, shapes of questions, days (from the capture's day)."""

    pattern: str
    kind: str
    anchor: str
    precision: str
    shapes: tuple[str, ...] = ()
    days: Days | None = None

    @property
    def needs_capture(self) -> bool:
        return self.anchor == "source_captured_at"


#: In the order in which they are tried.
RULES = (
    Rule(_ISO, "exact_date", "explicit", "day", ("when",), _iso_day),
    Rule(_MONTH_YEAR, "month_year", "explicit", "month", ("when", "date_range"), _named_month),
    Rule(_END_OF, "date_range", "source_captured_at", "range", ("when", "date_range"), _month_end),
    Rule(_MONTH_DAY, "exact_date", "source_captured_at", "day", ("when",), _named_day),
    Rule(r"\b(?:today|yesterday)\b", "exact_date", "source_captured_at", "day", ("when",), _near_day),
    Rule(r"\blast month\b", "date_range", "source_captured_at", "month", ("when", "date_range"), _last_month),
    Rule(r"\b(?:couple|few)\s+\w+\s+ago\b", "recency", "source_captured_at", "coarse", ("when", "recency"), _ago),
    Rule(rf"{_AMOUNT}\s+ago\b", "recency", "source_captured_at", "day", ("when", "recency"), _ago),
    Rule(_AMOUNT, "duration", "none", "duration", ("duration",)),
    Rule(rf"\b(?:around|about)\s+{_CLOCK[2:]}", "routine_time", "clock", "coarse", ("routine_time",)),
    Rule(_CLOCK, "routine_time", "clock", "exact", ("routine_time",)),
    Rule(r"\b(?:morning|afternoon|evening|night)\b|\bevery\s+(?:day|week)\b", "routine_time", "repeating", "routine", ("routine_time",)),
    Rule(r"\b(?:after|before)\s+", "event_relative", "known_event", "relative_order", ("relative_order",)),
    Rule(r"\b(?:recently|sometime|around then|when i was younger|last (?:spring|summer|fall|winter))\b", "vague_time", "none", "coarse"),
)
UNKNOWN = Rule("", "unknown", "none", "unknown")


def amount_iso(phrase: Column) -> Column:
    """A duration in ISO form, such as PT5H or P2W."""
    unit = _part(phrase, _AMOUNT, 2)
    timed = unit.isin("minute", "hour")
    return F.concat(F.when(timed, "PT").otherwise("P"), _count(phrase).cast("string"), F.upper(F.substring(unit, 1, 1)))


def clock_time(phrase: Column) -> Column:
    hour = _part(phrase, _CLOCK, 1).cast("int") % 12 + F.when(_part(phrase, _CLOCK, 3) == "pm", 12).otherwise(0)
    minute = _part(phrase, _CLOCK, 2)
    return F.format_string("%02d:%s", hour, F.when(minute == "", "00").otherwise(minute))


def time_meaning(phrase: Column, captured: Column, known_event: Column | None = None) -> Column:
    """A struct of kind, anchor, precision, first_day, last_day (inclusive), value and shapes.

    ``captured`` dates the source; a phrase that counts from it where it is null, or a relative one without a known event,
    is ``needs_anchor`` and answers nothing. A null phrase, or one that names no time, is ``unknown``.
    """
    p, on = F.lower(F.coalesce(phrase, F.lit(""))), F.to_date(captured)
    event = F.coalesce(known_event, F.lit(False)) if known_event is not None else F.lit(False)
    no_day = F.lit(None).cast("date")

    def said(rule: Rule) -> Column:
        first, last = rule.days(p, on) if rule.days else (no_day, no_day)
        anchored = on.isNotNull() if rule.needs_capture else event if rule.anchor == "known_event" else F.lit(True)
        value = amount_iso(p) if rule.kind == "duration" else clock_time(p) if rule.anchor == "clock" else F.regexp_extract(p, f"({rule.pattern})", 1)
        return F.struct(
            F.when(anchored, rule.kind).otherwise("needs_anchor").alias("kind"),
            F.lit(rule.anchor).alias("anchor"),
            F.lit(rule.precision).alias("precision"),
            F.when(anchored, first).alias("first_day"),
            F.when(anchored, last).alias("last_day"),
            F.trim(value).alias("value"),
            F.when(anchored, F.array(*map(F.lit, rule.shapes)).cast("array<string>")).otherwise(F.array().cast("array<string>")).alias("shapes"),
        )

    out = said(UNKNOWN)
    for rule in reversed(RULES):
        holds = p.rlike(rule.pattern)
        if rule.kind == "exact_date" and rule.anchor == "explicit":
            holds = holds & F.try_to_date(_part(p, _ISO, 0), "yyyy-MM-dd").isNotNull()
        out = F.when(holds, said(rule)).otherwise(out)
    return out
