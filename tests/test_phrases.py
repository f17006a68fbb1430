"""Time phrases: one golden case a class, and those that name no day."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from memlake.functions import phrases

ON = datetime(2026, 3, 31, 9)

CASES = [
    ("On 2025-06-12 we met", ON, "exact_date", date(2025, 6, 12), date(2025, 6, 12), "2025-06-12", ["when"]),
    ("on 2025-02-31", ON, "unknown", None, None, "", []),
    ("February 2024", None, "month_year", date(2024, 2, 1), date(2024, 2, 29), "february 2024", ["when", "date_range"]),
    ("June 12th", ON, "exact_date", date(2026, 6, 12), date(2026, 6, 12), "june 12th", ["when"]),
    ("June 12th", None, "needs_anchor", None, None, "june 12th", []),
    ("yesterday", ON, "exact_date", date(2026, 3, 30), date(2026, 3, 30), "yesterday", ["when"]),
    ("end of june", ON, "date_range", date(2026, 6, 24), date(2026, 6, 30), "end of june", ["when", "date_range"]),
    ("last month", ON, "date_range", date(2026, 2, 1), date(2026, 2, 28), "last month", ["when", "date_range"]),
    ("two weeks ago", ON, "recency", date(2026, 3, 17), date(2026, 3, 17), "two weeks ago", ["when", "recency"]),
    ("one month ago", ON, "recency", date(2026, 2, 28), date(2026, 2, 28), "one month ago", ["when", "recency"]),
    ("a few days ago", ON, "recency", date(2026, 3, 28), date(2026, 3, 28), "few days ago", ["when", "recency"]),
    ("for five hours", ON, "duration", None, None, "PT5H", ["duration"]),
    ("around 12:30 am", ON, "routine_time", None, None, "00:30", ["routine_time"]),
    ("7 PM", ON, "routine_time", None, None, "19:00", ["routine_time"]),
    ("every morning", ON, "routine_time", None, None, "morning", ["routine_time"]),
    ("before the wedding", ON, "needs_anchor", None, None, "before", []),
    ("recently", ON, "vague_time", None, None, "recently", []),
    ("", ON, "unknown", None, None, "", []),
    (None, None, "unknown", None, None, "", []),
]


def test_each_class(spark):
    rows = spark.createDataFrame([(i, text, on) for i, (text, on, *_) in enumerate(CASES)], "i int, text string, at timestamp")
    found = rows.select("i", phrases.time_meaning(F.col("text"), F.col("at")).alias("m")).orderBy("i").collect()
    for (text, _, *want), r in zip(CASES, found, strict=True):
        assert [r.m.kind, r.m.first_day, r.m.last_day, r.m.value, r.m.shapes] == want, text


def test_precision_and_known_events(spark):
    rows = spark.createDataFrame([("before the wedding",), ("few weeks ago",), ("3 weeks ago",), ("about 7 pm",)], "text string")
    found = rows.select(phrases.time_meaning(F.col("text"), F.lit(ON), F.lit(True)).alias("m")).collect()
    assert [(r.m.kind, r.m.precision) for r in found] == [("event_relative", "relative_order"), ("recency", "coarse"), ("recency", "day"), ("routine_time", "coarse")]
