"""Column functions: text, time, vectors. All stay in generated code; none is a Python UDF."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secret patterns and their names, applied in this order; results must equal these replacements.
SECRET_PATTERNS = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("openai_key", r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b"),
    ("database_url", r"(?i)\b(?:postgres|postgresql|mysql|mongodb)://[^\s\"'`]+"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
    ("session_cookie", r"(?i)\b(?:session|cookie|connect\.sid|sid)\s*[:=]\s*[A-Za-z0-9%._~+/=-]{24,}"),
    ("oauth_secret", r"(?i)\b(?:client_secret|oauth[_-]?token|refresh_token|access_token)\s*[:=]\s*[A-Za-z0-9._~+/=-]{20,}"),
    ("env_secret", r"\b[A-Z0-9_]*(?:API_KEY|TOKEN|SECRET|PASSWORD|COOKIE|DATABASE_URL)\s*=\s*[^\s\"'`]+"),
)
SENSITIVE = r"(?i)\b(?:client|customer|private|confidential|medical|health|passport|visa|token|secret)\b"
# Fixed values end.


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with ``\\b`` at ASCII word bounds, whatever letters stand beside; Java's own bound is by Unicode."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")


def normalize_text(text: Column) -> Column:
    """CRLF to LF, blanks collapsed, at most one empty line between paragraphs, ends trimmed."""
    out = F.regexp_replace(text, "\r\n", "\n")
    out = F.regexp_replace(out, "[ \t]+", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def collapse(text: Column) -> Column:
    """All white space to single blanks, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def tokens(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def sentences(text: Column) -> Column:
    """Array of trimmed sentences: runs without .!? or line end, with the closing marks."""
    found = F.regexp_extract_all(text, F.lit(r"([^.!?\n]+(?:[.!?]+|$|\n))"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"[\n\r\t]", " "))), lambda s: F.length(s) > 0)


def may_hold_secret(text: Column) -> Column:
    """False only where no secret pattern can match: plain substrings first, patterns without bounds where these are common."""
    lower = F.lower(text)
    some = lambda *words: reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in words])
    named = some("=", ":") & (F.contains(lower, F.lit("session")) | F.contains(lower, F.lit("cookie")) | F.contains(lower, F.lit("sid")) | F.contains(lower, F.lit("token")) | F.contains(lower, F.lit("secret")))
    return (
        some("PRIVATE KEY", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "://", "eyJ")
        | (F.contains(text, F.lit("=")) & some("API_KEY", "TOKEN", "SECRET", "PASSWORD", "COOKIE", "DATABASE_URL"))
        | (named & text.rlike(r"(?i)(?:session|cookie|sid|secret|token)\s*[:=]"))
    )


def redact(text: Column) -> Column:
    """The text with each secret replaced; most texts hold no sign of one and pass as they are."""
    replaced = reduce(lambda t, p: F.regexp_replace(t, ascii_bounds(p[1]), f"[REDACTED:{p[0]}]"), SECRET_PATTERNS, text)
    return F.when(may_hold_secret(text), replaced).otherwise(text)


def secret_kinds(text: Column) -> Column:
    """Names of the patterns that hit, each looked for in the text that earlier ones have redacted."""
    found, current = [], text
    for name, pattern in [(n, ascii_bounds(p)) for n, p in SECRET_PATTERNS]:
        found.append(F.when(current.rlike(pattern), F.lit(name)))
        current = F.regexp_replace(current, pattern, f"[REDACTED:{name}]")
    return F.array_compact(F.array(*found))


def privacy_tier(text: Column) -> Column:
    lower = F.lower(text)
    some = reduce(lambda x, y: x | y, [F.contains(lower, F.lit(w)) for w in re.findall("[a-z]+", SENSITIVE.split("(?:")[1])])
    return F.when(redact(text) != text, "secret_risk").when(some & text.rlike(ascii_bounds(SENSITIVE)), "sensitive").otherwise("normal")


def weighted_rules(text: Column, rules: list[tuple[str, float]], base: float = 0.0) -> Column:
    """Sum of the weights of the patterns that match."""
    return reduce(lambda s, r: s + F.when(text.rlike(ascii_bounds(r[0])), r[1]).otherwise(0.0), rules, F.lit(base))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_share(query: Column, candidate: Column) -> Column:
    """Share of distinct query tokens that the candidate has; 0 without query tokens."""
    n = F.size(F.array_distinct(query))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(query, candidate)) / n)


def overlaps(start: Column, end: Column, window_start: Column, window_end: Column) -> Column:
    """Interval overlap; a null bound is open."""
    return (end.isNull() | (end >= window_start)) & (start.isNull() | (start <= window_end))


def window_granularity(start: Column, end: Column) -> Column:
    days = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return (
        F.when(start.isNull() | end.isNull(), "none").when(days <= 0, "broad").when(days <= 1.1, "day").when(days <= 45, "month").when(days <= 370, "year").otherwise("broad")
    )


def season(ts: Column) -> Column:
    """Northern season of a time."""
    return F.element_at(F.array(*map(F.lit, ("winter", "spring", "summer", "autumn"))), (F.floor(F.month(ts) % 12 / 3) + 1).cast("int"))


def day_part(ts: Column) -> Column:
    hour = F.hour(ts)
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


# Questions that name no subject, and words of time and place that add nothing to them.
LOW_INFORMATION = r"(?i)\b(?:what\s+happened|what\s+did\s+.+\s+do|where\s+did\s+.+\s+go)\b"
# Fixed values end.


def low_information(text: Column, significant_terms: Column) -> Column:
    """Whether a question asks what happened without a significant term."""
    return (F.size(significant_terms) == 0) & text.rlike(ascii_bounds(LOW_INFORMATION))
