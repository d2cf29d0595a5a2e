"""Dates in text: the surest pattern that gives a real date wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
# fixed values: patterns, how to read what they match, and how sure they are
PATTERNS = [
    ("\\b(\\d{4}-\\d{2}-\\d{2})(?:T\\d{2}:\\d{2})", "yyyy-MM-dd", 0.95),
    ("\\b(\\d{4}-\\d{2}-\\d{2})\\b", "yyyy-MM-dd", 0.9),
    (f"\\b((?:{MONTHS})\\s+\\d{{1,2}},?\\s+\\d{{4}})\\b", "MMMM d yyyy", 0.85),
    (f"\\b((?:{SHORT})\\s+\\d{{1,2}},?\\s+\\d{{4}})\\b", "MMM d yyyy", 0.8),
    ("\\b(\\d{1,2}/\\d{1,2}/\\d{4})\\b", "M/d/yyyy", 0.6),
    ("\\b(\\d{1,2}\\.\\d{1,2}\\.\\d{4})\\b", "d.M.yyyy", 0.6),
    ("\\b(\\d{4}-\\d{2})\\b", "yyyy-MM", 0.5),
    (f"\\b((?:{MONTHS})\\s+\\d{{4}})\\b", "MMMM yyyy", 0.5),
    ("\\b(20\\d{2})\\b", "yyyy", 0.3),
]


def _candidates(text: Column) -> list[Column]:
    out = []
    for pattern, form, confidence in PATTERNS:
        found = F.regexp_extract(text, pattern, 1)
        plain = F.regexp_replace(F.regexp_replace(found, ",", ""), "\\s+", " ")
        day = F.try_to_date(plain, form)
        out.append(F.when((found != "") & day.isNotNull(), F.struct(day.alias("date"), F.lit(confidence).alias("confidence"))))
    return out


def best_date(text: Column) -> Column:
    """``struct(date, confidence)`` of the surest pattern; of equal ones the earlier; null if none gives a date."""
    return F.coalesce(*_candidates(text))


def all_dates(text: Column) -> Column:
    """One ``struct(date, confidence)`` per distinct date, the surest first, of equal ones by pattern and place in the text."""
    parts = []
    for pattern, form, confidence in PATTERNS:
        parts.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _read(form, confidence)))
    found = F.filter(F.concat(*parts), lambda x: x["date"].isNotNull())
    return F.aggregate(
        found,
        F.expr("cast(array() as array<struct<date:date,confidence:double>>)"),
        lambda kept, x: F.when(F.exists(kept, lambda k: k["date"] == x["date"]), kept).otherwise(F.concat(kept, F.array(x))),
    )


def _read(form: str, confidence: float):
    def of(found: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(found, ",", ""), "\\s+", " ")
        return F.struct(F.try_to_date(plain, form).alias("date"), F.lit(confidence).alias("confidence"))

    return of
