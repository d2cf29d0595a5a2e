"""Scores and labels of retrieved or catalogued rows.  Every date rule takes an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
# fixed values: seasons in which a topic counts more, as (topic, first month, last month)
SEASONS = [("tax", 3, 4), ("review", 12, 1), ("budget", 1, 2), ("budget", 10, 11)]


def age_days(when: Column, as_of: Column) -> Column:
    """Whole elapsed 24-hour periods."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(when)) / 86400).cast("long")


def decay(when: Column, as_of: Column, rate: float = 0.1, max_years: float = 10.0, least: float = 0.1) -> Column:
    """1 / (1 + rate * age in years), the age cut at ``max_years``; a missing date counts as today."""
    years = F.least(F.greatest(age_days(when, as_of), F.lit(0)) / 365.25, F.lit(max_years))
    return F.greatest(1.0 / (1.0 + F.coalesce(years, F.lit(0.0)) * rate), F.lit(least))


def half_life(confidence: Column, days: Column) -> Column:
    """Confidence halves every year; changes of 0.001 or less are not made."""
    new = F.round(confidence * F.pow(F.lit(2.0), -days / 365.0), 4)
    return F.when((days > 0) & (F.abs(confidence - new) > 0.001), new).otherwise(confidence)


def freshness(days: Column) -> Column:
    return F.when(days <= 7, "fresh").when(days <= 30, "current").when(days <= 90, "aging").when(days <= 365, "stale").otherwise("archive")


def _about(topic: str):
    return lambda tag: F.lower(tag).contains(topic)


def seasonal_boost(tags: Column, month: Column, boost: float = 1.3) -> Column:
    hits = F.lit(False)
    for topic, first, last in SEASONS:
        now = month.between(first, last) if first <= last else (month >= first) | (month <= last)
        hits = hits | (now & F.exists(tags, _about(topic)))
    return F.when(hits, F.lit(boost)).otherwise(F.lit(1.0))


def relevance(score: Column, correct: float = 0.7, ambiguous: float = 0.3) -> Column:
    """A missing score is 0.5."""
    s = F.coalesce(score, F.lit(0.5))
    return F.when(s > correct, "correct").when(s >= ambiguous, "ambiguous").otherwise("incorrect")


def rrf(rank: Column, weight: float = 1.0) -> Column:
    return F.coalesce(F.lit(float(weight)) / (F.lit(float(RRF_K)) + rank), F.lit(0.0))
