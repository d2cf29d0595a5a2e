"""Checks of what was ingested: coverage, links, conflicts, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL = "https?://[^\\s\"'<>()\\[\\]]+"
# fixed values: patterns of numbers with a meaning, and what they count
NUMBERS = [
    ("version", "version\\s+(\\d+(?:\\.\\d+)+)"),
    ("version", "v(\\d+(?:\\.\\d+)+)"),
    ("date", "(\\d{4}-\\d{2}-\\d{2})"),
    ("date", "(\\d{1,2}/\\d{1,2}/\\d{4})"),
    ("percentage", "(\\d+(?:\\.\\d+)?)\\s*%"),
    ("count", "(\\d+(?:,\\d{3})*)\\s+(?:users?|items?|files?|documents?|records?)"),
    ("price", "\\$(\\d+(?:,\\d{3})*(?:\\.\\d{2})?)"),
    ("duration", "(\\d+)\\s*(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?)"),
]


def urls(text: Column) -> Column:
    """Distinct http(s) links, be they bare, in an attribute or in Markdown, without punctuation at the end and without those to the local host."""
    found = F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:!?]+$", ""))
    return F.filter(F.array_distinct(found), lambda u: ~u.rlike("^https?://(localhost|127\\.0\\.0\\.1)"))


def numbers(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys..., type, value`` for every number that the patterns find."""
    parts = [F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)), _named(t)) for t, p in NUMBERS]
    return rows.select(*keys, F.inline(F.concat(*parts)))


def _named(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))


def coverage_status(chars: Column, words: Column) -> Column:
    return F.when((chars >= 0.9) & (words >= 0.85), "good").when((chars >= 0.7) & (words >= 0.7), "acceptable").when(chars > 0, "degraded").otherwise("missing")


def batch_gate(rows: DataFrame) -> DataFrame:
    """One row of measures and the verdict over ``is_sensitive, file_size, n_chars, is_duplicate, has_error``."""
    m = rows.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("is_sensitive").cast("double")), 6).alias("sensitive_rate"),
        F.sum(((F.col("file_size") > 10_000) & (F.col("n_chars") < 100)).cast("long")).alias("n_empty"),
        F.sum(F.col("has_error").cast("long")).alias("n_errors"),
        F.round(F.avg(F.col("is_duplicate").cast("double")), 6).alias("duplicate_rate"),
    )
    bad = (F.col("sensitive_rate") > 0.5) | (F.col("n_errors") > 0) | (F.col("n_empty") > 0) | ((F.col("n") > 5) & (F.col("duplicate_rate") > 0.8))
    return m.withColumn("verdict", F.when(bad, "review").otherwise("pass"))
