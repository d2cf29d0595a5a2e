"""Analytics of a query log: totals, trends, failures, gaps, suggestions, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failed(n_results: Column, top_score: Column, least: float = 0.3) -> Column:
    return (n_results < 1) | (top_score < least)


def summary(log: DataFrame) -> DataFrame:
    """One row over ``q, score, n_results``: queries, distinct ones, mean score, failures."""
    bad = failed(F.col("n_results"), F.col("score"))
    return log.agg(F.count("*").alias("n"), F.countDistinct("q").alias("n_distinct"), F.round(F.avg("score"), 6).alias("mean_score"), F.sum(bad.cast("long")).alias("n_failed"))


def trend(log: DataFrame, by: str, order: str, score: str, margin: float = 0.05) -> DataFrame:
    """Per group the mean of the first and of the second half, and whether it improves, declines or is stable."""
    w = Window.partitionBy(by)
    ranked = log.withColumn("_rn", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    first = F.col("_rn") <= F.floor(F.col("_n") / 2)
    halves = ranked.groupBy(by).agg(F.round(F.avg(F.when(first, F.col(score))), 6).alias("first_half"), F.round(F.avg(F.when(~first, F.col(score))), 6).alias("second_half"))
    gap = F.col("second_half") - F.col("first_half")
    return halves.withColumn("trend", F.when(gap > margin, "improving").when(gap < -margin, "declining").otherwise("stable"))


def suggestions(log: DataFrame, least_count: int = 3, least_mean: float = 0.5) -> DataFrame:
    """Golden-set candidates per normalised query: seen often enough, good enough on average, with the best hit's file."""
    g = log.groupBy(F.lower(F.trim("q")).alias("q")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.max_by("file", F.struct("score", F.col("id"))).alias("file"))
    return g.filter((F.col("n") >= least_count) & (F.col("mean_score") >= least_mean) & F.col("file").isNotNull())


def gaps(log: DataFrame, words: Column) -> DataFrame:
    """Failed queries by their first three meaningful words; confidence grows with the count up to five."""
    g = log.groupBy(F.array_join(F.slice(words, 1, 3), " ").alias("topic")).agg(F.count("*").alias("n"))
    return g.withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 5))


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def sessions(events: DataFrame, by: str, at: str, gap_seconds: int) -> DataFrame:
    """``by, session, started, ended, n``: a new session begins after a pause of more than ``gap_seconds``."""
    w = Window.partitionBy(by).orderBy(at, "event_id")
    new = F.coalesce((_micros(F.col(at)) - _micros(F.lag(at).over(w))) > gap_seconds * 1_000_000, F.lit(True))
    numbered = events.withColumn("session", F.sum(new.cast("long")).over(w))
    return numbered.groupBy(by, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))
