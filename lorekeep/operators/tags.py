"""Tagging: keyword scores, suggestions, co-occurrence, learned rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def keyword_scores(docs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``doc_id, tag, n_hits, n_keywords, score``; the taxonomy (``tag, keyword``) is a stated, small set.

    Words are counted per document before they meet the keywords, so that a text is read once.
    """
    words = docs.select("doc_id", T.words(F.col("text")).alias("w"))
    counted = words.select("doc_id", F.size("w").alias("n"), F.explode_outer("w").alias("keyword")).groupBy("doc_id", "keyword").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    total = taxonomy.groupBy("tag").agg(F.count("*").alias("n_keywords"))
    hits = counted.join(F.broadcast(taxonomy), "keyword").groupBy("doc_id", "tag").agg(F.sum("k").alias("n_hits"), F.count("*").alias("n_found"), F.first("n").alias("n"))
    score = (F.least(F.lit(1.0), F.col("n_hits") / (F.col("n") / 100 + 1)) + F.least(F.lit(1.0), F.col("n_found") / F.col("n_keywords"))) / 2
    return hits.join(F.broadcast(total), "tag").select("doc_id", "tag", "n_hits", "n_keywords", F.round(score, 6).alias("score"))


def cooccurrence(bridge: DataFrame, doc: str = "doc_id", tag: str = "tag") -> DataFrame:
    """``tag, other, n`` for tags on the same documents."""
    b = bridge.select(F.col(doc).alias("d"), F.col(tag).alias("tag")).distinct()
    return b.join(b.select("d", F.col("tag").alias("other")), "d").filter("tag <> other").groupBy("tag", "other").agg(F.count("*").alias("n"))


def learned_rules(corrections: DataFrame, least_count: int = 2) -> DataFrame:
    """``kind, ai, human, n, confidence``: how often a correction was made, out of all of its kind."""
    g = corrections.groupBy("kind", "ai", "human").agg(F.count("*").alias("n"))
    return g.withColumn("confidence", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6)).filter(F.col("n") >= least_count)
