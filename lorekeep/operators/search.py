"""The search pipeline as one plan, and its variants: many queries at once, each step an operator of its own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..staging import stage
from . import retrieval as R
from . import vector_index as VI
from .text_index import sent


def permitted(queries: DataFrame, scope: str = "scope", rights: str = "rights") -> DataFrame:
    """Queries whose ``rights`` allow their ``scope``: restricted and all need their own right, main the plain one."""
    need = F.when(F.col(scope).isin("restricted", "all"), "search_restricted").otherwise("search_main")
    return queries.filter(F.array_contains(rights, "search_main") & F.array_contains(F.col(rights), need))


def search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, as_of: Column, k: int = 5, widen: int = 10, tags: Column | None = None) -> DataFrame:
    """``query_id, id, score, relevance, rank, citation``: permission, tags, hybrid search, rerank, decay, corrective filter, format.

    ``docs`` has ``doc_id, text, source, modified`` and whatever ``tags``, a condition, looks at; ``queries`` is a stated set
    with ``query_id, qtext, qvec, scope, rights``.  The hybrid step takes ``widen`` times what is asked for, and the
    reranker cuts that back; decay changes the order once more.
    """
    asked = permitted(queries)
    pool = docs if tags is None else docs.filter(tags)
    known = vectors.join(pool.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    found = R.hybrid(pool, known, asked, k * widen)
    rows = found.join(asked.select("query_id", "qtext"), "query_id").join(pool.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "modified"), "id")
    best = R.rerank(rows, R.overlap_score(), k)
    aged = resorted(best.withColumn("score", F.round(F.col("rerank_score") * S.decay(F.col("modified"), as_of), 6)), "score")
    kept = R.corrective(aged.select("query_id", "id", "score", "rank", "source"))
    return kept.select("query_id", "id", "score", "relevance", "rank", citation(F.col("rank"), F.col("source")).alias("citation"))


def resorted(rows: DataFrame, score: str, by: str = "query_id", name: str = "rank") -> DataFrame:
    """Ranks after a score was changed by decay or a boost."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "id")))


def citation(rank: Column, source: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), source)


def topic_context(ranked: DataFrame, most: int = 4000, by: str = "query_id") -> DataFrame:
    """``query_id, context, citations, n_tokens, n_chunks``: contents in rank order until the next one would pass ``most`` tokens.

    ``ranked`` is a top-k list (``rank, content, citation``), so a query's rows are few.
    """
    kept = R.budget(ranked, T.estimate_tokens(F.col("content")), most, [by], [F.col("rank")])
    g = kept.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("x"), F.array_sort(F.collect_set("citation")).alias("citations"), F.max("used_tokens").alias("n_tokens"))
    return g.select(by, F.array_join(F.transform("x", lambda c: c["content"]), "\n\n---\n\n").alias("context"), "citations", "n_tokens", F.size("x").alias("n_chunks"))


def similar_entities(entities: DataFrame, queries: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """``query_id, name, similarity, n_neighbours``: entities (``name, vec``) near a stated set of query vectors, with their degree."""

    def score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        return -np.maximum(1 - ((x - q) ** 2).sum(1), 0).round(6)

    # beyond a distance of one all are alike and names decide: such ones are among the least 2 k
    least = entities.join(stage(VI.usable(entities, "name", "vec").select(F.col("id").alias("name")).distinct().orderBy("name").limit(2 * k)), "name", "left_semi")
    near = VI.brute(entities, queries, k, "name", "vec", score, "far").unionByName(VI.brute(least, queries, 2 * k, "name", "vec", score, "far"))
    near = near.select("query_id", F.col("id").alias("name"), (F.lit(0.0) - F.col("far")).alias("similarity")).distinct()
    best = stage(R.top(near, ["query_id"], [F.desc("similarity"), F.asc("name")], k))
    ends = edges.select(F.col("subject").alias("name"), F.col("object").alias("other")).unionByName(edges.select(F.col("object").alias("name"), F.col("subject").alias("other")))
    degree = ends.join(sent(best.select("name").distinct()), "name", "left_semi").distinct().groupBy("name").agg(F.count("*").alias("n_neighbours"))
    return best.join(degree, "name", "left").select("query_id", "name", "similarity", F.coalesce("n_neighbours", F.lit(0).cast("long")).alias("n_neighbours"))


def page(found: DataFrame, offset: int, k: int, by: str = "query_id") -> DataFrame:
    """The ranks after ``offset``, ``k`` of them, and whether more follow (``found`` holds some rows beyond)."""
    more = F.max("rank").over(Window.partitionBy(by)) > offset + k
    return found.withColumn("has_more", more).filter((F.col("rank") > offset) & (F.col("rank") <= offset + k))
