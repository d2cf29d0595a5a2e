"""Retrieval: dense, full-text and sparse top-k, rank fusion and what follows it.

Queries are rows, so many run as one job; ranks come from window limits that Spark
prunes before the shuffle.  Ties are always broken by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..staging import settle
from . import vector_index

K1, B = 1.2, 0.75


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Exact nearest neighbours over all rows, without an index: ``query_id, id, distance, rank``; ``queries`` has ``query_id, qvec``."""
    return vector_index.brute(vectors, queries, k, id_col, vec)


def top(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The full-text index: ``id, term, tf, length``."""
    tokens = docs.select(F.col(id_col).alias("id"), T.words(F.col(text_col)).alias("w")).withColumn("length", F.size("w"))
    return tokens.select("id", "length", F.explode_outer("w").alias("term")).filter("term is not null").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``query_id, id, score, rank``.  Only postings of the queries' terms are formed; document lengths come with them.

    ``queries`` (``query_id, qtext``) is a stated, small set.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(T.words(F.col("qtext")))).alias("term"))
    sized = docs.select(F.col(id_col).alias("id"), T.words(F.col(text_col)).alias("w")).withColumn("length", F.size("w"))
    stats = sized.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    # an inner explode would cut the texts once more, in a filter that it infers
    tokens = sized.select("id", "length", F.explode_outer("w").alias("term"))
    hits = tokens.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    tf = settle(hits.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length")))  # of the queries' terms alone, read twice
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    joined = tf.join(F.broadcast(df), "term").join(F.broadcast(terms), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = joined.withColumn("part", F.round(part, 9)).groupBy("query_id", "id").agg(F.round(F.sum(F.col("part").cast("decimal(28,9)")).cast("double"), 6).alias("score"))
    return top(scored, ["query_id"], [F.desc("score"), F.asc("id")], k)


def sparse(weights: DataFrame, query_weights: DataFrame, k: int) -> DataFrame:
    """Learned-lexical search: ``weights`` (``id, term, w``) against ``query_weights`` (``query_id, term, qw``)."""
    scored = weights.join(F.broadcast(query_weights), "term").groupBy("query_id", "id").agg(F.round(F.sum((F.col("w") * F.col("qw")).cast("decimal(28,9)")).cast("double"), 6).alias("score"))
    return top(scored, ["query_id"], [F.desc("score"), F.asc("id")], k)


def fuse(lists: dict[str, tuple[DataFrame, float]], by: str = "query_id") -> DataFrame:
    """Weighted reciprocal-rank fusion: each list has ``by, id, rank``; one union and one aggregation for any number of lists."""
    parts = []
    for name, (rows, weight) in lists.items():
        ranks = [(F.col("rank") if n == name else F.lit(None).cast("int")).alias(f"{n}_rank") for n in lists]
        parts.append(rows.select(by, "id", S.rrf(F.col("rank"), weight).alias("part"), *ranks))
    both = reduce(DataFrame.unionByName, parts)
    ranks = [F.max(f"{n}_rank").alias(f"{n}_rank") for n in lists]
    return both.groupBy(by, "id").agg(F.round(F.sum(F.col("part").cast("decimal(28,15)")).cast("double"), 9).alias("rrf_score"), *ranks)


def redistribute(dense: float, text: float, sparse_weight: float, has_sparse: bool) -> tuple[float, float, float]:
    """Without sparse hits their weight goes 7 : 3 to the dense and the text list."""
    return (dense, text, sparse_weight) if has_sparse else (dense + 0.7 * sparse_weight, text + 0.3 * sparse_weight, 0.0)


def hybrid(docs: DataFrame | None, vectors: DataFrame | None, queries: DataFrame, k: int = 10, weights: tuple = (0.5, 0.2, 0.3), over: int = 3, lists: tuple | None = None) -> DataFrame:
    """The top ``k`` of dense and full-text search, fused; ``queries`` has ``query_id, qtext, qvec``, of which one may be null.

    ``lists``: the two searches, functions of queries and a number of rows, as an index gives them; else all of ``docs`` and ``vectors`` are read.
    """
    wd, wt, _ = redistribute(*weights, has_sparse=False)
    dense, text = lists or ((lambda q, n: knn(vectors, q, n)), (lambda q, n: bm25(docs, q, n)))
    found = {"dense": (dense(queries.filter("qvec is not null").select("query_id", "qvec"), over * k), wd), "text": (text(queries.filter("qtext is not null").select("query_id", "qtext"), over * k), wt)}
    return top(fuse(found), ["query_id"], [F.desc("rrf_score"), F.asc("id")], k)


def rerank(rows: DataFrame, scorer: Column, k: int, limit: int = 2048, threshold: float | None = None, by: str = "query_id", content: str = "content") -> DataFrame:
    """Order by ``scorer``, an expression over ``qtext`` and the first ``limit`` characters as ``passage``; keeps the rank before."""
    scored = rows.withColumn("passage", F.substring(content, 1, limit)).withColumn("rerank_score", scorer).drop("passage")
    if threshold is not None:
        scored = scored.filter(F.col("rerank_score") >= threshold)
    return top(scored.withColumnRenamed("rank", "original_rank"), [by], [F.desc("rerank_score"), F.asc("id")], k, "final_rank")


def overlap_score() -> Column:
    """The stand-in scorer without a model: share of the query's words in the passage."""
    q = F.array_distinct(T.words(F.col("qtext")))
    return F.round(F.size(F.array_intersect(q, T.words(F.col("passage")))) / F.greatest(F.size(q), F.lit(1)), 6)


def corrective(rows: DataFrame, score: str = "score", by: str = "query_id", fallback: int = 3) -> DataFrame:
    """Correct rows, then ambiguous ones; if none is left, the first ``fallback`` rows, marked so."""
    labelled = rows.withColumn("relevance", S.relevance(F.col(score)))
    w = Window.partitionBy(by)
    kept = F.sum((F.col("relevance") != "incorrect").cast("int")).over(w)
    ranked = labelled.withColumn("kept", kept).withColumn("place", F.row_number().over(w.orderBy("rank")))
    out = ranked.filter((F.col("relevance") != "incorrect") | ((F.col("kept") == 0) & (F.col("place") <= fallback)))
    return out.withColumn("relevance", F.when(F.col("kept") == 0, "fallback").otherwise(F.col("relevance"))).drop("kept", "place")


def merge_scopes(rows: DataFrame, key: str, k: int, by: str = "query_id") -> DataFrame:
    """Union of scopes without repeats: of the same key the restricted copy wins, then the better rank."""
    first = Window.partitionBy(by, key).orderBy(F.desc(F.col("scope") == "restricted"), "rank", "id")
    one = rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    return top(one.drop("rank"), [by], [F.desc("rrf_score"), F.asc("id")], k)


def budget(rows: DataFrame, tokens: Column, most: int, by: list[str], order: list[Column]) -> DataFrame:
    """The prefix of rows before the running token count first passes ``most``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used_tokens", F.sum(tokens).over(w)).filter(F.col("used_tokens") <= most)
