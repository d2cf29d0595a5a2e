"""Search plans: dense, text and sparse lists, their fusion, and the steps after it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions import vectors as V
from ..keep import kept
from ..operators import retrieval as R
from ..operators import text_index as TI
from ..operators import vector_index as VI
from ..registry import query, table

# the stated query set: every row whose id is divisible by 100, with its whole text, against all rows
QUERIES = "select item_id as query_id, text as qtext from benchmark where item_id % 100 = 0"
DIST = "round(list_sum(list_transform(list_zip(e.embedding, q.qvec), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), 9)"
QV = "qv as (select vec_id as query_id, embedding as qvec from embeddings where vec_id % 100 = 0)"
KNN = f"""{QV}, dist as (select q.query_id, e.vec_id as id, {DIST} as distance from embeddings e, qv q),
dense as (select *, (row_number() over (partition by query_id order by distance, id))::integer as rank from dist qualify rank <= 30)"""
BM25 = rf"""qs as ({QUERIES}), qt as (select distinct query_id, unnest(regexp_extract_all(lower(qtext), '[\p{{L}}\p{{N}}_]+')) as term from qs),
w as (select doc_id as id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as w from documents), st as (select count(*) as n_docs, avg(len(w)) as mean_length from w),
tok as (select id, len(w) as length, unnest(w) as term from w), tf as (select id, term, count(*) as tf, any_value(length) as length from tok where term in (select term from qt) group by all),
df as (select term, count(*) as df from tf group by 1),
sc as (select query_id, id, round(sum(round(ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * length / mean_length)), 9)::decimal(28,9))::double, 6) as score
  from tf join df using (term) join qt using (term), st group by all),
txt as (select *, (row_number() over (partition by query_id order by score desc, id))::integer as rank from sc qualify rank <= 30)"""


def _fused(a: str, b: str, wa: float, wb: float, k: int) -> str:
    return f"""u as (select query_id, id, {wa!r}::double / (60 + rank) as part, rank as dense_rank, null::integer as text_rank from {a}
 union all select query_id, id, {wb!r}::double / (60 + rank), null, rank from {b}),
f as (select query_id, id, round(sum(part::decimal(28,15))::double, 9) as rrf_score, max(dense_rank) as dense_rank, max(text_rank) as text_rank from u group by all),
fused as (select *, (row_number() over (partition by query_id order by rrf_score desc, id))::integer as rank from f qualify rank <= {k})"""


def texts(spark, d):
    return table(spark, d, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("qtext"))


def vecs(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


def vector_index(spark, d):
    """The index of all vectors, kept from the first search on."""
    rows = table(spark, d, "embeddings")
    return VI.opened(spark, kept(spark, rows, "vectors", lambda path: VI.build(rows, path)))


def dense_list(spark, d, k=30):
    return VI.search(vector_index(spark, d), vecs(spark, d), k, exact=True)


def text_index(spark, d):
    """The postings of all documents, kept from the first search on."""
    docs = table(spark, d, "documents")
    return TI.opened(spark, kept(spark, docs, "postings", lambda path: TI.build(docs, path)))


def text_list(spark, d, k=30):
    return TI.search(text_index(spark, d), texts(spark, d), k)


def indexed(spark, d):
    """The two searches of a hybrid one, on the kept indexes."""
    return (lambda asked, k: VI.search(vector_index(spark, d), asked, k, exact=True)), (lambda asked, k: TI.search(text_index(spark, d), asked, k))


WD, WT, _ = R.redistribute(0.5, 0.2, 0.3, has_sparse=False)


@query("r01_dense_knn", f"with {KNN} select query_id, id, distance, rank from dense")
def r01(spark, d):
    return dense_list(spark, d)


@query("r01_probed_lists")
def r01_probed(spark, d):
    """The same queries on as many lists as find nine neighbours in ten, measured on a sample against the exact search."""
    index = vector_index(spark, d)
    return VI.search(index, vecs(spark, d), 10, probes=VI.probes_for(index, 0.9))


@query("r02_full_text", f"with {BM25} select query_id, id, score, rank from txt")
def r02(spark, d):
    return text_list(spark, d)


@query("r02_documents_as_queries", f"with {BM25.replace(QUERIES, 'select doc_id as query_id, text as qtext from documents where doc_id % 100 = 0').replace('rank <= 30', 'rank <= 10')} select query_id, id, score, rank from txt")
def r02_documents(spark, d):
    """Whole documents as queries: hundreds of terms each, the document itself at or near the top."""
    asked = table(spark, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("qtext"))
    return TI.search(text_index(spark, d), asked, 10)


SPARSE = r"""qs as (""" + QUERIES + r"""), qt as (select query_id, term, count(*)::double as qw from (select query_id, unnest(regexp_extract_all(lower(qtext), '[\p{L}\p{N}_]+')) as term from qs) group by all),
dt as (select id, term, ln(1 + count(*))::double as w from (select doc_id as id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term from documents) group by all),
ss as (select query_id, id, round(sum(round(w * qw, 9)::decimal(28,9))::double, 6) as score from dt join qt using (term) group by all),
spl as (select *, (row_number() over (partition by query_id order by score desc, id))::integer as rank from ss qualify rank <= 30)"""


def sparse_list(spark, d, k=30):
    return TI.search(text_index(spark, d), texts(spark, d), k, "sparse")


@query("r03_sparse_search", f"with {SPARSE} select query_id, id, score, rank from spl")
def r03(spark, d):
    return sparse_list(spark, d)


@query("r04_vector_only_fallback", f"with {KNN} select query_id, id, round(1.0::double / (60 + rank), 9) as score, rank from dense where rank <= 10")
def r04(spark, d):
    return dense_list(spark, d, 10).select("query_id", "id", F.round(1.0 / (60 + F.col("rank")), 9).alias("score"), "rank")


@query("r05_rrf_two_way", f"with {KNN}, {BM25}, {_fused('dense', 'txt', 0.7, 0.3, 10)} select query_id, id, rrf_score, dense_rank, text_rank, rank from fused")
def r05(spark, d):
    return R.top(R.fuse({"dense": (dense_list(spark, d), 0.7), "text": (text_list(spark, d), 0.3)}), ["query_id"], [F.desc("rrf_score"), F.asc("id")], 10)


@query("r06_rrf_three_way", f"""with {KNN}, {BM25}, {SPARSE.replace("qs as (" + QUERIES + "), ", "").replace("qt as", "qt2 as").replace("join qt using", "join qt2 using")},
u as (select query_id, id, 0.5::double / (60 + rank) as part from dense union all select query_id, id, 0.2::double / (60 + rank) from txt union all select query_id, id, 0.3::double / (60 + rank) from spl),
f as (select query_id, id, round(sum(part::decimal(28,15))::double, 9) as rrf_score from u group by all)
select query_id, id, rrf_score, (row_number() over (partition by query_id order by rrf_score desc, id))::integer as rank from f qualify rank <= 10""")
def r06(spark, d):
    fused = R.fuse({"dense": (dense_list(spark, d), 0.5), "text": (text_list(spark, d), 0.2), "sparse": (sparse_list(spark, d), 0.3)})
    return R.top(fused, ["query_id"], [F.desc("rrf_score"), F.asc("id")], 10).select("query_id", "id", "rrf_score", "rank")


@query("r07_weight_redistribution", "select r_regionkey, case when r_regionkey % 2 = 0 then 0.71::double else 0.5::double end as dense, case when r_regionkey % 2 = 0 then 0.29::double else 0.2::double end as text, case when r_regionkey % 2 = 0 then 0.0::double else 0.3::double end as sparse from region")
def r07(spark, d):
    """Queries with and without sparse hits."""
    got, lost = (R.redistribute(0.5, 0.2, 0.3, has_sparse=x) for x in (True, False))
    weights = [F.round(F.when(F.col("r_regionkey") % 2 == 0, b).otherwise(a), 6).alias(n) for a, b, n in zip(got, lost, ("dense", "text", "sparse"), strict=True)]
    return table(spark, d, "region").select("r_regionkey", *weights)


HYBRID = f"{KNN}, {BM25}, {_fused('dense', 'txt', WD, WT, 10)}"


@query("r08_hybrid_search", f"with {HYBRID} select query_id, id, rrf_score, dense_rank, text_rank, rank from fused")
def r08(spark, d):
    q = texts(spark, d).join(vecs(spark, d), "query_id", "full_outer")
    return R.hybrid(None, None, q, 10, lists=indexed(spark, d))


@query("r09_scope_merge", f"""with {HYBRID}, l as (select doc_id, max(toxic) as toxic from labels group by 1),
s as (select f.*, d.source, case when l.toxic = 1 then 'restricted' else 'main' end as scope from fused f join documents d on d.doc_id = f.id left join l on l.doc_id = f.id),
o as (select *, row_number() over (partition by query_id, source order by (scope = 'restricted') desc, rank, id) as n from s)
select * from (select query_id, id, source, scope, rrf_score, (row_number() over (partition by query_id order by rrf_score desc, id))::integer as rank from (select * exclude (rank) from o where n = 1)) where rank <= 5""")
def r09(spark, d):
    found = r08(spark, d)
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = found.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id").join(labels.withColumnRenamed("doc_id", "id"), "id", "left")
    rows = rows.withColumn("scope", F.when(F.col("toxic") == 1, "restricted").otherwise("main"))
    return R.merge_scopes(rows, "source", 5).select("query_id", "id", "source", "scope", "rrf_score", "rank")


@query("r10_small_to_big", f"""with {KNN}, c as (select query_id, id // 10 as parent_id, id, distance from dense),
b as (select query_id, parent_id, min(distance) as distance, arg_min(id, (distance, id)) as child_id from c group by all)
select query_id, parent_id, distance, child_id, (row_number() over (partition by query_id order by distance, parent_id))::integer as rank from b qualify rank <= 5""")
def r10(spark, d):
    """Children's hits to their parents: ten vectors in a row share one."""
    hits = dense_list(spark, d).withColumn("parent_id", F.floor(F.col("id") / 10))
    best = hits.groupBy("query_id", "parent_id").agg(F.min("distance").alias("distance"), F.min_by("id", F.struct("distance", "id")).alias("child_id"))
    return R.top(best, ["query_id"], [F.asc("distance"), F.asc("parent_id")], 5)


@query("r11_multi_query_fusion", f"""with {KNN}, m as (select id, round(sum(round(1.0::double / (60 + rank), 12)::decimal(28,12))::double, 9) as rrf, count(*)::bigint as n_queries, array_to_string(list(query_id::varchar order by query_id), ',') as queries from dense group by 1)
select id, rrf, n_queries, queries, round(rrf * (1 + 0.1::double * (n_queries - 1) * 0.2::double), 9) as boosted from m""")
def r11(spark, d):
    part = F.round(1.0 / (60 + F.col("rank")), 12).cast("decimal(28,12)")
    m = dense_list(spark, d).groupBy("id").agg(
        F.round(F.sum(part).cast("double"), 9).alias("rrf"), F.count("*").alias("n_queries"), F.array_join(F.transform(F.array_sort(F.collect_list("query_id")), lambda x: x.cast("string")), ",").alias("queries")
    )
    return m.withColumn("boosted", F.round(F.col("rrf") * (1 + F.lit(0.1) * (F.col("n_queries") - 1) * F.lit(0.2)), 9))


RERANK = HYBRID + r""", rr as (select f.query_id, f.id, f.rank as original_rank, round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.qtext), '[\p{L}\p{N}_]+')), list_distinct(regexp_extract_all(lower(substr(d.text, 1, 2048)), '[\p{L}\p{N}_]+'))))::double
  / greatest(len(list_distinct(regexp_extract_all(lower(q.qtext), '[\p{L}\p{N}_]+'))), 1), 6) as rerank_score from fused f join qs q using (query_id) join documents d on d.doc_id = f.id),
rk as (select *, (row_number() over (partition by query_id order by rerank_score desc, id))::integer as final_rank from rr qualify final_rank <= 5)"""


def reranked(spark, d):
    rows = r08(spark, d).join(texts(spark, d), "query_id").join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")
    return R.rerank(rows, R.overlap_score(), 5)


@query("r12_rerank", f"with {RERANK} select query_id, id, original_rank, rerank_score, final_rank from rk")
def r12(spark, d):
    return reranked(spark, d).select("query_id", "id", "original_rank", "rerank_score", "final_rank")


DECAY = "greatest(1.0::double / (1.0::double + least(greatest((floor((epoch('2024-06-01'::timestamp) - epoch(o_orderdate)) / 86400))::bigint, 0) / 365.25::double, 10.0::double) * 0.1::double), 0.1::double)"


@query("r13_time_decay", f"select o_orderkey, round({DECAY}, 6) as multiplier, round(o_totalprice * {DECAY}, 4) as decayed from orders")
def r13(spark, d):
    m = S.decay(F.col("o_orderdate"), F.lit("2024-06-01").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", F.round(m, 6).alias("multiplier"), F.round(F.col("o_totalprice") * m, 4).alias("decayed"))


@query("r14_corrective_filter", """with s as (select user_id as query_id, event_id as id, value / 100 as score, row_number() over (partition by user_id order by event_id) as rank from events),
l as (select *, case when coalesce(score, 0.5) > 0.7 then 'correct' when coalesce(score, 0.5) >= 0.3 then 'ambiguous' else 'incorrect' end as rel from s),
k as (select *, sum((rel <> 'incorrect')::int) over (partition by query_id) as kept, row_number() over (partition by query_id order by rank) as place from l)
select query_id, id, round(score, 6) as score, case when kept = 0 then 'fallback' else rel end as relevance from k where rel <> 'incorrect' or (kept = 0 and place <= 3)""")
def r14(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("score"), rank.alias("rank"))
    return R.corrective(rows).select("query_id", "id", F.round("score", 6).alias("score"), "relevance")


@query("r15_seasonal_boost", """with s(topic, first, last) as (values ('tax', 3, 4), ('review', 12, 1), ('budget', 1, 2), ('budget', 10, 11)),
t as (select o_orderkey, month(o_orderdate) as m, case o_orderkey % 4 when 0 then 'tax-form' when 1 then 'review' when 2 then 'budget' else 'notes' end as tag from orders)
select o_orderkey, case when exists(select 1 from s where contains(tag, topic) and (case when first <= last then m between first and last else m >= first or m <= last end)) then 1.3::double else 1.0::double end as boost from t""")
def r15(spark, d):
    k = F.col("o_orderkey") % 4
    tag = F.when(k == 0, "tax-form").when(k == 1, "review").when(k == 2, "budget").otherwise("notes")
    return table(spark, d, "orders").select("o_orderkey", S.seasonal_boost(F.array(tag), F.month("o_orderdate")).alias("boost"))


@query("r23_related_documents", f"""with p as (select label as query_id, pos, avg(v) as v from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings) group by all),
qv as (select query_id, list(v order by pos) as qvec from p group by 1), dd as (select q.query_id, e.vec_id as id, e.label, round(list_sum(list_transform(list_zip(e.embedding, q.qvec), lambda z: (z[1]::double - z[2]) * (z[1]::double - z[2]))), 6) as distance from embeddings e, qv q where e.label <> q.query_id)
select query_id, id, distance, (row_number() over (partition by query_id order by distance, id))::integer as rank from dd qualify rank <= 5""")
def r23(spark, d):
    """Mean vector of a group (A35), its neighbours, without its own members."""
    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    q = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("qvec")).withColumnRenamed("label", "query_id")
    pairs = e.join(F.broadcast(q), e["label"] != q["query_id"])
    scored = pairs.select("query_id", F.col("vec_id").alias("id"), F.round(V.squared_l2(F.col("embedding"), F.col("qvec")), 6).alias("distance"))
    return R.top(scored, ["query_id"], [F.asc("distance"), F.asc("id")], 5)


@query("w05_token_budget", """with t as (select source, doc_id, sum(floor(length(text) / 4)::bigint) over (partition by source order by doc_id rows unbounded preceding) as used from documents)
select source, doc_id, used::bigint as used_tokens from t where used <= 2000""")
def w05(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    return R.budget(docs, T.estimate_tokens(F.col("text")), 2000, ["source"], [F.col("doc_id")]).select("source", "doc_id", "used_tokens")


@query("r34_cosine", "select a.vec_id, b.vec_id as other_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda z: z::double * z::double))) * sqrt(list_sum(list_transform(b.embedding, lambda z: z::double * z::double)))), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def r34(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", "other_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("f17_pagination", f"with {BM25} select query_id, id, rank, count(*) over (partition by query_id) > 10 as has_more from txt where rank <= 20 qualify rank > 5 and rank <= 10")
def f17(spark, d):
    from pyspark.sql import Window

    rows = text_list(spark, d, 20).withColumn("has_more", F.count("*").over(Window.partitionBy("query_id")) > 10)
    return rows.filter("rank > 5 and rank <= 10").select("query_id", "id", "rank", "has_more")


QROWS = "(select event_id, case event_id % 6 when 0 then 'red fish vs blue fish' when 1 then 'cats and dogs' when 2 then 'how to cook rice' when 3 then 'what is tea' when 4 then 'why is the sky blue' else 'green hills' end as q from events)"


def _query_rows(spark, d):
    k = F.col("event_id") % 6
    q = F.when(k == 0, "red fish vs blue fish").when(k == 1, "cats and dogs").when(k == 2, "how to cook rice").when(k == 3, "what is tea").when(k == 4, "why is the sky blue").otherwise("green hills")
    return table(spark, d, "events").select("event_id", q.alias("q"))


@query("r18_classify_query", rf"""select event_id, case when regexp_matches(q, '^(how to|how do|how can)') then 'procedural' when regexp_matches(q, '^(what is|what are|define)') then 'conceptual' when regexp_matches(q, '^(why|explain why)') then 'explanatory'
 when regexp_matches(q, '^(when|where|who)') then 'factual' else 'general' end as kind, trim(regexp_replace(regexp_replace(lower(q), '^(what|how|why|when|where|who|is|are|do|does|can|should)\s+', ''), '\?$', '')) as focus from {QROWS}""")
def r18(spark, d):
    from ..operators import queries as Q

    return _query_rows(spark, d).select("event_id", Q.kind(F.col("q")).alias("kind"), Q.focus(F.col("q")).alias("focus"))


@query("r17_decompose", rf"""with c as (select *, regexp_extract(q, '(.+)\s+vs\.?\s+(.+)', 1) as a, regexp_extract(q, '(.+)\s+vs\.?\s+(.+)', 2) as b, regexp_extract(q, '(.+)\s+and\s+(.+)', 1) as x, regexp_extract(q, '(.+)\s+and\s+(.+)', 2) as y from {QROWS}),
p as (select event_id, unnest(case when a <> '' then [(trim(a), 'entity', 1.0::double), (trim(b), 'entity', 1.0::double), (q, 'comparison', 1.2::double)] when x <> '' then [(trim(x), 'factual', 1.0::double), (trim(y), 'factual', 1.0::double)] else [(q, 'single', 1.0::double)] end) as s from c)
select event_id, s[1] as sub_query, s[2] as kind, s[3] as weight from p""")
def r17(spark, d):
    from ..operators import queries as Q

    return Q.decompose(_query_rows(spark, d), "q").select("event_id", "sub_query", F.when(F.col("kind").isin("entity", "comparison", "factual"), F.col("kind")).otherwise("single").alias("kind"), "weight")
