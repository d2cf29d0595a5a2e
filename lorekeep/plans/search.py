"""Plans of the whole search pipeline and of its variants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import hooks as H
from ..functions import vectors as V
from ..operators import retrieval as R
from ..operators import search as Q
from ..registry import query, table
from . import graph as G
from . import retrieval as P

DAY = "'2024-06-01'::timestamp - to_days((doc_id % 3000)::integer)"
WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


def _wide(sql: str, k: int) -> str:
    return sql.replace("rank <= 30", f"rank <= {3 * k}").replace("qualify rank <= 10)", f"qualify rank <= {k})")


def dated(spark, d):
    made = F.lit("2024-06-01").cast("timestamp") - F.make_dt_interval((F.col("doc_id") % 3000).cast("int"))
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang", made.alias("modified"))


MULT = f"greatest(1.0::double / (1.0::double + least(greatest((doc_id % 3000)::bigint, 0) / 365.25::double, 10.0::double) * 0.1::double), 0.1::double)"
PIPE = f"""pool as (select * from documents where lang in ('en', 'de', 'es')), {P.KNN}, {P.BM25}, {P._fused('dense', 'txt', P.WD, P.WT, 10)}"""
PIPE = _wide(PIPE, 50).replace("from embeddings e, qv q", "from embeddings e, qv q where e.vec_id in (select doc_id from pool)").replace("as w from documents)", "as w from pool)")
PIPE = PIPE.replace("where item_id % 100 = 0", "where item_id % 100 = 0 and item_id % 3 <> 1").replace("where vec_id % 100 = 0", "where vec_id % 100 = 0 and vec_id % 3 <> 1")
PIPE += f""", rr as (select f.query_id, f.id, coalesce(round(len(list_intersect({WORDS.format('q.qtext')}, {WORDS.format('substr(d.text, 1, 2048)')})) / greatest(len({WORDS.format('q.qtext')}), 1), 6), 0.0::double) as rerank_score, d.source, d.doc_id from fused f join qs q using (query_id) join pool d on d.doc_id = f.id),
rk as (select *, row_number() over (partition by query_id order by rerank_score desc, id) as place from rr qualify place <= 5),
ag as (select *, round(rerank_score * {MULT}, 6) as score from rk), rs as (select *, (row_number() over (partition by query_id order by score desc, id))::integer as rank from ag),
l as (select *, case when score > 0.7 then 'correct' when score >= 0.3 then 'ambiguous' else 'incorrect' end as rel from rs), kp as (select *, sum((rel <> 'incorrect')::int) over (partition by query_id) as kept, row_number() over (partition by query_id order by rank) as n from l)"""


@query("r21_search_pipeline", f"with {PIPE} select query_id, id, score, case when kept = 0 then 'fallback' else rel end as relevance, rank, concat('[', rank::varchar, '] ', source) as citation from kp where rel <> 'incorrect' or (kept = 0 and n <= 3)")
def r21(spark, d):
    """Queries with a text; those of restricted scope without the right for it get nothing."""
    third = F.col("query_id") % 3
    q = P.texts(spark, d).join(P.vecs(spark, d), "query_id", "left").withColumn("scope", F.when(third == 0, "main").otherwise("restricted"))
    q = q.withColumn("rights", F.when(third == 1, F.array(F.lit("search_main"))).otherwise(F.array(F.lit("search_main"), F.lit("search_restricted"))))
    return Q.search(dated(spark, d), table(spark, d, "embeddings"), q, F.lit("2024-06-01").cast("timestamp"), tags=F.col("lang").isin("en", "de", "es"))


@query("r24_topic_context", f"""with {_wide(P.BM25, 10).replace('rank <= 30', 'rank <= 20')}, u as (select query_id, rank, text, source, sum(length(text) // 4) over (partition by query_id order by rank rows unbounded preceding) as used from txt join documents on doc_id = id)
select query_id, md5(string_agg(text, concat(chr(10), chr(10), '---', chr(10), chr(10)) order by rank)) as context, array_to_string(list_sort(list_distinct(list(source))), ',') as citations, max(used)::bigint as n_tokens, count(*)::integer as n_chunks from u where used <= 60000 group by query_id""")
def r24(spark, d):
    found = P.text_list(spark, d, 20).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("citation")), "id")
    got = Q.topic_context(found, 60_000)
    return got.select("query_id", F.md5(F.col("context").cast("binary")).alias("context"), F.array_join("citations", ",").alias("citations"), "n_tokens", "n_chunks")


@query("r26_semantic_entities", f"""with {G.EDGES}, {P.QV}, s as (select q.query_id, concat('s', e.vec_id) as name, greatest(0.0::double, round(greatest(0.0::double, 1 - list_sum(list_transform(list_zip(e.embedding, q.qvec), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))), 6)) as similarity from embeddings e, qv q),
b as (select * from s qualify row_number() over (partition by query_id order by similarity desc, name) <= 5), g as (select object as name, count(distinct subject) as n from e group by 1)
select query_id, b.name, similarity, coalesce(n, 0) as n_neighbours from b left join g on g.name = b.name""")
def r26(spark, d):
    entities = table(spark, d, "embeddings").select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("vec"))
    return Q.similar_entities(entities, P.vecs(spark, d), G.edges(spark, d), 5)


@query("r30_rest_search", f"with {_wide(P.HYBRID, 20)} select query_id, id, rrf_score as score, rank, max(rank) over (partition by query_id) > 10 as has_more from fused qualify rank > 5 and rank <= 10")
def r30(spark, d):
    """The plain variant: hybrid alone, ten rows beyond what is asked for, a page of it; the score is the fusion's."""
    q = P.texts(spark, d).join(P.vecs(spark, d), "query_id", "full_outer")
    found = R.hybrid(None, None, q, 5 + 5 + 10, lists=P.indexed(spark, d))
    return Q.page(found, 5, 5).select("query_id", "id", F.col("rrf_score").alias("score"), "rank", "has_more")


@query("r30_vector_fallback", f"with {P.KNN} select query_id, id, round(greatest(0.0::double, 1 - distance), 6) as score, rank from dense where rank <= 10")
def r30b(spark, d):
    """Without a full-text index: nearest vectors, scored by their distance."""
    return P.dense_list(spark, d, 10).select("query_id", "id", F.round(F.greatest(F.lit(0.0), 1 - F.col("distance")), 6).alias("score"), "rank")


@query("r31_plain_search", f"with {P.KNN} select query_id, id, source, distance, rank from dense join documents on doc_id = id where rank <= 5")
def r31(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return P.dense_list(spark, d, 5).join(docs, "id").select("query_id", "id", "source", "distance", "rank")


VEC = r"""w as (select item_id, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: (('0x' || substr(md5(w), 1, 2))::integer) % 64) as spots from benchmark),
c as (select item_id, list_transform(range(64), lambda i: len(list_filter(spots, lambda p: p = i))::double) as v from w), n as (select item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as length from c)"""


@query("r32_dense_embedding", f"with {VEC}, u as (select item_id, unnest(range(64)) as dim, unnest(v) as x, length from n) select item_id, dim::integer as dim, round(x / length, 6) as weight from u where x > 0")
def r32(spark, d):
    """The stand-in embedder's non-zero places."""
    v = table(spark, d, "benchmark").select("item_id", F.posexplode(H.word_vector(F.col("text"))).alias("dim", "weight"))
    return v.filter("weight > 0").select("item_id", "dim", F.round("weight", 6).alias("weight"))


@query("r33_dual_embedding", rf"with {VEC}, s as (select item_id, count(*) as n_terms, round(sum(round(ln(1 + n)::double, 9)::decimal(28,9))::double, 6) as mass from (select item_id, term, count(*) as n from (select item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) as term from benchmark) group by all) group by 1) select item_id, len(list_filter(v, lambda x: x > 0))::integer as n_dims, n_terms, mass from n join s using (item_id)")
def r33(spark, d):
    """Dense and sparse form of a text in one pass."""
    both = table(spark, d, "benchmark").select("item_id", H.word_vector(F.col("text")).alias("v"), H.word_weights(F.col("text")).alias("s"))
    mass = F.aggregate(F.map_values("s"), F.lit(0).cast("decimal(28,9)"), lambda a, x: (a + F.round(x, 9).cast("decimal(28,9)")).cast("decimal(28,9)"))
    return both.select("item_id", F.size(F.filter("v", lambda x: x > 0)).alias("n_dims"), F.size("s").cast("long").alias("n_terms"), F.round(mass.cast("double"), 6).alias("mass"))


@query("t05_resort_after_boost", f"with {P.KNN}, b as (select query_id, id, round(distance * (1 + (id % 7)), 6) as score from dense) select query_id, id, score, (row_number() over (partition by query_id order by score desc, id))::integer as rank from b")
def t05(spark, d):
    boosted = P.dense_list(spark, d).select("query_id", "id", F.round(F.col("distance") * (1 + F.col("id") % 7), 6).alias("score"))
    return Q.resorted(boosted, "score")


@query("u05_related_minus_known", f"with {G.NAMES}, k as (select distinct doc_id, lower(name) as key from m), t as (select key from k where doc_id % 100 = 0) select distinct doc_id from k where key in (select key from t) and doc_id not in (select vec_id from embeddings)")
def u05(spark, d):
    """Documents that share a name with the stated ones, without those already known."""
    k = G.names(spark, d).select("doc_id", F.lower("name").alias("key")).distinct()
    related = k.join(k.filter("doc_id % 100 = 0").select("key").distinct(), "key", "left_semi").select("doc_id").distinct()
    return related.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("t06_best_facts", "select conv_id, turn, n_words from (select conv_id, turn, len(regexp_extract_all(text, '[a-zA-Z]+'))::integer as n_words from conversations) order by n_words desc, turn desc, conv_id limit 25")
def t06(spark, d):
    """A top-k by two keys: the most words, then the latest turn."""
    n = F.size(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0)))
    return table(spark, d, "conversations").select("conv_id", "turn", n.alias("n_words")).orderBy(F.desc("n_words"), F.desc("turn"), "conv_id").limit(25)


@query("t07_newest_first", "select o_orderkey, (row_number() over (order by o_orderdate desc, o_orderkey))::integer as place from orders qualify place <= 100")
def t07(spark, d):
    top = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("place"))  # of the hundred rows alone


EXEMPLARS = "x as (select label, vec_id as ex, embedding as xe from embeddings where vec_id % 100 = 0)"


@query("j23_taxonomy_exemplars", f"""with {EXEMPLARS}, s as (select e.vec_id, x.label as tag, round(list_sum(list_transform(list_zip(e.embedding, x.xe), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(e.embedding, lambda z: z::double * z::double))) * sqrt(list_sum(list_transform(x.xe, lambda z: z::double * z::double)))), 6) as c from embeddings e, x)
select vec_id, tag, max(c) as similarity from s group by all""")
def j23(spark, d):
    """Every vector against the exemplars of each tag, in blocks; the nearest one counts."""
    from ..operators import vector_index as VI

    e = table(spark, d, "embeddings")
    exemplars = e.filter("vec_id % 100 = 0").select(F.col("label").alias("tag"), F.col("embedding").alias("qvec"))
    return VI.best_of_groups(e, exemplars).select(F.col("id").alias("vec_id"), "tag", "similarity")


@query("j11_semantic_conflicts", """with t as (select vec_id, embedding, text from embeddings join documents on doc_id = vec_id), i as (select vec_id, embedding, text from t union all select vec_id + 1000000, list_transform(range(1, len(embedding) + 1), lambda i: case when i > vec_id % 24 then embedding[i] else 0::float end), concat('never ', text) from t),
p as (select a.vec_id as left_id, b.vec_id as right_id, a.text as x, b.text as y, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda z: z::double * z::double))) * sqrt(list_sum(list_transform(b.embedding, lambda z: z::double * z::double)))), 6) as cosine from i a join i b on a.vec_id < b.vec_id),
c as (select left_id, right_id, cosine, list_distinct(list_filter(regexp_split_to_array(lower(x), '[\\s\\p{Z}]+'), lambda w: w <> '')) as wa, list_distinct(list_filter(regexp_split_to_array(lower(y), '[\\s\\p{Z}]+'), lambda w: w <> '')) as wb from p where cosine >= 0.8)
select left_id, right_id, cosine, 0.6::double as confidence from c where list_has_any(wa, NEG) <> list_has_any(wb, NEG) and len(list_filter(list_intersect(wa, wb), lambda w: not list_contains(NEG || ['the', 'a', 'is', 'are', 'was', 'were'], w))) > 3""".replace("NEG", "['not','never','no','none','cannot','don''t','doesn''t','won''t','isn''t','aren''t']"))
def j11(spark, d):
    """Texts on one topic (vectors at a cosine of 0.8 or more) of which one denies: each text against variants of all."""
    from ..operators import quality as K

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    t = table(spark, d, "embeddings").select("vec_id", "embedding").join(docs, "vec_id")
    lacking = F.transform("embedding", lambda x, i: F.when(i >= F.col("vec_id") % 24, x).otherwise(F.lit(0.0).cast("float")))
    variant = t.withColumns({"embedding": lacking, "text": F.concat(F.lit("never "), "text")}).withColumn("vec_id", F.col("vec_id") + 1000000)
    return K.semantic_conflicts(t.unionByName(variant), 0.8, every=True)
