"""The steps of search and scoring on their own: rank lists, joins of lists, sorts, unions, and the parts of scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import catalog as C
from ..operators import privacy as V
from ..operators import retrieval as R
from ..registry import query, table
from . import retrieval as P
from .privacy import MAIL, PHONE, SECRETS, planted, PLANTED
from .texts import STRIP, TOKENS


@query("f06_checked_identifiers", "select doc_id, lang from documents where lang = 'en'")
def f06(spark, d):
    """A filter from a user's words: the column's name is checked, the value is a literal whatever it holds."""
    bad = 0
    for name in ("lang; drop table x", "a b", "", "1a"):
        try:
            C.column(name)
        except ValueError:
            bad += 1
    if bad != 4:
        raise AssertionError("a name that is no identifier was taken")
    docs = table(spark, d, "documents")
    return docs.filter(C.equals("lang", "en") & ~C.equals("lang", "en' or '1' = '1")).select("doc_id", "lang")


@query("w01_list_ranks", "select user_id, event_id, (row_number() over (partition by user_id order by value desc, event_id))::integer as rank from events")
def w01(spark, d):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", rank.alias("rank"))


@query("w02_sub_query_ranks", f"with {P.KNN} select id, count(*) as n_lists, min(rank)::integer as best, max(rank)::integer as worst from dense group by 1")
def w02(spark, d):
    """Where each hit stands in the lists of the sub-queries."""
    return P.dense_list(spark, d).groupBy("id").agg(F.count("*").alias("n_lists"), F.min("rank").alias("best"), F.max("rank").alias("worst"))


@query("w03_rank_changes", f"with {P.RERANK} select query_id, id, original_rank, final_rank, original_rank - final_rank as gained from rk")
def w03(spark, d):
    return P.reranked(spark, d).select("query_id", "id", "original_rank", "final_rank", (F.col("original_rank") - F.col("final_rank")).alias("gained"))


@query("w04_rank_scores", f"with {P.KNN} select query_id, id, round(1.0::double / (60 + rank), 9) as score from dense")
def w04(spark, d):
    return P.dense_list(spark, d).select("query_id", "id", F.round(S.rrf(F.col("rank")), 9).alias("score"))


@query("t02_text_top_k", f"with {P.BM25} select query_id, id, score from txt where rank <= 7")
def t02(spark, d):
    return P.text_list(spark, d, 7).select("query_id", "id", "score")


FUSED = f"{P.KNN}, {P.BM25}, {P._fused('dense', 'txt', 0.7, 0.3, 10)}"


def both_lists(spark, d):
    return {"dense": (P.dense_list(spark, d), 0.7), "text": (P.text_list(spark, d), 0.3)}


@query("a11_reciprocal_rank_sums", f"with {FUSED} select query_id, id, rrf_score from f")
def a11(spark, d):
    return R.fuse(both_lists(spark, d)).select("query_id", "id", "rrf_score")


@query("t03_fused_order", f"with {FUSED} select query_id, id, rank from fused")
def t03(spark, d):
    """By fused score, ties by id."""
    return R.top(R.fuse(both_lists(spark, d)), ["query_id"], [F.desc("rrf_score"), F.asc("id")], 10).select("query_id", "id", "rank")


@query("t04_rerank_cut", f"with {P.RERANK} select query_id, id, rerank_score from rk where final_rank <= 3")
def t04(spark, d):
    return P.reranked(spark, d).filter("final_rank <= 3").select("query_id", "id", "rerank_score")


@query("j03_full_outer_lists", f"with {P.KNN}, {P.BM25} select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.id, b.id) as id, a.rank as dense_rank, b.rank as text_rank from dense a full outer join txt b on a.query_id = b.query_id and a.id = b.id")
def j03(spark, d):
    dense = P.dense_list(spark, d).select("query_id", "id", F.col("rank").alias("dense_rank"))
    return dense.join(P.text_list(spark, d).select("query_id", "id", F.col("rank").alias("text_rank")), ["query_id", "id"], "full_outer")


SPL = P.SPARSE.replace("qs as (" + P.QUERIES + "), ", "").replace("qt as", "qt2 as").replace("join qt using", "join qt2 using")


@query("j04_three_lists", f"with {P.KNN}, {P.BM25}, {SPL}, u as (select query_id, id, 1 as k from dense union all select query_id, id, 2 from txt union all select query_id, id, 4 from spl) select query_id, id, sum(k)::bigint as lists from u group by all")
def j04(spark, d):
    """Which of three lists have a hit: one union and one aggregation where chained outer joins would be two shuffles."""
    lists = [(P.dense_list(spark, d), 1), (P.text_list(spark, d), 2), (P.sparse_list(spark, d), 4)]
    parts = [rows.select("query_id", "id", F.lit(k).alias("k")) for rows, k in lists]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("query_id", "id").agg(F.sum("k").alias("lists"))


@query("j05_child_to_parent", "select l.l_orderkey, l.l_linenumber, o.o_custkey, l.l_extendedprice from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey) as n from lineitem) l join orders o on o.o_orderkey = l.l_orderkey where n = 1")
def j05(spark, d):
    """The best child of each parent with the parent's row."""
    best = R.top(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], 1, "n")
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return best.join(parents, "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey", "l_extendedprice")


@query("a35_mean_vector", "select label, pos::integer - 1 as dim, round(avg(v), 6) as mean from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings) group by all")
def a35(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("w09_half_split", "with n as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n from events) select user_id, i <= n // 2 as first_half, count(*) as n, round(avg(value), 6) as mean from n group by all")
def w09(spark, d):
    w = Window.partitionBy("user_id")
    rows = table(spark, d, "events").withColumn("i", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("n", F.count("*").over(w))
    return rows.groupBy("user_id", (F.col("i") <= F.floor(F.col("n") / 2)).alias("first_half")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("w13_greedy_packing", "with recursive e as (select event_type as k, event_id, value, row_number() over (partition by event_type, event_id // 500 order by event_id) as i, event_id // 500 as b from events), w as (select k, b, i, value as used, 0 as part from e where i = 1 union all select e.k, e.b, e.i, case when w.used + e.value > 100 then e.value else w.used + e.value end, case when w.used + e.value > 100 then w.part + 1 else w.part end from w join e on e.k = w.k and e.b = w.b and e.i = w.i + 1) select k, b, max(part)::integer + 1 as n_parts from w group by all")
def w13(spark, d):
    """Values packed in order into parts of at most 100, within blocks: a fold over a block's own list."""
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.floor(F.col("event_id") / 500).alias("b")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("used"))
    step = lambda s, x: F.when((s["n"] == 0) | (s["used"] + x["value"] > 100), F.struct((s["n"] + 1).alias("n"), x["value"].alias("used"))).otherwise(F.struct(s["n"].alias("n"), (s["used"] + x["value"]).alias("used")))
    return g.select("k", "b", F.aggregate("x", start, step, lambda s: s["n"]).alias("n_parts"))


@query("w16_overlapping_findings", f"with {PLANTED} select doc_id, length(regexp_replace(regexp_replace(text, '{MAIL}', '#', 'g'), '{PHONE}', '#', 'g'))::bigint as n_chars from d where doc_id % {len(SECRETS)} = {len(SECRETS) - 1}")
def w16(spark, d):
    """What redaction leaves of each text when every finding, overlapping ones merged, is one sign."""
    docs = planted(spark, d).filter(F.col("doc_id") % len(SECRETS) == len(SECRETS) - 1)
    found = V.findings(docs, [p for p in V.PATTERNS if p[0] in ("EMAIL", "PHONE")])
    gone = V.redact(docs, found.withColumn("kind", F.lit("X")))
    return gone.select("doc_id", F.char_length(F.replace("text", F.lit("[REDACTED-X]"), F.lit("#"))).cast("long").alias("n_chars"))


@query("w18_breakpoints", "with recursive p as (select distinct user_id, floor(epoch(ts))::bigint as t from events), c as (select user_id, min(t) as s from p group by 1 union all select c.user_id, (select min(t) from p where p.user_id = c.user_id and p.t >= c.s + 21600) from c where exists (select 1 from p where p.user_id = c.user_id and p.t >= c.s + 21600)) select user_id, count(*) as n_breaks from c group by 1")
def w18(spark, d):
    from ..operators import notes as N

    e = table(spark, d, "events").select("user_id", F.unix_timestamp("ts").alias("t"))
    return N.chapters(e, "user_id", "t", 21600.0).groupBy("user_id").agg(F.count("*").alias("n_breaks"))


@query("u01_scope_union", """with l as (select doc_id, max(toxic) as toxic from labels group by 1), s as (select d.doc_id, d.source, d.n_chars, case when toxic = 1 then 'restricted' else 'main' end as scope from documents d left join l using (doc_id))
select source, lang_key, doc_id from (select source, n_chars % 50 as lang_key, doc_id, row_number() over (partition by source, n_chars % 50 order by (scope = 'restricted') desc, n_chars, doc_id) as n from s) where n = 1""")
def u01(spark, d):
    """Of rows with the same key the restricted one wins, then the shorter one."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = table(spark, d, "documents").join(labels, "doc_id", "left").withColumn("lang_key", F.col("n_chars") % 50)
    order = [F.desc(F.coalesce(F.col("toxic") == 1, F.lit(False))), F.asc("n_chars"), F.asc("doc_id")]
    return R.top(rows, ["source", "lang_key"], order, 1, "n").select("source", "lang_key", "doc_id")


@query("u08_distinct_shingles", rf"with w as (select doc_id, {TOKENS.format('lower(text)')} as w from documents) select doc_id, len(w)::bigint as n_words, len(list_distinct(w))::bigint as n_distinct from w")
def u08(spark, d):
    w = T.tokens(F.lower("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query("u09_concatenated_findings", f"with {PLANTED}, t(term) as (values ('worthless'), ('license')), m as (select doc_id, 'EMAIL' as kind, unnest(regexp_extract_all(text, '{MAIL}')) as v from d union all select doc_id, 'CUSTOM', term from d join t on contains(lower(text), term)) select doc_id, kind, count(*) as n from m group by all")
def u09(spark, d):
    """Findings of patterns and of a dictionary as one list."""
    docs = planted(spark, d)
    a = V.findings(docs, [p for p in V.PATTERNS if p[0] == "EMAIL"]).select("doc_id", "kind")
    terms = spark.createDataFrame([("worthless", "CUSTOM"), ("license", "CUSTOM")], "term string, kind string")
    return a.unionByName(V.custom_terms(docs, terms).select("doc_id", "kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("x16_completeness", rf"""with b as (select doc_id, {STRIP.format("text")} as t from documents)
select doc_id, case when t = '' then 0.0::double else ((case when regexp_matches(t, '^[\p{{Lu}}\-*•0-9#]') then 4 else 0 end) + (case when regexp_matches(t, '[.!?:;)"'']$') then 4 else 0 end) + (case when len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: length({STRIP.format("s")}) > 10)) > 0 then 2 else 0 end))::double / 10 end as score from b""")
def x16(spark, d):
    return table(spark, d, "documents").select("doc_id", T.completeness(F.col("text")).alias("score"))


@query("x17_length_adequacy", rf"with n as (select doc_id, len({TOKENS.format('text')}) as n from documents) select doc_id, round(case when n < 5 then 0.1::double when n < 20 then 0.3::double + (n - 5) * 0.03::double when n <= 500 then 1.0::double else greatest(0.3::double, 1.0::double - (n - 500) * 0.001::double) end, 6) as score from n")
def x17(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.length_adequacy(F.col("text")), 6).alias("score"))


@query("x18_coherence", rf"""with b as (select doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {STRIP.format("s")}), lambda s: length(s) > 3), lambda s: len({TOKENS.format("s")})::double) as z from documents),
m as (select *, case when len(z) > 0 then list_sum(z) / len(z) end as mean from b), v as (select *, case when len(z) > 0 then sqrt(list_sum(list_transform(z, lambda x: (x - mean) * (x - mean))) / len(z)) end as sd from m)
select doc_id, case when len(z) = 0 then 0.2::double else ((case when mean >= 8 and mean <= 25 then 5 when mean >= 5 and mean <= 40 then 3 else 1 end) + (case when len(z) >= 2 then 3 else 0 end) + (case when len(z) >= 2 and sd < mean * 0.5::double then 2 when len(z) >= 2 and sd < mean then 1 else 0 end))::double / 10 end as score from v""")
def x18(spark, d):
    return table(spark, d, "documents").select("doc_id", T.coherence(F.col("text")).alias("score"))


@query("p05_pluggable_searcher", f"with {P.KNN}, {P.BM25} select 'dense' as searcher, query_id, id from dense where rank <= 3 union all select 'text', query_id, id from txt where rank <= 3")
def p05(spark, d):
    """Searchers are functions of the number of hits that give ``query_id, id, rank``; the caller does not know which."""
    searchers = {"dense": lambda k: P.dense_list(spark, d, k), "text": lambda k: P.text_list(spark, d, k)}
    parts = [f(3).select(F.lit(name).alias("searcher"), "query_id", "id") for name, f in searchers.items()]
    return parts[0].unionByName(parts[1])


@query("p06_custom_patterns", r"select doc_id, 'TICKET' as kind, v as value, count(*) as n from (select doc_id, unnest(regexp_extract_all(concat(text, ' ref AB-', doc_id % 1000 + 1000), '\b[A-Z]{2}-\d{4}\b')) as v from documents) group by all")
def p06(spark, d):
    """A user's own kinds of findings beside the fixed ones."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" ref AB-"), (F.col("doc_id") % 1000 + 1000).cast("string")).alias("text"))
    found = V.findings(docs, [("TICKET", r"\b(?-i:[A-Z]{2})-\d{4}\b", 0.8)])
    return found.groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))
