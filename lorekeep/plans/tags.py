"""Tag plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tags as G
from ..operators import terms as TM
from ..registry import query, table

TAX = [("articles", "the"), ("articles", "der"), ("articles", "la"), ("links", "and"), ("links", "und"), ("links", "et"), ("abuse", "idiot"), ("abuse", "scum"), ("legal", "license")]
TAX_SQL = "tax(tag, keyword) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in TAX) + ")"
BRIDGE = "br as (select distinct o_custkey as d, o_orderpriority as tag from orders)"


@query("x40_keyword_tags", rf"""with {TAX_SQL}, w as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as w from documents), c as (select doc_id, keyword, count(*) as k, any_value(n) as n from (select doc_id, len(w) as n, unnest(w) as keyword from w) group by all),
t as (select tag, count(*) as n_keywords from tax group by 1), h as (select doc_id, tag, sum(k)::bigint as n_hits, count(*) as n_found, any_value(n) as n from c join tax using (keyword) group by all)
select doc_id, tag, n_hits, n_keywords, round((least(1.0::double, n_hits / (n::double / 100 + 1)) + least(1.0::double, n_found::double / n_keywords)) / 2, 6) as score from h join t using (tag)""")
def x40(spark, d):
    return G.keyword_scores(table(spark, d, "documents"), spark.createDataFrame(TAX, "tag string, keyword string"))


@query("x41_hybrid_tag_score", "with k as (select doc_id as id, n_chars / 40000.0::double as ks from documents), e as (select vec_id as id, label / 10.0::double as es from embeddings) select coalesce(k.id, e.id) as id, round(0.4::double * coalesce(ks, 0) + 0.6::double * coalesce(es, 0), 6) as score from k full join e on k.id = e.id")
def x41(spark, d):
    k = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 40000).alias("ks"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") / 10).alias("es"))
    return k.join(e, "id", "full_outer").select("id", F.round(0.4 * F.coalesce("ks", F.lit(0.0)) + 0.6 * F.coalesce("es", F.lit(0.0)), 6).alias("score"))


@query("j18_tag_cooccurrence", f"with {BRIDGE} select a.tag, b.tag as other, count(*) as n from br a join br b on a.d = b.d and a.tag <> b.tag group by 1, 2")
def j18(spark, d):
    return G.cooccurrence(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("x39_tag_suggestions", f"with {BRIDGE}, c as (select a.tag, b.tag as other, count(*) as n from br a join br b on a.d = b.d and a.tag <> b.tag group by 1, 2) select tag, other, least(0.8::double, 0.3::double + 0.1::double * (n // 300)) as confidence from c")
def x39(spark, d):
    return j18(spark, d).select("tag", "other", F.least(F.lit(0.8), 0.3 + 0.1 * F.floor(F.col("n") / 300)).alias("confidence"))


@query("j22_keyword_documents", f"with {TAX_SQL} select doc_id, tag, keyword, ((length(text) - length(replace(lower(text), keyword, ''))) // length(keyword))::bigint as n from documents join tax on contains(lower(text), keyword)")
def j22(spark, d):
    tax = spark.createDataFrame([(keyword, tag) for tag, keyword in TAX], "term string, kind string")
    return TM.counted(table(spark, d, "documents"), tax).select("doc_id", F.col("kind").alias("tag"), F.col("term").alias("keyword"), "n")


@query("a30_correction_patterns", "select l_returnflag as ai, l_linestatus as human, count(*) as n, max(l_shipdate) as last_seen from lineitem group by all")
def a30(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("ai"), F.col("l_linestatus").alias("human")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last_seen"))


@query("a31_learned_rules", "with g as (select case when l_linenumber % 2 = 0 then 'folder' else 'category' end as kind, l_returnflag as ai, l_linestatus as human, count(*) as n from lineitem group by all) select kind, ai, human, n, round(n::double / sum(n) over (partition by kind), 6) as confidence from g where n >= 2")
def a31(spark, d):
    li = table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "folder").otherwise("category")
    return G.learned_rules(li.select(kind.alias("kind"), F.col("l_returnflag").alias("ai"), F.col("l_linestatus").alias("human")))


@query("a32_tag_stats", "select p_type as tag, count(*) as n from part group by 1")
def a32(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("tag")).agg(F.count("*").alias("n"))


@query("x59_tag_tree", "with recursive t(node, parent) as (select concat('n', n_nationkey), concat('r', n_regionkey) from nation union all select concat('r', r_regionkey), 'root' from region), w(node, depth) as (select 'root', 0 union all select t.node, depth + 1 from t join w on t.parent = w.node) select node, depth from w")
def x59(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("_lk_nation")
    table(spark, d, "region").createOrReplaceTempView("_lk_region")
    return spark.sql("""with recursive t(node, parent) as (select concat('n', n_nationkey), concat('r', n_regionkey) from _lk_nation union all select concat('r', r_regionkey), 'root' from _lk_region),
        w(node, depth) as (select 'root', 0 union all select t.node, depth + 1 from t join w on t.parent = w.node) select node, depth from w""")
