"""Quality plans: links, numbers that conflict, coverage, batches, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import verification as V
from ..registry import query, table

# the pages link to paths alone: each gets its address in all three forms, and one to the local host
PAGES = """pg as (select page_id, concat(html, ' <a href="', url, '">x</a> [m](', url, '&m=1) see ', url, '. http://localhost/x') as html from pages)"""
LINKS = PAGES + r""", u as (select distinct page_id, regexp_replace(unnest(regexp_extract_all(html, 'https?://[^\s"''<>()\[\]]+')), '[.,;:!?]+$', '') as url from pg), l as (select * from u where not regexp_matches(url, '^https?://(localhost|127\.0\.0\.1)'))"""


def links(spark, d):
    page = F.concat("html", F.lit(' <a href="'), "url", F.lit('">x</a> [m]('), "url", F.lit("&m=1) see "), "url", F.lit(". http://localhost/x"))
    return table(spark, d, "pages").select("page_id", F.explode(V.urls(page)).alias("url"))


@query("x23_urls", f"with {LINKS} select page_id, url from l")
def x23(spark, d):
    return links(spark, d)


CODE = "(200 + (length(url) * 7) % 300)::integer"


@query("x24_http_status", f"with {LINKS} select page_id, url, case when {CODE} between 200 and 299 then 'ok' when {CODE} between 300 and 399 then 'redirect' else 'broken' end as status from l")
def x24(spark, d):
    code = (200 + (F.char_length("url") * 7) % 300).cast("int")
    return links(spark, d).select("page_id", "url", L.http_status(code).alias("status"))


@query("a26_link_report", f"with {LINKS}, s as (select page_id, case when {CODE} between 200 and 299 then 'ok' when {CODE} between 300 and 399 then 'redirect' else 'broken' end as status from l) select p.page_id, count(status) as n_links, coalesce(sum((status = 'ok')::bigint), 0)::bigint as n_ok, case when count(status) = 0 then 100.0::double else round(100.0::double * sum((status = 'ok')::bigint)::bigint / count(status), 4) end as health from pages p left join s using (page_id) group by 1")
def a26(spark, d):
    s = table(spark, d, "pages").select("page_id").join(x24(spark, d), "page_id", "left")
    ok = F.sum((F.col("status") == "ok").cast("long"))
    n = F.count("status")
    return s.groupBy("page_id").agg(n.alias("n_links"), F.coalesce(ok, F.lit(0).cast("long")).alias("n_ok"), F.when(n == 0, F.lit(100.0)).otherwise(F.round(100.0 * ok / n, 4)).alias("health"))


NUMS = "n as (select conv_id, unnest(" + " || ".join("list_transform(regexp_extract_all(text, '(?i){1}', 1), lambda v: struct_pack(type := '{0}', value := v))".format(t, p.replace("\\\\", "\\")) for t, p in V.NUMBERS) + ") as f from (select page_id as conv_id, concat(html, ' version 1.', page_id % 3, ' or version 2.0, 10 users, ', 10 + page_id % 2, ' users, 5 % in ', page_id % 4, ' days and 3 days') as text from pages))"


def stated(spark, d):
    """Pages with numbers of several kinds, some of which differ from each other."""
    n = lambda k: (F.col("page_id") % k).cast("string")
    said = F.concat("html", F.lit(" version 1."), n(3), F.lit(" or version 2.0, 10 users, "), (10 + F.col("page_id") % 2).cast("string"), F.lit(" users, 5 % in "), n(4), F.lit(" days and 3 days"))
    return table(spark, d, "pages").select("page_id", said.alias("html"))


@query("x21_numeric_facts", f"with {NUMS} select conv_id as page_id, f.type as type, f.value as value, count(*) as n from n group by all")
def x21(spark, d):
    return V.numbers(stated(spark, d), "html", ["page_id"]).groupBy("page_id", "type", "value").agg(F.count("*").alias("n"))


@query("a24_numeric_conflicts", f"with {NUMS} select conv_id as page_id, f.type as type, count(distinct f.value) as n_values, array_to_string(list_sort(list_distinct(list(f.value)))[1:2], '|') as evidence from n group by all having count(distinct f.value) > 1")
def a24(spark, d):
    g = V.numbers(stated(spark, d), "html", ["page_id"]).groupBy("page_id", "type")
    return g.agg(F.countDistinct("value").alias("n_values"), F.array_join(F.slice(F.array_sort(F.collect_set("value")), 1, 2), "|").alias("evidence")).filter("n_values > 1")


@query("a23_conflict_report", f"with {NUMS}, c as (select conv_id, f.type as type, count(distinct f.value) as k from n group by all) select type, case when k > 3 then 'high' else 'medium' end as severity, count(*) as n from c where k > 1 group by all")
def a23(spark, d):
    return a24(spark, d).groupBy("type", F.when(F.col("n_values") > 3, "high").otherwise("medium").alias("severity")).agg(F.count("*").alias("n"))


@query("a28_batch_gate", """with l as (select doc_id, max(toxic) as toxic from labels group by 1), r as (select d.*, coalesce(toxic = 1, false) as s, count(*) over (partition by sha256(text)) > 1 as dup from documents d left join l using (doc_id)),
m as (select count(*) as n, round(avg(s::int), 6) as sensitive_rate, sum((n_chars * 3 > 10000 and n_chars < 100)::bigint)::bigint as n_empty, sum((n_chars < 8)::bigint)::bigint as n_errors, round(avg(dup::int), 6) as duplicate_rate from r)
select *, case when sensitive_rate > 0.5 or n_errors > 0 or n_empty > 0 or (n > 5 and duplicate_rate > 0.8) then 'review' else 'pass' end as verdict from m""")
def a28(spark, d):
    from pyspark.sql import Window

    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    same = F.count("*").over(Window.partitionBy(T.content_hash(F.col("text")))) > 1
    rows = table(spark, d, "documents").withColumn("is_duplicate", same).join(labels, "doc_id", "left")
    return V.batch_gate(rows.select(F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_sensitive"), (F.col("n_chars") * 3).alias("file_size"), "n_chars", "is_duplicate", (F.col("n_chars") < 8).alias("has_error")))


@query("a29_commit_check", "select o_orderkey, count(l_orderkey) as n_children, case when count(l_orderkey) = 0 then 'fail' else 'ok' end as status from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def a29(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    k = F.coalesce("n", F.lit(0).cast("long"))
    return table(spark, d, "orders").join(n, "o_orderkey", "left").select("o_orderkey", k.alias("n_children"), F.when(k == 0, "fail").otherwise("ok").alias("status"))


SP = r"'[\s\p{Z}]+'"
COV = rf"""s as (select doc_id, text, list_filter(regexp_split_to_array(lower(text), {SP}), lambda x: x <> '') as w, substr(text, 1, (length(text) * (50 + doc_id % 51) // 100)::bigint) as kept from documents),
c as (select doc_id, round(length(kept)::double / greatest(length(text), 1), 3) as char_ratio, round(len(list_intersect(list_distinct(w), list_distinct(list_filter(regexp_split_to_array(lower(kept), {SP}), lambda x: x <> ''))))::double / greatest(len(list_distinct(w)), 1), 3) as word_coverage from s),
v as (select *, case when char_ratio >= 0.9 and word_coverage >= 0.85 then 'good' when char_ratio >= 0.7 and word_coverage >= 0.7 then 'acceptable' when char_ratio > 0 then 'degraded' else 'missing' end as status from c)"""


@query("x53_coverage", f"with {COV} select doc_id, char_ratio, word_coverage, status from v")
def x53(spark, d):
    """Each text against a copy cut at 50 to 100 percent."""
    n = F.char_length("text")
    kept = F.expr("substring(text, 1, cast(floor(char_length(text) * (50 + doc_id % 51) / 100) as int))")
    words = lambda c: F.array_distinct(T.tokens(F.lower(c)))
    rows = table(spark, d, "documents").select("doc_id", "text", kept.alias("kept"))
    chars = F.round(F.char_length("kept") / F.greatest(n, F.lit(1)), 3)
    cover = F.round(F.size(F.array_intersect(words(F.col("text")), words(F.col("kept")))) / F.greatest(F.size(words(F.col("text"))), F.lit(1)), 3)
    got = rows.select("doc_id", chars.alias("char_ratio"), cover.alias("word_coverage"))
    return got.withColumn("status", V.coverage_status(F.col("char_ratio"), F.col("word_coverage")))


@query("a34_verification_rollup", f"with {COV} select status, count(*) as n from v group by 1")
def a34(spark, d):
    return x53(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("w15_word_samples", rf"with s as (select doc_id, unnest(range(0, len(w), 100)) as pos, w from (select doc_id, list_filter(regexp_split_to_array(text, {SP}), lambda x: x <> '') as w from documents)) select doc_id, pos::integer as pos, w[pos + 1] as word from s")
def w15(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "word"))
    return words.filter("pos % 100 = 0")


@query("x54_context_recall", rf"""with w as (select item_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) as w from benchmark), p as (select a.item_id, a.w as g, b.w as c from w a join w b on b.item_id = a.item_id + 1)
select item_id, round(least(len(list_intersect(g, c)) / greatest(0.5::double * len(g), 1.0::double), 1.0::double), 6) as recall from p""")
def x54(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.words(F.col("text"))).alias("g"))
    c = w.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("c"))
    recall = F.least(F.size(F.array_intersect("g", "c")) / F.greatest(0.5 * F.size("g"), F.lit(1.0)), F.lit(1.0))
    return w.join(c, "item_id").select("item_id", F.round(recall, 6).alias("recall"))


@query("a37_evaluation_mean", "select event_id, round(0.25::double * s + 0.25::double * (1 - s) + 0.30::double * s * s + 0.20::double, 6) as overall from (select event_id, least(value / 500, 1.0::double) as s from events)")
def a37(spark, d):
    s = F.least(F.col("value") / 500, F.lit(1.0))
    return table(spark, d, "events").withColumn("s", s).select("event_id", F.round(0.25 * F.col("s") + 0.25 * (1 - F.col("s")) + 0.30 * F.col("s") * F.col("s") + 0.20, 6).alias("overall"))


@query("a39_relevance_counters", "select sum((value / 100 > 0.7)::bigint)::bigint as correct, sum((value / 100 between 0.3 and 0.7)::bigint)::bigint as ambiguous, sum((value / 100 < 0.3)::bigint)::bigint as incorrect from events")
def a39(spark, d):
    s = F.col("value") / 100
    return table(spark, d, "events").agg(F.sum((s > 0.7).cast("long")).alias("correct"), F.sum(s.between(0.3, 0.7).cast("long")).alias("ambiguous"), F.sum((s < 0.3).cast("long")).alias("incorrect"))


@query("j24_citation_check", "select b.item_id, b.item_id * 7 as source_id, d.doc_id is not null as known, coalesce(contains(d.text, substr(b.text, 1, 40)), false) as verbatim from benchmark b left join documents d on d.doc_id = b.item_id * 7")
def j24(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("source"))
    cites = table(spark, d, "benchmark").withColumn("source_id", F.col("item_id") * 7).join(docs, "source_id", "left")
    return cites.select("item_id", "source_id", F.col("source").isNotNull().alias("known"), F.coalesce(F.col("source").contains(F.substring("text", 1, 40)), F.lit(False)).alias("verbatim"))


@query("x57_fragmentation", "select source, least(1.0::double, (count(*) - count(*) // 2)::double / (count(*) // 2)) as fragmentation from documents group by 1")
def x57(spark, d):
    n = F.count("*")
    want = F.floor(n / 2)
    return table(spark, d, "documents").groupBy("source").agg(F.least(F.lit(1.0), (n - want) / want).alias("fragmentation"))
