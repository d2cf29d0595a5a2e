"""Plans over dates, notes, transcripts, facts and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import notes as N
from ..operators import retrieval as R
from ..registry import query, table
from . import retrieval as P

# order dates written in ten ways, by order: what each says, the surest date in it, and how sure that is
DATED = """t as (select o_orderkey, o_orderkey % 10 as k, o_orderdate::date as day, date_trunc('month', o_orderdate)::date as month, date_trunc('year', o_orderdate)::date as year, year(o_orderdate) >= 2000 as late from orders)"""


def dated(spark, d):
    k, day = F.col("o_orderkey") % 10, F.col("o_orderdate")
    said = [("due ", "yyyy-MM-dd", " ok"), ("on ", "M/d/yyyy", " or 2031"), ("since ", "yyyy-MM", " then"), None, None, ("at ", "yyyy-MM-dd'T'10:30", " sharp"), ("by ", "MMMM d, yyyy", "."), ("by ", "MMM d yyyy", "."), ("am ", "d.M.yyyy", " um"), ("in ", "MMMM yyyy", "!")]
    text = F.when(k == 3, F.lit("year 2024 only"))
    for i, x in enumerate(said):
        if x is not None:
            text = text.when(k == i, F.concat(F.lit(x[0]), F.date_format(day, x[1]), F.lit(x[2])))
    return table(spark, d, "orders").select("o_orderkey", text.otherwise("none").alias("text"))


@query("x19_best_date", f"""with {DATED} select o_orderkey, strftime(case when k in (0, 1, 5, 6, 7, 8) then day when k in (2, 9) then month when k = 3 then '2024-01-01'::date end, '%Y-%m-%d') as found,
 case k when 0 then 0.9::double when 1 then 0.6::double when 2 then 0.5::double when 3 then 0.3::double when 5 then 0.95::double when 6 then 0.85::double when 7 then case when month(day) = 5 then 0.85::double else 0.8::double end when 8 then 0.6::double when 9 then 0.5::double end as confidence from t""")
def x19(spark, d):
    best = dated(spark, d).select("o_orderkey", D.best_date(F.col("text")).alias("b"))
    return best.select("o_orderkey", F.date_format("b.date", "yyyy-MM-dd").alias("found"), F.col("b.confidence").alias("confidence"))


@query("x19b_all_dates", f"""with {DATED}, a as (select o_orderkey, 1 as i, day as date, 0.95::double as confidence from t where k = 5 union all select o_orderkey, 2, day, 0.9 from t where k = 0 union all select o_orderkey, 3, day, 0.85 from t where k = 6 or (k = 7 and month(day) = 5)
 union all select o_orderkey, 4, day, 0.8 from t where k = 7 union all select o_orderkey, 5, day, 0.6 from t where k in (1, 8) union all select o_orderkey, 7, month, 0.5 from t where k in (0, 2, 5, 9)
 union all select o_orderkey, 9, year, 0.3 from t where k not in (3, 4) and late union all select o_orderkey, 10, '2031-01-01'::date, 0.3 from t where k = 1 union all select o_orderkey, 10, '2024-01-01'::date, 0.3 from t where k = 3),
f as (select o_orderkey, date, arg_min(confidence, i) as confidence, min(i) as i from a group by o_orderkey, date) select o_orderkey, (row_number() over (partition by o_orderkey order by i) - 1)::integer as place, date, confidence from f""")
def x19b(spark, d):
    return dated(spark, d).select("o_orderkey", F.posexplode(D.all_dates(F.col("text"))).alias("place", "x")).select("o_orderkey", "place", "x.date", "x.confidence")


@query("x37_safe_names", "select p_partkey, regexp_replace(regexp_replace(concat(' CUI_', p_name, '/', p_brand, '?'), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') as name from part")
def x37(spark, d):
    raw = F.concat(F.lit(" CUI_"), "p_name", F.lit("/"), "p_brand", F.lit("?"))
    return table(spark, d, "part").select("p_partkey", N.safe_name(raw).alias("name"))


@query("x46_wikilinks", "select item_id, md5(regexp_replace(text, '(?i)^((?:[^`\\[]|\\[[^\\]]*\\]|`[^`]*`)*?)\\b(the)\\b', '\\1[[\\2]]')) as digest from benchmark")
def x46(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(N.wikilinks(F.col("text"), "the").cast("binary")).alias("digest"))


@query("x48_json_repair", "select event_id, concat('{\"k\": ', (props->>'$.k'), '}') as repaired from events")
def x48(spark, d):
    broken = F.concat(F.lit("<think>hm</think>```json "), F.regexp_replace("props", "\\}$", ""), F.lit("```"))
    return table(spark, d, "events").select("event_id", N.repair_json(broken).alias("repaired"))


SNIPPETS = [
    "import os\n\ndef f{k}(x):\n    return x\n\nclass C:\n    pass\n",
    "@cache\nasync def g{k}():\n    await h()\n\nx = {k}\n\n@a\n@b\nclass D{k}(Base):\n    def m(self):\n        def inner():\n            pass\n",
    "def broken{k}(:\n    pass\n",
    "  \n",
    "# only {k} comments\nx = 1\n",
]


@query("x08_code_blocks")
def x08(spark, d):
    """Sources of several kinds: functions and classes, decorators and nesting, an error, nothing, no definitions."""
    k = F.col("p_partkey")
    source = F.replace(F.get(F.array(*[F.lit(s) for s in SNIPPETS]), (k % len(SNIPPETS)).cast("int")), F.lit("{k}"), k.cast("string"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(N.code_blocks(source)).alias("place", "block"))


CHAPTERS = """p as (select distinct user_id, floor(epoch(ts))::bigint as t from events), c as (select user_id, min(t) as started, 0 as chapter from p group by 1
 union all select c.user_id, (select min(t) from p where p.user_id = c.user_id and p.t >= c.started + 86400), c.chapter + 1 from c where exists (select 1 from p where p.user_id = c.user_id and p.t >= c.started + 86400))"""


@query("x27_chapters", f"with recursive {CHAPTERS} select user_id, chapter, started::double as started from c")
def x27(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_timestamp("ts").alias("t"))
    return N.chapters(e, "user_id", "t", 86400.0)


@query("x28_chapter_assignment", f"with recursive {CHAPTERS} select user_id, (select max(chapter) from c where c.user_id = e.user_id and c.started <= floor(epoch(ts))::bigint) as chapter, count(*) as n from events e group by all")
def x28(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_timestamp("ts").alias("t"))
    return N.assign(e, N.chapters(e, "user_id", "t", 86400.0), "user_id", "t").groupBy("user_id", "chapter").agg(F.count("*").alias("n"))


RATE = "round(list_reduce(list_prepend(0.1::double, list(k order by o_orderkey)), lambda r, k: case when k > 0 then greatest(r * 0.9::double, 0.01::double) when k < 0 then least(r * 1.1::double, 0.5::double) else r end), 6)"


@query("r16_adaptive_decay", f"select o_orderpriority, {RATE} as rate from (select o_orderpriority, o_orderkey, case when o_totalprice > 1.5 * 250000 then 1.0::double when o_totalprice < 0.5 * 250000 then -1.0::double else 0.0::double end as k from orders) group by 1")
def r16(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", F.col("o_totalprice").alias("picked"), F.lit(250000.0).alias("others"))
    return N.adaptive_rate(o, "o_orderpriority", "o_orderkey")


@query("r19_hypothetical_expansion", "select event_id, case when length(q) < 10 or regexp_matches(q, '^(find|open|show|list) ') then q else concat('A passage about ', q) end as expanded from (select event_id, concat(case event_id % 3 when 0 then 'find ' when 1 then 'explain the ' else '' end, event_type) as q from events)")
def r19(spark, d):
    k = F.col("event_id") % 3
    q = F.concat(F.when(k == 0, "find ").when(k == 1, "explain the ").otherwise(""), "event_type")
    rows = table(spark, d, "events").select("event_id", q.alias("q"))
    return N.expand_hypothetical(rows, "q", F.concat(F.lit("A passage about "), "q")).select("event_id", "expanded")


@query("r22_result_format", f"with {P.HYBRID} select query_id, id, concat('[', rank::varchar, '] ', source, ' (', rrf_score::decimal(12,6)::varchar, ')') as citation from fused join documents on doc_id = id")
def r22(spark, d):
    rows = P.r08(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return rows.select("query_id", "id", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source", F.lit(" ("), F.col("rrf_score").cast("decimal(12,6)").cast("string"), F.lit(")")).alias("citation"))


@query("r27_cited_evidence", "select item_id, source_id, doc_id is not null as known, coalesce(contains(lower(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))), quote), false) as verbatim from (select item_id, item_id * 3 as source_id, lower(trim(regexp_replace(substr(text, 1, 30), '[\\s\\p{Z}]+', ' ', 'g'))) as quote from benchmark) left join documents on doc_id = source_id")
def r27(spark, d):
    answers = table(spark, d, "benchmark").select("item_id", (F.col("item_id") * 3).alias("source_id"), F.substring("text", 1, 30).alias("quote"))
    evidence = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("content"))
    return N.cited(answers, evidence, ["source_id"]).select("item_id", "source_id", "known", "verbatim")


@query("r29_semantic_cache", """with q as (select vec_id, embedding as e from embeddings where vec_id % 100 = 0), c as (select vec_id as cached, embedding as f from embeddings where vec_id % 100 > 0),
s as (select q.vec_id, cached, round(list_sum(list_transform(list_zip(e, f), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(e, lambda z: z::double * z::double))) * sqrt(list_sum(list_transform(f, lambda z: z::double * z::double)))), 6) as cosine from q, c)
select vec_id, min(cached) as cached from s where cosine >= 0.3 group by 1""")
def r29(spark, d):
    """The first stored vector that is similar enough to a query's; stored vectors have an index that is kept."""
    from ..keep import kept
    from ..operators import vector_index as VI

    e = table(spark, d, "embeddings")
    stored = VI.unit(e.filter("vec_id % 100 > 0"))
    index = VI.opened(spark, kept(spark, e, "stored", lambda path: VI.build(stored, path)))
    asked = VI.unit(e.filter("vec_id % 100 = 0")).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return VI.first_within(index, asked, 0.3).select(F.col("query_id").alias("vec_id"), F.col("id").alias("cached"))


@query("a38_retrieval_quality", f"with {P.BM25}, g as (select item_id as query_id, item_id * 11 as expected from benchmark where item_id % 100 = 0) select g.query_id, rank is not null as hit, round(coalesce(1.0::double / rank, 0.0::double), 6) as reciprocal from g left join txt on txt.query_id = g.query_id and txt.id = g.expected and rank <= 10")
def a38(spark, d):
    golden = table(spark, d, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 11).alias("expected"))
    return N.hit_rank(P.text_list(spark, d), golden, 10)


@query("x51_fact_updates", "select conv_id, role, md5(list_reduce(list(text order by turn), lambda a, b: case when contains(lower(a), lower(b)) then a else b end)) as fact from conversations group by all")
def x51(spark, d):
    facts = table(spark, d, "conversations").select("conv_id", "role", "turn", F.col("text").alias("fact"), F.lit(0.7).alias("confidence"))
    return N.keep_facts(facts, ["conv_id", "role"], "turn").select("conv_id", "role", F.md5(F.col("fact").cast("binary")).alias("fact"))


@query("x62_rule_lookup", "with r(n, kind, pattern, value, confidence) as (values (1, 'category', 'view', 'A', 0.6), (2, 'category', 'view', 'B', 0.9), (3, 'category', 'click', 'C', 0.4)), h as (select event_id, r.value, row_number() over (partition by event_id order by n) as k from events join r on pattern = event_type where confidence >= 0.5) select event_id, value from h where k = 1")
def x62(spark, d):
    rules = spark.createDataFrame([(1, "view", "A", 0.6), (2, "view", "B", 0.9), (3, "click", "C", 0.4)], "n int, event_type string, value string, confidence double").filter("confidence >= 0.5")
    return table(spark, d, "events").select("event_id", "event_type").join(F.broadcast(rules), "event_type").groupBy("event_id").agg(F.min_by("value", "n").alias("value"))


@query("x63_classification_defaults", "select event_id, coalesce(props->>'$.category', 'uncategorised') as category, coalesce((props->>'$.k')::bigint, 0) as k from events")
def x63(spark, d):
    got = F.from_json("props", "category string, k bigint")
    return table(spark, d, "events").select("event_id", F.coalesce(got["category"], F.lit("uncategorised")).alias("category"), F.coalesce(got["k"], F.lit(0).cast("long")).alias("k"))


@query("j19_golden_review_queue", "select event_type as q from (select distinct event_type from events) where event_type not in ('click', 'view')")
def j19(spark, d):
    known = spark.createDataFrame([("click",), ("view",)], "event_type string")
    return table(spark, d, "events").select("event_type").distinct().join(known, "event_type", "left_anti").select(F.col("event_type").alias("q"))


@query("w17_surest_span", "select l_orderkey, l_partkey, arg_max(l_linenumber, (l_quantity, -l_linenumber)) as line from lineitem group by all")
def w17(spark, d):
    return R.top(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], [F.desc("l_quantity"), F.asc("l_linenumber")], 1, "n").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("line"))


@query("a08_document_counts", "select count(distinct source) as n_sources, count(*) as n_chunks from documents")
def a08(spark, d):
    return table(spark, d, "documents").agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n_chunks"))


@query("k21_postings_index", r"select doc_id as id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term from documents) group by all")
def k21(spark, d):
    return P.text_index(spark, d).blocks.select("term", F.explode(F.arrays_zip("ids", "tfs")).alias("p")).select(F.col("p.ids").alias("id"), "term", F.col("p.tfs").cast("long").alias("tf"))
