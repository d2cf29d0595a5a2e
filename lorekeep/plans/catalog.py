"""Catalog plans.  The catalog is derived from the corpus: language as category, source and size as tags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..registry import query, table

CAT = """l as (select doc_id, max(toxic) as toxic from labels group by 1),
cat as (select d.doc_id, concat('file', d.doc_id::varchar, case d.doc_id % 3 when 0 then '.pdf' when 1 then '.md' else '.txt' end) as file_name, d.lang as category, d.source,
 [d.lang, d.source, case when d.n_chars > 2000 then 'long' else 'short' end] as tags, case when d.doc_id % 17 = 0 then 'deleted' when d.doc_id % 5 = 0 then 'archived' else 'active' end as status,
 coalesce(l.toxic = 1, false) as is_sensitive, d.n_chars as file_size, '2024-06-01'::timestamp - to_days((d.doc_id % 500)::integer) as created_at from documents d left join l using (doc_id))"""


def catalog(spark, d):
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    k = F.col("doc_id")
    ext = F.when(k % 3 == 0, ".pdf").when(k % 3 == 1, ".md").otherwise(".txt")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("file"), k.cast("string"), ext).alias("file_name"),
        F.col("lang").alias("category"),
        "source",
        F.array("lang", "source", F.when(F.col("n_chars") > 2000, "long").otherwise("short")).alias("tags"),
        F.when(k % 17 == 0, "deleted").when(k % 5 == 0, "archived").otherwise("active").alias("status"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_sensitive"),
        F.col("n_chars").alias("file_size"),
        (F.lit("2024-06-01").cast("timestamp") - F.make_dt_interval((k % 500).cast("int"))).alias("created_at"),
    )


@query("f01_equality_filter", f"with {CAT} select doc_id, file_name from cat where source = 'src3'")
def f01(spark, d):
    return catalog(spark, d).filter(C.equals("source", "src3")).select("doc_id", "file_name")


@query("f02_like_filter", f"with {CAT} select doc_id, file_name from cat where file_name like 'file1%.pdf'")
def f02(spark, d):
    return catalog(spark, d).filter(C.like("file_name", "file1%.pdf")).select("doc_id", "file_name")


@query("f03_tag_filter", f"with {CAT} select doc_id from cat where list_contains(tags, 'long')")
def f03(spark, d):
    return catalog(spark, d).filter(C.tagged("long")).select("doc_id")


@query("f04_tag_conjunction", f"with {CAT} select doc_id from cat where list_contains(tags, 'long') and list_contains(tags, 'fr')")
def f04(spark, d):
    return catalog(spark, d).filter(C.tagged(["long", "fr"])).select("doc_id")


@query("f05_filter_dictionary", f"with {CAT} select doc_id from cat where category = 'en' and status = 'active' and list_contains(tags, 'short')")
def f05(spark, d):
    return catalog(spark, d).filter(C.where({"category": "en", "status": "active", "tags": "short"})).select("doc_id")


@query("f07_catalog_search", f"with {CAT} select doc_id, file_name, status, file_size from cat where status <> 'deleted' and category = 'de'")
def f07(spark, d):
    return C.search(catalog(spark, d), category="de").select("doc_id", "file_name", "status", "file_size")


@query("f09_projection", "select doc_id, lang from documents")
def f09(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang")


@query("f11_recent_files", f"with {CAT} select doc_id, file_name from cat where created_at >= '2024-05-01'::timestamp and (file_name like '%.pdf' or file_name like '%.md')")
def f11(spark, d):
    recent = F.col("created_at") >= F.lit("2024-05-01").cast("timestamp")
    return catalog(spark, d).filter(recent & F.col("file_name").rlike("\\.(pdf|md)$")).select("doc_id", "file_name")


@query("f13_row_masking", f"with {CAT} select doc_id, case when is_sensitive then '[restricted]' else file_name end as shown from cat")
def f13(spark, d):
    return catalog(spark, d).select("doc_id", F.when(F.col("is_sensitive"), "[restricted]").otherwise(F.col("file_name")).alias("shown"))


@query("f14_path_safety", f"with {CAT} select doc_id, not (regexp_matches(concat('/data/', source, '/', file_name), '(^|/)(\\.\\.|\\.ssh|\\.git|etc)(/|$)') or contains(file_name, 'file13')) as safe from cat")
def f14(spark, d):
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), "file_name")
    return catalog(spark, d).select("doc_id", (~(path.rlike("(^|/)(\\.\\.|\\.ssh|\\.git|etc)(/|$)") | F.col("file_name").contains("file13"))).alias("safe"))


@query("f15_folder_rules", f"with {CAT}, r(n, pattern, folder) as (values (1, '9\\.pdf$', 'Nines'), (2, '\\.pdf$', 'Papers'), (3, '^file[12]', 'Early')), h as (select doc_id, folder, row_number() over (partition by doc_id order by n) as k from cat join r on regexp_matches(lower(file_name), pattern)) select doc_id, folder from h where k = 1")
def f15(spark, d):
    rules = spark.createDataFrame([(1, "9\\.pdf$", "Nines"), (2, "\\.pdf$", "Papers"), (3, "^file[12]", "Early")], "n int, pattern string, folder string")
    hits = catalog(spark, d).join(F.broadcast(rules), F.expr("lower(file_name) rlike pattern"))  # a rule list is a few rows
    return hits.groupBy("doc_id").agg(F.min_by("folder", "n").alias("folder"))


@query("f12_scope_gate", f"with {CAT} select doc_id from cat where not is_sensitive")
def f12(spark, d):
    return catalog(spark, d).filter(~F.col("is_sensitive")).select("doc_id")


@query("f18_principal_lookup", "with p(key, agent, scope) as (values ('view', 'reader', 'main'), ('purchase', 'buyer', 'all')) select event_id, coalesce(agent, 'open') as agent, coalesce(scope, 'main') as scope from events left join p on key = event_type")
def f18(spark, d):
    keys = spark.createDataFrame([("view", "reader", "main"), ("purchase", "buyer", "all")], "event_type string, agent string, scope string")
    joined = table(spark, d, "events").join(F.broadcast(keys), "event_type", "left")
    return joined.select("event_id", F.coalesce("agent", F.lit("open")).alias("agent"), F.coalesce("scope", F.lit("main")).alias("scope"))


@query("a01_catalog_stats", f"""with {CAT} select 'total' as measure, '' as key, sum((status <> 'deleted')::bigint)::bigint as n from cat
union all select 'category', category, count(*) from cat where status <> 'deleted' and category is not null group by 2 union all select 'status', status, count(*) from cat group by 2
union all select 'sensitive', '', sum((status <> 'deleted' and is_sensitive)::bigint)::bigint from cat union all select 'tag', t, count(*) from (select unnest(tags) as t from cat where status <> 'deleted') group by 2""")
def a01(spark, d):
    return C.stats(catalog(spark, d))


@query("a02_tag_histogram", f"with {CAT} select trim(t) as tag, count(*) as n from (select unnest(string_split(concat(',', array_to_string(tags, ', '), ','), ',')) as t from cat) where trim(t) <> '' group by 1")
def a02(spark, d):
    joined = F.concat(F.lit(","), F.array_join("tags", ", "), F.lit(","))
    tags = catalog(spark, d).select(F.explode(F.split(joined, ",")).alias("tag")).select(F.trim("tag").alias("tag")).filter("tag <> ''")
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


@query("a03_folder_tree", f"with {CAT} select coalesce(nullif(trim(case when doc_id % 11 = 0 then ' ' else source end), ''), 'Unsorted') as folder, count(*) as n, sum((status = 'archived')::bigint)::bigint as n_archived from cat group by 1")
def a03(spark, d):
    name = F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("source"))
    folder = F.coalesce(F.expr("nullif(trim(x), '')"), F.lit("Unsorted"))
    return catalog(spark, d).withColumn("x", name).groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.sum((F.col("status") == "archived").cast("long")).alias("n_archived"))


@query("a04_devices", "select source as device, lang as location, count(*) as n from documents group by all")
def a04(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("device"), F.col("lang").alias("location")).agg(F.count("*").alias("n"))


@query("a05_distinct_count", "select count(distinct l_partkey) as n_parts from lineitem")
def a05(spark, d):
    return table(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("n_parts"))


@query("a07_string_aggregation", "select source, array_to_string(list_sort(list_distinct(list(lang))), ',') as langs from documents group by 1")
def a07(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("a09_index_listing", "select source, count(*) as n, arg_min(substr(text, 1, 200), doc_id) as preview from documents where trim(text) <> '' group by 1")
def a09(spark, d):
    docs = table(spark, d, "documents").filter("trim(text) <> ''")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.min_by(F.substring("text", 1, 200), "doc_id").alias("preview"))


@query("a10_best_child", "select l_orderkey, min(l_extendedprice) as best, arg_min(l_linenumber, (l_extendedprice, l_linenumber)) as line from lineitem group by 1")
def a10(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("best"), F.min_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).alias("line"))


@query("a36_reconstruct_text", "select conv_id, md5(string_agg(text, chr(10) order by turn)) as digest, count(*) as n_turns from conversations group by 1")
def a36(spark, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(parts, "\n").alias("t"), F.count("*").alias("n_turns"))
    return rows.select("conv_id", F.md5(F.col("t").cast("binary")).alias("digest"), "n_turns")


@query("k02_delete_count", "select count(*) as n_deleted from documents where source = 'src4'")
def k02(spark, d):
    return C.delete(table(spark, d, "documents"), F.col("source") == "src4")[1]


@query("k03_bulk_delete", "with w(doc_id) as (values (1), (2), (999999)) select w.doc_id::bigint as doc_id, count(d.doc_id) as n_found, case when count(d.doc_id) > 0 then 'deleted' else 'not_found' end as outcome from w left join documents d using (doc_id) group by 1")
def k03(spark, d):
    wanted = spark.createDataFrame([(1,), (2,), (999999,)], "doc_id long")
    found = table(spark, d, "documents").join(F.broadcast(wanted), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return wanted.join(found, "doc_id", "left").select("doc_id", n.alias("n_found"), F.when(n > 0, "deleted").otherwise("not_found").alias("outcome"))


@query("k04_update_tags", f"with {CAT} select doc_id, array_to_string(case when category = 'fr' then list_append(tags, 'checked') else tags end, ',') as tags from cat")
def k04(spark, d):
    new = C.update(catalog(spark, d), F.col("category") == "fr", {"tags"}, tags=F.array_append("tags", F.lit("checked")))
    return new.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("k05_entity_upsert", "select event_type as name, 'event' as type, user_id as doc_id, min(ts) as first_seen, max(ts) as last_seen, count(*) as mentions, max(value) as score from events group by all")
def k05(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("name"), F.lit("event").alias("type"), F.col("user_id").alias("doc_id"), F.col("ts").alias("seen"), F.col("value").alias("score"))
    return C.upsert_entities(e)


@query("k06_last_write_wins", "select l_partkey, l_suppkey, arg_max(l_quantity, (l_orderkey, l_linenumber, l_shipdate, l_quantity)) as quantity from lineitem group by all")
def k06(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max_by("l_quantity", F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")).alias("quantity"))


@query("k09_soft_delete", f"with {CAT} select case when source = 'src7' then 'deleted' else status end as status, count(*) as n from cat group by 1")
def k09(spark, d):
    new = C.update(catalog(spark, d), F.col("source") == "src7", {"status"}, status="deleted")
    return new.groupBy("status").agg(F.count("*").alias("n"))


@query("k13_cold_migration", f"with {CAT} select doc_id, case when status = 'deleted' then 'missing' when status = 'archived' then 'already_cold' when file_size > 5000 then 'too_large' else 'migrated' end as outcome from cat")
def k13(spark, d):
    s = F.col("status")
    outcome = F.when(s == "deleted", "missing").when(s == "archived", "already_cold").when(F.col("file_size") > 5000, "too_large").otherwise("migrated")
    return catalog(spark, d).select("doc_id", outcome.alias("outcome"))


@query("k15_manifest_cleanup", f"with {CAT} select strftime(created_at, '%Y-%m') as month, status = 'active' as stays, count(*) as n from cat group by all")
def k15(spark, d):
    return catalog(spark, d).groupBy(F.date_format("created_at", "yyyy-MM").alias("month"), (F.col("status") == "active").alias("stays")).agg(F.count("*").alias("n"))


@query("j06_orphan_parents", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')")
def j06(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j07_unindexed_files", "select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def j07(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id")


@query("j13_manifest_enrichment", f"with {CAT} select doc_id, o_orderpriority as priority from cat left join orders on o_orderkey = doc_id")
def j13(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("priority"))
    return catalog(spark, d).join(orders, "doc_id", "left").select("doc_id", "priority")


@query("j14_parent_child_counts", "with c as (select l_orderkey, count(*) as n from lineitem group by 1) select o_orderkey, coalesce(n, 0) as n_children from orders left join c on l_orderkey = o_orderkey")
def j14(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_children"))


@query("u02_tags_match_all", f"with {CAT}, t as (select doc_id, unnest(tags) as t from cat) select doc_id from t where t in ('long', 'fr') group by 1 having count(distinct t) = 2")
def u02(spark, d):
    t = catalog(spark, d).select("doc_id", F.explode("tags").alias("t")).filter(F.col("t").isin("long", "fr"))
    return t.groupBy("doc_id").agg(F.countDistinct("t").alias("n")).filter("n = 2").select("doc_id")


@query("u03_tags_match_any", f"with {CAT}, t as (select doc_id, unnest(tags) as t from cat) select distinct doc_id from t where t in ('es', 'de')")
def u03(spark, d):
    return catalog(spark, d).select("doc_id", F.explode("tags").alias("t")).filter(F.col("t").isin("es", "de")).select("doc_id").distinct()


@query("u04_orphan_sources", "select distinct l_suppkey from lineitem except select s_suppkey from supplier where s_nationkey > 12")
def u04(spark, d):
    a = table(spark, d, "lineitem").select("l_suppkey")
    return a.subtract(table(spark, d, "supplier").filter("s_nationkey > 12").select(F.col("s_suppkey").alias("l_suppkey")))


@query("u07_lookup_union", "select distinct doc_id from (select doc_id from documents where lang = 'fr' union all select doc_id from documents where source = 'src2')")
def u07(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter("lang = 'fr'").select("doc_id").unionByName(docs.filter("source = 'src2'").select("doc_id")).dropDuplicates(["doc_id"])


@query("x42_source_authority", f"""with {CAT} select doc_id, case when list_contains(tags, 'src1') then 'official' when category = 'de' then 'professional' when contains(category, 'e') then 'educational'
 when file_name like '%.pdf' then 'professional' when file_name like '%.txt' or file_name like '%.md' then 'personal' else 'unknown' end as authority from cat""")
def x42(spark, d):
    from ..functions import labels as L

    rules = {"tags": {"src1": "official"}, "category": {"de": "professional"}, "contains": {"e": "educational"}}
    return catalog(spark, d).select("doc_id", L.authority(F.col("tags"), F.col("category"), F.col("file_name"), rules).alias("authority"))


@query("x43_freshness", f"with {CAT}, a as (select doc_id, floor((epoch('2024-06-01'::timestamp) - epoch(created_at)) / 86400)::bigint as days from cat) select doc_id, days, case when days <= 7 then 'fresh' when days <= 30 then 'current' when days <= 90 then 'aging' when days <= 365 then 'stale' else 'archive' end as level from a")
def x43(spark, d):
    from ..functions import scoring as S

    days = S.age_days(F.col("created_at"), F.lit("2024-06-01").cast("timestamp"))
    return catalog(spark, d).select("doc_id", days.alias("days"), S.freshness(days).alias("level"))


@query("a22_freshness_summary", f"""with {CAT}, a as (select floor((epoch('2024-06-01'::timestamp) - epoch(created_at)) / 86400)::bigint as days from cat), f as (select days, case when days <= 7 then 'fresh' when days <= 30 then 'current' when days <= 90 then 'aging' when days <= 365 then 'stale' else 'archive' end as level from a),
lv(level) as (values ('fresh'), ('current'), ('aging'), ('stale'), ('archive'), ('never')) select lv.level, count(days) as n, coalesce(round(avg(days), 4), 0) as mean_age from lv left join f using (level) group by 1""")
def a22(spark, d):
    levels = spark.createDataFrame([(x,) for x in ("fresh", "current", "aging", "stale", "archive", "never")], "level string")
    got = x43(spark, d).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("days"), 4).alias("mean_age"))
    return levels.join(got, "level", "left").select("level", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("mean_age", F.lit(0.0)).alias("mean_age"))


@query("f16_stale_content", f"with {CAT}, a as (select doc_id, floor((epoch('2024-06-01'::timestamp) - epoch(created_at)) / 86400)::bigint as days from cat) select doc_id, days from a where days > 90")
def f16(spark, d):
    return x43(spark, d).filter(F.col("level").isin("stale", "archive")).orderBy(F.desc("days"), "doc_id").select("doc_id", "days")


@query("x56_file_types", f"with {CAT} select doc_id, case when file_name like '%.pdf' then 'pdf' when file_name like '%.md' then 'markdown' when file_name like '%.txt' then 'text' else 'unknown' end as file_type from cat")
def x56(spark, d):
    from ..functions import labels as L

    return catalog(spark, d).select("doc_id", L.file_type(F.col("file_name")).alias("file_type"))


@query("x61_folder_list", "select distinct concat_ws('/', lang, source) as folder from documents union select distinct lang from documents")
def x61(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.concat_ws("/", "lang", "source").alias("folder")).union(docs.select("lang")).distinct()


@query("w12_timeline", "select user_id, event_type, min(ts) as first_seen, (row_number() over (partition by user_id order by min(ts), event_type))::integer as place from events group by user_id, event_type")
def w12(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("first_seen", "event_type")))
