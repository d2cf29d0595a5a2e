"""Query-log plans: ``event_type`` is the query, ``value`` its score, ``user_id`` its session."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..registry import query, table

LOG = "log as (select event_id as id, event_type as q, least(value / 100, 1.0) as score, (event_id % 4)::integer as n_results, user_id, ts, case when event_id % 3 > 0 then concat('file', event_id % 10) end as file from events)"


def log(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select(
        k.alias("id"), F.col("event_type").alias("q"), F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), (k % 4).cast("int").alias("n_results"), "user_id", "ts",
        F.when(k % 3 > 0, F.concat(F.lit("file"), (k % 10).cast("string"))).alias("file"),
    )


@query("a12_summary", f"with {LOG} select count(*) as n, count(distinct q) as n_distinct, round(avg(score), 6) as mean_score, sum((n_results < 1 or score < 0.3)::bigint)::bigint as n_failed from log")
def a12(spark, d):
    return A.summary(log(spark, d))


@query("a13_trend", f"""with {LOG}, r as (select *, row_number() over (partition by user_id order by id) as rn, count(*) over (partition by user_id) as n from log),
h as (select user_id, round(avg(score) filter (where rn <= n // 2), 6) as first_half, round(avg(score) filter (where rn > n // 2), 6) as second_half from r group by 1)
select *, case when second_half - first_half > 0.05 then 'improving' when second_half - first_half < -0.05 then 'declining' else 'stable' end as trend from h""")
def a13(spark, d):
    return A.trend(log(spark, d), "user_id", "id", "score")


@query("a14_golden_suggestions", f"with {LOG}, g as (select lower(trim(q)) as q, count(*) as n, round(avg(score), 6) as mean_score, (arg_max(struct_pack(f := file), (score, id))).f as file from log group by 1) select * from g where n >= 3 and mean_score >= 0.1 and file is not null")
def a14(spark, d):
    return A.suggestions(log(spark, d), least_mean=0.1)


@query("a15_query_patterns", f"with {LOG} select q as pattern, count(*) as frequency, round(avg(score), 6) as mean_score, max(ts) as last_seen from log group by 1")
def a15(spark, d):
    return log(spark, d).groupBy(F.col("q").alias("pattern")).agg(F.count("*").alias("frequency"), F.round(F.avg("score"), 6).alias("mean_score"), F.max("ts").alias("last_seen"))


@query("a16_popular_queries", f"with {LOG} select q, count(*) as n from log group by 1")
def a16(spark, d):
    return log(spark, d).groupBy("q").agg(F.count("*").alias("n"))


@query("a17_metric_summary", "select event_type as metric, min(value) as least, max(value) as most, round(avg(value), 6) as mean, count(*) as n, arg_max(value, (ts, event_id)) as latest from events group by 1")
def a17(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("metric"))
    return g.agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"))


@query("a18_search_gaps", f"with {LOG} select q as topic, count(*) as n, least(1.0::double, count(*) / 5.0::double) as confidence from log where n_results < 1 or score < 0.3 group by 1")
def a18(spark, d):
    bad = log(spark, d).filter(A.failed(F.col("n_results"), F.col("score")))
    return A.gaps(bad, F.filter(F.split("q", " "), lambda w: F.char_length(w) > 3))


@query("a19_topic_imbalance", "with c as (select source as tag, count(*) as n from documents group by 1), t as (select tag, case when tag in ('src3', 'src5') then n // 10 else n end as n from c) select tag, n from (select *, avg(n) over () as mean from t) where n < 0.3 * mean")
def a19(spark, d):
    c = table(spark, d, "documents").groupBy(F.col("source").alias("tag")).agg(F.count("*").alias("n"))
    t = c.withColumn("n", F.when(F.col("tag").isin("src3", "src5"), F.floor(F.col("n") / 10)).otherwise(F.col("n")))
    mean = t.agg(F.avg("n").alias("mean"))  # one row
    return t.join(F.broadcast(mean), F.col("n") < 0.3 * F.col("mean")).select("tag", "n")


@query("a20_sparse_folders", "with f as (select r_name as folder from region union all select 'EMPTY'), c as (select r_name as folder, count(*) as n from nation join region on n_regionkey = r_regionkey group by 1) select f.folder, coalesce(n, 0) as n from f left join c using (folder) where coalesce(n, 0) < 6")
def a20(spark, d):
    folders = table(spark, d, "region").select(F.col("r_name").alias("folder")).union(spark.createDataFrame([("EMPTY",)], "folder string"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("folder")).agg(F.count("*").alias("n"))
    return folders.join(n, "folder", "left").select("folder", F.coalesce("n", F.lit(0).cast("long")).alias("n")).filter("n < 6")


@query("a21_gap_rollup", f"with {LOG}, g as (select concat('search:', q) as gap, least(1.0::double, count(*) / 5000.0::double) as confidence from log where score < 0.3 group by 1 union all select concat('user:', user_id), least(1.0::double, count(*) / 500.0::double) from log where score < 0.3 group by 1) select gap, confidence from g order by confidence desc, gap limit 5")
def a21(spark, d):
    low = log(spark, d).filter("score < 0.3")
    a = low.groupBy(F.concat(F.lit("search:"), "q").alias("gap")).agg(F.least(F.lit(1.0), F.count("*") / 5000).alias("confidence"))
    b = low.groupBy(F.concat(F.lit("user:"), "user_id").alias("gap")).agg(F.least(F.lit(1.0), F.count("*") / 500).alias("confidence"))
    return a.unionByName(b).orderBy(F.desc("confidence"), "gap").limit(5)


@query("f10_failed_queries", f"with {LOG} select id, q from log where n_results < 1 or score < 0.3")
def f10(spark, d):
    return log(spark, d).filter(A.failed(F.col("n_results"), F.col("score"))).select("id", "q")


@query("w10_feedback_target", f"with {LOG} select user_id, q, arg_max(id, (ts, id)) as id from log where n_results > 0 group by all")
def w10(spark, d):
    return log(spark, d).filter("n_results > 0").groupBy("user_id", "q").agg(F.max_by("id", F.struct("ts", "id")).alias("id"))


@query("w07_bounded_history", f"with {LOG} select user_id, id, (row_number() over (partition by user_id order by ts desc, id desc))::integer as place from log qualify place <= 10")
def w07(spark, d):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id")))
    return log(spark, d).withColumn("place", place).filter("place <= 10").select("user_id", "id", "place")


@query("w19_sliding_minute", "select event_id, count(*) over (partition by user_id order by epoch(date_trunc('second', ts))::bigint range between 3600 preceding and current row) as n_hour from events")
def w19(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_timestamp("ts")).rangeBetween(-3600, 0)
    return table(spark, d, "events").select("event_id", F.count("*").over(w).alias("n_hour"))


@query("m08_sessions", """with g as (select *, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) > 7200000000, true) as fresh from events), s as (select *, (sum(fresh::bigint) over (partition by user_id order by ts, event_id rows unbounded preceding))::bigint as session from g)
select user_id, session, min(ts) as started, max(ts) as ended, count(*) as n from s group by all""")
def m08(spark, d):
    return A.sessions(table(spark, d, "events"), "user_id", "ts", 7200)


@query("t08_top_counter", "select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 20")
def t08(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


@query("t10_priority_queue", "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'O' order by o_orderpriority, o_orderdate, o_orderkey limit 50")
def t10(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")
