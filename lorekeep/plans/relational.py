"""Relational completeness: join kinds, set operations, grouping sets and frames over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query, table

MONEY = "decimal(28,6)"


def _sum(c):
    return F.round(F.sum(c.cast(MONEY)).cast("double"), 2)


@query("rel_pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity::decimal(28,6))::double, 2) as sum_qty, round(sum((l_extendedprice * (1 - l_discount))::decimal(28,6))::double, 2) as revenue, count(*) as n from lineitem where l_shipdate <= '1998-09-02' group by all")
def pricing(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(_sum(F.col("l_quantity")).alias("sum_qty"), _sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count("*").alias("n"))


@query("rel_star_join", "select r_name, round(sum(o_totalprice::decimal(28,6))::double, 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def star(spark, d):
    nations = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows at any scale
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name").agg(_sum(F.col("o_totalprice")).alias("total"))


@query("rel_right_join", "select c_custkey, count(o_orderkey) as n from orders right join customer on o_custkey = c_custkey group by 1")
def right(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("rel_semi_join", "select s_suppkey from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity > 49)")
def semi(spark, d):
    li = table(spark, d, "lineitem").filter("l_quantity > 49")
    return table(spark, d, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("rel_full_outer", "with a as (select l_partkey as k, count(*) as n from lineitem where l_quantity > 45 group by 1), b as (select p_partkey as k, p_size from part where p_size < 10) select coalesce(a.k, b.k) as k, n, p_size from a full join b on a.k = b.k")
def full(spark, d):
    a = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    return a.join(table(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("k"), "p_size"), "k", "full_outer").select("k", "n", "p_size")


@query("rel_interval_join", "with h as (select distinct user_id, date_trunc('hour', ts) as h from events where event_type = 'signup') select h.user_id, h.h, count(e.event_id) as n from h join events e on e.user_id = h.user_id and e.ts >= h.h and e.ts < h.h + interval 6 hour group by all")
def interval(spark, d):
    """Interval join by equi-join on the buckets that an interval touches."""
    e = table(spark, d, "events")
    hour = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    h = e.filter("event_type = 'signup'").select("user_id", F.date_trunc("hour", "ts").alias("h")).distinct()
    spread = h.withColumn("bucket", F.explode(F.sequence(hour("h"), hour("h") + 5)))
    return spread.join(e.select("user_id", hour("ts").alias("bucket"), "event_id"), ["user_id", "bucket"]).groupBy("user_id", "h").agg(F.count("*").alias("n"))


@query("rel_rollup", "select o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::bigint as gid, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))


@query("rel_cube", "select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::bigint as gid, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))


@query("rel_set_operations", "select l_partkey from lineitem where l_quantity > 48 intersect select p_partkey from part where p_size > 5 except select l_partkey from lineitem where l_discount > 0.09")
def sets(spark, d):
    li = table(spark, d, "lineitem")
    a = li.filter("l_quantity > 48").select("l_partkey").intersect(table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey")))
    return a.subtract(li.filter("l_discount > 0.09").select("l_partkey"))


@query("rel_rank_frames", "select o_custkey, o_orderkey, (rank() over w)::integer as rk, (dense_rank() over (partition by o_custkey order by o_orderstatus))::integer as dr, (sum(o_totalprice::decimal(18,2)) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row))::double as moving from orders window w as (partition by o_custkey order by o_totalprice desc)")
def frames(spark, d):
    w = Window.partitionBy("o_custkey")
    moving = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w.orderBy(F.desc("o_totalprice"))).alias("rk"), F.dense_rank().over(w.orderBy("o_orderstatus")).alias("dr"), moving.cast("double").alias("moving"))


@query("t01_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def topk(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("rel_pivot", "select l_returnflag, count(*) filter (where l_linestatus = 'O') as o, count(*) filter (where l_linestatus = 'F') as f from lineitem group by 1")
def pivot(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count()
    return p.select("l_returnflag", F.coalesce("O", F.lit(0).cast("long")).alias("o"), F.coalesce("F", F.lit(0).cast("long")).alias("f"))
