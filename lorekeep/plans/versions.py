"""Version and conversation plans: a customer's orders are the versions of one document."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import queries as Q
from ..operators import versions as V
from ..operators.diffs import text_diff
from ..registry import query, table


@query("w06_latest_versions", "select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc))::integer as age from orders qualify age <= 3")
def w06(spark, d):
    return V.latest(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "age")


@query("w08_change_detection", "with p as (select *, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders) select o_custkey, o_orderkey, o_orderstatus from p where before is null or before <> o_orderstatus")
def w08(spark, d):
    return V.changed(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("m13_change_skip", "with p as (select *, lag(md5(o_orderpriority)) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders) select o_custkey, sum((before is null or before <> md5(o_orderpriority))::bigint)::bigint as n_indexed, count(*) as n_versions from p group by 1")
def m13(spark, d):
    orders = table(spark, d, "orders")
    kept = V.changed(orders, "o_custkey", ["o_orderdate", "o_orderkey"], F.md5(F.col("o_orderpriority").cast("binary"))).groupBy("o_custkey").agg(F.count("*").alias("n_indexed"))
    return orders.groupBy("o_custkey").agg(F.count("*").alias("n_versions")).join(kept, "o_custkey").select("o_custkey", "n_indexed", "n_versions")


# the oracle fills the table of common lengths a row (a line of the old text) at a time
X45 = """with recursive p as (select conv_id, turn, string_split(coalesce(text, ''), chr(10)) as b, string_split(coalesce(lag(text) over (partition by conv_id order by turn), ''), chr(10)) as a from conversations),
t(conv_id, turn, i, l) as (select conv_id, turn, 0, list_transform(b, lambda x: 0) from p union all
 select p.conv_id, p.turn, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(l[k], coalesce(l[k - 1], 0) + (a[i + 1] = b[k])::integer)))) from t join p using (conv_id, turn) where i < len(a))
select conv_id, turn, (len(b) - l[len(b)])::bigint as added, (len(a) - l[len(b)])::bigint as removed from t join p using (conv_id, turn) where i = len(a)"""


def _turn_pairs(spark, d):
    return table(spark, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))


@query("x45_line_diff", X45)
def x45(spark, d):
    return _turn_pairs(spark, d).select("conv_id", "turn", V.line_diff(F.col("before"), F.col("text")).alias("x")).select("conv_id", "turn", "x.added", "x.removed")


@query("x45_hunks")
def x45_hunks(spark, d):
    """A row per hunk that turns a turn's predecessor into it."""
    rows = _turn_pairs(spark, d).select("conv_id", "turn", F.posexplode(text_diff()(F.col("before"), F.col("text"))["hunks"]).alias("place", "h"))
    return rows.select("conv_id", "turn", "place", "h.old_start", "h.old_lines", "h.new_start", "h.new_lines", "h.body")


@query("x45_positional_summary", "with p as (select conv_id, turn, string_split(text, chr(10)) as b, string_split(coalesce(lag(text) over (partition by conv_id order by turn), ''), chr(10)) as a from conversations) select conv_id, turn, len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is distinct from b[i]))::bigint as n_changed from p")
def x45b(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("b"), F.split(F.coalesce(F.lag("text").over(w), F.lit("")), "\n").alias("a"))
    gap = F.filter(F.zip_with("a", "b", lambda x, y: ~x.eqNullSafe(y)), lambda z: z)
    return rows.select("conv_id", "turn", F.size(gap).cast("long").alias("n_changed"))


@query("w11_previous_turn", "select conv_id, turn, md5(coalesce(lag(text) over (partition by conv_id order by turn), '')) as before from conversations")
def w11(spark, d):
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(before.cast("binary")).alias("before"))


@query("r20_follow_up_rewrite", r"""with p as (select *, lag(text) over (partition by conv_id order by turn) as before, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as w, lower(regexp_split_to_array(trim(text), '\s+')[1]) as first from conversations)
select conv_id, turn, md5(case when before is not null and (len(w) <= 3 or list_contains(['it', 'this', 'that', 'they', 'them', 'those', 'these', 'its', 'their'], first) or list_has_any(w, ['also', 'another', 'more', 'else', 'too', 'instead', 'besides', 'similarly']))
 then concat_ws(' ', array_to_string(list_filter(regexp_split_to_array(before, '[\s\p{Z}]+'), lambda x: length(x) > 2)[1:5], ' '), text) else text end) as digest from p""")
def r20(spark, d):
    rows = Q.rewrite_follow_ups(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.md5(F.col("rewritten").cast("binary")).alias("digest"))


FACTS = ["my name is (\\w+)", "I work (?:at|for) ([A-Z]\\w+)", "I prefer (\\w+)", "I use (\\w+) for", "I(?:'m| am) moving to (\\w+)"]


@query("x50_user_facts", "with t as (select conv_id, turn, concat(text, case turn % 3 when 0 then ' I prefer tea.' when 1 then ' my name is Ada' else ' I work at Acme' end) as t from conversations where role = 'user'), f as (select conv_id, turn, unnest(regexp_extract_all(t, '(?i)my name is (\\w+)') || regexp_extract_all(t, '(?i)I work (?:at|for) ([A-Z]\\w+)') || regexp_extract_all(t, '(?i)I prefer (\\w+)') || regexp_extract_all(t, '(?i)I use (\\w+) for') || regexp_extract_all(t, '(?i)I(?:''m| am) moving to (\\w+)')) as fact from t) select conv_id, turn, fact from f")
def x50(spark, d):
    k = F.col("turn") % 3
    said = F.concat("text", F.when(k == 0, " I prefer tea.").when(k == 1, " my name is Ada").otherwise(" I work at Acme"))
    rows = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", said.alias("t"))
    found = F.concat(*[F.regexp_extract_all("t", F.lit("(?i)" + p), F.lit(0)) for p in FACTS])
    return rows.select("conv_id", "turn", F.explode(found).alias("fact"))


@query("a33_fact_stats", "select role as category, case turn % 2 when 0 then 'pattern' else 'manual' end as origin, count(*) as n from conversations group by all")
def a33(spark, d):
    origin = F.when(F.col("turn") % 2 == 0, "pattern").otherwise("manual")
    return table(spark, d, "conversations").groupBy(F.col("role").alias("category"), origin.alias("origin")).agg(F.count("*").alias("n"))


@query("x52_context_rendering", "select conv_id, role, md5(concat('## ', role, chr(10), string_agg(concat('- ', text), chr(10) order by turn))) as rendered from conversations group by conv_id, role")
def x52(spark, d):
    """A user's facts that have not expired, grouped by category: here a conversation's turns by role."""
    return V.rendered(table(spark, d, "conversations"), ["conv_id"], "role", "turn", "text").select("conv_id", "role", F.md5(F.col("rendered").cast("binary")).alias("rendered"))


@query("x49_correction_diff", "with o as (select l_orderkey, l_linenumber, l_returnflag as ai_flag, case when l_linenumber % 3 = 0 then 'X' else l_returnflag end as human_flag, l_linestatus as ai_status, l_linestatus as human_status from lineitem) select l_orderkey, l_linenumber, (ai_flag <> human_flag)::integer + (ai_status <> human_status)::integer as n_changed from o")
def x49(spark, d):
    li = table(spark, d, "lineitem")
    human = F.when(F.col("l_linenumber") % 3 == 0, "X").otherwise(F.col("l_returnflag"))
    pair = lambda a, h: F.struct(a.alias("ai"), h.alias("human"))
    fields = F.create_map(F.lit("flag"), pair(F.col("l_returnflag"), human), F.lit("status"), pair(F.col("l_linestatus"), F.col("l_linestatus")))
    diff = F.map_filter(fields, lambda k, v: v["ai"] != v["human"])
    return li.select("l_orderkey", "l_linenumber", F.size(diff).alias("n_changed"))
