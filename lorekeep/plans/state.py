"""Plans with state: caches, rate limits, queues, resumable jobs, cursors, breakers, over the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import walks as W
from ..registry import query, table
from ..staging import checkpoint_folder

# events in order with whole seconds, numbered within a key, for oracles that walk them by recursion
STEPS = "s as (select event_id, {key} as k, floor(epoch(ts))::bigint as t, value, row_number() over (partition by {key} order by floor(epoch(ts)), event_id) as i from events)"
HITS = f"""{STEPS.format(key="user_id")}, c as (select event_id, k, i, t as stored, false as hit from s where i = 1 union all
 select s.event_id, s.k, s.i, case when s.t - c.stored < 3600 then c.stored else s.t end, s.t - c.stored < 3600 from c join s on s.k = c.k and s.i = c.i + 1)"""


def events(spark, d):
    return table(spark, d, "events").withColumn("t", F.unix_timestamp("ts"))


@query("r28_result_cache", f"with recursive {HITS} select event_id, hit from c")
def r28(spark, d):
    """Lookups of each user's results against a cache of an hour."""
    return W.cache_hits(events(spark, d), "user_id", "t", "event_id", 3600).select("event_id", "hit")


@query("a40_cache_stats", f"with recursive {HITS} select k as user_id, count(*) as n, sum(hit::bigint)::bigint as n_hits, round(avg(hit::int), 6) as hit_rate from c group by 1")
def a40(spark, d):
    hit = F.col("hit").cast("int")
    rows = W.cache_hits(events(spark, d), "user_id", "t", "event_id", 3600)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("n_hits"), F.round(F.avg(hit), 6).alias("hit_rate"))


@query("m10_expired_entries", "with e as (select user_id, event_type, max(ts) as stored from events group by all), n as (select max(ts) as now from events) select user_id, event_type from e, n where floor(epoch(now)) - floor(epoch(stored)) >= 43200")
def m10(spark, d):
    entries = events(spark, d).groupBy("user_id", "event_type").agg(F.max("t").alias("stored"))
    now = events(spark, d).agg(F.max("t").alias("now"))  # one row
    return entries.join(F.broadcast(now), F.col("now") - F.col("stored") >= 43200).select("user_id", "event_type")


@query("t09_eviction", "with e as (select user_id, event_type, max(ts) as stored from events group by all) select user_id, event_type from (select *, row_number() over (order by stored desc, user_id, event_type) as place from e) where place > 128")
def t09(spark, d):
    entries = events(spark, d).groupBy("user_id", "event_type").agg(F.max("ts").alias("stored"))
    return J.evicted(entries, 128, "stored", ["user_id", "event_type"]).select("user_id", "event_type")


@query("m02_priority_queue", """with j as (select o_orderkey as job, left(o_orderpriority, 1)::integer as priority, o_orderdate as created, (o_orderkey % 5)::integer as failures from orders)
select job, least(failures + 1, 3)::integer as attempts, case when failures < 3 then 'done' else 'failed' end as state, priority + least(failures, 2) as priority from j""")
def m02(spark, d):
    """Jobs that fail a given number of times, at most three attempts each."""
    o = table(spark, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"), F.col("o_orderdate").alias("created"), (F.col("o_orderkey") % 5).cast("int").alias("failures"))
    return J.run_queue(jobs, lambda rows, attempt: rows.withColumn("ok", F.col("failures") < attempt), most=3).select("job", "attempts", "state", "priority")


@query("m03_token_bucket", f"""with recursive {STEPS.format(key="user_id")}, c as (select event_id, k, i, t, 4.0::double as tokens, true as allowed from s where i = 1 union all
 select s.event_id, s.k, s.i, s.t, case when least(5.0::double, c.tokens + (s.t - c.t) * 0.0005::double) >= 1 then least(5.0::double, c.tokens + (s.t - c.t) * 0.0005::double) - 1 else least(5.0::double, c.tokens + (s.t - c.t) * 0.0005::double) end,
  least(5.0::double, c.tokens + (s.t - c.t) * 0.0005::double) >= 1 from c join s on s.k = c.k and s.i = c.i + 1) select event_id, allowed from c""")
def m03(spark, d):
    return W.token_bucket(events(spark, d), "user_id", "t", "event_id", 5.0, 0.0005).select("event_id", "allowed")


@query("m04_resumable_job", "select lang, count(*) as n, sum((doc_id % 3 = 0)::bigint)::bigint as n_before, sum((doc_id % 3 <> 0)::bigint)::bigint as n_resumed from documents group by 1")
def m04(spark, d):
    """A job that stopped after a third of its documents, and its second run over what was left."""
    path = f"{checkpoint_folder(spark)}/job-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "lang")
    work = lambda rows: rows.withColumn("result", F.col("doc_id") * 2)
    J.resume(docs.filter("doc_id % 3 = 0"), "doc_id", path, work)
    done = J.resume(docs, "doc_id", path, work)
    before = F.col("run") == 1
    return done.groupBy("lang").agg(F.count("*").alias("n"), F.sum(before.cast("long")).alias("n_before"), F.sum((~before).cast("long")).alias("n_resumed"))


@query("m06_cursor_sync", "with m as (select max(o_orderdate) as top from orders where o_orderdate < '1996-01-01'), r as (select *, case when o_orderdate < '1996-01-01' then 1 else 2 end as run from orders) select run, count(*) as n, max(o_orderdate) as cursor from r group by 1")
def m06(spark, d):
    """Two syncs of a source; the second takes what was updated after the first one's cursor."""
    path = f"{checkpoint_folder(spark)}/sync-{uuid.uuid4().hex}"
    source = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("updated"))
    J.sync(source.filter("updated < '1996-01-01'"), "updated", path)
    return J.sync(source, "updated", path).groupBy("run").agg(F.count("*").alias("n"), F.max("updated").alias("cursor"))


@query("m11_backpressure", """with u as (select event_id, user_id, ts, 80 + value % 20 as used from events), m as (select *, case when used >= 92 then true when used <= 88 then false end as mark from u)
select event_id, coalesce(last_value(mark ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), false) as paused, case when used >= 97 then 0.5::double when used >= 92 then 0.75::double else 1.0::double end as share from m""")
def m11(spark, d):
    """Memory use that pauses work at 92 percent and lets it go on at 88, and the share of workers left."""
    used = 80 + F.col("value") % 20
    rows = table(spark, d, "events").withColumn("used", used)
    return J.backpressure(rows, "user_id", ["ts", "event_id"], "used").select("event_id", "paused", "share")


BREAK = f"""{STEPS.format(key="event_type")}, f as (select *, value < 30 as bad from s),
c as (select event_id, k, i, t, 'closed' as seen, case when bad then 1 else 0 end as fails, 0 as wins, case when bad then t else 0 end as since, 'closed' as mode from f where i = 1 union all
 select event_id, k, i, t, seen, case when seen = 'open' then fails when bad then fails + 1 when seen = 'half_open' then case when w + 1 >= 2 then 0 else fails end else 0 end, case when seen = 'half_open' and not bad then w + 1 else w end,
  case when seen <> 'open' and bad then t else since end, case when seen = 'open' then 'open' when bad then case when seen = 'half_open' or fails + 1 >= 3 then 'open' else mode2 end when seen = 'half_open' and w + 1 >= 2 then 'closed' else mode2 end from
 (select f.event_id, f.k, f.i, f.t, f.bad, c.fails, c.since, case when c.mode = 'open' and f.t - c.since >= 900 then 'half_open' else c.mode end as seen, case when c.mode = 'open' and f.t - c.since >= 900 then 'half_open' else c.mode end as mode2,
  case when c.mode = 'open' and f.t - c.since >= 900 then 0 else c.wins end as w from c join f on f.k = c.k and f.i = c.i + 1))"""


@query("m12_circuit_breaker", f"with recursive {BREAK} select event_id, seen as state from c")
def m12(spark, d):
    calls = events(spark, d).withColumn("bad", F.col("value") < 30)
    return W.circuit_breaker(calls, "event_type", "t", "event_id", "bad", threshold=3, successes=2, timeout=900).select("event_id", "state")


@query("m12_retry_waits", "select event_id, least(60.0::double, 1.0::double * power(2.0::double, event_id % 8)) as wait from events")
def m12b(spark, d):
    return table(spark, d, "events").select("event_id", J.backoff((F.col("event_id") % 8).cast("int"), 1.0, 60.0).alias("wait"))
