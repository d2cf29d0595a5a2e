"""Streaming plans over the event table, run to the end of the files; their oracles are the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, reach
from ..streaming import events as E
from ..streaming import keyed


def _plain(rows):
    """Times as in the table, without a zone."""
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in rows.dtypes])


@query("m07_windowed_log", "select date_trunc('hour', ts) as started, event_type, count(*) as n, round(sum(value::decimal(18,6))::double, 4) as total from events group by all")
def m07(spark, d):
    return _plain(E.drain(E.windowed(E.read(spark, d, "events")), "complete"))


@query("m07_sliding_windows", "with s as (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as started, event_type, value from events) select started, event_type, count(*) as n, round(sum(value::decimal(18,6))::double, 4) as total from s group by all")
def m07b(spark, d):
    return _plain(E.drain(E.windowed(E.read(spark, d, "events"), "2 hours", "1 hour"), "complete"))


@query("m08_session_windows", """with g as (select *, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) >= 7200000000, true) as fresh from events), s as (select *, sum(fresh::bigint) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
select user_id, min(ts) as started, count(*) as n from s group by user_id, k""")
def m08(spark, d):
    return _plain(E.drain(E.sessions(E.read(spark, d, "events")), "complete"))


@query("m09_entity_counters", "select user_id, event_type, min(ts) as first_seen, max(ts) as last_seen, count(*) as mentions, max(value) as score from events group by all")
def m09(spark, d):
    return _plain(E.drain(E.counters(E.read(spark, d, "events")), "complete"))


@query("m09_click_counters", "with u as (select distinct on (click_id) * from clicks) select client_id, kind, min(ts) as first_seen, max(ts) as last_seen, count(*) as mentions, max(value) as score from u where click_id is not null group by all")
def m09_clicks(spark, d):
    """Every click counted once for its client and kind, repeats and late ones among them, with the ids seen as keyed state."""
    reach(spark)
    clicks = E.read(spark, d, "clicks", files_per_trigger=64).filter("click_id is not null")
    stream = keyed.deltas(clicks, "click_id", ["client_id", "kind"], "ts", "value")
    return _plain(keyed.totals(E.drain_keyed(stream), "client_id long, kind string"))


@query("m05_incremental_dedup", "select distinct event_id from events")
def m05(spark, d):
    return _plain(E.drain(E.without_repeats(E.read(spark, d, "events"), "event_id").select("event_id"), "append"))


@query("m01_file_arrival", "select doc_id, length(text)::bigint as n from documents")
def m01(spark, d):
    return _plain(E.drain(E.read(spark, d, "documents").select("doc_id", F.char_length("text").cast("long").alias("n")), "append"))
