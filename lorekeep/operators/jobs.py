"""Jobs: queues with attempts, resumable runs, cursors, eviction, backpressure, backoff."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def run_queue(jobs: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], most: int = 3) -> DataFrame:
    """``jobs`` (``priority``, lower first, and others) after up to ``most`` attempts each: ``attempts, state``.

    ``attempt(rows, n)`` adds ``ok``.  What fails waits behind its former peers (its priority number grows by one) and
    is tried again; a round is one plan over all jobs that wait, whatever their number.
    """
    waiting, finished = jobs, None
    for n in range(1, most + 1):
        tried = stage(attempt(waiting, n).withColumn("attempts", F.lit(n)))
        last = n == most
        over = tried.filter("ok" if not last else "true").withColumn("state", F.when(F.col("ok"), "done").otherwise("failed")).drop("ok")
        finished = over if finished is None else finished.unionByName(over)
        waiting = tried.filter("not ok").drop("ok", "attempts").withColumn("priority", F.col("priority") + 1)
    return finished


def _table_at(rows: DataFrame, path: str) -> DataFrame | None:
    try:
        return rows.sparkSession.read.parquet(path)
    except AnalysisException:  # nothing was written yet
        return None


def resume(rows: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``work`` over the rows whose key has no result at ``path`` yet and keep its results there; all results with their ``run``."""
    done = _table_at(rows, path)
    left = rows if done is None else rows.join(done.select(key), key, "left_anti")
    run = 1 if done is None else done.agg(F.max("run")).first()[0] + 1
    work(left).withColumn("run", F.lit(run)).write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def sync(source: DataFrame, updated: str, path: str) -> DataFrame:
    """Take what was updated after the greatest ``updated`` at ``path``, which is the cursor, and add it there; all rows with their ``run``."""
    have = _table_at(source, path)
    new, run = source, 1
    if have is not None:
        last = have.agg(F.max(updated).alias("cursor"), F.max("run").alias("run")).first()
        new, run = source.filter(F.col(updated) > F.lit(last["cursor"])), last["run"] + 1
    new.withColumn("run", F.lit(run)).write.mode("append").parquet(path)
    return source.sparkSession.read.parquet(path)


def evicted(entries: DataFrame, capacity: int, stored: str, key: list[str]) -> DataFrame:
    """The entries beyond the ``capacity`` newest; which those are is one top-k, not a sort of all entries."""
    kept = entries.orderBy(F.desc(stored), *key).limit(capacity)
    return entries.join(F.broadcast(kept.select(*key)), key, "left_anti")


def backpressure(rows: DataFrame, by: str, order: list[str], used: str, pause: float = 92, go_on: float = 88) -> DataFrame:
    """``paused`` from the last time a bound was passed, and the ``share`` of workers left."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col(used) >= pause, True).when(F.col(used) <= go_on, False)
    share = F.when(F.col(used) >= pause + 5, 0.5).when(F.col(used) >= pause, 0.75).otherwise(1.0)
    return rows.withColumn("paused", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False))).withColumn("share", share)


def backoff(attempt: Column, first: float, most: float) -> Column:
    """Seconds to wait before an attempt, doubling up to a bound."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), attempt))
