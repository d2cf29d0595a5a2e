"""Events counted once by keyed state: restarts, repeats, late, null and hot rows against the batch result."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from lorekeep.streaming import events as E
from lorekeep.streaming import keyed as K

SCHEMA = "id long, at timestamp, who long, kind string, v double"
BEGIN = dt.datetime(2024, 1, 1)


def counted(spark, folder, state, **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return E.drain_keyed(K.deltas(stream, "id", ["who", "kind"], "at", "v", **how), state)


def expected(rows):
    out, seen = {}, set()
    for i, at, who, kind, v in rows:
        if i is not None and i in seen:
            continue
        seen.add(i)
        out.setdefault((who, kind), []).append((at, v))
    least = lambda xs, f: f([x for x in xs if x is not None], default=None)
    return {k: (least([a for a, _ in x], min), least([a for a, _ in x], max), len(x), least([v for _, v in x], max)) for k, x in out.items()}


def found(spark, deltas):
    rows = K.totals(deltas, "who long, kind string").collect()
    assert len({(r.who, r.kind) for r in rows}) == len(rows)
    return {(r.who, r.kind): (r.first_seen, r.last_seen, r.mentions, r.score) for r in rows}


def test_restarts_repeats_late_and_hot(spark, tmp_path):
    """Three runs over one state, each with new events, repeats of all earlier runs and events from long before."""
    rng = random.Random(5)
    rows = [((1 << 60) + k if k % 9 else -k, BEGIN + dt.timedelta(minutes=rng.randrange(10_000)), 7 if k % 3 else k % 20, rng.choice(["a", "b", None]), rng.choice([None, float(k % 50)])) for k in range(900)]
    rows = [(i, None if k % 90 == 1 else at, None if k % 70 == 1 else who, kind, v) for k, (i, at, who, kind, v) in enumerate(rows)]
    source, state, sent = str(tmp_path / "in"), str(tmp_path / "state"), []
    for part in range(3):
        fresh = rows[part * 300 : part * 300 + 300]
        batch = fresh + rng.sample(fresh, 40) + rng.sample(sent, min(len(sent), 90)) + [(None, BEGIN, 3, "none", 1.0)] * 2
        rng.shuffle(batch)
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        sent += batch
        deltas = counted(spark, source, state, parts=4)
    want = expected(sent)
    assert found(spark, deltas) == want and want[3, "none"][2] == sum(r[0] is None for r in sent)
    n = deltas.count()
    assert counted(spark, source, state, parts=4).count() == n  # nothing new: nothing added


def test_state_expires(spark, tmp_path):
    """A repeat that comes after its bucket expired counts again; one before that does not."""
    rows, source = [(1, BEGIN, 1, "a", 1.0), (2, BEGIN, 1, "a", 2.0)], str(tmp_path / "in")
    for keep_ms, total in ((1, 4), (3_600_000, 2)):
        state = str(tmp_path / f"state{keep_ms}")
        for k in range(2):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append" if k else "overwrite").parquet(f"{source}{keep_ms}")
            deltas = counted(spark, f"{source}{keep_ms}", state, parts=1, keep_ms=keep_ms)
        assert deltas.agg(F.sum("mentions")).first()[0] == total


def test_empty_and_clashing_names(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], "id long, at timestamp, _by long, kind string, v double").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id long, at timestamp, _by long, _part string, kind string, v double").parquet(source)
    assert E.drain_keyed(K.deltas(stream, "id", ["kind"], "at", "v"), str(tmp_path / "s")).count() == 0

