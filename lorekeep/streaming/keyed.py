"""Keyed state with expiry: events counted once each, however often and however late they come.

A state key is a part of the id space, not an entity, so an entity that holds most events is spread over all parts.  In a
part, map state holds the ids seen, packed by event-time bucket; a bucket expires ``keep_ms`` after its last new event.
The stream appends what every batch adds to an entity, and the entity's row is the sum of those, by ``totals``.  Parts
and deltas are written exactly once, so a stream that starts again from its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CUT = ["_part", "_known", "_id", "_bucket", "_by", "_at", "_score"]
DELTA = "_by string, first_seen timestamp, last_seen timestamp, mentions long, score double"


class CountOnce(StatefulProcessor):
    """What the events of a batch that were not seen before add to each entity."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "bucket long", "ids binary", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}  # a bucket is fetched once and written once a batch: every call is a round trip
        grown = set()
        for some in rows:
            some = some.set_axis(CUT, axis=1)  # they come without their names
            new = ~(some["_known"] & some.duplicated(["_bucket", "_id"])).to_numpy()
            places = np.flatnonzero(new & some["_known"].to_numpy())
            ids, buckets = some["_id"].to_numpy()[places], some["_bucket"].to_numpy()[places]
            order = np.argsort(buckets, kind="stable")
            cuts = np.flatnonzero(np.diff(buckets[order])) + 1
            for mine in np.split(order, cuts) if len(order) else ():
                bucket = int(buckets[mine[0]])
                if bucket not in held:
                    got = self.seen.getValue((bucket,))
                    held[bucket] = np.empty(0, np.int64) if got is None else np.frombuffer(got[0], np.int64)
                fresh = ~np.isin(ids[mine], held[bucket])
                new[places[mine[~fresh]]] = False
                if fresh.any():
                    held[bucket] = np.concatenate([held[bucket], ids[mine[fresh]]])
                    grown.add(bucket)
            if new.any():
                g = some[new].groupby("_by", sort=False)
                yield g.agg(first_seen=("_at", "min"), last_seen=("_at", "max"), mentions=("_at", "size"), score=("_score", "max")).reset_index()
        for bucket in grown:
            self.seen.updateValue((bucket,), (held[bucket].tobytes(),))

    def close(self) -> None:
        pass


def deltas(events: DataFrame, id: str, by: list[str], at: str, score: str, keep_ms: int | None = 30 * 86_400_000, parts: int = 64, bucket_seconds: int = 30 * 86_400) -> DataFrame:
    """``_by`` (the entity's columns as JSON), ``first_seen, last_seen, mentions, score`` of each batch's new events, as a stream.

    A repeat has the id and the event-time bucket of an event that its bucket's state still holds, and is not counted; which
    of an event's copies counts in one batch is open, so copies should agree.  Late events count, since no watermark drops
    them.  An event without id counts each time it comes; one without time has a bucket of its own.  ``parts`` stays as it is
    for the life of a checkpoint; a part's bucket should hold no more than some million ids.
    """
    known = F.col(id).isNotNull()
    cut = events.select(
        F.pmod(F.xxhash64(id, F.when(~known, F.xxhash64(at, *by))), F.lit(parts)).cast("int").alias("_part"),
        known.alias("_known"), F.coalesce(F.col(id).cast("long"), F.lit(0)).alias("_id"),
        F.coalesce(F.floor(F.unix_seconds(at) / bucket_seconds), F.lit(-(1 << 62))).cast("long").alias("_bucket"),
        F.to_json(F.struct(*by)).alias("_by"), F.col(at).alias("_at"), F.col(score).cast("double").alias("_score"),
    )
    return cut.groupBy("_part").transformWithStateInPandas(CountOnce(keep_ms), DELTA, "Append", "ProcessingTime")


def totals(rows: DataFrame, of: str) -> DataFrame:
    """The entities' rows from all deltas; ``of`` is the schema of the entity's columns."""
    g = rows.groupBy("_by").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("mentions").alias("mentions"), F.max("score").alias("score"))
    return g.withColumn("_by", F.from_json("_by", of)).select("_by.*", "first_seen", "last_seen", "mentions", "score")
