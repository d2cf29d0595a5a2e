"""Structured Streaming forms: the same operators over event streams.

Every function takes a streaming (or batch) frame and returns one; ``drain`` runs a stream to the end of what is there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import checkpoint_folder
from .keyed import PROVIDER, ROCKSDB


def read(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream; ``files_per_trigger`` is the rate limit."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"})  # event time needs a zone; the session's is UTC


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``started, event_type, n, total`` per tumbling or sliding window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double"), 4).alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def without_repeats(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def counters(events: DataFrame) -> DataFrame:
    """First and last seen, mentions and best score per entity, updated as events come."""
    return events.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("mentions"), F.max("value").alias("score"))


def drain(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Everything the stream gives for what is there now: a table of Parquet files in the shared checkpoint folder.

    In ``append`` mode the sink writes files; other modes rewrite the result at every batch, of which the last one stays.
    A named ``folder`` keeps state and result, and a later drain into it goes on from there.
    """
    spark = stream.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        q = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_keyed(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """``drain`` for streams of ``keyed``: expiring state asks for RocksDB, and would ask for batches without data for ever."""
    conf = stream.sparkSession.conf
    own = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: conf.get(k, None) for k in own}
    for k, v in own.items():
        conf.set(k, v)
    try:
        return drain(stream, "append", folder)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
