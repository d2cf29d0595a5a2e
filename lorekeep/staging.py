"""Cutting lineage in the shared checkpoint folder, so that a lost executor costs its tasks alone."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input that one partition of a packed frame stands for at most.
SHARE = 64 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of its own only for a session of a single machine (tests) that names none."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "lorekeep-checkpoints")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame) -> DataFrame:
    """``df``, materialised once; Spark's cleaner removes the copy when the frame is no longer referenced."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a Parquet table in the shared folder, of which later reads take only the columns they need, and what deletes it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString()), lambda: path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and checkpoints that ``df`` is computed from; of other RDDs, ``SHARE`` for each partition."""
    total, leaves = 0, df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    conf, paths = df.sparkSession._jsc.hadoopConfiguration(), df.sparkSession._jvm.org.apache.hadoop.fs.Path
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() != "LogicalRDD":
            total += int(str(leaf.stats().sizeInBytes()))
        elif leaf.rdd().getCheckpointFile().isDefined():
            path = paths(leaf.rdd().getCheckpointFile().get())
            total += path.getFileSystem(conf).getContentSummary(path).getLength()
        else:
            total += leaf.rdd().getNumPartitions() * SHARE
    return total


def settle(df: DataFrame, each: int = 2) -> DataFrame:
    """``stage`` for what comes out of a shuffle: in no more files than ``packed`` allows, so that a small frame is not hundreds of them."""
    return stage(packed(df, each))


def packed(df: DataFrame, each: int = 8, share: int = SHARE) -> DataFrame:
    """``df`` in no more partitions than ``each`` a core or one for each ``share`` bytes that it is computed from, whichever is more.

    What is written from a small frame is then not a great many small files, and a partition's share of a large one does not grow with it.
    """
    return df.coalesce(min((1 << 31) - 1, max(8, each * df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // share))))
