"""Indexes that are kept: built once for a table as it is now, and opened by every later search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .staging import checkpoint_folder


def state_of(table: DataFrame) -> str:
    """A digest of the names, lengths and times of a table's files."""
    spark, seen = table.sparkSession, hashlib.sha256()
    for f in sorted(table.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.update(f"{f}\0{status.getLen()}\0{status.getModificationTime()}\n".encode())
    return seen.hexdigest()[:32]


def kept(spark: SparkSession, table: DataFrame, kind: str, build: Callable[[str], None]) -> str:
    """The folder of the index ``kind`` of ``table``; ``build`` writes it under a name of its own, which becomes the folder's when it is whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/index-{kind}-{state_of(table)}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        part = path.suffix(f"-{spark._jvm.java.util.UUID.randomUUID().toString()}")
        build(part.toString())
        if not files.rename(part, path) and not files.exists(path):
            raise OSError(f"{path.toString()} could not be put in place")
    return path.toString()
