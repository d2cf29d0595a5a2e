"""All registered queries of the engine and their SQL oracles.

A query is registered under ``<operator id>_<name>`` by the module in
``lorekeep.plans`` that composes it; its oracle is the same computation in plain
SQL over the same tables.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PLANS = ("texts", "catalog", "retrieval", "dedup", "privacy", "graph", "analytics", "quality", "versions", "tags", "chunks", "relational", "streams", "ingest", "notes", "writes", "state", "search", "intake", "hooked", "parts", "files")
COSTLY = ("documents", "embeddings", "pages")
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame``, with its oracle if SQL can express it."""

    def put(f):
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return put


def reach(spark: SparkSession) -> None:
    """Let Python workers find this package wherever the driver was started; paths that a machine lacks do no harm."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table.  One file of one row group would be one task; on tables of documents, whose rows are costly, that is spread over the cores."""
    reach(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in COSTLY and (cores := spark.sparkContext.defaultParallelism) > rows._jdf.queryExecution().toRdd().getNumPartitions():
        return rows.repartition(cores)
    return rows


def _load() -> None:
    for name in PLANS:
        importlib.import_module(f"lorekeep.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
