"""Sinks: appends, registrations, merges, archives, compaction and rotation, as table writes and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def append(rows: DataFrame, path: str) -> DataFrame:
    """Add ``rows`` to the Parquet table at ``path``, which the first batch creates; the whole table."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def register(records: DataFrame, now: Column, tags: str = "tags") -> DataFrame:
    """Catalog rows of new records: normalised distinct tags without blanks, both stamps, status active."""
    clean = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: T.tag(F.trim(t))), lambda t: t != ""))
    return records.withColumns({tags: clean, "status": F.lit("active"), "created_at": now, "updated_at": now})


def record_exports(catalog: DataFrame, destination: str, path: Column, now: Column) -> DataFrame:
    """Export events of catalog rows: ``doc_id, destination, path, exported_at, redacted``."""
    return catalog.select("doc_id", F.lit(destination).alias("destination"), path.alias("path"), now.alias("exported_at"), F.col("is_sensitive").alias("redacted"))


def archive_paths(files: DataFrame, folder: Column, stamp: Column, name: str = "file_name", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, path``: folder and name; of files that would share a path all but the first get a stamp before the suffix.

    Clashes are found by the least id of a path, an aggregation and a join, so that a hot path is no single task.
    """
    placed = files.select(F.col(id_col).alias("doc_id"), F.concat_ws("/", folder, F.col(name)).alias("path"), stamp.cast("string").alias("stamp"))
    first = placed.groupBy("path").agg(F.min("doc_id").alias("first"))
    clash = F.regexp_replace("path", "(\\.[^./]*)?$", "")
    suffix = F.regexp_extract("path", "(\\.[^./]*)$", 1)
    return placed.join(first, "path").select("doc_id", F.when(F.col("doc_id") == F.col("first"), F.col("path")).otherwise(F.concat(clash, F.lit("_"), "stamp", suffix)).alias("path"))


def merge_manifest(items: DataFrame, updates: DataFrame, key: str = "item_id") -> DataFrame:
    """Items after a batch of updates: ``proposed`` maps are merged key by key, other columns replaced where given."""
    others = [c for c in updates.columns if c not in (key, "proposed")]
    renamed = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in updates.columns if c != key])
    both = items.join(renamed, key, "left")
    kept = F.map_filter("proposed", lambda k, _: ~F.coalesce(F.map_contains_key("_new_proposed", k), F.lit(False)))
    merged = F.when(F.col("_new_proposed").isNull(), F.col("proposed")).otherwise(F.map_concat(kept, "_new_proposed"))
    values = {"proposed": merged, **{c: F.coalesce(f"_new_{c}", c) for c in others}}
    return both.withColumns(values).select(*items.columns)


def compact(spark: SparkSession, path: str, out: str, rows_per_file: int) -> DataFrame:
    """The table at ``path`` rewritten in files of about ``rows_per_file`` rows; ``files_before, files_after, n_rows``."""
    rows = spark.read.parquet(path)
    n = rows.count()
    rows.repartition(max(1, -(-n // rows_per_file))).write.mode("overwrite").parquet(out)
    count = lambda p: spark.read.parquet(p).select(F.input_file_name().alias("f")).distinct().agg(F.count("*").alias("n"))
    before, after = count(path).withColumnRenamed("n", "files_before"), count(out).withColumnRenamed("n", "files_after")
    return before.crossJoin(after).withColumn("n_rows", F.lit(n))  # one row each


def rotate(backups: DataFrame, by: list[str], at: str, keep: int, id_col: str) -> DataFrame:
    """Backups with their place from the newest and whether they go: all beyond the ``keep`` newest of their set."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at), F.desc(id_col)))
    return backups.withColumn("place", place).withColumn("goes", F.col("place") > keep)


def migrate(spark: SparkSession, path: str, out: str, **columns: Column) -> DataFrame:
    """The table at ``path`` written again with new or recomputed columns."""
    spark.read.parquet(path).withColumns(columns).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
