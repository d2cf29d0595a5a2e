"""The document catalog: filters, mutations as rewrites, statistics."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def column(name: str) -> Column:
    """A column by a checked identifier."""
    if not IDENTIFIER.match(name):
        raise ValueError(f"not an identifier: {name!r}")
    return F.col(name)


def equals(name: str, value: object) -> Column:
    return column(name).cast("string") == F.lit(str(value))


def like(name: str, pattern: str) -> Column:
    return column(name).like(pattern)


def tagged(tags: str | list[str], name: str = "tags") -> Column:
    """All of the tags are in the array column."""
    wanted = [tags] if isinstance(tags, str) else list(tags)
    return reduce(lambda a, b: a & b, [F.array_contains(column(name), t) for t in wanted], F.lit(True))


def where(filters: dict) -> Column:
    """All filters at once; the key ``tags`` means membership, the others equality."""
    parts = [tagged(v) if k == "tags" else equals(k, v) for k, v in filters.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(catalog: DataFrame, status: str | None = None, **filters) -> DataFrame:
    """Newest first; deleted records are left out unless ``status`` asks for them."""
    state = F.col("status") == status if status else F.col("status") != "deleted"
    return catalog.filter(state & where({k: v for k, v in filters.items() if v is not None})).orderBy(F.desc("created_at"), "doc_id")


def update(rows: DataFrame, condition: Column, allowed: set[str], **values) -> DataFrame:
    """Rewrite of the allowed columns where the condition holds."""
    bad = set(values) - allowed
    if bad:
        raise ValueError(f"columns that may not be changed: {sorted(bad)}")
    return rows.withColumns({k: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def delete(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and the number of rows that go."""
    gone = F.coalesce(condition, F.lit(False))
    return rows.filter(~gone), rows.filter(gone).agg(F.count("*").alias("n_deleted"))


def stats(catalog: DataFrame) -> DataFrame:
    """Long form ``measure, key, n``: totals, per category, per status (deleted included), sensitive, per tag."""
    alive = F.col("status") != "deleted"
    parts = [
        catalog.agg(F.sum(alive.cast("long")).alias("n")).select(F.lit("total").alias("measure"), F.lit("").alias("key"), "n"),
        catalog.filter(alive & F.col("category").isNotNull()).groupBy("category").agg(F.count("*").alias("n")).select(F.lit("category").alias("measure"), F.col("category").alias("key"), "n"),
        catalog.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("status").alias("measure"), F.col("status").alias("key"), "n"),
        catalog.agg(F.sum((alive & F.col("is_sensitive")).cast("long")).alias("n")).select(F.lit("sensitive").alias("measure"), F.lit("").alias("key"), "n"),
        catalog.filter(alive).select(F.explode("tags").alias("key")).groupBy("key").agg(F.count("*").alias("n")).select(F.lit("tag").alias("measure"), "key", "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """One row per (name, type, document): first and last seen, mentions, best score."""
    return mentions.groupBy("name", "type", "doc_id").agg(
        F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count("*").alias("mentions"), F.max("score").alias("score")
    )
