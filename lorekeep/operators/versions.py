"""Version histories: numbering, changes, latest states, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diffs import text_diff


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``version`` counted from 1 in order."""
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def latest(rows: DataFrame, by: str, order: list[Column], n: int = 1) -> DataFrame:
    """The last ``n`` rows of each key, newest first; ``age`` is 1 for the newest."""
    return rows.withColumn("age", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("age") <= n)


def changed(rows: DataFrame, by: str, order: list[str], state: Column) -> DataFrame:
    """Rows whose state differs from that of the row before; a first row is a change."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_s", state).withColumn("_p", F.lag("_s").over(w)).filter(F.col("_p").isNull() | (F.col("_s") != F.col("_p"))).drop("_s", "_p")


_differ = text_diff()


def line_diff(old: Column, new: Column) -> Column:
    """Lines added and removed between two texts, the fewest possible."""
    found = _differ(old, new)
    return F.struct(found["added"].alias("added"), found["removed"].alias("removed"))


def rendered(facts: DataFrame, by: list[str], category: str, order: str, text: str, expires: str | None = None, now: Column | None = None) -> DataFrame:
    """A heading per category and a line a fact, in order, of the facts that have not expired; a list is bounded by its owner's facts."""
    alive = facts if expires is None else facts.filter(F.col(expires).isNull() | (F.col(expires) > now))
    g = alive.groupBy(*by, category).agg(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("_t")))).alias("_x"))
    lines = F.array_join(F.transform("_x", lambda x: F.concat(F.lit("- "), x["_t"])), "\n")
    return g.select(*by, category, F.concat(F.lit("## "), F.col(category), F.lit("\n"), lines).alias("rendered"))
