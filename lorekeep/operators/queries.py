"""Query understanding: kind, focus, decomposition and rewriting of follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: the patterns of the decomposition rules, in order
COMPARISONS = ["(.+)\\s+vs\\.?\\s+(.+)", "(.+)\\s+versus\\s+(.+)", "(.+)\\s+compared to\\s+(.+)", "difference between\\s+(.+)\\s+and\\s+(.+)", "(.+)\\s+or\\s+(.+)\\s*\\?"]
COMPOUNDS = ["(.+)\\s+and\\s+(.+)", "(.+)\\s+as well as\\s+(.+)", "(.+)\\s+along with\\s+(.+)"]
ASPECTS = ["what is (.+) and how", "why (.+) and how"]
# fixed values: how a follow-up starts, and the words that tie it to what came before
PRONOUNS = ["it", "this", "that", "they", "them", "those", "these", "its", "their"]
CONNECTORS = ["also", "another", "more", "else", "too", "instead", "besides", "similarly"]


def kind(q: Column) -> Column:
    low = F.lower(q)
    return (
        F.when(low.rlike("^(how to|how do|how can)"), "procedural")
        .when(low.rlike("^(what is|what are|define)"), "conceptual")
        .when(low.rlike("^(why|explain why)"), "explanatory")
        .when(low.rlike("^(when|where|who)"), "factual")
        .otherwise("general")
    )


def focus(q: Column) -> Column:
    """The query without a leading question word and a final question mark."""
    bare = F.regexp_replace(F.lower(q), "^(what|how|why|when|where|who|is|are|do|does|can|should)\\s+", "")
    return F.trim(F.regexp_replace(bare, "\\?$", ""))


def _parts(q: Column, pattern: str) -> list[Column]:
    return [F.trim(F.regexp_extract(q, "(?i)" + pattern, i)) for i in (1, 2)]


def decompose(rows: DataFrame, q: str) -> DataFrame:
    """Sub-queries, one row each: comparisons first, then compounds, else the query itself."""
    col = F.col(q)

    def sub(text: Column, kind_: Column | str, weight: float = 1.0) -> Column:
        return F.struct(text.alias("sub_query"), (F.lit(kind_) if isinstance(kind_, str) else kind_).alias("kind"), F.lit(weight).alias("weight"))

    chosen = None
    cases = [(p, "entity") for p in COMPARISONS] + [(p, "factual") for p in COMPOUNDS]
    for pattern, name in cases:
        a, b = _parts(col, pattern)
        subs = [sub(a, name), sub(b, name)] + ([sub(col, "comparison", 1.2)] if name == "entity" else [])
        hit = col.rlike("(?i)" + pattern)
        chosen = F.when(hit, F.array(*subs)) if chosen is None else chosen.when(hit, F.array(*subs))
    return rows.select(*rows.columns, F.inline(chosen.otherwise(F.array(sub(col, kind(col))))))


def rewrite_follow_ups(turns: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """``rewritten``: a follow-up gets up to five longer words of the turn before it in front."""
    previous = F.lag(text).over(Window.partitionBy(by).orderBy(order))
    words = F.array_distinct(T.words(F.col(text)))
    first = F.lower(F.element_at(F.split(F.trim(F.col(text)), "\\s+"), 1))
    follows = (F.size(words) <= 3) | first.isin(PRONOUNS) | F.arrays_overlap(words, F.array(*[F.lit(c) for c in CONNECTORS]))
    before = F.slice(F.filter(T.tokens(F.col("_before")), lambda x: F.char_length(x) > 2), 1, 5)
    rows = turns.withColumn("_before", previous)
    joined = F.concat_ws(" ", F.array_join(before, " "), F.col(text))
    return rows.withColumn("rewritten", F.when(F.col("_before").isNotNull() & follows, joined).otherwise(F.col(text))).drop("_before")
