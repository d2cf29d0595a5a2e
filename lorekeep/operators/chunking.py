"""Cutting documents into sections, sentences, parents and children.

The greedy packers are folds over a document's own pieces; they run as higher-order
functions, so a document never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: abbreviations whose full stop ends no sentence
ABBREVIATIONS = ["Dr", "Mr", "Mrs", "Ms", "Prof", "Inc", "Ltd", "Corp", "vs", "etc", "Jr"]
DOT = "<DOT>"


def sentences(text: Column, restore: bool = True) -> Column:
    """Non-empty sentences; a full stop, question or exclamation mark before white space ends one."""
    kept = F.regexp_replace(text, "\\b(" + "|".join(ABBREVIATIONS) + ")\\.", "$1" + DOT)
    parts = F.filter(F.split(kept, "(?<=[.!?])[\\s\\p{Z}]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.replace(x, F.lit(DOT), F.lit("."))) if restore else parts


def pack(pieces: Column, limit: int, joiner: str, overlap: int = 0) -> Column:
    """Greedy packing of text pieces into chunks of at most ``limit`` estimated tokens.

    A piece that alone is larger makes a chunk of its own.  With ``overlap`` a chunk starts with the
    whole last pieces of the chunk before it, up to so many tokens.  Rows: ``struct(chunks, held)``.
    """
    empty = F.expr("cast(array() as array<string>)")
    size = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.floor(F.char_length(x) / 4).cast("int"))
    start = F.struct(empty.alias("chunks"), empty.alias("held"))

    def tail(held: Column) -> Column:
        if not overlap:
            return empty
        back = F.aggregate(
            F.reverse(held),
            F.struct(empty.alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full")),
            lambda s, x: F.when(
                ~s["full"] & (s["n"] + F.floor(F.char_length(x) / 4).cast("int") <= overlap),
                F.struct(F.concat(F.array(x), s["kept"]).alias("kept"), (s["n"] + F.floor(F.char_length(x) / 4).cast("int")).alias("n"), F.lit(False).alias("full")),
            ).otherwise(F.struct(s["kept"].alias("kept"), s["n"].alias("n"), F.lit(True).alias("full"))),
        )
        return back["kept"]

    def step(s: Column, x: Column) -> Column:
        over = (F.size(s["held"]) > 0) & (size(s["held"]) + F.floor(F.char_length(x) / 4).cast("int") > limit)
        closed = F.struct(F.concat(s["chunks"], F.array(F.array_join(s["held"], joiner))).alias("chunks"), F.concat(tail(s["held"]), F.array(x)).alias("held"))
        return F.when(over, closed).otherwise(F.struct(s["chunks"].alias("chunks"), F.concat(s["held"], F.array(x)).alias("held")))

    end = lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["chunks"], F.array(F.array_join(s["held"], joiner)))).otherwise(s["chunks"])
    return F.aggregate(pieces, start, step, end)


def parents(docs: DataFrame, limit: int = 1500) -> DataFrame:
    """``doc_id, parent_index, content``: paragraphs packed into parents."""
    paragraphs = F.filter(F.transform(F.split("text", "\n[ \t]*\n"), T.strip), lambda x: x != "")
    # an inner explode would pack the texts once more, in a filter that it infers
    return docs.select("doc_id", F.posexplode_outer(pack(paragraphs, limit, "\n\n")).alias("parent_index", "content")).filter("parent_index is not null")


def children(rows: DataFrame, keys: list[str], content: str = "content", target: int = 150, overlap: int = 25) -> DataFrame:
    """``keys..., chunk_index, content``: sentences packed into children with whole-sentence overlap."""
    return rows.select(*keys, F.posexplode_outer(pack(sentences(F.col(content)), target, " ", overlap)).alias("chunk_index", "content")).filter("chunk_index is not null")


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, section, title, start, content`` by Markdown headers; text before the first header has no title, blank sections go."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line", "t"))
    w = Window.partitionBy("doc_id").orderBy("line")
    marked = lines.withColumn("head", F.col("t").rlike("^#{1,6}[ \t]+.+$")).withColumn("start", F.sum(F.char_length("t") + 1).over(w) - F.char_length("t") - 1)
    marked = marked.withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    grouped = marked.groupBy("doc_id", "section").agg(
        F.max(F.when(F.col("head"), F.regexp_replace("t", "^#{1,6}[ \t]+", ""))).alias("title"),
        F.min("start").alias("start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t", "head"))), lambda x: F.when(~x["head"], x["t"])), "\n").alias("content"),
    )
    return grouped.filter(T.strip(F.col("content")) != "").select("doc_id", F.col("section").cast("long").alias("section"), "title", F.col("start").cast("long").alias("start"), "content")


def line_windows(docs: DataFrame, size: int = 60, step: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, first_line, n_lines, content``: windows of lines that overlap by ``size - step``."""
    split = docs.select(F.col(id_col).alias("doc_id"), F.split(text_col, "\n").alias("lines"))
    at = split.select("doc_id", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(step))).alias("i"))
    part = F.slice("lines", F.col("i") + 1, F.lit(size))
    return at.select("doc_id", F.col("i").cast("long").alias("first_line"), F.size(part).cast("long").alias("n_lines"), F.array_join(part, "\n").alias("content"))
