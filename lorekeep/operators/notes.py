"""Notes and answers: links between notes, names of files, repaired JSON, transcripts, user facts, cited evidence."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .breaks import breaks




def safe_name(name: Column) -> Column:
    """Letters, digits, dash, dot and underscore; others and their runs become one underscore."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


@F.pandas_udf(T.StringType())
def repair_json(raw: pd.Series) -> pd.Series:
    """The first object of an answer: without thinking tags and fences, and with open strings and brackets closed; null if hopeless."""

    def one(text: str | None) -> str | None:
        text = re.sub(r"<think>.*?</think>", "", text or "", flags=re.DOTALL)
        text = re.sub(r"^\s*```(?:json)?|```\s*$", "", text.strip())
        if "{" not in text:
            return None
        text, stack, quoted, skip = text[text.index("{") :], [], False, False
        for i, c in enumerate(text):
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
                if not stack:
                    text = text[: i + 1]
                    break
        text += '"' * quoted + "".join(reversed(stack))
        try:
            return json.dumps(json.loads(re.sub(r",\s*([}\]])", r"\1", text)), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    return raw.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def code_blocks(source: pd.Series) -> pd.Series:
    """Top-level definitions of Python source, with what stands before and between them; unreadable source is one block."""

    def one(text: str | None) -> list[str]:
        text = text or ""
        try:
            body = ast.parse(text).body
        except (SyntaxError, ValueError):
            return [text] if text.strip() else []
        lines, out, at = text.split("\n"), [], 0
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([node.lineno, *[d.lineno for d in node.decorator_list]]) - 1
                out += ["\n".join(lines[at:first]), "\n".join(lines[first : node.end_lineno])]
                at = node.end_lineno
        out.append("\n".join(lines[at:]))
        return [x for x in out if x.strip()]

    return source.map(one)


def wikilinks(text: Column, name: str) -> Column:
    """``[[name]]`` around the first whole-word mention outside of links and code, in any case."""
    pattern = "(?i)^((?:[^`\\[]|\\[[^\\]]*\\]|`[^`]*`)*?)\\b(" + re.escape(name) + ")\\b"
    return F.regexp_replace(text, pattern, "$1[[$2]]")


def chapters(segments: DataFrame, by: str, at: str, least_gap: float) -> DataFrame:
    """``by, chapter, started``: a chapter begins when ``least_gap`` has passed since the last one's start; ``breaks`` says how."""
    return breaks(segments, by, at, least_gap).select(by, F.col("place").cast("int").alias("chapter"), "started")


def assign(points: DataFrame, spans: DataFrame, by: str, at: str) -> DataFrame:
    """Each point with the chapter that began last before it: one sort of both sides, no range join."""
    tagged = points.select(by, F.col(at).cast("double").alias("t"), F.lit(1).alias("k"), F.lit(None).cast("int").alias("chapter")).unionByName(spans.select(by, F.col("started").alias("t"), F.lit(0).alias("k"), "chapter"))
    w = Window.partitionBy(by).orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn("chapter", F.last("chapter", ignorenulls=True).over(w)).filter("k = 1").select(by, "t", "chapter")


def cited(answers: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """``known`` and ``verbatim`` of each citation (``quote``) against its evidence (``content``), white space and case apart."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, "[\\s\\p{Z}]+", " ")))
    joined = answers.join(evidence.select(*keys, "content"), keys, "left")
    return joined.withColumn("known", F.col("content").isNotNull()).withColumn("verbatim", F.coalesce(plain(F.col("content")).contains(plain(F.col("quote"))), F.lit(False))).drop("content")


def adaptive_rate(choices: DataFrame, by: str, order: str, start: float = 0.1, block: int = 1 << 16) -> DataFrame:
    """Decay rate per category after its choices, in order: older picks lower it, newer picks raise it, within bounds.

    A run of updates is ``rate -> min(max(a * rate, lo), hi)`` whatever its length, so runs of ``block`` order values are
    folded apart and their results are folded after: no task holds a whole category.
    """
    older, newer = F.col("picked") > 1.5 * F.col("others"), F.col("picked") < 0.5 * F.col("others")
    one = F.struct(
        F.when(older, 0.9).when(newer, 1.1).otherwise(1.0).alias("a"), F.when(older, 0.01).otherwise(0.0).alias("lo"), F.when(newer, 0.5).otherwise(F.lit(float("inf"))).alias("hi")
    )

    def then(f: Column, g: Column) -> Column:
        bound = lambda x: F.least(F.greatest(x, g["lo"]), g["hi"])
        return F.struct((f["a"] * g["a"]).alias("a"), bound(f["lo"] * g["a"]).alias("lo"), bound(f["hi"] * g["a"]).alias("hi"))

    def folded(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
        g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("f.a").alias("a"), F.col("f.lo").alias("lo"), F.col("f.hi").alias("hi")))).alias("x"))
        same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"))
        return g.select(*keys, F.aggregate("x", same, then).alias("f"))

    runs = folded(choices.select(by, order, F.floor(F.col(order) / block).alias("_run"), one.alias("f")), [by, "_run"], order)
    f = F.col("f")
    return folded(runs, [by], "_run").select(by, F.round(F.least(F.greatest(f["a"] * start, f["lo"]), f["hi"]), 6).alias("rate"))


def expand_hypothetical(rows: DataFrame, q: str, generate: Column) -> DataFrame:
    """``expanded``: a generated passage for the dense search; short queries and direct look-ups keep their own words."""
    skip = (F.char_length(q) < 10) | F.lower(q).rlike("^(find|open|show|list) ")
    return rows.withColumn("expanded", F.when(skip, F.col(q)).otherwise(generate))


def keep_facts(facts: DataFrame, by: list[str], order: str) -> DataFrame:
    """The fact of each category after all updates: a new one replaces the old unless the old contains it and is as sure."""
    g = facts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "fact", "confidence"))).alias("x"))
    last = F.aggregate(
        F.slice("x", 2, F.size("x")),
        F.element_at("x", 1),
        lambda a, b: F.when(F.lower(a["fact"]).contains(F.lower(b["fact"])) & (b["confidence"] <= a["confidence"]), a).otherwise(b),
    )
    return g.select(*by, last.alias("l")).select(*by, "l.fact", "l.confidence")


def hit_rank(found: DataFrame, golden: DataFrame, k: int) -> DataFrame:
    """``query_id, hit, reciprocal`` of each golden query (``query_id, expected``) in the ranked results (``query_id, id, rank``)."""
    hits = golden.join(found.filter(F.col("rank") <= k), (golden["query_id"] == found["query_id"]) & (golden["expected"] == found["id"]), "left")
    return hits.select(golden["query_id"], F.col("rank").isNotNull().alias("hit"), F.round(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)), 6).alias("reciprocal"))


