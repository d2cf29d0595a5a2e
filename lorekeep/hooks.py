"""Typed places for models and plug-ins: what a caller supplies and how it becomes part of a plan.

A hook is a plain Python function over a batch of values; it runs as an Arrow-batched function on the executors.  The
stand-ins here need no model: they are column expressions, so that plans run and can be compared without one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T

Embedder = Callable[[list[str]], list[list[float]]]
Classifier = Callable[[list[tuple[str, str]]], list[str]]
Generator = Callable[[str, list[str]], list[str]]
Decomposer = Callable[[list[str]], list[list[str]]]
Handler = Callable[[DataFrame], DataFrame]
Check = Callable[[SparkSession], DataFrame]


def embedder(model: Embedder, prefix: str = "") -> Callable[[Column], Column]:
    """A column of texts to one of vectors; ``prefix`` is put before queries by models that want it, not before passages."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in model([prefix + (t or "") for t in texts])])

    return run


def word_vector(text: Column, dims: int = 64) -> Column:
    """The stand-in embedder: words hashed to ``dims`` places, counted and brought to length one; zeros without words."""
    place = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 2), 16, 10).cast("int") % dims
    at = F.transform(T.words(text), place)

    def counted(places: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(places, lambda p: p == d)).cast("double"))

    def unit(v: Column) -> Column:
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))

    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return once(once(at, counted), unit)


def word_weights(text: Column) -> Column:
    """The stand-in sparse embedder: ``map<word, log(1 + count)>``."""
    words = T.words(text)
    distinct = F.array_sort(F.array_distinct(words))
    return F.map_from_arrays(distinct, F.transform(distinct, lambda w: F.log1p(F.size(F.filter(words, lambda x: x == w)).cast("double"))))


def classifier(model: Classifier) -> Callable[[Column, Column], Column]:
    """Two columns of texts to a label: entailment, neutral or contradiction."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(model(list(zip(a, b, strict=True))))

    return run


def generator(model: Generator, system: str) -> Callable[[Column], Column]:
    """A column of prompts to one of answers; a model that fails gives null for its batch, and the plan goes on."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        try:
            return pd.Series(model(system, [p or "" for p in prompts]), dtype=object)
        except Exception:  # a model's outage is a null answer, as callers expect
            return pd.Series([None] * len(prompts), dtype=object)

    return run


def decomposer(model: Decomposer) -> Callable[[Column], Column]:
    """A column of queries to arrays of sub-queries."""

    @F.pandas_udf("array<string>")
    def run(queries: pd.Series) -> pd.Series:
        return pd.Series([list(x) for x in model([q or "" for q in queries])])

    return run


def taxonomy(spark: SparkSession, text: str) -> DataFrame:
    """``tag, keyword, threshold`` of a taxonomy in JSON: ``{tag: {keywords: [...], threshold: x}}``; blank keywords go."""
    rows = [(tag, str(k).strip().lower(), float(spec.get("threshold", 0.5))) for tag, spec in json.loads(text).items() for k in spec.get("keywords", []) if str(k).strip()]
    return spark.createDataFrame(rows, "tag string, keyword string, threshold double")


def dispatch(rows: DataFrame, kind: str, handlers: dict[str, Handler]) -> DataFrame:
    """Every kind's rows through its handler; kinds without one are left out (P08).  Handlers give the same columns."""
    return reduce(DataFrame.unionByName, [handle(rows.filter(F.col(kind) == name)) for name, handle in handlers.items()])


def health(spark: SparkSession, checks: dict[str, Check]) -> DataFrame:
    """``name, ok, detail`` of every check, a frame of one row ``ok, detail``."""
    return reduce(DataFrame.unionByName, [check(spark).select(F.lit(name).alias("name"), F.col("ok").cast("boolean").alias("ok"), F.col("detail").cast("string").alias("detail")) for name, check in checks.items()])
