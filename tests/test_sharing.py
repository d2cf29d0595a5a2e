"""Documents that share names, against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import graph as G
from lorekeep.operators import sharing


def plain(rows, picks):
    keys = {}
    for i, name in rows:
        if i is not None and name is not None:
            keys.setdefault(i, set()).add(name.lower())
    return {(a, b): sorted(keys[a] & keys[b]) for a in keys if picks(a) for b in keys if a != b and keys[a] & keys[b]}


@pytest.mark.parametrize(("names", "shared", "kind"), [(1 << 17, 1 << 18, "long"), (40, 7, "long"), (300, 50, "string")])
def test_pairs_equal_all_pairs(spark, monkeypatch, names, shared, kind):
    """Also with many small packs, a name that all have, rows that repeat, and rows without id or name."""
    monkeypatch.setattr(sharing, "NAMES", names)
    monkeypatch.setattr(sharing, "SHARED", shared)
    r = random.Random(5)
    rows = [(i, f"N{min(r.randrange(60), r.randrange(60))}é") for i in range(150) for _ in range(r.randrange(6))]
    rows += [(i, "Everywhere") for i in range(0, 150, 2)] + [(7, "Alone"), (0, "EVERYWHERE"), (None, "Everywhere"), (3, None), (300, "N1é")]
    rows += rows[::3]
    frame = spark.createDataFrame(rows, "doc_id long, name string").withColumn("doc_id", F.col("doc_id").cast(kind))
    picks = F.col("doc_id").cast("long") % 10 == 0
    want = plain(rows, lambda i: i % 10 == 0)
    got = G.shared(frame, picks).collect()
    assert len(got) == len(want) and {(int(x.doc_id), int(x.other_id)): x.names for x in got} == want
    assert all(x.n_shared == len(x.names) for x in got)
    assert {(int(x.doc_id), int(x.other_id)): x.names for x in G.shared(frame, picks, mark="|").collect()} == {k: "|".join(v) for k, v in want.items()}


def test_no_pair_is_shuffled(spark):
    """A name that all have makes as many pairs as the result has rows: what is left of the plan shuffles none of them."""
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("Everywhere").alias("name"))
    pairs = G.shared(frame, F.col("doc_id") % 4 == 0)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString() and pairs.count() == 100 * 399


def test_nothing_shared(spark):
    frame = spark.createDataFrame([(0, "One"), (1, "Two")], "doc_id long, name string")
    assert G.shared(frame, F.col("doc_id") == 0).collect() == [] == G.shared(frame.filter("false"), F.col("doc_id") == 0).collect()
