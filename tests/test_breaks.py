"""Breaks against a plain walk, with keys of many blocks."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from lorekeep.operators import breaks as B


def plain(rows, gap):
    times, out = defaultdict(set), set()
    for k, t in rows:
        if t is not None:
            times[k].add(float(t))
    for k, ts in times.items():
        last, n = None, 0
        for t in sorted(ts):
            if last is None or t >= last + gap:
                out.add((k, n, t))
                last, n = t, n + 1
    return out


def rows(seed, n):
    r = random.Random(seed)
    out = [("hot", r.randint(0, 40 * n) // r.choice([1, 1, 500])) for _ in range(n)]
    out += [(r.choice(["a", "b", None]), r.randint(0, 500)) for _ in range(n // 3)]
    out += [("burst", 1000 + i) for i in range(n // 4)] + [("burst", 10**6 + 7 * i) for i in range(n // 4)]
    return out + [("lone", 5), ("void", None), ("hot", None), ("twice", 3), ("twice", 3)]


@pytest.mark.parametrize(("gap", "block"), [(40, 100), (10**5, 150), (0, 300), (37.5, 1 << 18)])
def test_breaks_equal_a_walk(spark, gap, block):
    data = rows(7, 900)
    frame = spark.createDataFrame([(k, t, 1, 0.5) for k, t in data], "key string, t long, part int, land double").repartition(3)
    got = B.breaks(frame, "key", "t", float(gap), block).collect()
    assert len(got) == len(set(got)) and {(r.key, r.place, r.started) for r in got} == plain(data, gap)


def test_empty(spark):
    assert B.breaks(spark.createDataFrame([], "user long, t double"), "user", "t", 5.0).collect() == []
