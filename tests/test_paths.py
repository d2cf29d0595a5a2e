"""Shortest paths against a breadth-first search."""

from __future__ import annotations

import random
from collections import deque

import pytest

from lorekeep.operators import graph as G


def plain(edges, start, end, hops):
    near = {}
    for a, p, b in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {}).setdefault(y, []).append(p)
    best, queue = {start: [start]}, deque([start])
    while queue:  # level by level; of equal lengths the least path
        x = queue.popleft()
        for y in near.get(x, {}):
            way = best[x] + [y]
            if y not in best:
                queue.append(y)
                best[y] = way
            elif len(best[y]) == len(way) and way < best[y]:
                best[y] = way
    path = best.get(end)
    if path is None or len(path) - 1 > hops:
        return None
    return path, [min(near[x][y]) for x, y in zip(path, path[1:], strict=False)]


@pytest.mark.parametrize(("nodes", "n", "hops"), [(40, 60, 6), (30, 30, 3), (12, 40, 4), (200, 210, 5)])
def test_paths_equal_breadth_first_search(spark, nodes, n, hops):
    r = random.Random(nodes)
    edges = [(f"n{r.randrange(nodes)}", r.choice("xyz"), f"n{r.randrange(nodes)}") for _ in range(n)]
    pairs = [(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(25)] + [("n1", "n1"), ("n1", "absent"), ("absent", "absent"), (None, "n1"), ("n2", "n3"), ("n2", "n3")]
    edge_rows = spark.createDataFrame([*edges, (None, "x", "n1"), ("n1", None, "n2")], "subject string, predicate string, object string")
    got = G.shortest_paths(edge_rows, spark.createDataFrame(pairs, "start string, end string"), hops).collect()
    assert len(got) == len(pairs)
    known = [(a, p, b) for a, p, b in edges]
    for row in got:
        want = plain([*known, ("n1", "~", "n2")], row.start, row.end, hops) if row.start else None
        if want is None:
            assert row.distance is None and row.path is None
        else:
            assert row.distance == len(want[0]) - 1 and row.path == want[0]
            assert [p or "~" for p in row.relations] == want[1]


def test_no_edges(spark):
    none = spark.createDataFrame([], "subject string, predicate string, object string")
    got = G.shortest_paths(none, spark.createDataFrame([("a", "b"), ("a", "a")], "start string, end string"), 3).collect()
    assert sorted((r.end, r.distance) for r in got if r.distance is not None) == [("a", 0)] and len(got) == 2


def test_the_last_two_steps_are_not_written_and_go_in_bounded_parts(spark, monkeypatch):
    """With a limit of a few rows the pairs are many parts, and the nodes between are tried in several rounds."""
    rows, write = [], G.written

    def counted(df):
        out = write(df)
        if "path" in df.columns:
            rows.append(out[0].count())
        return out

    monkeypatch.setattr(G, "written", counted)
    monkeypatch.setattr(G, "SENT", 12)
    r = random.Random(8)
    edges = [(f"p{k}", "by", f"s{r.randrange(60)}") for k in range(120) for _ in range(3)]
    pairs = [(f"p{k}", f"p{k + 1}") for k in range(5)] + [("p7", "s3"), ("p8", "nowhere")]
    got = G.shortest_paths(spark.createDataFrame(edges, "subject string, predicate string, object string"), spark.createDataFrame(pairs, "start string, end string"), 4).collect()
    for row in got:
        want = plain(edges, row.start, row.end, 4)
        assert (row.path, row.relations) == (want or (None, None))
    assert len(got) == len(pairs) and max(rows) <= 3 * len(pairs) + 60


def test_pairs_that_do_not_meet_are_few_readings_of_the_edges(spark, monkeypatch):
    """No part of the pairs reads all edges for itself, and an odd distance is not looked for in even steps."""
    calls, last = [], G._last_steps
    monkeypatch.setattr(G, "SENT", 12)
    monkeypatch.setattr(G, "_last_steps", lambda *a: calls.append(a) or last(*a))
    edges = [(f"{p}{k}", "by", f"{s}{(k + j) % 4}") for p, s in ("ps", "qt") for k in range(200) for j in range(2)]
    pairs = [(f"p{k}", f"t{k % 4}") for k in range(6)] + [("p1", "s3"), ("p0", "p2")]
    got = G.shortest_paths(spark.createDataFrame(edges, "subject string, predicate string, object string"), spark.createDataFrame(pairs, "start string, end string"), 4).collect()
    for row in got:
        assert (row.path, row.relations) == (plain(edges, row.start, row.end, 4) or (None, None))
    assert len(got) == len(pairs) and len(calls) <= 2


@pytest.mark.parametrize("wide", [1, 3])
def test_neighbours_of_a_node_may_stand_in_several_rows(spark, monkeypatch, wide):
    monkeypatch.setattr(G, "WIDE", wide)
    r = random.Random(5)
    edges = [(f"n{r.randrange(30)}", r.choice("xyz"), f"n{r.randrange(30)}") for _ in range(45)] + [("n3", "x", "n3")]
    pairs = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(25)]
    for hops in (2, 4):
        got = G.shortest_paths(spark.createDataFrame(edges, "subject string, predicate string, object string"), spark.createDataFrame(pairs, "start string, end string"), hops).collect()
        for row in got:
            assert (row.path, row.relations) == (plain(edges, row.start, row.end, hops) or (None, None))
        assert len(got) == len(pairs)
