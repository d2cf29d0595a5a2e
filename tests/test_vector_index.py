"""The vector index against plain search: exact mode, recall of the probed lists, many queries, odd rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.operators import vector_index as V


def clusters(n, d, seed, hot=0):
    r = np.random.Generator(np.random.PCG64(seed))
    centres = r.normal(0, 1, (25, d))
    x = centres[r.integers(0, 25, n)] + r.normal(0, 0.5, (n, d))
    x[:hot] = x[0]
    return x.astype(np.float32)


def frame(spark, x, name="vec_id", vec="embedding", start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in row], "x") for i, row in enumerate(x)], f"{name} long, {vec} array<float>, id string").repartition(4)


def plain(x, q, k):
    d = ((x[None].astype(float) - q[:, None].astype(float)) ** 2).sum(2).round(9)
    return {(i, int(j), d[i, j], r + 1) for i in range(len(q)) for r, j in enumerate(sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k])}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    x, q = clusters(3000, 12, 1, hot=700), clusters(60, 12, 2)
    path = str(tmp_path_factory.mktemp("index"))
    return x, q, V.build(frame(spark, x), path), path


@pytest.mark.parametrize("many", [False, True])
def test_exact_search_is_exact(spark, data, monkeypatch, many):
    x, q, index, path = data
    if many:
        monkeypatch.setattr(V, "QUERIES", 16)
        monkeypatch.setattr(V, "CELL", 100)
    queries = frame(spark, q, "query_id", "qvec")
    for found in (V.search(index, queries, 7, probes=3, exact=True), V.search(V.opened(spark, path), queries, 7, probes=1, exact=True), V.brute(frame(spark, x), queries, 7)):
        assert {(r.query_id, r.id, r.distance, r["rank"]) for r in found.collect()} == plain(x, q, 7)


@pytest.mark.parametrize("many", [False, True])
def test_probed_lists_have_a_recall_of_nine_in_ten(spark, data, monkeypatch, many):
    x, q, index, _ = data
    if many:
        monkeypatch.setattr(V, "QUERIES", 16)
    got = {(r.query_id, r.id) for r in V.search(index, frame(spark, q, "query_id", "qvec"), 10, probes=8).collect()}
    want = {(a, b) for a, b, _, _ in plain(x, q, 10)}
    assert len(got & want) / len(want) >= 0.9


def test_a_search_reads_only_the_folders_of_its_lists(spark, data, monkeypatch):
    x, q, index, _ = data
    assert index.size.sum() == len(x) and len(index.size) == 54
    plan = V._scan_few(index, frame(spark, q[:1], "query_id", "qvec").collect(), 5, V.distances, "distance", (index.rows.schema["id"].dataType, index.rows.schema["id"].dataType), "query_id long, id long, distance double", lambda far, tau: V.nearest_lists(far, 2), None)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "folder" in text.split("PartitionFilters")[1][:80]


def test_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [1.0]), (None, [1.0, 2.0]), (6, [5.0, 5.0]), (6, [5.0, 5.0]), (7, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [4.0, 4.0]), (4, [1.0, 2.0, 3.0])], "query_id long, qvec array<float>")
    index = V.build(vectors, str(tmp_path / "a"))
    want = [(1, None, 0.0, 1), (1, 1, 0.0, 2), (1, 6, 25.0, 3), (3, 6, 2.0, 1), (3, 6, 2.0, 2), (3, None, 13.0, 3)]
    for found in (V.search(index, queries, 3, exact=True), V.brute(vectors, queries, 3)):
        assert sorted(map(tuple, found.select("query_id", "id", "distance", "rank").collect()), key=lambda r: (r[0], r[3])) == want
    none = V.build(spark.createDataFrame([], "vec_id long, embedding array<float>"), str(tmp_path / "b"))
    assert V.search(none, queries, 3, exact=True).collect() == [] and V.search(index, queries.limit(0), 3).collect() == []


@pytest.mark.parametrize("many", [False, True])
def test_first_within_a_cosine(spark, tmp_path, monkeypatch, many):
    if many:
        monkeypatch.setattr(V, "QUERIES", 8)
        monkeypatch.setattr(V, "CELL", 64)
    x, q = clusters(600, 6, 4, hot=100), clusters(30, 6, 5)
    x[7] = 0
    index = V.build(V.unit(frame(spark, x)), str(tmp_path / "u"), n_lists=9)
    asked = V.unit(frame(spark, q, "query_id", "qvec"), "qvec")
    for cosine in (0.3, 0.9, 0.995):
        with np.errstate(invalid="ignore"):
            c = (q.astype(float) @ x.T.astype(float)) / np.outer(np.linalg.norm(q.astype(float), axis=1), np.linalg.norm(x.astype(float), axis=1))
        want = {(i, int(np.flatnonzero(row.round(6) >= cosine)[0])) for i, row in enumerate(c) if (row.round(6) >= cosine).any()}
        assert {tuple(r) for r in V.first_within(index, asked, cosine).collect()} == want


@pytest.mark.parametrize("many", [False, True])
def test_best_exemplar_of_each_tag(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(V, "QUERIES", 8)
        monkeypatch.setattr(V, "CELL", 64)
    x, q = clusters(300, 6, 6), clusters(40, 6, 7)
    x[3] = 0
    tags = [None if i % 7 == 0 else i % 5 for i in range(40)]
    exemplars = spark.createDataFrame([(t, [float(v) for v in row]) for t, row in zip(tags, q, strict=True)], "tag int, qvec array<float>")
    want = {}
    for i, a in enumerate(x.astype(float)):
        for t, b in zip(tags, q.astype(float), strict=True):
            n = np.linalg.norm(a) * np.linalg.norm(b)
            want[i, t] = max(want.get((i, t), -2), round(float(a @ b / n) if n else 0.0, 6))
    got = {(r.id, r.tag): r.similarity for r in V.best_of_groups(frame(spark, x), exemplars).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_recall_on_the_given_vectors(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = e.filter("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding as qvec")
    index = V.build(e, str(tmp_path / "i"))
    want = {(r.query_id, r.id) for r in V.brute(e, asked, 10).collect()}
    probes = V.probes_for(index, 0.9)
    got = {(r.query_id, r.id) for r in V.search(index, asked, 10, probes=probes).collect()}
    assert probes < len(index.centroids) and len(got & want) / len(want) >= 0.9


def test_a_cell_and_a_block_of_queries_are_measured_in_bounded_memory():
    import tracemalloc

    r = np.random.default_rng(3)
    x, q = r.standard_normal((V.CELL, 8)), r.standard_normal((V.QUERIES, 8))
    far, gap, tau = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1)), np.full(len(q), 0.5)
    tracemalloc.start()
    best = V.Best(5)
    V.gather(best, pa.array(np.arange(len(x))), x, q, V.distances, tau, V._inside(gap, far, tau))
    best.cut()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20  # the whole matrix alone has 268 MB
    d = np.sort(V.squared(x, q[:50]), axis=0)[:5]
    assert all(np.allclose(np.sort(best.score[best.query == i]), [v for v in d[:, i] if v <= 0.5], atol=1e-8) for i in range(50))
