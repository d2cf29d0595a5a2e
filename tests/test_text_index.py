"""The posting index against scores computed plainly, over a few dozen queries."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lorekeep.operators import retrieval as R
from lorekeep.operators import text_index as X
from lorekeep.operators import text_scan as S


def corpus():
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 120)))) for i in range(1500)]
    docs += [(2000, None), (2001, ""), (2002, "?! ..."), (2003, "Only Once Ünïque_1"), (2004, "tie tie"), (2005, "tie tie"), (2006, "w0 " * 5000)]
    queries = [(k, " ".join(r.choices(vocabulary, k=r.randint(1, 8)))) for k in range(40)] + [(50, None), (51, ""), (52, "nothing_like_it"), (53, "TIE"), (54, "w0"), (55, "w0 w0 w1 w399"), (56, docs[3][1]), (57, "ünïque_1 only")]
    return docs, queries


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def plain(docs, queries, k, kind):
    cut = {i: words(t) for i, t in docs}
    mean = sum(len(w) for i, w in cut.items() if dict(docs)[i] is not None) / sum(t is not None for _, t in docs)
    df = Counter(t for w in cut.values() for t in set(w))
    out = set()
    for q, text in queries:
        scores = Counter()
        for t, qw in Counter(words(text)).items():
            idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
            for i, w in cut.items():
                if tf := w.count(t):
                    scores[i] += round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) if kind == "bm25" else math.log(1 + tf) * qw, 9)
        best = sorted(scores, key=lambda i: (-round(scores[i], 6), i))[:k]
        out |= {(q, i, round(scores[i], 6), n + 1) for n, i in enumerate(best)}
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    docs, queries = corpus()
    path = str(tmp_path_factory.mktemp("text"))
    keep, X.CELL = X.CELL, 40
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, tf int").repartition(4)
    index = X.build(frame, path)
    X.CELL = keep
    return docs, queries, frame, spark.createDataFrame(queries, "query_id long, qtext string"), index, path


@pytest.mark.parametrize("kind", ["bm25", "sparse"])
@pytest.mark.parametrize("k", [1, 10])
def test_index_equals_plain_scores(spark, made, kind, k):
    docs, queries, _, asked, _, path = made
    got = {(r.query_id, r.id, r["rank"]): r.score for r in X.search(X.opened(spark, path), asked, k, kind).collect()}
    want = {(q, i, n): score for q, i, score, n in plain(docs, queries, k, kind)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in got)


def test_index_equals_search_without_one(made):
    _, _, frame, asked, index, _ = made
    rows = lambda df: set(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    assert rows(X.search(index, asked, 10)) == rows(R.bm25(frame, asked, 10))


def test_most_cells_stay_closed_and_folders_are_pruned(spark, made):
    _, _, _, _, index, _ = made
    one = spark.createDataFrame([(1, "w390 w395")], "query_id long, qtext string")
    all_, opened = X.open_cells(index, one, 3)
    assert opened < all_ / 2
    plan = index.blocks.filter(X.F.col("folder").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "folder" in plan.split("PartitionFilters")[1][:60]


def test_empty(spark, tmp_path, made):
    _, _, _, asked, index, _ = made
    assert X.search(index, asked.limit(0), 5).collect() == []
    none = X.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "n"))
    assert X.search(none, asked, 5).collect() == []


def test_a_task_counts_a_bounded_number_of_words_at_a_time():
    n = X.WORDS // 20
    docs = pa.record_batch({"id": pa.array(range(100)), "cell": pa.array([0] * 100, pa.int32()), "length": pa.array([n] * 100, pa.int32()), "w": pa.array([["a", "b"] * (n // 2)] * 100)})
    sent = [pa.ipc.open_stream(x).read_all() for b in X._sender(1)(iter([docs])) for x in b.column("postings").to_pylist()]
    assert all(t.num_rows <= 2 * X.WORDS // n + 2 for t in sent)
    assert sum(t.num_rows for t in sent) == 200 and sum(pc.sum(t["tf"]).as_py() for t in sent) == 100 * (n // 2) * 2


@pytest.mark.parametrize("kind", ["bm25", "sparse"])
@pytest.mark.parametrize("k", [1, 10])
def test_long_queries_are_scored_without_a_row_for_each_term_and_cell(spark, made, monkeypatch, kind, k):
    docs, queries, _, asked, _, path = made
    monkeypatch.setattr(X, "LONG", 2)
    monkeypatch.setattr(X, "MANY", 1 if k == 1 else 256)  # all queries, or the long ones
    monkeypatch.setattr(S, "QUERIES", 20)
    monkeypatch.setattr(S, "SPAN", 3)
    got = {(r.query_id, r.id, r["rank"]): r.score for r in X.search(X.opened(spark, path), asked, k, kind).collect()}
    want = {(q, i, n): score for q, i, score, n in plain(docs, queries, k, kind)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in got)


def test_a_long_query_stages_no_row_for_a_term_in_a_cell(spark, made, monkeypatch):
    docs, _, _, _, index, _ = made
    staged = []
    for module in (X, S):
        keep = module.stage
        monkeypatch.setattr(module, "stage", lambda df, keep=keep: staged.append(keep(df)) or staged[-1])
    asked = spark.createDataFrame([(q, " ".join(f"w{k}" for k in range(300))) for q in range(20)], "query_id long, qtext string")
    assert X.search(index, asked, 10).count() == 200
    assert max(f.count() for f in staged) <= 20 * 300


def test_sums_are_the_same_by_matrices_and_one_by_one(monkeypatch):
    r = np.random.default_rng(3)
    term = np.sort(r.integers(0, 30, 900))
    doc, part = r.integers(0, 50, 900), r.integers(1, 10**10, 900).astype(float)
    pairs = np.unique(term * 50 + doc, return_index=True)[1]
    term, doc, part = term[pairs], doc[pairs], part[pairs]
    n = r.integers(1, 40, 30)
    query = np.concatenate([r.choice(40, x, replace=False) for x in n])
    first = np.cumsum(n) - n
    made = []
    for share in (0.0, 0.3, 2.0):
        monkeypatch.setattr(S, "RARE", share)
        monkeypatch.setattr(S, "SUMS", 100)
        made.append(S._sums(doc, term, part, 50, first, n, query, 40))
    want = np.zeros((40, 50))
    for t, d, p in zip(term, doc, part, strict=True):
        want[query[first[t] : first[t] + n[t]], d] += p
    assert all((m == want).all() for m in made)


def test_postings_are_sent_in_few_rows_and_a_word_once_in_each():
    """2^19 words were two rows for each folder and group, with the word beside every posting."""
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [r.choices(vocabulary, k=1 << 13) for _ in range(64)]
    docs = pa.record_batch({"id": pa.array(range(64)), "cell": pa.array([0] * 64, pa.int32()), "length": pa.array([1 << 13] * 64, pa.int32()), "w": pa.array(texts)})
    rows = [(f, pa.ipc.open_stream(x).read_all()) for b in X._sender(1)(iter([docs])) for f, x in zip(b.column("folder").to_pylist(), b.column("postings").to_pylist(), strict=True)]
    assert len(rows) == len({f for f, _ in rows}) <= X.FOLDERS
    assert sum(len(t["term"].chunk(0).dictionary) for _, t in rows) == 300
    got = Counter((i, w) for _, t in rows for i, w, n in zip(t["id"].to_pylist(), t["term"].to_pylist(), t["tf"].to_pylist(), strict=True) for _ in range(n))
    assert got == Counter((i, w) for i, text in enumerate(texts) for w in text)
