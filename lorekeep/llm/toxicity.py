"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models over hashed
word features; each later model also gets the earlier categories' probabilities
(as log-odds).  In training these are out-of-fold predictions, so that a later
model learns how far the earlier ones can be trusted.  A category's threshold is
the one with the best F1 on the out-of-fold predictions.

The models are fitted on the driver on at most ``SAMPLE`` labelled rows, taken by hash of
the id; only their hashed features are collected.  All documents are scored, whole,
with weights of a fixed size.

Defined results: null text counts as empty and is scored by the intercepts; a label that
is null leaves its row out of training; without labelled rows, or with one class alone, a
category has its base rate (0 without rows) everywhere and no document is marked; repeated
rows are scored row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import pieces, text_buffers, tidy
from ._words import LOWER, word_hashes, word_spans

SAMPLE = 12_000
BITS = 18
FOLDS = 3
ROUNDS = 150
MIN_Z = 4.5
MIN_DOCS = 4
_LETTERS = LOWER.copy()
_LETTERS[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def word_features(texts: pa.Array):
    """Sorted distinct feature numbers of each text: its words, lower-cased and without ASCII punctuation, hashed."""
    buf, offsets = text_buffers(texts)
    clean = _LETTERS[buf]
    for i, j in pieces(offsets, 1 << 20):
        part, off = clean[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, bounds = word_spans(part, off)
        ids = (word_hashes(part, starts, ends) >> np.uint64(64 - BITS)).astype(np.int32)
        for d in range(j - i):
            yield np.unique(ids[bounds[d] : bounds[d + 1]])


class Rows:
    """Sparse binary rows with a few dense columns."""

    def __init__(self, features: list[np.ndarray]):
        self.n = len(features)
        self.ids = np.concatenate(features) if features else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(self.n), [len(f) for f in features])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.ids], minlength=self.n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray) -> dict:
    """A logistic model on the rows in ``use``, over the features that tell the classes apart."""
    n1, n0 = int(y[use].sum()), int(use.sum() - y[use].sum())
    w = np.zeros(1 << BITS)
    if not n1 or not n0:
        rate = n1 / max(1, n1 + n0)
        return {"w": w, "dense": np.zeros(dense.shape[1]), "bias": float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))}
    inside = use[rows.row]
    df1 = np.bincount(rows.ids[inside & (y[rows.row] == 1)], minlength=1 << BITS)
    df = np.bincount(rows.ids[inside], minlength=1 << BITS)
    p = np.clip(df / (n1 + n0), 1e-9, 1 - 1e-9)
    z = (df1 / n1 - (df - df1) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    kept = np.flatnonzero((np.abs(z) >= MIN_Z) & (df >= MIN_DOCS))
    column = np.full(1 << BITS, -1)
    column[kept] = np.arange(len(kept))
    entry = inside & (column[rows.ids] >= 0)
    r, c = rows.row[entry], column[rows.ids[entry]]
    coef, coef_d, bias = np.zeros(len(kept)), np.zeros(dense.shape[1]), float(np.log(n1 / n0))
    g2, g2d, g2b = np.full(len(kept), 1e-6), np.full(dense.shape[1], 1e-6), 1e-6
    for _ in range(ROUNDS):
        score = np.bincount(r, weights=coef[c], minlength=rows.n) + dense @ coef_d + bias
        err = np.where(use, _sigmoid(score) - y, 0.0)
        g = np.bincount(c, weights=err[r], minlength=len(kept)) + 0.5 * coef
        gd, gb = dense.T @ err + 0.5 * coef_d, err.sum()
        g2, g2d, g2b = g2 + g * g, g2d + gd * gd, g2b + gb * gb
        coef, coef_d, bias = coef - 0.5 * g / np.sqrt(g2), coef_d - 0.5 * gd / np.sqrt(g2d), bias - 0.5 * gb / np.sqrt(g2b)
    w[kept] = coef
    return {"w": w, "dense": coef_d, "bias": float(bias)}


def predict(model: dict, rows: Rows, dense: np.ndarray) -> np.ndarray:
    return _sigmoid(rows.dot(model["w"]) + dense @ model["dense"] + model["bias"])


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1; above 1 (nothing is marked) without positive rows."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    last = np.flatnonzero(np.concatenate((p[order][1:] != p[order][:-1], [True])))  # equal scores stand or fall together
    k = last[np.argmax(f1[last])]
    after = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + after) / 2)


def fit_chain(features: list[np.ndarray], targets: np.ndarray) -> list[dict]:
    """One model and threshold a category, in chain order; ``targets`` is (rows, categories)."""
    rows = Rows(features)
    fold = np.arange(rows.n) % FOLDS
    dense, chain = np.zeros((rows.n, 0)), []
    for k in range(targets.shape[1]):
        y = targets[:, k].astype(float)
        out = np.zeros(rows.n)
        for f in range(FOLDS):
            held = fold == f
            out[held] = predict(fit(rows, dense, y, ~held), rows, dense)[held]
        chain.append(fit(rows, dense, y, np.ones(rows.n, bool)) | {"threshold": best_threshold(out, y)})
        dense = np.column_stack([dense, log_odds(out)])
    return chain


def score(docs: DataFrame, labelled: DataFrame, categories: dict[str, Column], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, p_<category>..., <category>...`` for every row; ``categories`` are 0/1 columns of ``labelled`` in chain order."""
    names = list(categories)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    target = F.array(*[c.cast("int") for c in categories.values()])
    known = labelled.select(F.col(id_col).cast("long").alias("doc_id"), target.alias("y")).filter(~F.exists("y", lambda x: x.isNull()))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id", F.to_json("y")).limit(sample)  # the bound on what the models see

    def features(batches):
        for b in batches:
            ids = pa.array([f.tolist() for f in word_features(b.column(1))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), ids], names=["doc_id", "y", "ids"])

    train = texts.join(F.broadcast(taken), "doc_id").select("doc_id", "text", "y").mapInArrow(tidy(features), "doc_id long, y array<int>, ids array<int>")
    got = sorted(train.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["y"], r["ids"]))
    chain = fit_chain([np.array(r["ids"], np.int32) for r in got], np.array([r["y"] for r in got], np.int64).reshape(-1, len(names)))
    shared = docs.sparkSession.sparkContext.broadcast([m | {"w": m["w"].astype(np.float32)} for m in chain])  # 2 ** BITS numbers a category

    def run(batches):
        models = shared.value
        for b in batches:
            rows = Rows(list(word_features(b.column(1))))
            dense, p = np.zeros((rows.n, 0)), []
            for m in models:
                p.append(predict(m, rows, dense))
                dense = np.column_stack([dense, log_odds(p[-1])])
            marks = [pa.array(x >= m["threshold"]) for x, m in zip(p, models, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, p), *marks], names=["doc_id", *[f"p_{n}" for n in names], *names])

    schema = ", ".join(["doc_id long", *[f"p_{n} double" for n in names], *[f"{n} boolean" for n in names]])
    return texts.mapInArrow(tidy(run), schema)
