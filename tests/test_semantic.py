"""The pairs of two cells of vectors against all cosines."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from lorekeep.operators import dedup as D


def found(a, b, threshold):
    """Pairs of two cells, or of one with itself if ``b`` is none; ids fall, so that their order is not that of rows."""
    one = b is None
    b = a if one else b
    x = np.arange(len(a))[::-1] * 2
    y = x if one else np.arange(len(b)) * 2 + 1
    got = [r for batch in D._alike(a.shape[1], 0, x.tobytes(), a.tobytes(), 0 if one else 1, y.tobytes(), b.tobytes(), threshold) for r in batch.to_pylist()]
    with np.errstate(all="ignore"):
        cosine = ((a[:, None] * b[None]).sum(2) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None])).round(6)
    r, c = np.nonzero(cosine >= threshold)
    want = sorted((min(x[i], y[j]), max(x[i], y[j]), cosine[i, j]) for i, j in zip(r, c, strict=True) if not one or i < j)
    return sorted((g["left_id"], g["right_id"], g["cosine"]) for g in got), want


@pytest.mark.parametrize("block", [(256, 512), (8, 16), (24, 7)])
@pytest.mark.parametrize(("width", "threshold"), [(1, 0.9), (2, 0.9), (64, 0.9), (64, 0.5), (64, -0.2), (200, 0.85), (64, 1.0)])
def test_pairs_equal_all_cosines(monkeypatch, block, width, threshold):
    """Vectors without a common direction, with variants around the threshold, and all about one direction, where bounds leave every pair open."""
    monkeypatch.setattr(D, "BLOCK", block)
    r = np.random.default_rng(3)
    apart = r.standard_normal((90, width)) * r.uniform(0.01, 100, (90, 1))
    variants = np.where(np.arange(width)[None] >= np.arange(90)[:, None] % 24, apart, 0)
    variants = variants[(variants != 0).any(1)]
    close = r.standard_normal((1, width)) + 0.4 * r.standard_normal((70, width))
    every = np.concatenate((apart, variants, close))
    for a, b in ((every, None), (apart, variants), (close, every), (close, None), (every[:1], every[:3])):
        got, want = found(np.ascontiguousarray(a), b if b is None else np.ascontiguousarray(b), threshold)
        assert got == want


def test_products_of_two_cells_are_never_held():
    """A strip of 1,024 rows against a cell of 16,384 is 64 MB of products and 16 MB of flags."""
    r = np.random.default_rng(4)
    a, b = (r.standard_normal((D.CELL, 16)) for _ in range(2))
    ids = np.arange(D.CELL).tobytes(), (np.arange(D.CELL) + D.CELL).tobytes()
    tracemalloc.start()
    try:
        for _ in D._alike(16, 0, ids[0], a.tobytes(), 1, ids[1], b.tobytes(), 0.999):
            pass
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
