"""Product codes: every answer against Lloyd's rounds written plainly, on ties, repeats, nulls and broken vectors."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorekeep.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, codes string, error string, v string, c0 string"


def plain(rows, parts, entries, rounds, scale=4096):
    """Every part against every entry in every round."""
    rows = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, v, _ in rows)
    width = max(sizes, key=lambda n: (sizes[n], n), default=0)
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if len(v) == width]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[near(v, p)].append(cut(v, p))
            new.append([[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if members[e] else books[p][e] for e in range(len(books[p]))])
        books = new
    out = [(i, lab, [near(v, p) for p in range(parts)], sum(far(cut(v, p), books[p][near(v, p)]) for p in range(parts))) for i, v, lab in kept]
    return out, books


def vectors(n, width, seed, hot=0.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.2) for _ in range(width)] for _ in range(7)]
    out = []
    for i in range(n):
        c = centres[0] if r.random() < hot else [x + r.gauss(0, 0.1) for x in r.choice(centres)]
        out.append((i * 3 % n if i % 5 else i, [float(np.float32(x)) for x in c], r.choice([0, 1, 2, None])))
    return out


def got_rows(found):
    return Counter((r.vec_id, r.label, tuple(r.codes), r.error) for r in found.rows.collect())


@pytest.mark.parametrize(("n", "width", "parts", "entries", "rounds", "hot"), [(700, 16, 4, 8, 6, 0.0), (400, 8, 8, 16, 6, 0.4), (9, 8, 2, 16, 3, 0.0), (1, 4, 2, 4, 6, 0.0), (300, 12, 3, 5, 1, 0.3)])
def test_codes_equal_plain_rounds(spark, n, width, parts, entries, rounds, hot):
    data = vectors(n, width, n, hot)
    frame = spark.createDataFrame([(*d, "x", "y", "z", "u") for d in data], SCHEMA).repartition(5)
    found = codes.encode(frame, carry=("label",), parts=parts, entries=entries, rounds=rounds)
    expected, books = plain(data, parts, entries, rounds)
    assert found.codebooks == books
    assert got_rows(found) == Counter((i, lab, tuple(c), e) for i, lab, c, e in expected)


def test_broken_rows_and_empty(spark):
    bad = [(1, None, 1), (2, [1.0, None, 0.0, 0.5], 1), (3, [float("nan")] * 4, 1), (4, [float("inf"), 0.0, 0.0, 0.0], 2), (5, [float("-inf")] * 4, 2), (6, [], 2), (7, [0.1, 0.2], 3)]
    good = [(k % 11, [0.25 * (k % 3), 0.5, -0.5 * (k % 2), 1e-5], None if k % 4 else 7) for k in range(30)] + [(None, [0.3, 0.3, 0.3, 0.3], 9)]
    rows = bad + good
    found = codes.encode(spark.createDataFrame([(*d, "x", "y", "z", "u") for d in rows], SCHEMA), carry=("label",), parts=2, entries=4)
    expected, books = plain(rows, 2, 4, 6)
    assert len(expected) == 31 and found.codebooks == books
    assert got_rows(found) == Counter((i, lab, tuple(c), e) for i, lab, c, e in expected)
    sums = Counter()
    for _, lab, _, e in expected:
        sums[lab] += e
    assert {(r.label, r.group_error) for r in codes.with_group_error(found.rows, "label").collect()} == set(sums.items())
    for broken in ([], bad[:5]):
        none = codes.encode(spark.createDataFrame([(*d, "x", "y", "z", "u") for d in broken], SCHEMA), carry=("label",))
        assert none.codebooks == [] and none.rows.collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        codes.encode(spark.createDataFrame([(1, [0.5] * 5, 1, "", "", "", "")], SCHEMA), parts=2)


def test_later_passes_measure_few_parts():
    """The heaps leave alone what no drift has reached, and still give what measuring all of them gives."""
    r = np.random.Generator(np.random.PCG64(5))
    x = (r.normal(0, 900, (20, 1, 4))[r.integers(0, 20, 5000)] + r.normal(0, 60, (5000, 1, 4))).astype(np.int32)
    books = x[:20].transpose(1, 0, 2).astype(np.int64)
    heaps, drift, total = codes.Heaps(1, 20), np.zeros((1, 20)), np.zeros((1, 20, 5), np.int64)
    looked = [codes.one_pass(x, heaps, books, drift, total, True)]
    for _ in range(6):
        new = np.array([[s[:-1] // s[-1] if s[-1] else b for s, b in zip(total[0], books[0], strict=True)]])
        step = np.sqrt(((new - books) ** 2).sum(2).astype(float))[0]
        books = new
        for e in range(20):
            drift[0, e] += step[e] + np.delete(step, e).max()
        looked.append(codes.one_pass(x, heaps, books, drift, total, False))
        entry, _, _ = codes.nearest(x[:, 0], books[0])
        assert (heaps.rows(0) == entry).all()
        assert (total[0, :, -1] == np.bincount(entry, minlength=20)).all()
        for e in range(20):
            h = heaps.heap(0, e)
            assert all(h[(k - 1) // 2] <= h[k] for k in range(1, len(h)))
    assert looked[0] == 5000 and looked[-1] < 500


def test_query_over_the_vectors(spark):
    from lorekeep.llm import queries

    got = queries.op13_codes(spark, "/root/testdata/sf0.001").collect()
    data = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    expected, books = plain(data, 8, 16, 6)
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    sums = Counter()
    for _, lab, _, e in expected:
        sums[lab] += e
    assert {(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == {(i, bytes(c).hex(), e, sums[lab], digest) for i, lab, c, e in expected}
    assert len(got) == len(expected)
