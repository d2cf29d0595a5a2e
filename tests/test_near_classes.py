"""Near-duplicate classes against all pairs."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import near_classes as N


def sets_of(text, k=3):
    w = [x for x in re.split(r"[\s]+", (text or "").lower()) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def content(text):
    t = re.sub(r"(^|[ ])[^\w ]+|[^\w ]+($|[ ])", " ", re.sub(r"\s+", " ", text).lower())
    return re.sub(r" +", " ", t).strip()


def plain(rows, threshold=0.8, k=3):
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    data = [(i, sets_of(t, k), None if t is None else content(t)) for i, t in rows if i is not None]
    for n, (i, s, c) in enumerate(data):
        for j, t, e in data[:n]:
            if (s and t and round(len(s & t) / len(s | t), 6) >= threshold) or (c is not None and c == e):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in parent}


def rows():
    r = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    out = [(i, " ".join(x if r.random() > 0.03 else f"e{r.randint(0, 9)}" for x in base)) for i in range(90)]  # around the threshold
    out += [(200 + i, " ".join(base + [f"n{i % 3}"])) for i in range(60)]  # near copies and copies
    chain = [f"c{k}" for k in range(200)]
    out += [(300 + i, " ".join(chain[i * 6 : i * 6 + 100])) for i in range(12)]  # a chain whose ends are far apart
    out += [(400, None), (401, None), (402, ""), (403, "two words"), (404, "Two words!"), (405, "one"), (None, "no id here at all"), (406, "a b c"), (406, "a b c"), (407, "x  y\tz\n")]
    out += [(500 + i, " ".join(f"u{r.randint(0, 10**6)}" for _ in range(r.randint(3, 60)))) for i in range(60)]
    return out


@pytest.mark.parametrize(("threshold", "k", "chunk"), [(0.8, 3, 256), (0.8, 3, 8), (0.9, 2, 16), (0.8, 5, 30)])
def test_classes_equal_all_pairs(spark, monkeypatch, threshold, k, chunk):
    monkeypatch.setattr(N, "LED", 7)
    data = rows()
    frame = spark.createDataFrame([(i, t, 1, "h") for i, t in data], "doc_id long, text string, n long, head string").repartition(3)
    got = N.classes(frame, threshold, k, chunk=chunk).collect()
    want = plain(data, threshold, k)
    assert len(got) == len(data) and {(r.doc_id, r.class_id) for r in got if r.doc_id is not None} == set(want.items())
    sizes = {c: sum(want[i] == c for i, _ in data if i is not None) for c in want.values()}
    assert all(r.class_size == sizes.get(r.class_id, 1) for r in got)


def test_empty(spark):
    assert N.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_group_of_near_copies_is_linear(spark):
    """Each is compared with leaders alone: no unit is left for cells."""
    base = [f"w{k}" for k in range(80)]
    frame = spark.createDataFrame([(i, " ".join([*base, f"t{i}"])) for i in range(800)], "doc_id long, text string")
    got = N.classes(frame, chunk=32).collect()
    assert {r.class_id for r in got} == {0} and {r.class_size for r in got} == {800}


def test_words_are_cut_as_by_the_pattern():
    """At every code point, alone and beside control characters that only Arrow's own splitter takes as white space."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = [c for c in points if c in "\x1c\x1d\x1e\x1f\x85"]
    for texts in ([f"a{c}b {c}" for c in points if c not in odd], [f"a{c}b {c} c" for c in odd], ["", " ", "a\x1fb\x0bc"]):
        column = pa.array(texts)
        assert [[w for w in x if w] for x in N._words(column).to_pylist()] == [[w for w in x if w] for x in pc.split_pattern_regex(column, r"[\s\x0B\p{Z}]+").to_pylist()]


def test_texts_of_equal_content_have_the_same_letters(spark):
    """Whatever normalising content drops or changes, at every code point."""
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    frame = spark.createDataFrame([(f"x{c}y {c}",) for c in points], "text string").repartition(4)
    for text, bare in frame.select("text", N.T.normalise_content(F.col("text"))).collect():
        assert N.letters(pa.scalar(text)) == N.letters(pa.scalar(bare))
    assert N.letters(pa.scalar("One 2, THREE!")) == N.letters(pa.scalar("three one-2")) != N.letters(pa.scalar("one 3, three")) and N.letters(pa.scalar(None, pa.string())) == 0


@pytest.mark.parametrize("sent", [1 << 20, 1])
def test_only_texts_with_the_letters_of_another_are_normalised(spark, monkeypatch, sent):
    seen = spark.sparkContext.accumulator(0)
    keep = F.udf(lambda t: (seen.add(1), t)[1])
    normal = N.T.normalise_content
    monkeypatch.setattr(N.T, "normalise_content", lambda text: normal(keep(text)))
    monkeypatch.setattr(N, "SENT", sent)
    data = [(i, f"text number {i} of many") for i in range(200)] + [(300, "Text  number 7, of many!"), (301, None), (302, None), (303, ""), (304, " ? ")]
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[300] == 7 and got[304] == 303 and got[302] == 302 and got == plain(data)
    lone = spark.createDataFrame([(i, "w" * (i + 1)) for i in range(200)] + [(300, "www")], "doc_id long, text string")
    seen.value = 0
    assert {r.doc_id: r.class_id for r in N.classes(lone).collect()}[300] == 2 and 0 < seen.value <= 8
