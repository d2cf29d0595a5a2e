"""Dictionaries in texts against regular expressions, term by term."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from lorekeep.operators import terms as D

TEXTS = [
    (1, "The token is Token-42, tokens aren't; a token."),
    (2, "aaaa aa a"),
    (3, None),
    (4, ""),
    (5, "Ünïque ünïque_ xünïque ÜNÏQUE!"),
    (6, "public   license, public license\npublic license."),
    (7, "İstanbul token İtoken"),
    (8, "tok" * 3000 + " end token"),
    (None, "no id token"),
    (1, "The token is Token-42, tokens aren't; a token."),
]
TERMS = [("token", "SECRET"), ("Token", "OTHER"), ("tok", None), ("aa", "X"), ("a", "X"), ("ünïque", "U"), ("public license", "L"), ("license.", "L"), (" ", "B"), (None, "B"), ("", "B"), ("token", "SECRET"), ("absent", "Z")]


def plain(whole, texts=TEXTS, terms=TERMS):
    out = Counter()
    for t, kind in {(t, k) for t, k in terms if t and t.strip()}:
        pattern = re.escape(D.folded(t))
        for i, text in texts:
            for m in re.finditer(pattern, D.folded(text or "")) if not whole else re.finditer(rf"(?<!\w){pattern}(?!\w)", D.folded(text or "")):
                out[i, t, kind, m.start(), m.end()] += 1
    return out


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame([(i, t, "k", "t") for i, t in TEXTS], "doc_id long, text string, kind string, term string").repartition(3)
    return docs, spark.createDataFrame(TERMS, "term string, kind string")


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("shards", [False, True])
def test_find_equals_one_expression_a_term(frames, monkeypatch, whole, shards):
    if shards:
        monkeypatch.setattr(D, "TERMS", 4)
    docs, terms = frames
    got = Counter((r.doc_id, r.term, r.kind, r.start, r.end) for r in D.find(docs, terms, whole).collect())
    assert got == plain(whole)
    n = Counter()
    for (i, t, k, _, _), c in got.items():
        n[i, t, k] += c
    counts = Counter()
    for r in D.counted(docs, terms, whole).collect():
        counts[r.doc_id, r.term, r.kind] += r.n
    assert counts == n


def test_masks_and_contexts(spark):
    docs = spark.createDataFrame([(1, "x" * 60 + " my secret99 here " + "y" * 60 + " ab")], "doc_id long, text string")
    rows = {r.term: r for r in D.find(docs, spark.createDataFrame([("secret99", "S"), ("ab", "T")], "term string, kind string"), around=10).collect()}
    assert rows["secret99"].masked == "***et99" and rows["secret99"].context == "xxxxxx my ***et99 here yyyy"
    assert rows["ab"].masked == "***" and rows["ab"].context == "yyyyyyyyy ***"


def test_empty_dictionary_and_table(spark, frames):
    docs, terms = frames
    assert D.find(docs, terms.limit(0)).collect() == [] and D.counted(docs.limit(0), terms).collect() == []


def test_cost_does_not_follow_the_number_of_terms():
    """One pass: the automaton of ten thousand terms finds in a text what that of ten does."""
    r = random.Random(2)
    few = tuple(f"needle{k}" for k in range(10))
    many = few + tuple("".join(r.choices("bcdfgh", k=12)) for _ in range(10_000))
    text = " ".join(r.choice(["alpha", "beta", "needle3", "needle77"]) for _ in range(5000))
    found = [[(s, e, t) for s, e, rows in D.occurrences(text, words, True) for t in (words[i] for i in rows)] for words in (few, many)]
    assert found[0] == found[1] and found[0]
