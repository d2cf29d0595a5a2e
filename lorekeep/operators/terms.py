"""Dictionaries of terms found in texts, in one pass over each text however many terms there are.

The terms become an Aho-Corasick automaton that goes to the documents; texts are read in Arrow batches.  Case does not
count.  Occurrences of one term do not overlap, the leftmost comes first; different terms may overlap.  With ``whole_words`` no
letter, digit or underscore may touch either end of an occurrence.

An automaton holds ``TERMS`` terms.  A larger dictionary is dealt to several, each with a pass of its own, so that what is sent to
the tasks is bounded.

Defined results: null texts have no occurrences; null and blank terms are none; terms that differ in case or kind alone are each
reported; positions are code points of the text as it stands; repeated rows are searched row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMS, ROWS = 100_000, 1 << 15


def folded(text: str) -> str:
    """Lower case, character by character where lower-casing would change the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


@lru_cache(4)
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        found.setdefault(folded(t), []).append(i)
    auto = ahocorasick.Automaton()
    for word, rows in found.items():
        auto.add_word(word, (len(word), rows))
    auto.make_automaton()
    return auto


def inner(c: str) -> bool:
    return c.isalnum() or c == "_"


def occurrences(text: str, terms: tuple[str, ...], whole_words: bool) -> Iterator[tuple[int, int, list[int]]]:
    """``start, end, terms``: where each term stands, by end."""
    low, free = folded(text), {}
    n = len(low)
    for last, (length, rows) in automaton(terms).iter(low):
        start = last - length + 1
        if start < free.get(rows[0], 0):
            continue
        if whole_words and ((start and inner(low[start - 1])) or (last + 1 < n and inner(low[last + 1]))):
            continue
        free[rows[0]] = last + 1
        yield start, last + 1, rows


def masked(value: str) -> str:
    return f"***{value[-4:]}" if len(value) > 4 else "***"


def _dictionaries(terms: DataFrame) -> list[tuple[tuple[str, ...], tuple[str | None, ...]]]:
    """The terms and kinds of each automaton: all in one, or dealt by hash."""
    rows = terms.select("term", "kind").filter(F.trim("term") != "").distinct()
    few = rows.limit(TERMS + 1).collect()
    shards = [few]
    if len(few) > TERMS:
        n = -(-rows.count() // (TERMS // 2))
        shards = [rows.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == k).collect() for k in range(n)]
    ordered = (sorted(s, key=lambda r: (r["term"], r["kind"] or "")) for s in shards)
    return [(tuple(r["term"] for r in s), tuple(r["kind"] for r in s)) for s in ordered if s]


def _scan(docs: DataFrame, terms: DataFrame, schema: str, rows_of, id_col: str, text_col: str) -> DataFrame:
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, {schema}"
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(words, kinds):
        def scan(batches):
            for b in batches:
                out: list[tuple] = []
                for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    out += [(key, *r) for r in rows_of(text.as_py(), words, kinds)]
                    if len(out) >= ROWS:
                        yield batch(out)
                        out = []
                if out:
                    yield batch(out)

        return scan

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(n).type) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)

    passes = [picked.mapInArrow(run(words, kinds), schema) for words, kinds in _dictionaries(terms)]
    return reduce(DataFrame.unionByName, passes) if passes else docs.sparkSession.createDataFrame([], schema)


def find(docs: DataFrame, terms: DataFrame, whole_words: bool = False, around: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, term, kind, start, end, masked, context`` of every occurrence of ``terms`` (``term, kind``).

    ``masked`` shows a term's last four characters, of a short one none; ``context`` is the text up to ``around`` characters about it, with the term masked.
    """

    def rows_of(text, words, kinds):
        for start, end, rows in occurrences(text, words, whole_words):
            for i in rows:
                shown = masked(words[i])
                yield words[i], kinds[i], start, end, shown, text[max(0, start - around) : end + around].replace(words[i], shown)

    return _scan(docs, terms, "term string, kind string, start int, end int, masked string, context string", rows_of, id_col, text_col)


def counted(docs: DataFrame, terms: DataFrame, whole_words: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, term, kind, n, first``: how often each term stands in each text that has it, and where first."""

    def rows_of(text, words, kinds):
        seen: dict[int, list[int]] = {}
        for start, _, rows in occurrences(text, words, whole_words):
            for i in rows:
                seen.setdefault(i, [0, start])[0] += 1
        return [(words[i], kinds[i], n, first) for i, (n, first) in seen.items()]

    return _scan(docs, terms, "term string, kind string, n long, first int", rows_of, id_col, text_col)
