"""Quality rules by weak supervision, in DataFrame functions only.

Every rule votes good, bad or abstains on a document.  Expectation-maximisation
over the table of vote patterns (at most 3 ** n_rules rows, counted over all
documents) estimates how each rule votes on good and on bad documents; the
posterior probability of being good replaces an all-rules-must-pass filter.  Several
rules look at each kind of fault, so that their votes agree where there is one: a
rule is trusted as far as the others bear it out, and one that votes bad all by itself
says little.  The estimates, a few dozen numbers, are the only thing that reaches the driver.

Defined results: null text has no words, so ``base_failed`` holds; a text
without words likewise; repeated rows and null ids are scored row by row; with no
rows the prior is one half and the result is empty; only the id and text columns
are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import stage

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ROUNDS = 25
#: Prior belief in a rule (votes bad, abstains, votes good) on good and on bad documents, worth this share of all documents.
BELIEF = ({-1: 0.01, 0: 0.09, 1: 0.9}, {-1: 0.2, 0: 0.2, 1: 0.6})
BELIEF_SHARE = 0.002
#: The start: how likely a document is good with no bad vote, with one, with more.
START = (0.98, 0.6, 0.05)
WORD = "[^\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, which a reference inside a lambda does not promise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs again; windows of WINDOW words, by position."""

    def from_sorted(s: Column) -> Column:
        again = F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]))
        return let(F.sort_array(F.filter(again, lambda p: p.isNotNull())), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), from_sorted)


def row_hash(id_col: str, text_col: str) -> Column:
    """What tells rows apart: id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The measures that the rules look at, one row a document; ``carry`` names columns that go along."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_words(w: Column) -> Column:
        hashes = F.when(
            F.size(w) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
        ).otherwise(F.expr("cast(array() as array<bigint>)"))
        repeat = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long")))
        again = F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat.alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            again.cast("long").alias("n_adjacent"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def left(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(text, pattern, ""))

    n = F.char_length(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    per_doc = docs.select(
        *carry,
        F.col(id_col).alias("doc_id"),
        row_hash(id_col, text_col).alias("row"),
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        left("[\\x20\\x09-\\x0D]+").cast("long").alias("word_chars"),
        (n - left("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (n - left("[#*$%&|<>](?=[\\x20\\x09-\\x0D]|\\z)")).cast("long").alias("n_symbol_words"),
        (n - left("[!?]")).cast("long").alias("n_exclaim"),
        (n - left("[0-9]")).cast("long").alias("n_digits"),
        (n - left("\\p{Lu}+")).cast("long").alias("n_upper"),
    )
    return per_doc.select(*carry, "doc_id", "row", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "w.n_distinct", "w.n_adjacent", "n_symbol_words", "n_exclaim", "n_digits", "n_upper")


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstain.  Symbols, repetition and shouting are each looked at by more than one rule."""
    words, chars = F.col("n_words"), F.col("word_chars")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": vote(words < 10, words >= 40),
        "word_length": vote((chars < 2 * words) | (chars > 14 * words), (chars >= 3 * words) & (chars <= 10 * words)),
        "symbols": vote(F.col("n_symbols") * 10 > words, F.col("n_symbols") * 50 <= words),
        "symbol_words": vote(F.col("n_symbol_words") * 20 > words, F.col("n_symbol_words") * 100 <= words),
        "symbol_chars": vote(F.col("n_symbols") * 40 > chars, F.col("n_symbols") * 400 <= chars),
        "dup_lines": vote((F.col("n_dup_lines") > 2) & (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3), (F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0)),
        "repeats": vote(F.col("n_repeat_words") * 5 > words, F.col("n_repeat_words") * 50 <= words),
        "adjacent": vote(F.col("n_adjacent") * 10 > words, F.col("n_adjacent") * 50 <= words),
        "variety": vote((words >= MIN_WORDS) & (F.col("n_distinct") * 10 < F.least(words, F.lit(120)) * 6), F.col("n_distinct") * 4 >= F.least(words, F.lit(60)) * 3),
        "exclaim": vote(F.col("n_exclaim") * 4 > words, F.col("n_exclaim") * 20 <= words),
        "digits": vote(F.col("n_digits") * 4 > chars, F.col("n_digits") * 10 <= chars),
        "capitals": vote(F.col("n_upper") * 2 > chars, F.col("n_upper") * 5 <= chars),
    }


def _posterior(names: list[str], theta: dict | None) -> Column:
    if theta is None:
        bad = sum((F.when(F.col(k) == -1, 1).otherwise(0) for k in names), F.lit(0))
        return F.when(bad == 0, START[0]).when(bad == 1, START[1]).otherwise(START[2])
    # one array literal, so that the generated code is the same in every round and is compiled once
    weights = [math.log(theta["prior"] / (1 - theta["prior"]))]
    for k in names:
        good, bad = theta[k]
        weights += [math.log(good[-1] / bad[-1]), 0.0, math.log(good[1] / bad[1])]  # abstaining says nothing
    w = F.array(*[F.lit(x) for x in weights])
    odds = F.element_at(w, 1)
    for j, k in enumerate(names):
        odds = odds + F.element_at(w, (F.col(k) + (3 * j + 3)).cast("int"))
    return 1 / (1 + F.exp(-odds))


def estimate(voted: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict:
    """Prior and per-rule vote probabilities given good and given bad, by expectation-maximisation."""
    patterns = stage(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1))
    theta: dict | None = None
    for _ in range(rounds):
        p = patterns.withColumn("p", _posterior(names, theta))
        sums = [F.sum(F.col("n") * F.col("p")).alias("good"), F.sum(F.col("n") * (1 - F.col("p"))).alias("bad")]
        for k in names:
            for v in (-1, 1):
                hit = F.when(F.col(k) == v, F.col("n")).otherwise(0)
                sums += [F.sum(hit * F.col("p")).alias(f"g_{k}_{v}"), F.sum(hit * (1 - F.col("p"))).alias(f"b_{k}_{v}")]
        r = p.agg(*sums).first()
        good, bad = r["good"] or 0.0, r["bad"] or 0.0
        weight = 1 + BELIEF_SHARE * (good + bad)
        new: dict = {"prior": (good + 1) / (good + bad + 2)}
        for k in names:
            pair = []
            for c, total, belief in (("g", good, BELIEF[0]), ("b", bad, BELIEF[1])):
                p_v = {v: ((r[f"{c}_{k}_{v}"] or 0.0) + weight * belief[v]) / (total + weight) for v in (-1, 1)}
                pair.append(p_v | {0: max(1e-6, 1 - p_v[-1] - p_v[1])})
            new[k] = tuple(pair)
        moved = theta is None or max(abs(new[k][c][v] - theta[k][c][v]) for k in names for c in (0, 1) for v in (-1, 0, 1)) > 1e-3
        theta = new
        if not moved:
            break
    return theta


def _judged(docs: DataFrame, id_col: str, text_col: str, keep_from: float, carry: tuple[str, ...] = ()) -> DataFrame:
    names = list(rules())
    voted = stage(features(docs, id_col, text_col, carry).withColumns(rules()))
    p = _posterior(names, estimate(voted, names))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return voted.withColumns({"base_failed": failed, "kept": ~failed & (p >= keep_from), "p_good": p})


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.5) -> DataFrame:
    """Measures, ``base_failed``, ``p_good`` and ``kept`` for every row of ``docs``."""
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return _judged(docs, id_col, text_col, keep_from).select("doc_id", "row", *measures, "base_failed", "kept", "p_good", *rules())


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The rows go along while their votes are counted, so that they need not meet their verdicts in a join.
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__lk_whole"))
    named = whole.select("__lk_whole", *[F.col("__lk_whole")[c].alias(c) for c in {id_col, text_col}])
    return _judged(named, id_col, text_col, keep_from, ("__lk_whole",)).filter("kept").select("__lk_whole.*")
