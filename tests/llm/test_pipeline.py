"""The pipeline's stages against plain versions of what each must do to its own input."""

from __future__ import annotations

from collections import Counter

import pytest
from test_llm_operators import brute_components, brute_quality, brute_spans, plain_estimate, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"


def walk(spark, docs, tmp_path):
    """Input and output rows of every stage, each written and read again."""
    seen, columns = {}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert name == "bpe" or after.columns == columns
        seen[name] = (docs.collect(), after.collect())
        docs = after
    return seen


def good_rows(spark, rows, schema):
    """Rows that plain expectation-maximisation over the rules' votes keeps; the measures under the votes are checked against plain ones."""
    from lorekeep.llm import quality

    names = list(quality.rules())
    voted = quality.features(spark.createDataFrame(rows, schema)).withColumns(quality.rules()).collect()
    _, p = plain_estimate([tuple(r[k] for k in names) for r in voted], names, quality.ROUNDS)
    kept = Counter()
    measured = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in voted)
    assert measured == Counter((r.doc_id, *brute_quality(r.text)) for r in rows)
    for r, x in zip(voted, p, strict=True):
        if r.n_words >= 10 and 100 * r.n_repeat_words <= 20 * r.n_words and x >= 0.5:
            kept[r.doc_id] += 1
    return kept


def masked(text):
    """Every base span by its kind; of overlapping ones the first names them."""
    out, at = "", 0
    for s, e, k in sorted((s, e, k) for k, s, e in brute_spans(text)):
        if s >= at:
            out += text[at:s] + f"[{('EMAIL', 'IP', 'CARD', 'PHONE')[k]}]"
        at = max(at, e)
    return out + text[at:]


def goals(rows, repeats=3):
    """Targets by plain shares: of what is left by weight, sources above ``repeats`` times their size fixed there, until none is."""
    size = Counter()
    for r in rows:
        size[r.source] += len(words(r.text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, [(5, 2, 1)[i % 3] for i in range(len(names))], strict=True))
    total, fixed = sum(size.values()), {s: 0 for s in names if not size[s]}
    while True:
        free = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > repeats * size[s]]
        if not over:
            return {s: fixed[s] if s in fixed else left * weight[s] / w for s in names}
        fixed.update({s: repeats * size[s] for s in over})


def check(spark, seen, schema):
    first, kept = seen["quality_rules"]
    assert Counter(r.doc_id for r in kept) == good_rows(spark, first, schema)
    assert {tuple(r) for r in kept} <= {tuple(r) for r in first}
    first, kept = seen["ngram_jaccard_join"]
    roots = brute_components([(r.doc_id, r.text) for r in first], 5, 80)
    assert Counter(r.doc_id for r in kept) == Counter({i for i, c in roots.items() if i == c})
    first, kept = seen["pii"]
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((r.doc_id, None if r.text is None else masked(r.text)) for r in first)
    assert all(r.text is None or r.n_chars == len(r.text) for r in kept)
    first, kept = seen["mixing"]
    taken = Counter()
    for r in kept:
        taken[r.source] += len(words(r.text))
    assert all(abs(taken[s] - g) <= 1 for s, g in goals(first).items())
    per, size = Counter(), Counter()
    for r in kept:
        per[r.doc_id] += len(words(r.text))
    for r in first:
        size[r.doc_id] += len(words(r.text))
    assert all(n <= 3 * size[i] for i, n in per.items())
    first, kept = seen["bpe"]
    tokenizers = pytest.importorskip("tokenizers")
    from lorekeep.llm.queries import tokenizer_path

    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    expected = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in first)
    assert Counter((r.doc_id, tuple(r.ids)) for r in kept) == expected and all(r.n_tokens == len(r.ids) for r in kept)


def test_stages_on_the_smallest_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check(spark, walk(spark, docs, tmp_path), docs.schema)


def test_stages_on_nulls_repeats_and_ties(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = " ".join(f"w{k} is" if k % 7 else f"mail{k}@x.example.com" for k in range(30))
    data = [(i, prose.replace("w3", f"v{i}"), "en", f"s{i % 3}") for i in range(6)]
    data += [(7, prose + " same", "en", None), (7, prose + " same", "en", None), (8, None, None, "s1"), (None, prose.replace("is", "was"), "en", "s2"), (9, "", "en", "s0"), (10, "a " * 4000, "en", "s1")]
    data += [(20 + i, " ".join(f"u{i}x{k}" for k in range(40)), "en", f"s{i % 2}") for i in range(12)]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in data], schema)
    check(spark, walk(spark, docs, tmp_path), docs.schema)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(not after for _, after in walk(spark, docs, tmp_path).values())


def test_run_leaves_the_last_stage_alone(spark):
    out = corpus_pipeline.run(spark, DATA)
    files = {f.rsplit("/", 2)[-2] for f in out.inputFiles()}
    assert out.count() > 0 and files == {"4-bpe"}
