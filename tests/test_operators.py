"""Hand-computed expectations of the operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import labels as L
from lorekeep.functions import scoring as S
from lorekeep.functions import text as T
from lorekeep.operators import catalog as C
from lorekeep.operators import chunking as K
from lorekeep.operators import dedup as D
from lorekeep.operators import graph as G
from lorekeep.operators import ingest as I
from lorekeep.operators import privacy as P
from lorekeep.operators import queries as Q
from lorekeep.operators import retrieval as R
from lorekeep.operators import versions as V
from lorekeep.sources import files as S3


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fusion_scores(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id int, id long, rank int")
    b = spark.createDataFrame([(0, 1, 1)], "query_id int, id long, rank int")
    got = {r.id: r.rrf_score for r in R.fuse({"v": (a, 0.7), "f": (b, 0.3)}).collect()}
    assert got == {1: pytest.approx(1 / 61, abs=1e-9), 2: pytest.approx(0.7 / 62, abs=1e-9)}
    assert R.redistribute(0.5, 0.2, 0.3, False)[:2] == (pytest.approx(0.71), pytest.approx(0.29))


def test_decay(spark):
    as_of = F.lit("2024-01-01").cast("timestamp")
    got = [round(one(spark, S.decay(F.lit(d).cast("timestamp"), as_of)), 3) for d in ("2022-12-31", "2019-01-01", "2000-01-01")]
    assert got == [pytest.approx(0.909, abs=1e-3), pytest.approx(0.667, abs=1e-3), 0.5]
    assert one(spark, S.decay(F.lit(None).cast("timestamp"), as_of)) == 1.0
    assert one(spark, S.half_life(F.lit(1.0), F.lit(730.0))) == 0.25
    assert one(spark, S.seasonal_boost(F.array(F.lit("Tax-2024")), F.lit(4))) == 1.3 and one(spark, S.seasonal_boost(F.array(F.lit("review")), F.lit(1))) == 1.3


def test_corrective_filter(spark):
    rows = spark.createDataFrame([(0, i, i, s) for i, s in enumerate((0.9, 0.5, 0.2, 0.1), 1)], "query_id int, id int, rank int, score double")
    assert {(r.id, r.relevance) for r in R.corrective(rows).collect()} == {(1, "correct"), (2, "ambiguous")}
    low = rows.withColumn("score", F.lit(0.1))
    assert {(r.id, r.relevance) for r in R.corrective(low).collect()} == {(1, "fallback"), (2, "fallback"), (3, "fallback")}


def test_text_rules(spark):
    assert one(spark, K.sentences(F.lit("Dr. No came. He left! Why? "))) == ["Dr. No came.", "He left!", "Why?"]
    assert one(spark, T.shingles(F.lit("A b c D a b c"), 3)) == ["a b c", "b c d", "c d a", "d a b"]
    assert one(spark, T.shingles(F.lit("a b"), 3)) == [] and one(spark, T.length_adequacy(F.lit("a b"))) == 0.1
    assert one(spark, T.contradicts(F.lit("the red fox does not like cold rain"), F.lit("the red fox likes like cold rain")))
    assert one(spark, T.tag(F.lit("Big Red Box!"))) == "big-red-box"


def test_packing_with_overlap(spark):
    parts = F.array(*[F.lit(c * 40) for c in "abcde"])  # ten tokens each
    assert one(spark, K.pack(parts, 20, " ")) == ["a" * 40 + " " + "b" * 40, "c" * 40 + " " + "d" * 40, "e" * 40]
    assert one(spark, K.pack(parts, 20, " ", 10)) == [x * 40 + " " + y * 40 for x, y in ("ab", "bc", "cd", "de")]


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\nbody\n## Two\n\nmore")], "doc_id int, text string")
    got = sorted((r.section, r.title, r.start, r.content) for r in K.sections(docs).collect())
    assert [(s, t, o) for s, t, o, _ in got] == [(0, None, 0), (1, "One", 6), (2, "Two", 17)] and got[1][3] == "body"


def test_secrets_and_redaction(spark):
    text = "ssn 123-45-6789, api_key = abcdefghijklmnopqrstuvwx and password: hunter22 mail a@b.co"
    docs = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    found = P.findings(docs)
    assert {r.kind for r in found.collect()} == {"SSN", "API_KEY", "PASSWORD", "EMAIL"}
    red = {r.doc_id: r.text for r in P.redact(docs, found).collect()}
    assert red[2] == "clean" and red[3] is None and "hunter22" not in red[1] and "[REDACTED-SSN]" in red[1]
    assert one(spark, L.tier(F.array(F.lit("EMAIL"), F.lit("SSN")))) == "restricted" and one(spark, L.mask(F.lit("EMAIL"), F.lit("jane@x.org"))) == "ja***@x.org"


def test_overlapping_findings_leave_nothing_in_clear(spark):
    docs = spark.createDataFrame([(1, "0123456789")], "doc_id long, text string")
    found = spark.createDataFrame([(1, "A", 2, 6, 0.9), (1, "B", 4, 8, 0.9)], "doc_id long, kind string, start int, end int, confidence double")
    assert P.redact(docs, found).first().text == "01[REDACTED-A]89"


def test_catalog(spark):
    cat = spark.createDataFrame([(1, "notes", "active", ["study"], False), (2, "notes", "active", ["study", "cert-prep"], True), (3, "reference", "active", ["cert-prep"], False), (4, "notes", "deleted", [], False)], "doc_id int, category string, status string, tags array<string>, is_sensitive boolean")
    got = {(r.measure, r.key): r.n for r in C.stats(cat).collect()}
    assert got["total", ""] == 3 and got["tag", "study"] == 2 and got["tag", "cert-prep"] == 2 and got["status", "active"] == 3 and got["status", "deleted"] == 1
    with pytest.raises(ValueError, match="identifier"):
        C.equals("a b; drop", 1)
    with pytest.raises(ValueError, match="may not"):
        C.update(cat, F.lit(True), {"status"}, doc_id=1)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("d", "r", "a")], "subject string, predicate string, object string")
    got = {r.node: r.distance for r in G.reachable(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {"a": 0, "b": 1, "d": 1, "c": 2}
    docs = spark.createDataFrame([(1, "Ada Lovelace uses engines. kernel depends on memory")], "doc_id int, text string")
    assert {(r.subject, r.predicate, r.object) for r in G.relations(docs).collect()} == {("Lovelace", "uses", "engines"), ("kernel", "depends_on", "memory")}


def test_near_and_exact_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " more"), (4, "other words stand here alone"), (5, None)], "doc_id int, text string")
    assert [(r.id, r.original_id) for r in D.exact(docs.filter("text is not null"), T.content_hash(F.col("text"))).collect()] == [(2, 1)]
    assert [(r.left_id, r.right_id) for r in D.near(docs).collect()] == [(1, 3)]


def test_near_duplicates_are_all_pairs(spark):
    r = random.Random(3)
    base, data = [f"w{i}" for i in range(300)], []
    for i in range(60):
        w = list(base)
        for k in range(r.randint(3, 7)):
            w[r.randrange(300)] = f"e{i}x{k}"
        data.append((i, " ".join(w)))
    data += [(100, data[7][1]), (101, data[7][1].upper()), (102, None), (103, "two words"), (104, "two words")]
    docs = spark.createDataFrame(data, "doc_id int, text string")
    sets = {i: {tuple(w[k : k + 3]) for k in range(298)} for i, w in ((i, t.split()) for i, t in data[:60])}
    score = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b}
    expected = {p: s for p, s in score.items() if s >= 0.8}
    assert 0 < len(expected) < len(score)
    for chunk in (7, 256):
        got = D.near(docs, chunk=chunk).collect()
        assert len(got) == len(expected) and {(x.left_id, x.right_id): x.jaccard for x in got} == expected
    assert {(x.id, x.original_id) for x in D.copies(docs).collect()} >= {(100, 7), (104, 103)}


def test_query_understanding(spark):
    rows = spark.createDataFrame([(1, "cats vs dogs"), (2, "tea and milk"), (3, "how to swim?")], "id int, q string")
    got = [(r.id, r.sub_query, r.kind, r.weight) for r in Q.decompose(rows, "q").orderBy("id", "weight", "sub_query").collect()]
    assert got == [(1, "cats", "entity", 1.0), (1, "dogs", "entity", 1.0), (1, "cats vs dogs", "comparison", 1.2), (2, "milk", "factual", 1.0), (2, "tea", "factual", 1.0), (3, "how to swim?", "procedural", 1.0)]
    turns = spark.createDataFrame([(1, 0, "python memory usage guide"), (1, 1, "and it?"), (1, 2, "completely different longer question here")], "c int, t int, text string")
    assert [r.rewritten for r in Q.rewrite_follow_ups(turns, "c", "t", "text").orderBy("t").collect()] == ["python memory usage guide", "python memory usage guide and it?", "completely different longer question here"]


def test_versions_and_ingest(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "doc int, n int, s string")
    assert [r.n for r in V.changed(rows, "doc", ["n"], F.col("s")).orderBy("n").collect()] == [1, 3]
    assert one(spark, V.line_diff(F.lit("a\nb"), F.lit("a\nc\nd"))) == (2, 1)
    docs = spark.createDataFrame([(1, "First sentence here. Second one there.\n\nNext paragraph stands alone.")], "doc_id int, text string")
    chunks = I.chunk_rows(docs)
    assert chunks.count() == 1 and I.new_chunks(chunks, chunks).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hello")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    (tmp_path / ".hidden.md").write_text("no")
    files = S3.scan(spark, str(tmp_path))
    assert {(r.name, r.text) for r in S3.extract(files).collect()} == {("a.md", "# hello"), ("b.bin", "")}
    assert {r.text for r in S3.extract(files, {"bin": lambda x: f"{len(x)} bytes"}).collect()} == {"# hello", "2 bytes"}
    assert [r.name for r in S3.unindexed(files, spark.createDataFrame([("a.md",)], "name string")).collect()] == ["b.bin"]
    assert [tuple(r) for r in S3.terms(spark, [{"value": " X1 ", "type": "code"}, {"value": ""}, {"value": "Y"}]).collect()] == [("X1", "CODE"), ("Y", "CUSTOM")]


def test_packed_follows_the_bytes_of_its_input(spark, monkeypatch, tmp_path):
    from lorekeep import staging

    path = str(tmp_path / "t")
    spark.range(0, 40000, 1, 30).selectExpr("id", "uuid() as u").write.parquet(path)
    read = spark.read.option("maxPartitionBytes", 1 << 14).parquet(path).repartition(200)
    least = max(8, 8 * spark.sparkContext.defaultParallelism)
    assert staging.packed(read).rdd.getNumPartitions() == least
    monkeypatch.setattr(staging, "SHARE", 1 << 14)
    size = staging.input_bytes(read)
    assert size > least << 14 and staging.packed(read).rdd.getNumPartitions() == -(-size >> 14) or staging.packed(read).rdd.getNumPartitions() == 200
    kept = staging.stage(read.groupBy((read.id % 7).alias("k")).count())
    assert 0 < staging.input_bytes(kept.crossJoin(kept.limit(1))) < 1 << 20
    table, drop = staging.written(read.limit(10))
    assert table.count() == 10
    drop()
