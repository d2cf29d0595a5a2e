"""Each operator against a brute-force version, on rows with nulls, repeats, ties, empty and long texts and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import bpe, components, fingerprints, jaccard, lm, mixing, pii, quality, sharding, substrings, toxicity
from lorekeep.llm._words import shingles, word_hashes, word_spans

SCHEMA = "doc_id long, text string, source string, node long, row string, label string, size long, cuts string, kept string"
WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, text or "")


def rows():
    r = random.Random(11)
    vocabulary = ["alpha", "beta", "gamma", "delta", "émile", "zeta,", "eta.", "theta", "iota", "kappa"]
    base = [r.choice(vocabulary) + str(r.randint(0, 30)) for _ in range(90)]
    out = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(90)] = f"edit{r.randint(0, 99)}"
        out.append((i, " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(50))
    out += [(100 + i, " ".join(f"w{r.randint(0, 5000)}" for _ in range(40)) + "\n" + passage + " end") for i in range(5)]
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "One two"), (204, "one  TWO"), (205, "a b " * 120), (206, "Line one.\nLine one.\nmail a.b@c.de or +1 (017) 555-7713 and 4111 1111 1111 1111 at 10.0.0.256")]
    out += [(207, "long " + " ".join(f"t{k}" for k in range(6000))), (208, "same"), (208, "same"), (None, "null id text here"), (209, "​ x ẞ Σίσυφος " + "é" * 30)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    sources = ["s1", "s2", "s3", None, "s4"]
    data = [(i, t, sources[k % 5], k, "r", "l", 7, "c", "k") for k, (i, t) in enumerate(rows())]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_cutting_matches_regex():
    texts = [t or "" for _, t in rows()]
    data = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data])))
    starts, ends, bounds = word_spans(buf, offsets)
    got = [[bytes(buf[starts[k] : ends[k]]).decode() for k in range(bounds[d], bounds[d + 1])] for d in range(len(texts))]
    assert got == [words(t) for t in texts]
    h = word_hashes(buf, starts, ends)
    flat = [w for t in texts for w in words(t)]
    assert len(set(h.tolist())) == len(set(flat))
    s, at = shingles(h, bounds, 4)
    expected = [len(w) - 3 if len(w) > 3 else int(bool(w)) for w in map(words, texts)]
    assert np.diff(at).tolist() == expected and len(s) == sum(expected)


def test_sharding(docs, empty):
    got = sharding.shard(docs, 4).toPandas()
    size = {(i, zlib.crc32((t or "").encode())): len((t or "").encode()) + 8 for i, t in rows()}
    assert len(got) == len(rows()) and all(size[None if math.isnan(r.doc_id) else int(r.doc_id), r.text_crc32] == r["size"] for _, r in got.iterrows())
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.shard(empty, 4).count() == 0


def test_packing_is_even_and_splits_hot_groups(spark):
    data = [(i, "hot text " * 20) for i in range(3000)] + [(5000 + i, "x" * (i % 700)) for i in range(6000)]
    got = sharding.shard(spark.createDataFrame(data, "doc_id long, text string"), 24).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).toPandas()
    assert len(got) == 24 and got.b.max() / got.b.mean() < 1.05 and got.n.max() / got.n.mean() < 1.3


def brute_components(data, n, percent):
    sets = {}
    for i, t in data:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    key = lambda x: (x is None, x)
    ids = sorted(sets, key=key)
    for a in ids:
        for b in ids:
            if key(a) < key(b) and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)), key=key)
                parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_join(docs, n, percent):
    got = {(r.doc_id, r.component_id) for r in jaccard.join(docs, n, percent).collect()}
    assert got == set(brute_components(rows(), n, percent).items())


def test_deduplicate_keeps_texts_of_rows_without_an_id_of_their_own(spark):
    def text(k):
        return " ".join(f"{k}w{i}" for i in range(60))

    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (8, text("a") + " more"), (9, text("f")), (9, text("f")), (None, None), (None, None), (10, "")]
    kept = jaccard.deduplicate(spark.createDataFrame([(i, t, None, 1, "", "", 1, "", "") for i, t in rows], SCHEMA).repartition(3))
    assert sorted(((r.doc_id or -1), r.text or "") for r in kept.collect()) == sorted([(-1, text("b")), (-1, text("c")), (7, text("d")), (7, text("e")), (8, text("a") + " more"), (9, text("f")), (-1, ""), (10, "")])
    ends = [(2**63 - 1, text("a")), (5, text("b")), (5, text("c")), (None, text("d"))]
    assert jaccard.deduplicate(spark.createDataFrame(ends, "doc_id long, text string")).count() == 4


def test_a_leader_of_many_meets_them_in_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LED", 3)
    base = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join(base[: 80 - k % 2] + [f"own{k}"])) for k in range(60)] + [(100 + k, " ".join(f"x{k}y{i}" for i in range(30))) for k in range(5)]
    got = {(r.doc_id, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == set(brute_components(rows, 5, 80).items())


def test_jaccard_empty_and_deduplicate(docs, empty):
    assert jaccard.join(empty).count() == 0
    kept = jaccard.deduplicate(docs)
    roots = brute_components(rows(), 5, 80)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == sorted(i if i is not None else -1 for i, c in roots.items() if i == c)


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 50, 50: 50, 70: 50}


def brute_quality(t):
    w = words(t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(docs, empty):
    expected = defaultdict(set)
    for i, t in rows():
        expected[i].add(brute_quality(t))
    got = quality.judge(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in expected[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def plain_estimate(votes, names, rounds):
    """The rounds of expectation-maximisation as a plain loop over rows; estimates and the posterior of each row."""

    def posterior(theta):
        out = []
        for v in votes:
            if theta is None:
                out.append(quality.START[min(2, v.count(-1))])
            else:
                odds = math.log(theta["prior"] / (1 - theta["prior"])) + sum(math.log(theta[k][0][x] / theta[k][1][x]) for k, x in zip(names, v, strict=True) if x)
                out.append(1 / (1 + math.exp(-odds)))
        return out

    mine = None
    for _ in range(rounds):
        p = posterior(mine)
        good, bad = sum(p), sum(1 - x for x in p)
        weight = 1 + quality.BELIEF_SHARE * (good + bad)
        new = {"prior": (good + 1) / (good + bad + 2)}
        for j, k in enumerate(names):
            pair = []
            for c, total, belief in ((p, good, quality.BELIEF[0]), ([1 - x for x in p], bad, quality.BELIEF[1])):
                pair.append({s: (sum(x for x, v in zip(c, votes, strict=True) if v[j] == s) + weight * belief[s]) / (total + weight) for s in (-1, 1)})
            new[k] = pair
        moved = mine is None or max(abs(new[k][c][s] - mine[k][c][s]) for k in names for c in (0, 1) for s in (-1, 1)) > 1e-3
        mine = new
        if not moved:
            break
    return mine, posterior(mine)


def test_quality_estimation_agrees_with_a_plain_loop(docs):
    """The estimates and the verdicts of the DataFrame rounds against the same rounds over collected votes."""
    names = list(quality.rules())
    voted = quality.features(docs).withColumns(quality.rules()).select(*names)
    theta = quality.estimate(voted, names, rounds=4)
    mine, _ = plain_estimate([tuple(r) for r in voted.collect()], names, 4)
    assert abs(theta["prior"] - mine["prior"]) < 1e-9
    assert all(abs(theta[k][c][s] - mine[k][c][s]) < 1e-9 for k in names for c in (0, 1) for s in (-1, 1))
    got = quality.judge(docs).collect()
    _, p = plain_estimate([tuple(r[k] for k in names) for r in got], names, quality.ROUNDS)
    assert all(abs(r.p_good - x) < 1e-6 and r.kept == (not r.base_failed and x >= 0.5) for r, x in zip(got, p, strict=True))


def test_quality_measures_of_the_rules(docs):
    expected = defaultdict(set)
    for i, t in rows():
        w = words(t)
        expected[i].add((len(set(w)), sum(a == b for a, b in zip(w, w[1:], strict=False)), len(re.findall(r"[#*$%&|<>](?=[\x20\x09-\x0D]|\Z)", t or ""))))
    assert all((r.n_distinct, r.n_adjacent, r.n_symbol_words) in expected[r.doc_id] for r in quality.features(docs).collect())


def test_quality_weighs_rules_by_what_others_bear_out(spark):
    """Neither all rules must pass nor is every document that passes the base kept: a lone vote says little, agreeing ones reject."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda k: [word() for _ in range(k)]
    data = [(i, " ".join(text(60))) for i in range(400)]
    data += [(1000 + i, " ".join(w + "###" for w in text(60))) for i in range(40)]
    data += [(2000 + i, " ".join(w for w in text(12) for _ in range(4))) for i in range(40)]
    data += [(3000 + i, " ".join([*text(30), *(str(r.randint(10**7, 10**8)) for _ in range(12))])) for i in range(12)]
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got[i].kept for i in range(400))
    assert not any(got[i].kept or got[i].base_failed for i in [*range(1000, 1040), *range(2000, 2040)])
    assert all(got[i].kept and got[i].digits == -1 for i in range(3000, 3012))


def test_toxicity(spark, empty):
    r = random.Random(2)
    common, rude = [f"w{i}" for i in range(400)], ["nasty", "vile", "awful"]
    data = []
    for i in range(900):
        toxic = i % 4 == 0
        w = [r.choice(common) for _ in range(60)] + ([r.choice(rude) for _ in range(3)] if toxic else [])
        r.shuffle(w)
        data.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    labels = docs.filter("doc_id % 2 = 0").select("doc_id", "toxic").unionByName(spark.createDataFrame([(5, None)], "doc_id long, toxic int"))
    got = toxicity.score(docs.select("doc_id", "text"), labels, {"rare": F.col("toxic") * 0, "toxic": F.col("toxic") == 1}).toPandas().merge(docs.select("doc_id", F.col("toxic").alias("y")).toPandas(), on="doc_id")
    held = got[got.doc_id % 2 == 1]
    assert ((held.toxic == (held.y == 1)).mean() > 0.97) and not got.rare.any()
    assert toxicity.score(empty, labels, {"toxic": F.col("toxic") == 1}).count() == 0
    none = toxicity.score(docs.select("doc_id", "text"), labels.filter("false"), {"toxic": F.col("toxic") == 1})
    assert none.filter("toxic").count() == 0 and none.count() == 900


def test_toxicity_of_odd_rows(spark):
    """Null and empty texts by the intercepts, repeated rows one by one, columns with the operator's own names ignored, a third of labels on one id."""
    r = random.Random(5)
    text = lambda bad: " ".join([r.choice([f"w{k}" for k in range(200)]) for _ in range(30)] + (["vile"] * 2 if bad else []))
    data = [(i, text(i % 3 == 0), 0.5, "x") for i in range(300)] + [(1000, None, 0.1, "x"), (1001, "", 0.1, "x"), (1002, " \n", 0.1, "x"), (0, "vile vile", 0.2, "y"), (None, "vile words", 0.1, "z"), (1003, "vile " * 20_000, 0.0, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic double, y string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(7, 0)] * 100 + [(None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels, {"toxic": F.col("toxic") == 1}).collect()
    assert len(got) == len(data) and sum(r.doc_id == 0 for r in got) == 2
    one = {r.doc_id: r.toxic for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert not any(one[i] for i in (1000, 1001, 1002)) and one[1003] and one[None]
    assert sum(r.toxic == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and 0 < r.doc_id < 300) > 290


def brute_spans(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        total = sum(v - 9 if v > 9 else v for v in (int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(d))))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_pii_base(docs, empty):
    r = random.Random(1)
    for _ in range(20000):
        t = "".join(r.choice("a1@.-+ 9(5)b\n") for _ in range(r.randint(0, 60)))
        assert brute_spans(t) == pii.base_spans(t), t
    got = {(x.doc_id, tuple(sorted(tuple(s) for s in x.base))) for x in pii.detect(docs).collect()}
    assert got == {(i, tuple(sorted(brute_spans(t or "")))) for i, t in rows()}
    assert pii.detect(empty).count() == 0


def test_pii_bootstrap_finds_unseen_identifiers(spark):
    data = [(i, f"hello there please write to ticket-desk: user{i}@mail.example.com thanks {i}") for i in range(30)]
    data += [(100 + i, f"hello there please write to ticket-desk: user{i}@localhost thanks") for i in range(3)]
    data += [(200 + i, f"the order number {10000 + i} was shipped") for i in range(30)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    added = {r.doc_id: r.added for r in pii.detect(docs).filter(F.size("added") > 0).collect()}
    assert set(added) == {100, 101, 102}
    assert data[30][1][added[100][0].start : added[100][0].end] == "user0@localhost" and added[100][0].kind == 0
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert masked[0] == "hello there please write to ticket-desk: [EMAIL] thanks 0" and masked[200] == data[33][1]


def test_fingerprints(docs, empty):
    got = fingerprints.edited_likeness(docs.filter("doc_id is not null and doc_id <> 208")).toPandas().sort_values("doc_id").reset_index(drop=True)
    data = sorted((i, t or "") for i, t in rows() if i is not None and i != 208)

    def grams(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    for k, (i, t) in enumerate(data):
        nxt, cut = data[(k + 1) % len(data)][1], len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got.doc_id[k] == i and got.n_chars[k] == len(t) and got.edited_sha256[k] == hashlib.sha256(edited.encode()).hexdigest()
        for b, near in ((edited, got.near_edited[k]), (nxt, got.near_next[k])):
            x, y = grams(t), grams(b)
            assert abs(near - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.25
    assert fingerprints.edited_likeness(docs).count() == len(rows()) and fingerprints.edited_likeness(empty).count() == 0


def test_fingerprints_with_repeated_and_null_ids(spark):
    """Successors in the order of id (null first) and text, where a hot id and null ids stand at the start of ranges."""
    data = [(None, f"null id {k} " * 9) for k in range(40)] + [(5, f"hot {k} " * 12) for k in range(60)] + [(k, f"row {k} of some words here " * 4) for k in range(6, 40)] + [(5, "same"), (5, "same"), (3, None)]
    got = fingerprints.edited_likeness(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    expected = Counter()
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        expected[i, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected


def test_fingerprints_of_long_texts(spark):
    data = [(k, " ".join(f"{k}x{j}" for j in range(n))) for k, n in enumerate([20_000, 20_000, 100_000, 100_000])]
    got = fingerprints.edited_likeness(spark.createDataFrame(data, "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(r.near_next < 0.05 for r in got) and len({r.fingerprint for r in got}) == 4
    for k, r in enumerate(got):
        t, nxt = data[k][1], data[(k + 1) % 4][1]
        x, y = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split(), (t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]).split()))
        assert abs(r.near_edited - len(x & y) / len(x | y)) < 0.15


def test_near_classes_against_all_pairs(docs, empty, spark):
    """Only verified pairs connect, and of the pairs that do nine in ten and more are found; members far from a bucket's first included."""
    exact = brute_components(rows(), 5, 80)
    got = {r.doc_id: r.class_id for r in fingerprints.near_classes(docs).collect()}
    assert set(got) == set(exact)
    pairs = lambda c: {(a, b) for a in c for b in c if a is not None and b is not None and a < b and c[a] == c[b]}
    mine, wanted = pairs(got), pairs(exact)
    assert mine <= wanted and len(mine) >= 0.9 * len(wanted) > 0
    r = random.Random(21)
    base = [f"b{k}" for k in range(150)]
    data = []
    for i in range(250):  # one template, edited to similarities on both sides of the threshold
        w = list(base)
        for _ in range(r.randint(1, 7)):
            w[r.randrange(150)] = f"e{r.randrange(10**6)}"
        data.append((i, " ".join(w)))
    got = {x.doc_id: x.class_id for x in fingerprints.near_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    mine, wanted = pairs(got), pairs(brute_components(data, 5, 80))
    assert mine <= wanted and len(mine) >= 0.9 * len(wanted)
    assert fingerprints.near_classes(empty).count() == 0


def test_jaccard_of_a_hot_template_in_small_cells(spark, monkeypatch):
    """A large group of near copies on both sides of the threshold, with lists and cells so small that all of them are cut."""
    r = random.Random(22)
    base = [f"b{k}" for k in range(120)]
    data = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(120)] = f"e{r.randrange(12)}"
        data.append((i, " ".join(w)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "CELL_SETS", 7)
    got = {x.doc_id: x.component_id for x in jaccard.join(docs, 5, 80).collect()}
    assert got == brute_components(data, 5, 80)


def test_tree_adds_all_blocks(spark):
    from lorekeep.llm import _exchange

    rows = [(t % 3, t // _exchange.FAN, np.int64(t).tobytes()) for t in range(2000)]
    add = lambda table: sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("block")).tobytes()
    got = _exchange.tree(spark.createDataFrame(rows, _exchange.BLOCKS), add, -(-2000 // _exchange.FAN)).collect()
    assert {r["part"]: int(np.frombuffer(r["block"], np.int64)[0]) for r in got} == {p: sum(t for t in range(2000) if t % 3 == p) for p in range(3)} and len(got) == 3


def test_long_lists_are_cut_into_blocks():
    r = np.random.default_rng(5)
    rec = np.zeros(300, jaccard._ENTRY)
    rec["key"] = 7
    rec["label"] = r.integers(0, 120, 300)
    rec["lo"] = np.sort(r.integers(10, 60, 300))
    rec["hi"] = rec["lo"] + r.integers(0, 8, 300)
    rec["rest"] = np.maximum(1, rec["lo"] - r.integers(0, 9, 300))
    whole = set(map(tuple, jaccard.list_pairs(rec, 80).tolist()))
    blocks, meet = jaccard.cut_list(rec, 80, 32)
    assert len(blocks) == 10 and len(meet) < 55
    parts = set()
    for i, j in meet:
        x, y = (np.frombuffer(blocks[k], jaccard._ENTRY) for k in (i, j))
        parts |= set(map(tuple, jaccard.list_pairs(x, 80, None if i == j else y).tolist()))
    assert parts == whole


def test_language_model(docs, empty):
    got = lm.score(docs).toPandas()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows()}
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows()]
    counts = Counter(w for i, t in tokens if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    expected = defaultdict(list)
    for i, t in tokens:
        expected[i].append((held[i], len(t), sum(w in counts for w in t), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)))
    assert len(got) == len(rows()) and (got.train_tokens == n).all() and (got.score < 0).all()
    for r in got.itertuples():
        i = None if math.isnan(r.doc_id) else int(r.doc_id)
        assert (r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) in expected[i]
    assert lm.score(empty).count() == 0


def test_class_model_is_a_distribution_and_learns():
    r = np.random.default_rng(3)
    counts = np.zeros((lm.CLASSES * lm.CLASSES // lm.SLICES, lm.CLASSES))
    counts[:, :4] = r.integers(0, 50, (len(counts), 4))
    w = lm.zero_weights()
    two, one = np.divmod(np.arange(len(counts)), lm.CLASSES)
    likelihood = []
    for _ in range(4):
        p = lm._log_softmax(lm._logits(w, two, one))
        assert np.allclose(np.exp(p).sum(axis=1), 1, atol=1e-4)
        likelihood.append((counts * p).sum())
        seen, expected = np.split(lm._expectations(0, counts, w), 2)
        step, at = (seen - expected) / (4 * ((seen + expected) / 2 + 1)), 0
        for k, m in w.items():
            w[k] = m + 1.6 * step[at : at + m.size].reshape(m.shape).astype(np.float32)
            at += m.size
    assert likelihood == sorted(likelihood)


def test_contexts_are_the_nearer_rare_word():
    h = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rare = np.array([True, False, False, True, True, True, False, False])
    got = lm.contexts(h, rare, np.array([0, 4, 4, 8]), share=1)
    expected = [0, lm.mix(h[0:1] ^ lm._NEXT)[0], lm.mix(h[0:1] ^ lm._SKIP)[0], 0, 0, lm.mix(h[4:5] ^ lm._NEXT)[0], lm.mix(h[5:6] ^ lm._NEXT)[0], lm.mix(h[5:6] ^ lm._SKIP)[0]]
    assert got.tolist() == [int(x) for x in expected]


def test_context_gains_against_a_plain_count():
    """Against dictionaries; and with its context each class is still a distribution, unknown tokens included."""
    r = random.Random(12)
    head = [(f"w{k}", k % 3, r.randint(5, 40)) for k in range(12)]  # token, class, count
    z = np.array([sum(c + 1 for _, k, c in head if k == cls) + 50.0 for cls in range(3)])  # others are rare tokens
    value = np.array([math.log10(c + 1) for _, _, c in head])
    data = []
    for _ in range(400):
        w = r.randrange(14)
        data.append((r.randrange(6), r.randrange(9), w if w < 12 else lm.OTHER, head[w][1] if w < 12 else w % 3, int(r.random() < 0.2)))
    got = lm.context_gains(np.array(data, lm._NEAR), value, z)
    seen, total = Counter(), Counter()
    for ctx, _, w, cls, held in data:
        if not held:
            seen[ctx, cls, w] += 1
            total[ctx, cls] += 1
    known = [n for (_, _, w), n in seen.items() if w != lm.OTHER]
    once, twice = known.count(1), known.count(2)
    discount = min(0.95, max(0.1, (once + 1) / (once + 2 * twice + 2)))
    alone = lambda w: (head[w][2] + 1) / (z[head[w][1]] + 1)

    def inside(ctx, cls, w):
        if not total[ctx, cls]:
            return None
        own = {v: seen[ctx, cls, v] for v in range(12) if head[v][1] == cls and seen[ctx, cls, v]}
        if w in own:
            return (own[w] - discount) / total[ctx, cls] / alone(w)
        return (1 - sum(n - discount for n in own.values()) / total[ctx, cls]) / (1 - sum(map(alone, own)))

    for (ctx, _, w, cls, _), g in zip(data, got, strict=True):
        p = inside(ctx, cls, w)
        assert abs(g - (0.0 if p is None else math.log10(p))) < 1e-9
    for ctx, cls in total:
        mass = sum(inside(ctx, cls, w) * alone(w) for w in range(12) if head[w][1] == cls)
        others = 1 - sum(alone(w) for w in range(12) if head[w][1] == cls)
        assert abs(mass + others * inside(ctx, cls, lm.OTHER) - 1) < 1e-9
    assert len(lm.context_gains(np.zeros(0, lm._NEAR), value, z)) == 0


def test_language_model_scores_a_copy_of_training_text_higher(spark):
    r = random.Random(3)
    words_ = [f"{a}{b}{c}{e}" for a in "bcdfgklmnp" for b in "aeiou" for c in "lmnrstvz" for e in "aeiou"]
    text = lambda: " ".join([r.choice(words_) if k % 4 else f"x{r.randrange(10**6)}" for k in range(200)])
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 == 2][:40]
    train = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 != 2][:400]
    data = [(i, text()) for i in train]
    data = [(i, data[k // 2][1]) for k, (i, _) in enumerate(data)]  # every text of the training part stands there twice
    data += [(i, data[k][1] if k < 20 else text()) for k, i in enumerate(held)]
    got = {x.doc_id: x.score - x.base_score for x in lm.score(spark.createDataFrame(data, "doc_id long, text string"), share=1).collect()}
    copies, others = [got[i] for i in held[:20]], [got[i] for i in held[20:]]
    assert min(copies) > max(others)


def test_every_position_has_features_of_the_words_before_it():
    """With any weights the parts of a class are a distribution in every context, and known tokens with a part's unknown place fill it."""
    r = np.random.default_rng(5)
    z = r.integers(0, 50, (lm.CLASSES, 1 << lm.BITS)).astype(float)
    logit, part = lm.choices(z)
    n = 1 << lm.BITS
    leaf, cls = np.arange(n), np.full(n, 7)
    for weights in (np.zeros(1 << 10, np.float32), r.normal(size=1 << 10).astype(np.float32)):
        one, two = np.full(n, 11, np.uint64), np.full(n, 12, np.uint64)
        p = 10 ** lm.shared_gains(one, two, cls, leaf, logit, weights)
        assert abs(p.sum() - 1) < 1e-6
        assert weights.any() or np.allclose(p, (z[7] + 1) / (z[7] + 1).sum(), atol=1e-6)
    assert np.allclose(10**part.reshape(z.shape), z + 1)
    one, two = lm.befores(np.arange(1, 5, dtype=np.uint64), np.array([0, 3, 4]))
    assert one[0] == one[3] and two[0] == two[1] == two[3] and len({*one.tolist(), *two.tolist()}) == 5


def test_order_of_frequent_words_is_learned(spark):
    """All words are frequent and of one class, so that nothing but the words before tells the next."""
    r = random.Random(4)
    vocabulary = [f"{a}{b}{c}ing" for a in "bdfg" for b in "aeio" for c in "lm"]
    in_order = lambda: [vocabulary[(k + s) % len(vocabulary)] for s in [r.randrange(99)] for k in range(100)]
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 == 2][:40]
    train = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 != 2][:200]
    texts = {i: in_order() for i in train + held}
    for i in held[20:]:
        r.shuffle(texts[i])
    got = {x.doc_id: x.score - x.base_score for x in lm.score(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()}
    assert min(got[i] for i in held[:20]) > max(got[i] for i in held[20:]) + 10


def _random_texts(n_docs: int, n_words: int):
    r = random.Random(9)
    return [(i, " ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(n_words))) for i in range(n_docs)]


def test_what_language_model_answers_does_not_grow_with_the_groups(spark, monkeypatch):
    """Each occurrence's answer goes back to its document in a few bytes, however many groups there are."""
    data = _random_texts(300, 200)
    answered, keep = spark.sparkContext.accumulator(0), lm.tidy

    def counted(f):
        if f.__name__ != "meet":
            return keep(f)

        def run(table):
            out = f(table)
            answered.add(sum(len(x) for x in out.column("block").to_pylist()))
            return out

        return keep(run)

    monkeypatch.setattr(lm, "tidy", counted)
    monkeypatch.setattr(lm, "HEAD", 50)
    monkeypatch.setattr(lm, "partitions_for", lambda total, per_group, least=8: 200)
    assert lm.score(spark.createDataFrame(data, "doc_id long, text string").coalesce(1)).count() == 300
    assert 0 < answered.value < 8 * 300 * 200


def test_language_model_by_units_of_any_size(spark, monkeypatch):
    data = [*_random_texts(60, 50), (60, None), (None, "w1 w2"), (5, "w1 w2"), (5, "w1 w2")]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(lm, "HEAD", 20)
    monkeypatch.setattr(lm, "KNOWN", 40)
    got, rows_of_batch = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    for unit, numbers, distinct, batch in ((1 << 21, 1 << 16, 1 << 20, 10_000), (300, 7, 30, 3)):
        for name, value in (("UNIT", unit), ("NUMBERS", numbers), ("DISTINCT", distinct)):
            monkeypatch.setattr(lm, name, value)
        spark.conf.set(rows_of_batch, batch)
        try:
            rows_ = lm.score(frame).collect()
        finally:
            spark.conf.unset(rows_of_batch)
        got.append(sorted((str(x.doc_id), x.n_tokens, x.n_known, round(x.base_score, 4), round(x.score, 3)) for x in rows_))
    assert got[0] == got[1] and len(got[0]) == len(data)


def test_packed_columns_come_back():
    from lorekeep.llm._exchange import pack, unpack

    r = np.random.default_rng(2)
    for n in (0, 1, 1000):
        columns = [r.integers(0, 2**63, n).astype("<u8"), r.integers(0, 9, n).astype("u1"), r.normal(size=n)]
        assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(columns, unpack(pack(*columns), "<u8", "u1", "<f8"), strict=True))


@pytest.mark.parametrize("hot", [substrings.HOT, 2, 5])
def test_repeated_passages(docs, empty, hot):
    texts = [(i, words(t)) for i, t in rows()]
    count = Counter(tuple(w[k : k + 35]) for _, w in texts for k in range(len(w) - 34))
    expected = Counter()
    for i, w in texts:
        stay = [True] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                stay[k : k + 35] = [False] * 35
        expected[i, len(w), stay.count(False), " ".join(x for x, y in zip(w, stay, strict=True) if y)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeated(docs, hot=hot).collect()) == expected
    assert substrings.remove_repeated(empty, hot=hot).count() == 0


def test_automaton_counts_windows():
    r = random.Random(5)
    for _ in range(60):
        seqs = [[r.randint(0, 2) for _ in range(r.randint(5, 25))] for _ in range(r.randint(1, 5))]
        weights = [r.randint(1, 2) for _ in seqs]
        count = Counter()
        for s, w in zip(seqs, weights, strict=True):
            for k in range(len(s) - 4):
                count[tuple(s[k : k + 5])] += w
        auto = substrings.Automaton(seqs, weights)
        for s in seqs:
            assert auto.repeated(s, 5) == [count[tuple(s[k : k + 5])] > 1 for k in range(len(s) - 4)]


def test_sainte_lague():
    assert mixing.sainte_lague([53, 24, 23], 7) == [3, 2, 2]
    assert mixing.sainte_lague([1, 1, 1], 2) == [1, 1, 0] and mixing.sainte_lague([0, 0], 5) == [0, 0] and mixing.sainte_lague([], 3) == []
    r = random.Random(4)
    for _ in range(100):
        votes = [r.randint(0, 50) for _ in range(6)]
        seats, got = r.randint(0, 30), [0] * 6
        for _ in range(seats if any(votes) else 0):
            i = max(range(6), key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
            got[i] += 1
        mine = mixing.sainte_lague(votes, seats)
        assert sum(mine) == sum(got) and sorted(v / (2 * g + 1) for v, g in zip(votes, mine, strict=True)) == pytest.approx(sorted(v / (2 * g + 1) for v, g in zip(votes, got, strict=True)))


def test_mixing(docs, empty):
    got = mixing.mix(docs).toPandas()
    sizes = Counter()
    for k, (_, t) in enumerate(rows()):
        sizes[["s1", "s2", "s3", None, "s4"][k % 5]] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]), strict=True))
    assert abs(sum(goal.values()) - sum(sizes.values())) < 1e-6 and all(goal[s] <= 3 * sizes[s] + 1e-6 for s in names)
    for s, g in got.groupby(got.source.fillna("")):
        assert g.target.iloc[0] == pytest.approx(goal[s or None]) and abs(g.taken.sum() - goal[s or None]) <= max(3, 0.02 * goal[s or None])
    assert (got.taken <= 3 * got["size"]).all() and len(got) == len(rows())
    again = mixing.mix(docs.repartition(2)).toPandas()
    assert sorted(map(str, zip(got.doc_id, got["size"], got.taken, strict=True))) == sorted(map(str, zip(again.doc_id, again["size"], again.taken, strict=True)))
    assert mixing.mix(empty).count() == 0


def test_cell_plan_takes_the_quota_to_the_word():
    r = random.Random(6)
    for _ in range(400):
        words, block, salt = r.randint(1, 400), r.choice([1, 3, 7, 50, 1000]), r.randint(0, 1 << 31)
        quota = r.randint(0, 3 * words)
        passes, extra, rest, n, step, start, width = mixing.cell_plan(words, quota, block, salt)
        ranks = [(j * step + start) % n for j in range(n)]
        assert sorted(ranks) == list(range(n)) and (n - 1) * width < words <= n * width
        own = [min(width, words - j * width) for j in range(n)]
        assert passes * words + sum(w if k < extra else min(w, rest) if k == extra else 0 for w, k in zip(own, ranks, strict=True)) == quota
    for total in (80_000_000, 4_800_000_000):  # a block of 305 and of 18,310 words
        passes, extra, rest, n, step, start, width = mixing.cell_plan(50, 150, total // mixing.BLOCKS, 5)
        assert passes * 50 + extra * width + rest == 150
    assert mixing.quotas([9.0, 0.5, 0.5], [9, 1, 1], 10) == [9, 1, 0] and mixing.quotas([3.0] + [1.4] * 9, [3] + [5] * 9, 15)[0] == 3


def test_small_sources_meet_their_targets(spark):
    data = [(i, " ".join(f"w{k}" for k in range(60)), "big") for i in range(400)]
    data += [(1000 + i, " ".join(f"v{k}" for k in range(7)), s) for i, s in enumerate(["few", "few", "mid", "zero"] + ["mid"] * 12)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), blocks=16).toPandas()  # blocks of 1,500 words, as a large corpus has
    for _, g in got.groupby("source"):
        assert g.target.iloc[0] > 0 and abs(g.taken.sum() - g.target.iloc[0]) <= 1
    assert got.taken.sum() == got["size"].sum() and (got.taken <= 3 * got["size"]).all()


def test_applied_mix_has_the_words_taken(docs, empty):
    """Repeated rows, null ids and columns that clash with the operator's own names included."""
    mixed = mixing.mix(docs)
    out = mixing.apply_mix(docs, mixed)
    assert out.columns == docs.columns
    count, taken = Counter(), Counter()
    for r in out.collect():
        count[r.doc_id] += len(words(r.text))
    for r in mixed.collect():
        taken[r.doc_id] += r.taken
    assert +count == +taken
    assert mixing.apply_mix(empty, mixing.mix(empty)).count() == 0


def test_hot_source_is_many_cells(spark):
    data = [(i, "one two three", "hot" if i % 3 else f"s{i % 4}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    assert (got.taken <= 9).all()


def test_redact_keeps_every_row_once(docs, empty, spark):
    kept = pii.redact(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    data = [(1, "mail a.b@c.de now", "x"), (1, "mail a.b@c.de now", "y"), (1, "other", "z"), (None, "a.b@c.de", None), (2, None, "n")]
    got = pii.redact(spark.createDataFrame(data, "doc_id long, text string, row string")).collect()
    assert Counter(tuple(r) for r in got) == Counter([(1, "mail [EMAIL] now", "x"), (1, "mail [EMAIL] now", "y"), (1, "other", "z"), (None, "[EMAIL]", None), (2, None, "n")])
    assert pii.redact(empty).count() == 0


def test_pii_keeps_kinds_apart_by_looks(spark):
    """A context that introduces e-mails adds no digits, and contexts of chance add nothing."""
    data = [(i, f"please write to desk: user{i}@mail.example.com thanks") for i in range(20)]
    data += [(100, "please write to Desk: 1234567890123456 thanks"), (101, "please write to desk user@localhost, thanks")]
    data += [(200 + i, f"of +1 (017) 555-{1000 + i}") for i in range(3)] + [(300, "of 12345678 things")]
    added = {r.doc_id: r.added for r in pii.detect(spark.createDataFrame(data, "doc_id long, text string")).filter(F.size("added") > 0).collect()}
    assert set(added) == {101} and added[101][0].kind == 0


def test_bpe_is_the_librarys(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    from lorekeep.llm.queries import tokenizer_path

    path = tokenizer_path()
    reference, own = tokenizers.Tokenizer.from_file(path), bpe.load(path)
    odd = ["", "   ", "Hello World İstanbul ΣΊΣΥΦΟΣ ΑΣ", "a<|endoftext|>b", "é café \U0001f600 naïve don't I'LL 123 ½\x00\x1c\x85y", "x" * 3000, "ab" * 2000, "ﬁ Å K", "日本語 한국어 العربية", "<|", "qzxjkvbpyg"]
    r = random.Random(9)
    odd += ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 1000), r.randint(0x4E00, 0x4E40), 0x20])) for _ in range(60)) for _ in range(300)]
    for t in odd + [t or "" for _, t in rows()]:
        ids = reference.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == reference.decode(ids, skip_special_tokens=False)
    for w in ("lower", "international", "xyzzy"):
        assert [own.token_of[i] for i in own._encode_word(w)] == own.merge_all([*w[:-1], w[-1] + bpe.SUFFIX])
    got = bpe.digests(docs, path).collect()
    assert len(got) == len(rows()) and bpe.digests(empty, path).count() == 0
    assert {(x.doc_id, x.text) for x in bpe.decode(bpe.encode(docs, path), path).collect()} == {(i, reference.decode(reference.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows()}


def test_bpe_digests_are_put_together_word_by_word():
    """As encoding a text and decoding its ids; a word that was seen before is neither walked nor decoded again."""
    from lorekeep.llm.queries import tokenizer_path

    own = bpe.WordBpe(tokenizer_path())
    texts = [t or "" for _, t in rows()] + ["", " ", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>", "ÅΣς été 12 3", "x" * 300, "\0"]
    for text in texts:
        ids = own.encode(text)
        assert own.there_and_back(text) == (np.array(ids, "<u4").tobytes(), own.decode(ids))
    known = own.both_ways.cache_info().misses
    decoded, own.decode = own.decode, None
    for text in texts:
        own.there_and_back(text)
    own.decode = decoded
    assert own.both_ways.cache_info().misses == known
