"""Packing: every id of the library's in exactly one piece, windows gapless, nothing padded."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.llm import packing, queries

SCHEMA = "doc_id long, text string, node int, ids string, start string, length int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def texts():
    r = random.Random(3)
    odd = [None, "", " \t\n", "It's <|endoftext|> DON'T <|STARTOFTEXT|>x", "é É ÉÀ İstanbul Σίσυφος ΣΑΣ", "a b c\x85d \x00 \x01x", "日本語 テキスト 123 ４５", "x" * 5000, "same text", "same text"]
    for i in range(300):
        odd.append(" ".join(f"w{r.randint(0, 3000)}{r.choice(['', ',', '.', '’s', 'Ü'])}" for _ in range(int(r.paretovariate(0.7) * 8) % 3000)))
    return odd + [" ".join(f"t{k}" for k in range(9000))]


def check(pieces, data, library, size):
    """``pieces``: rows; ``data``: (id, text) in order; repeated or null ids are matched by their ids' contents."""
    want = defaultdict(list)
    for i, t in data:
        want[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    per_window, per_doc = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert r.length == len(r.ids) > 0
        per_window[r.sequence_id].append((r.offset, r.length))
        per_doc[r.doc_id].append(r)
    for own in per_window.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1])
    totals = [sum(n for _, n in own) for own in per_window.values()]
    assert all(n <= size and n & (n - 1) == 0 for n in totals)  # each is full or a power of two
    assert sum(n != size for n in totals) <= size.bit_length()
    assert set(per_doc) == set(want)
    for i, whole in want.items():
        assert sum(r.length for r in per_doc[i]) == sum(map(len, whole))
        if len(whole) == 1:
            own = sorted(per_doc[i], key=lambda r: r.start)
            assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
            assert [x for r in own for x in r.ids] == whole[0] and {r.doc_tokens for r in own} == {len(whole[0])}
        else:
            assert {r.doc_tokens for r in per_doc[i]} == {len(w) for w in whole}


@pytest.mark.parametrize(("size", "windows", "parts"), [(64, 4, 3), (2048, 64, 2), (256, 1, 40), (128, 8, 70)])
def test_every_token_once(spark, library, size, windows, parts):
    data = [(k if k % 50 else 7 if k else None, t) for k, t in enumerate(texts())]
    frame = spark.createDataFrame([(i, t, 1, "a", "b", 2) for i, t in data], SCHEMA).repartition(parts)
    check(packing.pack(frame, queries.tokenizer_path(), size=size, open_windows=windows).collect(), data, library, size)


def test_empty_and_one_document(spark, library):
    path = queries.tokenizer_path()
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).collect() == []
    one = packing.pack(spark.createDataFrame([(5, None, 1, "", "", 1)], SCHEMA), path).collect()
    assert [(r.doc_id, r.start, r.length, r.ids, r.doc_tokens, r.offset) for r in one] == [(5, 0, 1, [1], 1, 0)]
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(spark.createDataFrame([], SCHEMA), path, size=1000)


def test_words_are_the_library_s(library):
    words, data = packing.Words(queries.tokenizer_path()), texts() + ["Σ’s ΑΣ \x85x", "a\u2028b", "<|x <|endoftext|>y"]
    for _ in range(2):  # the second time from the table
        ids, at = words.encode(pa.array([t or "" for t in data]))
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(data))] == [library.encode(t or "", add_special_tokens=False).ids for t in data]


def test_best_fit_and_few_cuts():
    packer = packing.Packer(10, 2, 0)
    for n in (6, 3, 7, 4):  # 6+3 | 7 | 4 fits nowhere: the fullest (9) is topped up with 1, 3 go with 7
        packer.place([("d", n, 0, np.zeros(n, np.int32))], n)
    assert [[len(p[3]) for p in own] for _, own in packer.full] == [[6, 3, 1], [7, 3]] and not packer.windows


def test_query(spark, library):
    got = queries.op12_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    seen = defaultdict(int)
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        seen[r.doc_id] += r.length
    assert seen == {i: len(w) for i, w in want.items()}
