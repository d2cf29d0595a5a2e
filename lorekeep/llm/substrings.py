"""Removal of long passages that occur more than once, by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words.  All equal windows choose the same anchor, the
least of their k-gram hashes, so an anchor deals every occurrence of a window to
the same reference shard.  Per shard, a suffix automaton over the distinct segments,
weighted by how often each occurs, is built and the segments are streamed through
it: where the matching statistic reaches the window length in a state with two
occurrences or more, the window is repeated and its words go.

Broadcasting the automata of all shards to all documents would grow with the square of
the corpus; here each automaton meets just the segments dealt to its shard.
Anchors that occur once cannot carry a repeated window; a bitmap of a fixed size
of the anchors seen twice keeps all other text at home (its false hits cost time,
never results).  The few anchors that occur very often, at most one in 100,000, would make
shards of any size; their windows are dealt one by one, by the hash of all their words,
and equal ones meet without an automaton.  Bitmap and hot anchors are all that is broadcast.

Defined results: null text has no words; texts shorter than the window keep all
words; repeated rows are occurrences of each other; null ids are kept apart by their
text (the id -2**63 stands for them and counts as null); an empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import BLOCKS, Router, records_of
from ._runtime import partitions_for, pieces, text_buffers, tidy
from ._words import SHINGLE, U64, grams, mix, word_hashes, word_spans

WINDOW = 35
ANCHOR_WORDS = 8
BITMAP_BITS = 27
_NULL_ID = -(2**63)
HOT = 2_000
_KEY = np.dtype([("key", "<u8"), ("n", "<u4")])
_WINDOW = np.dtype([("key", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4")])
_REF = np.dtype([("key", "<u8"), ("seg", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4"), ("n", "<i4")])
_HEAD = np.dtype([("key", "<u8"), ("seg", "<u8"), ("n", "<i4")])
_POS_BITS = U64(28)
_LOW = U64((1 << 28) - 1)


def anchors(words: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: the anchor's hash, the first window's start and the number of windows."""
    n = len(words)
    sizes = np.diff(bounds)
    valid = np.zeros(n, bool)
    for lo, hi in zip(bounds[:-1][sizes >= window], bounds[1:][sizes >= window], strict=True):
        valid[lo : hi - window + 1] = True
    if not valid.any():
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = grams(words, k)
    packed = (g & ~_LOW) | np.arange(len(g), dtype=U64)  # the leftmost of equal hashes wins, in every copy alike
    width, span = window - k + 1, 1
    least = packed
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    starts = np.flatnonzero(valid)
    place = (least[starts] & _LOW).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(place) != 0) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(starts)])))
    return g[place[first]], starts[first], count


class Automaton:
    """A suffix automaton of several sequences, each with a weight, that tells how often a substring occurs."""

    def __init__(self, sequences: list[list[int]], weights: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        for seq, weight in zip(sequences, weights, strict=True):
            last = 0
            for c in seq:
                last = self._extend(last, c)
                self.count[last] += weight
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.length)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.count.append(0)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # a sequence before this one went here
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        cur = len(self.length)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.count.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def repeated(self, seq: list[int], window: int) -> list[bool]:
        """For each window of ``seq``, in order: whether it occurs twice or more."""
        out, state, matched = [], 0, 0
        for i, c in enumerate(seq):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                matched += 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if i >= window - 1:
                out.append(matched >= window and self.count[state] >= 2)
        return out


def _hashed(batch: pa.RecordBatch, column: int):
    """Word hashes of consecutive documents: the first document, the hashes and their bounds."""
    buf, offsets = text_buffers(batch.column(column))
    for i, j in pieces(offsets, 1 << 20):
        part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, bounds = word_spans(part, off)
        yield i, word_hashes(part, starts, ends), bounds


def _seen_twice(texts: DataFrame, window: int, k: int, bits: int, n_anchors: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap of the anchors that occur twice or more in the corpus, and those that occur ``hot`` times or more, in order."""
    n_groups = partitions_for(n_anchors, 1_000_000)

    def find(batches):
        router = Router(n_groups)
        for b in batches:
            for _, words, bounds in _hashed(b, 0):
                keys, counts = np.unique(anchors(words, bounds, window, k)[0], return_counts=True)
                rec = np.empty(len(keys), _KEY)
                rec["key"], rec["n"] = keys, counts
                yield from router.add(rec)
        yield from router.flush()

    def twice(table: pa.Table) -> pa.Table:
        rec = np.concatenate([np.frombuffer(x.as_buffer(), _KEY) for x in table.column("block").combine_chunks()])
        order = np.argsort(rec["key"])
        keys, n = rec["key"][order], rec["n"][order].astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, n = keys[new], np.add.reduceat(n, new)
        hit = np.unique((keys[n > 1] >> U64(64 - bits)).astype(np.int64))
        words, which = np.unique(hit >> 6, return_inverse=True)
        value = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(value, which, U64(1) << (hit & 63).astype(U64))
        often = keys[n >= hot].view(np.int64)
        return pa.table(
            {
                "word": pa.array(np.concatenate((words, np.full(len(often), -1))), pa.int64()),
                "bits": pa.array(np.concatenate((value.view(np.int64), np.zeros(len(often), np.int64)))),
                "hot": pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(often, pa.int64())]),
            }
        )

    blocks = texts.select("text").mapInArrow(tidy(find), BLOCKS)
    found = blocks.groupBy("part").applyInArrow(tidy(twice), "word long, bits long, hot long").groupBy("word").agg(F.bit_or("bits").alias("bits"), F.collect_set("hot").alias("hot"))
    packed = found.toArrow()  # at most 2 ** (bits - 6) rows and n_anchors / hot hot anchors
    word, value = packed.column("word").to_numpy(), packed.column("bits").to_numpy().view(np.uint64)
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[word[word >= 0]] = value[word >= 0]
    often = [x for s in packed.column("hot").to_pylist() for x in s]
    return out, np.sort(np.array(often, np.int64).view(np.uint64))


def _windows(words: np.ndarray, start: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some runs: the run of each, where it starts, and the hash of its words."""
    run = np.repeat(np.arange(len(start)), count)
    at = start[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    h = np.full(len(at), U64(window))
    for j in range(window):
        h += words[at + j] * SHINGLE[j]
    return run, at, mix(h)


def _emit(part: np.ndarray, kind: int, blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(np.full(len(blocks), kind, np.int32)), pa.array(blocks, pa.large_binary()).cast(pa.binary())],
        names=["part", "kind", "block"],
    )


class _Segments:
    """Segments on their way to their shards: each content once per flush, and a reference for each place."""

    def __init__(self, n_groups: int):
        self.n_groups, self.size = n_groups, 0
        self.refs: list[np.ndarray] = []
        self.heads: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self.seen: set[tuple[int, int]] = set()

    def add(self, refs: np.ndarray, words: list[np.ndarray]):
        self.refs.append(refs)
        fresh = []
        for i, (key, seg) in enumerate(zip(refs["key"].tolist(), refs["seg"].tolist(), strict=True)):
            if (key, seg) not in self.seen:
                self.seen.add((key, seg))
                fresh.append(i)
        head = np.empty(len(fresh), _HEAD)
        head["key"], head["seg"] = refs["key"][fresh], refs["seg"][fresh]
        head["n"] = [len(words[i]) for i in fresh]
        self.heads.append(head)
        self.words += [words[i] for i in fresh]
        self.size += int(head["n"].sum()) + len(refs)
        if self.size > 1 << 21:
            yield from self.flush()

    def flush(self):
        if not self.refs:
            return
        refs, heads = np.concatenate(self.refs), np.concatenate(self.heads)
        for kind, rec in ((0, refs), (1, heads)):
            part = ((rec["key"] >> U64(17)) % U64(self.n_groups)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            groups = np.split(order, cuts) if len(order) else []
            blocks = []
            for own in groups:
                block = rec[own].tobytes()
                if kind:
                    flat = np.concatenate([self.words[i] for i in own])
                    block = len(own).to_bytes(8, "little") + block + np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                blocks.append(block)
            if blocks:
                yield _emit(np.array([part[own[0]] for own in groups], np.int32), kind, blocks)
        self.refs, self.heads, self.words, self.seen, self.size = [], [], [], set(), 0


def _contents(block: bytes):
    n = int.from_bytes(block[:8], "little")
    heads = np.frombuffer(block, _HEAD, n, 8)
    raw = np.frombuffer(block, np.uint8, offset=8 + n * _HEAD.itemsize).reshape(-1, 6)
    at = 0
    for key, seg, size in zip(heads["key"].tolist(), heads["seg"].tolist(), heads["n"].tolist(), strict=True):
        yield key, seg, raw[at : at + size]
        at += size


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, row, spans`` of the rows with repeated windows: word ranges ``(from, to)``, ``to`` exclusive; ``row`` hashes id and text."""
    texts = _rows(docs, id_col, text_col)
    bits = BITMAP_BITS
    # an anchor stands for some 14 words; a wrong guess only makes groups larger or smaller
    n_anchors = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 33
    bitmap = texts.sparkSession.sparkContext.broadcast(_seen_twice(texts, window, k, bits, n_anchors, max(hot, n_anchors // 100_000)))  # 2 ** (bits - 3) bytes, 100,000 anchors
    n_groups = partitions_for(n_anchors, 100_000)  # small groups, several a task, are dealt evenly

    def send(batches):
        (marked, often), out = bitmap.value, _Segments(n_groups)
        single = Router(n_groups, kind=2)
        for b in batches:
            ids = b.column(0).fill_null(_NULL_ID).to_numpy()
            rows = b.column(1).to_numpy()
            for first, words, bounds in _hashed(b, 2):
                key, start, count = anchors(words, bounds, window, k)
                place = (key >> U64(64 - bits)).astype(np.int64)
                hit = np.flatnonzero((marked[place >> 6] >> (place & 63).astype(U64)) & U64(1))
                if len(often) and len(hit):
                    found = np.minimum(np.searchsorted(often, key[hit]), len(often) - 1)
                    heavy = often[found] == key[hit]
                    _, at, h = _windows(words, start[hit[heavy]], count[hit[heavy]], window)
                    hit = hit[~heavy]
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    own = np.empty(len(at), _WINDOW)
                    own["key"], own["doc"], own["row"], own["start"] = h, ids[first + doc], rows[first + doc], at - bounds[doc]
                    yield from single.add(own)
                if not len(hit):
                    continue
                doc = np.searchsorted(bounds, start[hit], side="right") - 1
                refs = np.empty(len(hit), _REF)
                refs["key"], refs["doc"], refs["row"] = key[hit], ids[first + doc], rows[first + doc]
                refs["start"], refs["n"] = start[hit] - bounds[doc], count[hit]
                pieces_ = [words[s : s + c + window - 1] for s, c in zip(start[hit], count[hit], strict=True)]
                refs["seg"] = [_digest(w) for w in pieces_]
                yield from out.add(refs, pieces_)
        yield from out.flush()
        yield from single.flush()

    def shard(table: pa.Table) -> pa.Table:
        refs, contents = [], {}
        for kind, block in zip(table.column("kind").to_pylist(), table.column("block").combine_chunks(), strict=True):
            if kind == 0:
                refs.append(np.frombuffer(block.as_buffer(), _REF))
            elif kind == 1:
                for key, seg, raw in _contents(block.as_py()):
                    contents.setdefault((key, seg), raw)
        rec = np.concatenate(refs) if refs else np.zeros(0, _REF)
        rec = rec[np.lexsort((rec["seg"], rec["key"]))]
        new_key = np.flatnonzero(np.concatenate((np.ones(min(1, len(rec)), bool), rec["key"][1:] != rec["key"][:-1])))
        ends = np.concatenate((new_key[1:], [len(rec)])) if len(rec) else new_key
        alone = records_of(table, _WINDOW, 2)
        _, which, seen = np.unique(alone["key"], return_inverse=True, return_counts=True)
        alone = alone[seen[which] > 1]
        doc, row, lo, hi = [alone["doc"]], [alone["row"]], [alone["start"].astype(np.int64)], [alone["start"].astype(np.int64) + window]
        for a, z in zip(new_key.tolist(), ends.tolist(), strict=True):
            own = rec[a:z]
            if z - a == 1 and own["n"][0] == 1:
                continue
            cut = np.flatnonzero(np.concatenate(([True], own["seg"][1:] != own["seg"][:-1]))).tolist()
            times = np.diff([*cut, z - a]).tolist()
            if len(cut) == 1 and times[0] > 1:
                flags = [None]
            else:
                key = int(own["key"][0])
                seqs = []
                for c in cut:
                    raw = contents[key, int(own["seg"][c])]
                    wide = np.zeros((len(raw), 8), np.uint8)
                    wide[:, :6] = raw
                    seqs.append(wide.view("<u8").ravel().tolist())
                auto = Automaton(seqs, times)
                flags = [None if t > 1 else auto.repeated(s, window) for s, t in zip(seqs, times, strict=True)]
            for c, t, flag in zip(cut, times, flags, strict=True):
                group = own[c : c + t]
                if flag is None:
                    runs = [(0, int(group["n"][0]))]
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.array(flag, np.int8), [0])))).reshape(-1, 2)
                    runs = [(int(x), int(y)) for x, y in edge]
                for x, y in runs:
                    doc.append(group["doc"])
                    row.append(group["row"])
                    lo.append(group["start"] + x)
                    hi.append(group["start"] + y + window - 1)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, row, lo, hi)]
        return pa.table({"doc": pa.array(flat[0], pa.int64()), "row": pa.array(flat[1], pa.int64()), "lo": pa.array(flat[2].astype(np.int32)), "hi": pa.array(flat[3].astype(np.int32))})

    blocks = texts.select("doc_id", "row", "text").mapInArrow(tidy(send), BLOCKS)
    found = blocks.groupBy("part").applyInArrow(tidy(shard), "doc long, row long, lo int, hi int")
    spans = found.groupBy("doc", "row").agg(F.collect_list(F.struct(F.col("lo").alias("from"), F.col("hi").alias("to"))).alias("spans"))
    return spans.select(F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias("doc_id"), "row", "spans")


def _digest(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))


def remove_repeated(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row; ``kept`` holds the words that stay, joined by one space."""
    spans = repeated_spans(docs, window, k, id_col, text_col, hot).withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    texts = _rows(docs, id_col, text_col)
    joined = texts.join(spans, (texts["row"] == F.col("_row")) & texts["doc_id"].eqNullSafe(F.col("_doc")), "left")

    def cut(batches):
        for b in batches:
            total, gone, kept = [], [], []
            for text, spans_ in zip(b.column(1), b.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                if spans_.is_valid:
                    stay = np.ones(len(words), bool)
                    for s in spans_.as_py():
                        stay[s["from"] : s["to"]] = False
                    words = [w for w, x in zip(words, stay.tolist(), strict=True) if x]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.select("doc_id", "text", "spans").mapInArrow(tidy(cut), "doc_id long, n_words long, n_removed long, kept string")
