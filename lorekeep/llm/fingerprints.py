"""Document fingerprints: MinHash signatures, bands joined in Spark, Jaccard verified.

The set of a text is its word 5-shingles (lower-cased; with fewer words the whole
sequence is one shingle).  A signature holds, for each of 128 universal
hash functions ``(a h + b) mod 2^32``, the least value over the set, with all its 32
bits (the high bits alone shrink to zero on long texts); the share of equal places
estimates the Jaccard similarity.

Defined results: null text counts as empty; a text without words has the empty
fingerprint, which is like another empty one (1.0) and like nothing else (0.0);
repeated rows keep one row each; an empty table gives an empty result; only the
id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import pieces, settle, stage, text_buffers, tidy
from ._words import LOWER, SHINGLE, mix, shingles, word_hashes, word_spans
from .components import components
from .jaccard import NULL_ID, cross_links, labels, leader_links, sets_of

PERMUTATIONS = 128
SHINGLE_WORDS = 5
BANDS, BAND_ROWS = 21, 6
_RNG = np.random.Generator(np.random.PCG64(97))
_A = (_RNG.integers(0, 2**31, PERMUTATIONS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_BLOCK = 8192
RANGE_ROWS = 2000
MAX_RANGES = 1 << 16


def minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Least value of each hash function over each document's shingles: (documents, PERMUTATIONS); without shingles all ones."""
    n = len(bounds) - 1
    out = np.full((n, PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _BLOCK, side="right")) - 1)
        lo, hi = int(bounds[i]), int(bounds[j])
        if j == i + 1 and hi - lo > _BLOCK:
            for s in range(lo, hi, _BLOCK):
                part = h[s : min(hi, s + _BLOCK)]
                np.minimum(out[i], (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=out[i])
        elif hi > lo:
            own = np.flatnonzero(np.diff(bounds[i : j + 1])) + i
            values = _A[:, None] * h[None, lo:hi] + _B[:, None]
            out[own] = np.minimum.reduceat(values, bounds[own] - lo, axis=1).T
        i = j
    return out


def _sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[buf]
    starts, ends, bounds = word_spans(low, offsets)
    return shingles(word_hashes(low, starts, ends), bounds, k)


def signatures(texts: pa.Array, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """32-bit signatures (documents, PERMUTATIONS) and whether the document has any shingle."""
    buf, offsets = text_buffers(texts)
    out, some = np.zeros((len(texts), PERMUTATIONS), np.uint32), np.zeros(len(texts), bool)
    for i, j in pieces(offsets, 1 << 20):
        h, bounds = _sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
        some[i:j] = np.diff(bounds) > 0
        out[i:j][some[i:j]] = minima(h, bounds)[some[i:j]]
    return out, some


def _hex(sig: np.ndarray, some: bool) -> str:
    return sig.astype(">u4").tobytes().hex() if some else ""


def _likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    return np.where(some_a & some_b, (a == b).mean(axis=1), (~some_a & ~some_b).astype(float))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint`` (hex, empty for texts without words) for every row."""

    def run(batches):
        for b in batches:
            sig, some = signatures(b.column(1), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_hex(s, x) for s, x in zip(sig, some, strict=True)])], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, fingerprint string")


def _bucketed(texts: DataFrame, k: int) -> DataFrame:
    """Per row: number of shingles, 128 bits that tell sets apart, and a key per band of the signature."""

    def run(batches):
        for b in batches:
            sig, some = signatures(b.column(1), k)
            keys = np.zeros((len(b), BANDS), np.int64)
            for i in range(BANDS):
                rows = sig[:, i * BAND_ROWS : (i + 1) * BAND_ROWS].astype(np.uint64)
                keys[:, i] = (mix(rows @ SHINGLE[:BAND_ROWS]) >> np.uint64(1)).astype(np.int64)
            size, one, two = [], [], []
            for s in sets_of(b.column(1), k):
                size.append(len(s))
                one.append(int(s.sum()) & 0xFFFFFFFFFFFFFFFF)
                two.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()) & 0xFFFFFFFFFFFFFFFF)
            bits = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), *bits, pa.array([x if y else [] for x, y in zip(keys.tolist(), some, strict=True)], pa.list_(pa.int64()))],
                names=["node", "n_shingles", "sig1", "sig2", "bands"],
            )

    return stage(texts.mapInArrow(tidy(run), "node long, n_shingles long, sig1 long, sig2 long, bands array<long>"))


def near_classes(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, class_id`` for every row: the least id that verified near copies reach.

    Signatures are cut into bands whose buckets are joined in Spark; documents that buckets connect are held against each other,
    all of them and not a bucket's first alone, in cells of a bounded size, and a pair counts if its sets' Jaccard similarity is
    ``percent`` or more.  Of pairs at 80 percent all but one in 500 share a bucket.  Equal sets are one class beforehand, so copies
    are not expanded.  Texts without words are a class each; rows that share an id are one; null ids are one, with a null class.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("node"), F.col(text_col).alias("text"))
    rows = _bucketed(texts, k)
    sets = rows.filter("n_shingles > 0")
    least = sets.groupBy("sig1", "sig2").agg(F.min("node").alias("u"))
    copies = sets.join(least, ["sig1", "sig2"]).filter("node <> u").select("u", F.col("node").alias("v")).distinct()
    classes = sets.join(least.select("sig1", "sig2", F.col("u").alias("node")), ["sig1", "sig2", "node"], "left_semi").dropDuplicates(["node", "sig1", "sig2"])
    keyed = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    heads = keyed.groupBy("band", "bucket").agg(F.min("node").alias("u"), F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(heads, ["band", "bucket"]).filter("node <> u").select("u", F.col("node").alias("v")).distinct()
    nodes = classes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    close = leader_links(classes, texts, k, percent).filter("close")
    members = nodes.join(labels(nodes.select("node"), met, "label"), "node").join(labels(nodes.select("node"), close, "party"), "node")
    members = settle(members)
    none = met.select(F.col("u").alias("p"), F.col("v").alias("q")).filter("false")
    far = cross_links(none, members, texts, k, percent)
    near = members.filter("node <> party").select(F.col("party").alias("u"), F.col("node").alias("v"))
    roots = components(copies.unionByName(near).unionByName(far))
    out = rows.select("node").join(roots, "node", "left")
    root = F.coalesce("root", "node")
    return out.select(F.when(F.col("node") != NULL_ID, F.col("node")).alias("doc_id"), F.when(root != NULL_ID, root).alias("class_id"))


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple], texts: list[str], edited: list[str], sigs, k: int) -> pa.RecordBatch:
    sig, some = sigs
    esig, esome = signatures(pa.array(edited, pa.string()), k)
    n = len(rows)
    near_edited = _likeness(sig[:n], esig, some[:n], esome)
    near_next = _likeness(sig[:n], sig[1 : n + 1], some[:n], some[1 : n + 1])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([_hex(s, x) for s, x in zip(sig[:n], some[:n], strict=True)]),
            pa.array([_hex(s, x) for s, x in zip(esig, esome, strict=True)]),
            pa.array(near_edited),
            pa.array(near_next),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """Each text against its edited form and against the next document's text, in ascending ``doc_id`` (null ids first, ties by text).

    The edited form ends in the first quarter-length of the next document.  Documents are dealt once, by ranges of
    the id; a range's first document is copied to the range before it, so that every document meets its successor.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = picked.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    n_ranges = max(8, min(MAX_RANGES, -(-ids["n"] // RANGE_ROWS)))
    cuts = []
    if ids["known"]:
        steps = [i / n_ranges for i in range(1, n_ranges)]
        cuts = sorted(set(picked.agg(F.percentile_approx("doc_id", F.lit(steps), 20 * n_ranges)).first()[0]))
    bounds = np.array(cuts, np.int64)  # at most MAX_RANGES

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(bounds, ids[known].to_numpy().astype(np.int64), side="right")
        return pd.Series(out)

    ranged = picked.withColumn("range", place("doc_id"))
    firsts = ranged.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")).orderBy("range").collect()
    order = [r["range"] for r in firsts]
    copies = [(r["first"]["doc_id"], order[i - 1], int(i == 0)) for i, r in enumerate(firsts)]
    copy_df = F.broadcast(docs.sparkSession.createDataFrame(copies, "first_id long, to_range int, around int"))
    # of rows that share a range's first id the first one goes; the least is found before the shuffle, so a hot id is no large group
    starts = ranged.drop("range").join(copy_df, F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("to_range").agg(F.min(F.struct("doc_id", "text")).alias("x"))
    copied = starts.select("x.doc_id", "x.text", F.col("to_range").alias("range"), F.lit(1).alias("copy"))
    rows = ranged.select("doc_id", "text", "range", F.lit(0).alias("copy")).unionByName(copied)
    dealt = rows.repartition(n_ranges, "range").sortWithinPartitions("range", "copy", "doc_id", "text")

    def run(batches):
        held: list[tuple] = []  # rows of one range whose successor is still to come
        size = 0

        def emit(last: bool):
            nonlocal held, size
            n = len(held) - 1
            if last:  # what follows the last real row is the copied first row of the next range
                n = sum(1 for r in held if not r[3])
                if n and len(held) == n:
                    raise AssertionError("a range without its successor")
                held = held[: n + 1]
            if n > 0:
                texts = [r[1] or "" for r in held]
                edited = []
                for i in range(n):
                    cut = len(texts[i]) // 4
                    edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
                yield _compare(held[:n], texts, edited, signatures(pa.array(texts, pa.string()), k), k)
            held, size = ([] if last else held[n:]), 0

        for b in batches:
            for doc_id, text, rng, copy in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][2] != rng:
                    yield from emit(True)
                held.append((doc_id, text, rng, copy))
                size += len(text or "")
                if size > 1 << 21 and len(held) > 1 and not copy:
                    yield from emit(False)
        if held:
            yield from emit(True)

    return dealt.select("doc_id", "text", "range", "copy").mapInArrow(tidy(run), _EDITED)
