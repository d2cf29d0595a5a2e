"""Classes of near-duplicate texts: a row for each document with its class, never the pairs of a class.

Texts are near when their sets of word ``k``-grams have a Jaccard similarity of ``threshold`` or more; a class is what such links connect,
together with equal content.  Copies stand behind one representative.  MinHash bands propose candidates in buckets.  Every text is first
compared with its buckets' leaders (their least ids), which connects a group of near copies at a cost linear in it.
Only buckets that then still hold several classes are looked at again: texts of different classes in them are
compared exactly, in cells of about ``chunk`` texts, so that no link is lost that shares a bucket (at 0.8 and 32 bands of 4 rows
all but one in 10^7 do); a class met by a few others is not compared with itself.

Defined results: null texts, texts of fewer than ``k`` words and rows without id are classes of their own unless their content is equal;
rows of one id are one document; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import settle, stage
from .components import components
from .dedup import exact, jaccards

BANDS, ROWS, CHUNK, LED = 32, 4, 256, 256
#: Bytes of text that are cut into words at once; ids that are broadcast.
PIECE, SENT = 1 << 23, 1 << 20
U = np.uint64


@lru_cache(1)
def _salts() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(1234))
    return tuple(r.integers(1, 2**63, BANDS * ROWS, dtype=np.int64).astype(U) * U(2) + U(1) for _ in range(2))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(29))


def _words(texts: pa.Array) -> pa.Array:
    """Words, and empty strings at the ends, between runs of ``[\\s\\x0B\\p{Z}]``; Arrow's own splitter, which is faster, also takes five control characters as white space."""
    if pc.any(pc.match_substring_regex(texts, r"[\x1C-\x1F\x{85}]")).as_py():
        return pc.split_pattern_regex(texts, r"[\s\x0B\p{Z}]+")
    return pc.utf8_split_whitespace(texts)


@lru_cache(1)
def _weights() -> np.ndarray:
    """Of each byte: what no normalisation of content drops or changes but in case, which is ASCII's letters and digits and the first bytes of some other letters.

    Lower-casing makes i and k of two characters beyond ASCII, so they have no weight.
    """
    w = np.zeros(256, U)
    for n, same in enumerate([*(x + x.upper() for x in "abcdefghjlmnopqrstuvwxyz"), *"0123456789"]):
        w[list(same.encode())] = _mix(_mix(np.array([n + 1], U)))
    w[[0xD0, 0xD1]] = _mix(_mix(np.array([101], U)))  # U+0400 to U+047F, in pairs of case
    w[[0xE5, 0xE6, 0xE7, 0xE8, 0xEB, 0xEC]] = _mix(_mix(np.array([102], U)))  # U+5000 to U+8FFF and U+B000 to U+CFFF, without case
    return w


def letters(text: pa.Scalar) -> int:
    """A number of the letters and digits of a text, whatever their order and case: texts of equal content have the same."""
    if not text.is_valid:
        return 0
    bytes_ = np.frombuffer(text.as_buffer(), np.uint8)
    n = sum((np.bincount(bytes_[i : i + (1 << 16)], minlength=256) for i in range(0, len(bytes_), 1 << 16)), np.zeros(256, np.int64))
    return int((n.astype(U) * _weights()).sum().view(np.int64))


def gram_sets(texts: pa.Array, k: int):
    """The distinct hashes of each text's word ``k``-grams, sorted; none for shorter texts."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, i = np.cumsum(sizes), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, side="right")))
        cut = _words(pc.utf8_lower(texts[i:j].fill_null("")))
        words, length = cut.flatten().dictionary_encode(), cut.value_lengths().to_numpy(zero_copy_only=False)
        names = words.dictionary.to_numpy(zero_copy_only=False)
        code = words.indices.to_numpy(zero_copy_only=False)
        own = pd.util.hash_array(names, categorize=False).astype(U) if len(names) else np.zeros(0, U)
        real = np.append(names != "", False)[code] if len(names) else np.zeros(0, bool)
        doc = np.repeat(np.arange(j - i), length)[real]
        h = own[code[real]]
        n = len(h) - k + 1
        if n > 0:
            gram = np.zeros(n, U)
            for s in range(k):
                gram = _mix(gram ^ h[s : s + n])
            gram = gram[doc[:n] == doc[k - 1 :]]
        at = np.searchsorted(doc[:n][doc[:n] == doc[k - 1 :]], np.arange(j - i + 1)) if n > 0 else np.zeros(j - i + 1, int)
        for d in range(j - i):
            yield np.unique(gram[at[d] : at[d + 1]]) if at[d + 1] > at[d] else np.zeros(0, U)
        i = j


def bands_of(s: np.ndarray) -> list[int]:
    """A key for each band: its least values under ``ROWS`` random orders."""
    salt, odd = _salts()
    least = np.full(len(salt), np.iinfo(U).max, U)
    for i in range(0, len(s), 1024):
        h = s[None, i : i + 1024] ^ salt[:, None]
        h *= odd[:, None]
        least = np.minimum(least, h.min(1))
    key = np.zeros(BANDS, U)
    for r in range(ROWS):
        key = _mix(key ^ least[r::ROWS])
    return key.view(np.int64).tolist()


def summaries(rows: DataFrame, k: int) -> DataFrame:
    """``id, n, a, b, keys, letters``: the size of each set, 128 bits that stand for it, its band keys, and what texts of equal content have in common."""

    def run(batches):
        for batch in batches:
            n, a, b, keys = [], [], [], []
            for s in gram_sets(batch.column(1), k):
                n.append(len(s))
                a.append(int(s.sum()) & 0xFFFFFFFFFFFFFFFF)
                b.append(int(_mix(s ^ U(0x5851F42D4C957F2D)).sum()) & 0xFFFFFFFFFFFFFFFF)
                keys.append(bands_of(s) if len(s) else [])
            columns = [batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(x, U).view(np.int64)) for x in (a, b)), pa.array(keys, pa.list_(pa.int64())), pa.array([letters(x) for x in batch.column(1)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "a", "b", "keys", "letters"])

    return stage(rows.mapInArrow(run, "id long, n long, a long, b long, keys array<long>, letters long"))


def _equal_content(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v``: texts of equal content.  Only those that have the letters of another text are normalised."""
    several = sets.groupBy("letters").agg((F.min("id") != F.max("id")).alias("several")).filter("several").select("letters")
    asked = settle(sets.select("id", "letters").join(several, "letters", "left_semi").select("id").distinct())
    few = asked.limit(SENT + 1).count() <= SENT
    texts = rows.filter("text is not null").join(F.broadcast(asked) if few else asked, "id", "left_semi")
    return exact(texts, T.content_hash(T.normalise_content(F.col("text"))), "id").select(F.col("original_id").alias("u"), F.col("id").alias("v"))


def _led(pairs: DataFrame, rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """``u, v``: which members (``v``) of a leader (``u``) are near it; a leader's members are dealt to cells, its text goes once to each."""
    counts = pairs.groupBy("u").agg(F.ceil(F.count("*") / LED).cast("int").alias("cells"))
    dealt = pairs.join(counts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("cells")).cast("int").alias("cell"), F.lit(1).alias("member"), F.col("v").alias("id"))
    led = counts.select("u", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("member"), F.col("u").alias("id"))
    met = led.unionByName(dealt).join(rows, "id").select("u", "cell", "member", "id", "text").repartition("u", "cell").sortWithinPartitions("u", "cell", "member")

    def verify(batches):
        here, lead = None, []
        for b in batches:
            u, v = [], []
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            for (head, cell, member, own), s in zip(keys, gram_sets(b.column(4), k), strict=True):
                if (head, cell) != here:
                    here, lead = (head, cell), []
                if not member:
                    lead.append(s)
                elif any(near(x, s, threshold) for x in lead):
                    u.append(head), v.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return settle(met.mapInArrow(verify, "u long, v long"), 8)


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    same = len(np.intersect1d(x, y, assume_unique=True))
    return round(same / (len(x) + len(y) - same), 6) >= threshold


def _rest(met: DataFrame, party: DataFrame, rows: DataFrame, k: int, threshold: float, chunk: int) -> DataFrame:
    """``u, v``: links between the classes (``party``) that leaders have left side by side in some bucket (``met``: id, band, key, head)."""
    joined = settle(met.join(party, "id"))
    mixed = joined.groupBy("band", "key").agg((F.min("party") != F.max("party")).alias("mixed")).filter("mixed").select("band", "key")
    left = settle(joined.join(mixed, ["band", "key"]))
    member = left.groupBy("id", "party").agg(F.min("head").alias("family"))
    size = member.groupBy("family", "party").agg(F.count("*").alias("n"))
    pooled = size.withColumn("own", F.when(F.col("n") > chunk, F.col("party")))  # large classes have cells of their own, small ones share
    parts = pooled.groupBy("family", "own").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("parts"))
    placed = member.join(pooled.select("family", "party", "own"), ["family", "party"])
    same = placed["family"].eqNullSafe(parts["family"]) & placed["own"].eqNullSafe(parts["own"])
    cell = settle(placed.join(parts, same).select("id", placed["party"], F.struct(placed["family"].alias("family"), placed["own"].alias("own"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).alias("cell")))
    seen = settle(left.select("id", "band", "key").join(cell.select("id", "cell"), "id").select("band", "key", "cell").distinct())
    other = seen.select("band", "key", F.col("cell").alias("other"))
    pools = seen.filter("cell.own is null").join(other, ["band", "key"]).filter("other.own is not null or cell <= other")
    several = seen.filter("cell.own is not null").groupBy("band", "key").agg((F.min("cell.own") != F.max("cell.own")).alias("several")).filter("several").select("band", "key")
    large = seen.filter("cell.own is not null").join(several, ["band", "key"]).join(other.filter("other.own is not null"), ["band", "key"]).filter("cell.own < other.own")
    units = settle(pools.select("cell", "other").unionByName(large.select("cell", "other")).distinct())
    sides = units.select(F.struct("cell", "other").alias("unit"), "cell", F.lit(0).alias("side")).unionByName(units.filter("cell <> other").select(F.struct("cell", "other").alias("unit"), F.col("other").alias("cell"), F.lit(1).alias("side")))
    seated = sides.join(cell, "cell").join(rows, "id").select("unit", "side", "party", "text")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, owner = table.column("side").to_numpy(), table.column("party").to_numpy()
        sets = list(gram_sets(pa.concat_arrays(table.column("text").chunks), k))
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if (side == 1).any() else a
        links: set[tuple[int, int]] = set()
        if len(a) and len(b):
            j = jaccards([sets[i] for i in a], [sets[i] for i in b]).round(6)
            for x, y in zip(*np.nonzero((j >= threshold) & (owner[a][:, None] != owner[b][None, :])), strict=True):
                links.add((int(min(owner[a[x]], owner[b[y]])), int(max(owner[a[x]], owner[b[y]]))))
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return seated.groupBy("unit").applyInArrow(compare, "u long, v long")


def classes(docs: DataFrame, threshold: float = 0.8, k: int = 3, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, class_id, class_size`` for every document: the least id of its class, and how many documents are in it."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    sets = summaries(rows, k)
    known = sets.filter("n > 0")
    least = known.groupBy("a", "b").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    equal = known.join(least.filter("copies > 1"), ["a", "b"]).filter("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    content = _equal_content(rows, sets)
    one = known.join(least.select("a", "b", F.col("first").alias("id")), ["a", "b", "id"], "left_semi")
    keyed = one.select("id", F.posexplode("keys").alias("band", "key")).distinct()
    heads = keyed.groupBy("band", "key").agg(F.min("id").alias("head"), F.count("*").alias("m")).filter("m > 1").drop("m")
    met = settle(keyed.join(heads, ["band", "key"]))
    close = _led(settle(met.filter("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v")).distinct()), rows, k, threshold)
    roots = components(close)
    party = met.select("id").distinct().join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("party"))
    links = close.unionByName(_rest(met, party, rows, k, threshold, chunk)).unionByName(equal).unionByName(content)
    root = components(links.distinct())
    found = settle(docs.select(F.col(id_col).alias("doc_id")).join(root, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id")))
    size = found.filter("class_id is not null").groupBy("class_id").agg(F.count("*").alias("class_size"))
    return found.join(size, "class_id", "left").select("doc_id", "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))
