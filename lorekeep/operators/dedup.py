"""Duplicates of documents: exact, near and semantic, each level without the pairs of the one before.

Exact copies are one window over the hash.  Near pairs come from MinHash bands, in whole buckets, and are verified
by exact Jaccard; semantic pairs come from the buckets of random projections and are verified by cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..memory import tidy
from ..staging import settle, stage
from .vector_index import matrix, usable

PRIME = (1 << 31) - 1
PERMUTATIONS, BANDS = 128, 32
CHUNK = 256
#: Sets whose signatures are held at once, and hashes of a set that meet all functions at once.
SIGNED, WIDE = 512, 1024


def _coefficients(n: int, seed: int = 42) -> list[tuple[int, int]]:
    """``n`` pairs below the prime, from a linear congruence started at ``seed``."""
    out, x = [], seed
    for _ in range(n):
        a = x = (x * 48271 + 11) % PRIME
        b = x = (x * 48271 + 11) % PRIME
        out.append((max(1, a), b))
    return out


def exact(docs: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """``id, original_id`` of every copy; the least id of a hash is the original."""
    hashed = docs.select(F.col(id_col).alias("id"), key.alias("h"))
    first = F.min("id").over(Window.partitionBy("h"))
    return hashed.select("id", first.alias("original_id")).filter("id <> original_id")


def _least(sets: pd.Series) -> pd.Series:
    """Least (a h + b) mod p over the hashes of each set, for each of PERMUTATIONS functions; zeros for none."""
    a, b = (np.array(x, np.int64)[:, None] for x in zip(*_coefficients(PERMUTATIONS), strict=True))
    out = []
    for s in sets:
        h = (np.asarray(s, np.int64) & 0x7FFFFFFFFFFFFFFF) % PRIME
        parts = [((a * h[None, i : i + WIDE] + b) % PRIME).min(axis=1) for i in range(0, len(h), WIDE)]
        out.append(np.minimum.reduce(parts) if parts else np.zeros(PERMUTATIONS, np.int64))
    return pd.Series(out)


def signatures(docs: DataFrame, shingles: Column, id_col: str = "doc_id") -> DataFrame:
    """``id_col, sig``: the MinHash signature of each row's set of shingles; zeros without any.  Hashes are expressions, the minima a batched numpy step."""
    kind = dict(docs.dtypes)[id_col]
    hashed = docs.select(id_col, F.transform(F.coalesce(shingles, F.array().cast("array<string>")), lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long")).alias("h"))

    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), SIGNED):
                b = whole.slice(i, SIGNED)
                sets = pd.Series([x.values.to_numpy() for x in b.column(1)], dtype=object)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(_least(sets)), pa.list_(pa.int64()))], names=[id_col, "sig"])

    return hashed.mapInArrow(tidy(run), f"`{id_col}` {kind}, sig array<long>")


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal places; 0 for signatures of different length."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), same / F.size(a)).otherwise(F.lit(0.0))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, original_id`` of the rows that ``near`` leaves out as copies: those whose normalised text has a lesser id."""
    return exact(docs.filter(F.col(text_col).isNotNull()), T.content_hash(T.normalise_content(F.col(text_col))), id_col)


def jaccards(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Jaccard similarity of every set of ``left`` with every set of ``right``; the sets' members are distinct."""
    flat = [np.concatenate(x) for x in (left, right)]
    row = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (left, right)]
    both = np.intersect1d(*flat)
    same = np.zeros((len(left), len(right)))
    code = [np.searchsorted(both, f) for f in flat]
    known = [(c < len(both)) & (both[np.minimum(c, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool) for c, f in zip(code, flat, strict=True)]
    for at in range(0, len(both), width):
        m = []
        for c, k, r, n in zip(code, known, row, (len(left), len(right)), strict=True):
            here = k & (c >= at) & (c < at + width)
            m.append(np.zeros((n, min(width, len(both) - at)), np.float32))
            m[-1][r[here], c[here] - at] = 1
        same += m[0] @ m[1].T
    size = [np.array([len(v) for v in x]) for x in (left, right)]
    return same / (size[0][:, None] + size[1][None, :] - same)


def meetings(keyed: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """``id, cell`` and ``unit, cell, other``: ids that share a bucket (``id, band, key``) are in the two cells of some unit.

    An id's family is the least id of its buckets; families are cut into cells of about ``chunk`` ids, so that a
    hot bucket is many units of a bounded size.
    """
    heads = keyed.groupBy("band", "key").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    met = settle(keyed.join(heads.select("band", "key", "head"), ["band", "key"]))
    family = met.groupBy("id").agg(F.min("head").alias("family"))
    parts = family.groupBy("family").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    cell = settle(family.join(parts, "family").select("id", F.struct("family", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).alias("cell")))
    seen = met.join(cell, "id").select("band", "key", "cell").distinct()
    units = seen.join(seen.select("band", "key", F.col("cell").alias("other")), ["band", "key"]).filter("cell <= other").select("cell", "other").distinct()
    return cell, settle(units.select(F.struct("cell", "other").alias("unit"), "cell", "other"))


def seat(rows: DataFrame, cell: DataFrame, units: DataFrame) -> DataFrame:
    """``unit, side, id, ...``: the rows of both cells of every unit; a cell that meets itself has one side."""
    seated = rows.join(cell, "id")
    left = units.select("unit", "cell", F.lit(0).alias("side")).join(seated, "cell")
    right = units.filter("cell <> other").select("unit", F.col("other").alias("cell"), F.lit(1).alias("side")).join(seated, "cell")
    return left.unionByName(right).drop("cell").withColumn("id", F.col("id").cast("long"))


def near(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, chunk: int = CHUNK) -> DataFrame:
    """``left_id, right_id, jaccard`` of all pairs of distinct texts that share a band's bucket (at 0.8 all but one in 10^7 do).

    Copies are left out beforehand; ``copies`` has them.  A text's family is the least id of its buckets.  Families are
    cut into cells of about ``chunk`` texts, and two cells that meet in a bucket are compared as a whole in one task.
    """
    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).withColumn("h", T.content_hash(T.normalise_content(F.col("t"))))
    least = one.groupBy("h").agg(F.min("id").alias("id"))
    texts = one.join(least, ["h", "id"], "left_semi").select("id", F.transform(T.shingles(F.col("t")), lambda x: F.xxhash64(x)).alias("s")).filter(F.size("s") > 0)
    rows = PERMUTATIONS // bands
    signed = texts.withColumn("sig", F.pandas_udf(_least, "array<long>")("s"))
    keys = F.array(*[F.xxhash64(F.slice("sig", i * rows + 1, rows)) for i in range(bands)])
    texts = stage(signed.select("id", "s", keys.alias("keys")))
    cell, units = meetings(texts.select("id", F.posexplode("keys").alias("band", "key")), chunk)
    dealt = seat(texts.select("id", "s"), cell, units)

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        a = g[g.side == 0]
        b = g[g.side == 1]
        own = not len(b)
        b = a if own else b
        x, y = a.id.to_numpy(), b.id.to_numpy()
        j = jaccards(list(a.s), list(b.s)).round(6)
        i, k = np.nonzero((j >= threshold) & ((x[:, None] < y[None, :]) | (not own)))
        return pd.DataFrame({"left_id": np.minimum(x[i], y[k]), "right_id": np.maximum(x[i], y[k]), "jaccard": j[i, k]})

    return dealt.groupBy("unit").applyInPandas(compare, "left_id long, right_id long, jaccard double")


#: Vectors of a cell: a task compares two cells.  Vectors of both that are compared at once, a multiple of 8 pairs.
CELL, BLOCK = 1 << 14, (256, 512)


def same_vectors(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``id, original_id`` of vectors equal to one with a lesser id, which ``semantic`` leaves out."""
    return exact(vectors.filter(F.col(vec).isNotNull()), F.sha2(F.to_json(vec).cast("binary"), 256), id_col)


def semantic(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec: str = "embedding", chunk: int = CELL) -> DataFrame:
    """``left_id, right_id, cosine`` of all pairs of different vectors whose cosine, rounded to 6 digits, is ``threshold`` or more.

    Exact: cells of about ``chunk`` vectors meet each other, pair by pair of cells, in tasks that read them from the shared folder
    without a shuffle.  Products in single precision, of few dimensions first, choose; those in double precision are reported.  The work is quadratic in the
    different vectors, a task's memory is that of two cells.  Equal vectors are left out beforehand (``same_vectors`` has them);
    vectors without direction are in no pair.
    """
    rows = usable(vectors, id_col, vec).filter(F.exists("v", lambda x: x != 0))
    rows = rows.groupBy(F.sha2(F.to_json("v").cast("binary"), 256).alias("h")).agg(F.min_by("v", "id").alias("v"), F.min("id").cast("long").alias("id")).withColumn("width", F.size("v"))
    rows = stage(rows.select("id", "v", "width"))
    cells = {r["width"]: -(-r["count"] // chunk) for r in rows.groupBy("width").count().collect()}
    number = F.coalesce(*[F.when(F.col("width") == w, F.lit(n)) for w, n in cells.items()], F.lit(1))

    def pack(table: pa.Table) -> pa.Table:
        x = matrix(table.column("v").combine_chunks())
        return pa.table({"width": table.column("width")[:1], "cell": table.column("cell")[:1], "ids": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()), "vs": pa.array([np.ascontiguousarray(x, float).tobytes()], pa.binary())})

    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("id"), number).cast("int"))
    packs = dealt.groupBy("width", "cell").applyInArrow(pack, "width int, cell int, ids binary, vs binary")
    packs = stage(packs.repartition(max(1, sum(cells.values()))))  # about a cell each
    other = packs.select(*(F.col(c).alias(f"other_{c}") for c in packs.columns))
    units = packs.hint("shuffle_replicate_nl").join(other, (F.col("width") == F.col("other_width")) & (F.col("cell") <= F.col("other_cell")))

    def compare(batches):
        for b in batches:
            for i in range(len(b)):
                yield from _alike(*(b.column(c)[i].as_py() for c in range(7)), threshold)

    return units.select("width", "cell", "ids", "vs", "other_cell", "other_ids", "other_vs").mapInArrow(tidy(compare), "left_id long, right_id long, cosine double")


@lru_cache(4)
def _leads(width: int, threshold: float) -> np.ndarray | None:
    """Orthonormal directions of which few unrelated vectors agree so much that their cosine could be ``threshold``; none if that takes most of ``width``."""
    m = np.arange(1, width // 2)
    enough = m[m - (1 - threshold) * width >= 3.5 * np.sqrt(m)]
    return np.linalg.qr(np.random.default_rng(7).standard_normal((width, enough[0])))[0] if len(enough) else None


def _bounding(unit: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Vectors whose products are cosines at least: coordinates along ``leads``, and the length of all that is across."""
    along = unit @ leads
    return np.column_stack((along, np.sqrt(np.maximum(0, 1 - (along * along).sum(1))))).astype(np.float32)


def _alike(width: int, cell: int, ids: bytes, vs: bytes, other: int, other_ids: bytes, other_vs: bytes, threshold: float):
    """The pairs of two cells, a block of both that fits into a core's cache at a time; in a cell that meets itself each pair counts once.

    Products of few dimensions that bound the cosine (Cauchy and Schwarz) choose first, and where they leave much open, those of all
    dimensions; both leave room for single precision.
    """
    x, y = np.frombuffer(ids, np.int64), np.frombuffer(other_ids, np.int64)
    a, b = np.frombuffer(vs, float).reshape(-1, width), np.frombuffer(other_vs, float).reshape(-1, width)
    with np.errstate(all="ignore"):
        units = [m / np.sqrt((m * m).sum(1))[:, None] for m in (a, b)]
    short, other_short = (u.astype(np.float32) for u in units)
    leads = _leads(width, threshold) if all(np.isfinite(u).all() for u in units) else None
    first, other_first = (short, other_short) if leads is None else (_bounding(u, leads) for u in units)
    del units
    least, one = np.float32(threshold - 1e-4), cell == other
    product, flags = np.empty(BLOCK[0] * BLOCK[1], np.float32), np.zeros(BLOCK[0] * BLOCK[1], bool)
    held, n_held = [], 0

    def verified():
        r, c = (np.concatenate(v) for v in zip(*held, strict=True))
        for j in range(0, len(r), 1 << 16):
            p, q = r[j : j + (1 << 16)], c[j : j + (1 << 16)]
            cosine = ((a[p] * b[q]).sum(1) / (np.sqrt((a[p] ** 2).sum(1)) * np.sqrt((b[q] ** 2).sum(1)))).round(6)
            good = cosine >= threshold
            left, right = x[p[good]], y[q[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right)), pa.array(cosine[good])], names=["left_id", "right_id", "cosine"])

    for i in range(0, len(a), BLOCK[0]):
        for j in range(i // BLOCK[1] * BLOCK[1] if one else 0, len(b), BLOCK[1]):
            rows, columns = slice(i, i + BLOCK[0]), slice(j, j + BLOCK[1])
            at, n, wide = _chosen(first[rows], other_first[columns], least, product, flags)
            if leads is not None and len(at) > n // 32:
                at, n, wide = _chosen(short[rows], other_short[columns], least, product, flags)
            if not len(at):
                continue
            r, c = np.divmod(at, wide)
            r, c = r + i, c + j
            if one:
                r, c = r[r < c], c[r < c]
            held.append((r, c))
            n_held += len(r)
            if n_held > 1 << 16:
                yield from verified()
                held, n_held = [], 0
    if n_held:
        yield from verified()


def _chosen(a: np.ndarray, b: np.ndarray, least: np.float32, product: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Places of the products of ``least`` or more, how many products there are, and in how many columns.  Flags are sought eight at a time, since few are set."""
    n = len(a) * len(b)
    out = product[:n].reshape(len(a), len(b))
    np.matmul(a, b.T, out=out)
    with np.errstate(invalid="ignore"):
        np.greater_equal(product[:n], least, out=flags[:n])
    flags[n : -(-n // 8) * 8] = False
    eight = flags[: -(-n // 8) * 8].reshape(-1, 8)
    some = np.flatnonzero(eight.view(np.uint64) != 0)
    if not len(some):
        return some, n, len(b)
    word, bit = np.nonzero(eight[some])
    return some[word] * 8 + bit, n, len(b)
