"""Product codes for vectors: one codebook for each part position, trained by Lloyd's rounds that rescan only what may have changed.

Vectors become integers, ``floor(scale * x)``, and stand in blocks, one row of a
table each.  A block keeps a heap for every part position and entry, holding its
rows whose part is assigned to that entry.  A key is the lower bound of the distance
to any other entry minus the upper bound of the distance to its own, plus the
entry's drift so far when it was pushed.  After each round the driver, which knows
the codebooks (a fixed number of integers), adds to every entry's drift how far it
moved plus how far the others moved at most.  The next pass pops the parts whose key
the drift has reached, measures these against all entries exactly, in integers,
and pushes them again; all other parts keep their entry without being looked at.
Keys are rounded down and drifts up, so that a tie is always measured.  What
a pass hands on are the changes of sums and counts, one list per task.

Defined results: rows whose vector is null, holds a null or a component that is not
finite are left out, as are vectors of another length than the most frequent one (the longest
of several); a null id sorts last; repeated rows are rows of their own; with
fewer rows than entries there are as many entries as rows; an empty table gives no rows
and no codebooks.  A length that the number of parts does not divide, or components
so large that a squared distance leaves 64 bits, raise.  Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import written
from ._runtime import tidy

#: Rows whose distances are measured at once.
STEP = 1 << 13
ROW = np.uint64(0xFFFFFFFF)


class Codes(NamedTuple):
    """``rows``: the carried columns, ``codes`` (an entry for each part position) and ``error``; ``codebooks[part][entry]``: integers."""

    rows: DataFrame
    codebooks: list[list[list[int]]]


def key_bits(keys: np.ndarray) -> np.ndarray:
    """Non-negative numbers as unsigned integers of the same order, rounded down."""
    low = np.maximum(keys, 0).astype(np.float32)
    low = np.where(low > keys, np.nextafter(low, np.float32(-np.inf)), low)
    return np.maximum(low, np.float32(0)).astype(np.float32).view(np.uint32).astype(np.uint64)


def limit_bits(drift: float) -> int:
    """The greatest heap entry whose key may be at or under ``drift``."""
    high = np.float32(drift)
    if high < drift:
        high = np.nextafter(high, np.float32(np.inf))
    return int(high.view(np.uint32)) << 32 | int(ROW)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row (the lowest of several), its squared distance, and the next entry's."""
    entry, first, second = (np.empty(len(x), np.int64) for _ in range(3))
    for i in range(0, len(x), STEP):
        d = ((x[i : i + STEP, None, :].astype(np.int64) - book[None]) ** 2).sum(2)
        at = np.arange(len(d))
        entry[i : i + STEP] = e = d.argmin(1)
        first[i : i + STEP] = d[at, e]
        d[at, e] = np.iinfo(np.int64).max
        second[i : i + STEP] = d.min(1)
    return entry, first, second


class Heaps:
    """The heaps of one block, for every part position and entry; entries are ``key bits << 32 | row``."""

    def __init__(self, parts: int, entries: int, cuts: np.ndarray | None = None, data: np.ndarray | None = None):
        self.parts, self.entries = parts, entries
        self.cuts = np.zeros(parts * entries + 1, np.int64) if cuts is None else cuts
        self.data = np.zeros(0, np.uint64) if data is None else data

    def heap(self, part: int, entry: int) -> np.ndarray:
        h = part * self.entries + entry
        return self.data[self.cuts[h] : self.cuts[h + 1]]

    def replace(self, heaps: list[np.ndarray]) -> None:
        self.cuts = np.concatenate(([0], np.cumsum([len(h) for h in heaps])))
        self.data = np.concatenate(heaps) if heaps else np.zeros(0, np.uint64)

    def rows(self, part: int) -> np.ndarray:
        """The entry of every row at this position."""
        sizes = np.diff(self.cuts[part * self.entries : (part + 1) * self.entries + 1])
        out = np.empty(int(sizes.sum()), np.int64)
        span = self.data[self.cuts[part * self.entries] : self.cuts[(part + 1) * self.entries]]
        out[(span & ROW).astype(np.int64)] = np.repeat(np.arange(self.entries), sizes)
        return out


def pop_violated(heap: np.ndarray, limit: int) -> tuple[list[int] | None, list[int]]:
    """What is left of a heap (None: it was not touched) and the rows that were popped from it."""
    if not len(heap) or int(heap[0]) > limit:
        return None, []
    left, popped = heap.tolist(), []
    while left and left[0] <= limit:
        popped.append(heapq.heappop(left) & 0xFFFFFFFF)
    return left, popped


def push_all(left: list[int], new: list[int]) -> list[int]:
    """``left`` with ``new`` pushed: one by one, or at once where that is less work."""
    if 4 * len(new) > len(left):
        left += new
        heapq.heapify(left)
    else:
        for v in new:
            heapq.heappush(left, v)
    return left


def one_pass(x: np.ndarray, heaps: Heaps, books: np.ndarray, drift: np.ndarray, moved: np.ndarray, fresh: bool) -> int:
    """Bring a block's heaps up to date with the codebooks; ``moved`` gets the change of sums and counts.  How many parts were measured."""
    n_parts, n_entries, out, looked_at = heaps.parts, heaps.entries, [], 0
    for p in range(n_parts):
        left: list[list[int] | None] = [[] for _ in range(n_entries)] if fresh else []
        rows, old = np.arange(len(x)), np.full(len(x), -1)
        if not fresh:
            popped = []
            for e in range(n_entries):
                rest, taken = pop_violated(heaps.heap(p, e), limit_bits(drift[p, e]))
                left.append(rest)
                popped.append(taken)
            rows = np.array([r for t in popped for r in t], np.int64)
            old = np.repeat(np.arange(n_entries), [len(t) for t in popped])
        looked_at += len(rows)
        part = x[rows, p]
        entry, first, second = nearest(part, books[p])
        upper, lower = np.sqrt(first.astype(np.float64)), np.sqrt(second.astype(np.float64))
        if n_entries == 1:
            lower[:] = np.inf
        since = drift[p][entry]
        keys = key_bits(lower - upper + since - 1e-9 * (1 + np.where(np.isinf(lower), 0, lower) + upper + since))
        packed = keys << np.uint64(32) | rows.astype(np.uint64)
        gone = entry != old
        values = np.column_stack((part[gone].astype(np.int64), np.ones(int(gone.sum()), np.int64)))
        np.add.at(moved[p], entry[gone], values)
        if not fresh:
            np.subtract.at(moved[p], old[gone], values)
        order = np.argsort(entry, kind="stable")
        to = np.searchsorted(entry[order], np.arange(n_entries + 1))
        for e in range(n_entries):
            new = packed[order[to[e] : to[e + 1]]]
            if left[e] is None and not len(new):
                out.append(heaps.heap(p, e))
            else:
                rest = heaps.heap(p, e).tolist() if left[e] is None else left[e]
                out.append(np.array(push_all(rest, new.tolist()), np.uint64))
    heaps.replace(out)
    return looked_at


def errors(x: np.ndarray, heaps: Heaps, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column for each part position) and squared distances summed over the parts."""
    codes = np.column_stack([heaps.rows(p) for p in range(heaps.parts)])
    error = np.zeros(len(x), np.int64)
    for p in range(heaps.parts):
        error += ((x[:, p].astype(np.int64) - books[p][codes[:, p]]) ** 2).sum(1)
    return codes, error


def integers(values: np.ndarray, parts: int, n: int) -> np.ndarray:
    """``n`` vectors as ``row, part, component`` in the narrowest type that holds them."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return values.astype(kind).reshape(n, parts, -1)


def encode(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    carry: tuple[str, ...] = (),
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> Codes:
    """Codes of every vector under codebooks trained on all of them; each starts as that part of the vectors with the ``entries`` smallest ids."""
    if rounds < 1:
        raise ValueError("rounds must be 1 or more")
    columns = (id_col, *carry)
    named = vectors.select(*[vectors[c].alias(f"c{k}") for k, c in enumerate(columns)], vectors[vector_col].alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = named.where(F.col("v").isNotNull() & finite)
    lengths = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    schema = T.StructType([T.StructField(c, vectors.schema[c].dataType) for c in columns] + [T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    if not lengths:
        return Codes(vectors.sparkSession.createDataFrame([], schema), [])
    width = lengths[0]["n"]
    if width % parts:
        raise ValueError(f"{parts} equal parts cannot be cut from {width} components")
    most = math.isqrt(2**61 // max(1, width))
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall("v", lambda x: F.abs(x.cast("double")) * scale < most)
    ints = kept.where(F.size("v") == width).withColumn("v", F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"{vector_col}: a component is beyond {most / scale:g}"))))
    seeds = [r["v"] for r in ints.select("c0", "v").orderBy(F.asc_nulls_last("c0"), "v").limit(entries).collect()]
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    n_entries, part_width = books.shape[1:]

    carried = [T.StructField(f"c{k}", T.ArrayType(vectors.schema[c].dataType)) for k, c in enumerate(columns)]
    state = T.StructType([*carried, *(T.StructField(n, T.BinaryType()) for n in ("vectors", "heaps")), T.StructField("bytes", T.IntegerType()), T.StructField("cuts", T.ArrayType(T.LongType())), T.StructField("moved", T.ArrayType(T.LongType()))])

    def block_row(arrays: list, x: np.ndarray, heaps: Heaps) -> dict:
        return {**{f"c{k}": a for k, a in enumerate(arrays)}, "vectors": x.tobytes(), "heaps": heaps.data.tobytes(), "bytes": x.dtype.itemsize, "cuts": heaps.cuts.tolist()}

    def blocks_of(batch: pa.RecordBatch):
        """Each block of a batch of the state: its carried columns, vectors and heaps."""
        for i in range(len(batch)):
            row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
            x = np.frombuffer(row["vectors"].as_buffer(), np.dtype(f"i{row['bytes'].as_py()}")).reshape(-1, parts, part_width)
            yield [row[f"c{k}"] for k in range(len(columns))], x, Heaps(parts, n_entries, np.array(row["cuts"].values, np.int64), np.frombuffer(row["heaps"].as_buffer(), np.uint64))

    def out_batch(rows: list[dict], types: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in types], schema=types)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_state = to_arrow_schema(state)

    def first(books, drift):
        def run(batches):
            moved = np.zeros((parts, n_entries, part_width + 1), np.int64)
            for b in batches:
                if len(b):
                    flat = b.column(len(columns)).flatten().to_numpy(zero_copy_only=False)
                    x, heaps = integers(flat, parts, len(b)), Heaps(parts, n_entries)
                    one_pass(x, heaps, books, drift, moved, True)
                    yield out_batch([block_row([b.column(k).to_pylist() for k in range(len(columns))], x, heaps)], arrow_state)
            yield out_batch([{"moved": moved.ravel().tolist()}], arrow_state)

        return run

    def next_pass(books, drift):
        def run(batches):
            moved = np.zeros((parts, n_entries, part_width + 1), np.int64)
            for b in batches:
                for arrays, x, heaps in blocks_of(b):
                    one_pass(x, heaps, books, drift, moved, False)
                    yield out_batch([block_row([a.as_py() for a in arrays], x, heaps)], arrow_state)
            yield out_batch([{"moved": moved.ravel().tolist()}], arrow_state)

        return run

    arrow_rows = to_arrow_schema(T.StructType([T.StructField(f"c{k}", vectors.schema[c].dataType) for k, c in enumerate(columns)] + schema.fields[-2:]))

    def last(books, drift):
        def run(batches):
            unused = np.zeros((parts, n_entries, part_width + 1), np.int64)
            for b in batches:
                for arrays, x, heaps in blocks_of(b):
                    one_pass(x, heaps, books, drift, unused, False)
                    codes, error = errors(x, heaps, books)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts), pa.int32()), pa.array(codes.ravel(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(a.values.cast(arrow_rows.field(k).type) for k, a in enumerate(arrays)), lists, pa.array(error)], schema=arrow_rows)

        return run

    drift = np.zeros((parts, n_entries))
    total = np.zeros((parts, n_entries, part_width + 1), dtype=object)
    table, drop = None, None
    for k in range(rounds):
        source = ints if k == 0 else table.where(F.col("vectors").isNotNull()).drop("moved")
        table, before = source.mapInArrow(tidy((first if k == 0 else next_pass)(books, drift)), state), drop
        table, drop = written(table)
        if before:
            before()
        sums = table.where(F.col("moved").isNotNull()).select(F.posexplode("moved").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        change = np.zeros(total.size, dtype=object)
        for r in sums:
            change[r["at"]] = r["x"]
        total = total + change.reshape(total.shape)
        new = books.copy()
        for p, e in np.ndindex(parts, n_entries):
            if total[p, e, -1]:
                new[p, e] = [int(s) // int(total[p, e, -1]) for s in total[p, e, :-1]]
        step = np.sqrt(((new - books) ** 2).sum(2).astype(np.float64))
        books = new
        if not step.any():
            break  # every later round would leave all as it is
        for p in range(parts):
            for e in range(n_entries):
                drift[p, e] += (step[p, e] + max(np.delete(step[p], e), default=0.0)) * (1 + 1e-9)
    final = table.where(F.col("vectors").isNotNull()).drop("moved").mapInArrow(tidy(last(books, drift)), T.StructType([T.StructField(f"c{k}", vectors.schema[c].dataType) for k, c in enumerate(columns)] + schema.fields[-2:]))
    rows, _ = written(final)
    drop()
    return Codes(rows.toDF(*columns, "codes", "error"), books.tolist())


def with_group_error(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``group_error``, the error summed over equal values of ``by`` (nulls together)."""
    sums = rows.groupBy(F.col(by).alias("_by")).agg(F.sum("error").alias("group_error"))
    return rows.join(sums, rows[by].eqNullSafe(sums["_by"])).drop("_by")
