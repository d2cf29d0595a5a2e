"""Breaks along each key's times: one begins where ``gap`` has passed since the last one began.

The rule looks back at its own result.  Keys of up to ``BLOCK`` times are walked in order, each in one task.  A longer
key is cut into blocks of consecutive times.  Within its block every time is followed, in numpy, along "the first time that
is ``gap`` later" to the last one inside; where that leads outside is found by one sorted search of all such ends.  So
a block is a single step, and the blocks that a chain really enters are marked by doubling those steps: after k
rounds a mark reaches 2^k blocks.  Then each block follows its own mark.  A key of any length thus runs on all cores, in a number of
rounds that is the logarithm of its blocks.

Defined results: null times are none; equal times count once; a null key is a key; times are doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

BLOCK = 1 << 18
ROUNDS = 62


def breaks(points: DataFrame, by: str, at: str, gap: float, block: int | None = None) -> DataFrame:
    """``by, place, started``: the breaks of each key, numbered from 0."""
    block = block or BLOCK
    times = points.select(F.col(by).alias("key"), F.col(at).cast("double").alias("t")).filter("t is not null").distinct()
    times = stage(times)
    long_ = stage(times.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block))
    n_long = long_.agg(F.sum("n")).first()[0]
    if not n_long:
        found = _walked(times, gap)
    else:
        keys = long_.select(F.col("key").alias("_key"))
        mine = F.col("key").eqNullSafe(F.col("_key"))
        found = _walked(times.join(keys, mine, "left_anti"), gap).unionByName(_doubled(times.join(keys, mine, "left_semi"), gap, -(-n_long // block) + 1))
    return found.withColumnRenamed("key", by)


def _kind(rows: DataFrame) -> str:
    return rows.schema["key"].dataType.simpleString()


def _runs(keys: pa.Array) -> np.ndarray:
    code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1, [len(code)])) if len(code) else np.zeros(1, np.int64)


def _table(batches) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks)


def _walked(times: DataFrame, gap: float) -> DataFrame:
    """Key by key, in constant memory."""

    def walk(batches):
        key, last, n = object(), 0.0, 0
        for b in batches:
            at, place = [], []
            for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if k != key:
                    key, n = k, -1
                elif t < last + gap:
                    continue
                last, n = t, n + 1
                at.append(i), place.append(n)
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(took), pa.array(place, pa.int64()), b.column(1).take(took)], names=["key", "place", "started"])

    return times.repartition("key").sortWithinPartitions("key", "t").mapInArrow(walk, f"key {_kind(times)}, place long, started double")


def _doubled(times: DataFrame, gap: float, blocks: int) -> DataFrame:
    """Keys that are cut into blocks."""
    kind = _kind(times)

    def ends(batches):
        """For each time of a block, where its chain inside the block needs to go on."""
        table = _table(batches)
        if table is None:
            return
        part, keys, t = TaskContext.get().partitionId(), _column(table, "key"), _column(table, "t").to_numpy()
        need = np.empty(len(t))
        bounds = _runs(keys)
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            own = t[i:j]
            to = np.searchsorted(own, own + gap, "left")
            to = np.where(to == len(own), np.arange(len(own)), np.maximum(to, np.minimum(np.arange(len(own)) + 1, len(own) - 1)))
            while not np.array_equal(to, to[to]):
                to = to[to]
            need[i:j] = np.maximum(own[to] + gap, np.nextafter(own[to], np.inf))  # a time is no break after itself
        yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(t), part, np.int32)), pa.array(t), pa.array(need)], names=["key", "part", "t", "need"])

    points = times.repartitionByRange(blocks, "key", "t").sortWithinPartitions("key", "t")
    points = stage(points.mapInArrow(ends, f"key {kind}, part int, t double, need double"))
    needs = points.select("key", F.col("need").alias("x"), F.lit(0).alias("real")).distinct()
    both = needs.unionByName(points.select("key", F.col("t").alias("x"), F.lit(1).alias("real")))

    def land(batches):
        """The next real time of each need in its block; null if the block has none, which a later block then answers.  Every run tells its first time."""
        table = _table(batches)
        if table is None:
            return
        part, keys, x, real = TaskContext.get().partitionId(), _column(table, "key"), _column(table, "x").to_numpy(), _column(table, "real").to_numpy() == 1
        bounds, rows, firsts = _runs(keys), [], []
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            own, asked = x[i:j][real[i:j]], np.flatnonzero(~real[i:j]) + i
            to = np.searchsorted(own, x[asked], "left")
            rows.append((asked, np.append(own, np.nan)[np.minimum(to, len(own))]))
            firsts.append((i, own[0] if len(own) else np.nan))
        asked, found = np.concatenate([a for a, _ in rows]), np.concatenate([f for _, f in rows])
        at = np.concatenate((asked, [i for i, _ in firsts])).astype(np.int64)
        landed = np.concatenate((found, [f for _, f in firsts]))
        first = np.concatenate((np.zeros(len(asked), bool), np.ones(len(firsts), bool)))
        columns = [keys.take(pa.array(at)), pa.array(np.full(len(at), part, np.int32)), pa.array(x[at]), pa.array(landed, pa.float64(), mask=np.isnan(landed)), pa.array(first)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "part", "need", "land", "first"])

    sought = stage(both.repartitionByRange(blocks, "key", "x").sortWithinPartitions("key", "x", "real").mapInArrow(land, f"key {kind}, part int, need double, land double, first boolean"))
    later = F.min("land").over(Window.partitionBy("key").orderBy("part").rowsBetween(1, Window.unboundedFollowing))  # a row for each block of a key
    after = sought.filter("first").select(F.col("key").alias("_key"), F.col("part").alias("_part"), later.alias("_land"))
    needed = sought.filter("not first").join(after, F.col("key").eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")), "left")
    needed = needed.select(F.col("key").alias("_key"), F.col("need").alias("_need"), F.coalesce("land", "_land").alias("land")).filter("land is not null")
    step = points.join(needed, F.col("key").eqNullSafe(F.col("_key")) & (F.col("need") == F.col("_need"))).select("key", "t", "land")

    marked = stage(points.groupBy("key").agg(F.min("t").alias("t")))
    entered = step.select("key", F.col("land").alias("t")).unionByName(marked).distinct()  # no chain comes into a block anywhere else
    jump = stage(step.join(entered.select(F.col("key").alias("_key"), F.col("t").alias("_t")), F.col("key").eqNullSafe(F.col("_key")) & (F.col("t") == F.col("_t")), "left_semi"))
    for _ in range(ROUNDS):
        to = jump.select(F.col("key").alias("_key"), F.col("t").alias("_t"), F.col("land").alias("_land"))
        new = stage(marked.join(to, F.col("key").eqNullSafe(F.col("_key")) & (F.col("t") == F.col("_t"))).select("key", F.col("_land").alias("t")))
        if new.isEmpty():
            break
        marked = marked.unionByName(new)
        jump = stage(jump.join(to, F.col("key").eqNullSafe(F.col("_key")) & (F.col("land") == F.col("_t"))).select("key", "t", F.col("_land").alias("land")))

    flags = marked.select(F.col("key").alias("_key"), F.col("t").alias("_t"), F.lit(True).alias("_mark")).distinct()
    flagged = points.join(flags, F.col("key").eqNullSafe(F.col("_key")) & (F.col("t") == F.col("_t")), "left").select("key", "part", "t", F.coalesce("_mark", F.lit(False)).alias("mark"))

    def follow(batches):
        table = _table(batches)
        if table is None:
            return
        keys, part, t, mark = _column(table, "key"), _column(table, "part").to_numpy(), _column(table, "t").to_numpy(), _column(table, "mark").to_numpy(zero_copy_only=False)
        bounds = np.union1d(_runs(keys), np.flatnonzero(np.diff(part)) + 1)
        at, rank = [], []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own, begun = t[i:j], np.flatnonzero(mark[i:j])
            k, n = (int(begun[0]) if len(begun) else len(own)), 0
            while k < len(own):
                at.append(i + k), rank.append(n)
                k, n = max(k + 1, int(np.searchsorted(own, own[k] + gap, "left"))), n + 1
        took = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([keys.take(took), pa.array(part).take(took), pa.array(t).take(took), pa.array(rank, pa.int64())], names=["key", "part", "started", "rank"])

    begun = stage(flagged.repartition(blocks, "part").sortWithinPartitions("part", "key", "t").mapInArrow(follow, f"key {kind}, part int, started double, rank long"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = begun.groupBy("key", "part").agg(F.count("*").alias("n")).select(F.col("key").alias("_key"), F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("_before"))
    joined = begun.join(counts, F.col("key").eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")))
    return joined.select("key", (F.col("rank") + F.col("_before")).alias("place"), "started")
