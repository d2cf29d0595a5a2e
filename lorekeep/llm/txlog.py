"""What a log of transactions with savepoints and rollbacks leaves: the fate of every change, and the store's state over time.

The log is dealt to blocks of consecutive records, so that no stream, transaction or key is one task.  In its block a
stream's records are cut at commits and aborts.  Rollbacks are taken in ascending order.  Each ends an interval
that begins at the latest open savepoint, and deletes every surviving change in it
once: pointers to the next surviving record, joined as in union-find, skip what earlier
rollbacks have deleted.  A block cannot know what came before its first commit or abort,
nor what follows its last.  It hands on only what matters to others: savepoints still
open and runs of changes still undecided at its end, rollbacks that reach behind its start, and the first
commit or abort.  ``FAN`` blocks' remainders meet per stream, the same rule decides
what they can, and so on level by level; what the last level leaves open is undone by
the log's end.

Committed changes have an order of their own, by commit and then by place.  Of a key's changes in an epoch the last one counts;
lags per key give what it adds to the number of stored keys and to the sum of their weights.  Lags and
running sums are taken in cells of ``CELL`` epochs; what a cell or block needs from those before it (the
last value of a key, the number of commits, the sums) is carried by the same kind of tree.  No task
gets more than a block, a cell, or ``FAN`` entries of a key or stream, whatever is hot, and
nothing that grows is collected or broadcast.

Defined results: a record without place is none and is left out; records of the same place are ordered by stream, action and
the other columns; null streams are one stream; a change without key is a change of the null key; a change without weight deletes its key; an unknown
or null action raises; an empty log gives empty results.  A transaction that stays open over many blocks costs the
levels above one entry for each block and savepoint.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from ._runtime import partitions_for, tidy

ACTIONS = ("change", "savepoint", "rollback", "commit", "abort")
CHANGE, SAVEPOINT, ROLLBACK, COMMIT, ABORT = range(5)
#: Records of a block; remainders of blocks that meet in a task.
BLOCK, FAN = 1 << 18, 32
#: Epochs that follow each other in one window.
CELL = 1 << 8
OPEN = -1


class Log(NamedTuple):
    """``changes``: every change with its fate; ``commits``: every commit with its number from 0; both by ``pos``, a record's place as one integer."""

    changes: DataFrame
    commits: DataFrame
    blocks: int


def decide(action: list[int], last: bool) -> tuple[list[int], list[bool]]:
    """One stream's consecutive records: for each change the record that decides it (``OPEN``: none here; ``len(action)``: the log's end), and which records the level above needs.

    What stands before the first commit or abort may belong to a transaction that began earlier.
    """
    n = len(action)
    by, up = [OPEN] * n, [False] * n
    alive = [k if a == CHANGE else k + 1 for k, a in enumerate(action)] + [n]  # the next surviving change from here on

    def find(k: int) -> int:
        top = k
        while alive[top] != top and top < n:
            top = alive[top]
        while alive[k] != top and k < top:
            alive[k], k = top, alive[k]
        return top

    def clear(low: int, high: int) -> None:
        """Every surviving change from ``low`` on is decided by ``high``."""
        k = find(low)
        while k < high:
            by[k] = high
            alive[k] = k + 1
            k = find(k + 1)

    begin, started, open_savepoints = 0, False, []
    for k, a in enumerate(action):
        if a == SAVEPOINT:
            open_savepoints.append(k)
        elif a == ROLLBACK:
            if open_savepoints:
                clear(open_savepoints.pop(), k)
            else:
                clear(begin, k)
                up[k] = not started
        elif a in (COMMIT, ABORT):
            clear(begin, k)
            up[k] = not started
            begin, started, open_savepoints = k + 1, True, []
    if last:
        clear(begin, n)
        up = [False] * n
    else:
        for k in open_savepoints:
            up[k] = True
        k = find(begin)
        while k < n:
            up[k] = True
            k = find(k + 1)
    return by, up


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before, and the end."""
    n = len(columns[0])
    new = np.zeros(n + 1, bool)
    new[[0, n]] = True
    for c in columns:
        new[1:n] |= c[1:] != c[:-1]
    return np.flatnonzero(new) if n else np.zeros(1, np.int64)


def read_all(batches) -> pa.Table | None:
    """A task's rows in one table: a block, or the remainders that meet."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def flat(column: pa.Array | pa.ChunkedArray | None, kind: pa.DataType, n: int) -> pa.Array:
    """A column as one array of a type; None: all null."""
    if column is None or n == 0:
        return pa.nulls(n, kind)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.cast(kind)


def codes_of(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values, nulls included."""
    return flat(column, column.type, len(column)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def over_blocks(df: DataFrame, keys: list[str], value: str, blocks: int, how: str) -> DataFrame:
    """``df`` (one row for each of ``keys`` and ``block``) with ``before``: the sum of ``value`` over the key's earlier blocks, or the last of them.

    ``FAN`` blocks meet in a window; their totals are carried in the same way, level by level.
    """
    total, running = (F.sum, F.sum) if how == "sum" else (None, F.last)
    node = F.floor(F.col("block") / FAN)
    earlier = Window.partitionBy(*keys, "node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    here = df.withColumn("node", node).withColumn("_inside", running(value).over(earlier))
    if blocks <= FAN:
        return here.withColumnRenamed("_inside", "before").drop("node")
    sums = here.groupBy(*keys, "node").agg((total(value) if total else F.max_by(value, "block")).alias(value)).withColumnRenamed("node", "block")
    carried = over_blocks(sums, keys, value, -(-blocks // FAN), how).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("block").alias("_node"), F.col("before").alias("_outside"))
    same = F.col("node") == F.col("_node")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = here.join(carried.hint("merge"), same)
    before = F.coalesce("_inside", "_outside") if how != "sum" else F.coalesce("_inside", F.lit(0)) + F.coalesce("_outside", F.lit(0))
    return joined.withColumn("before", before).drop("node", "_inside", "_node", "_outside", *[f"_{k}" for k in keys])


def reassemble(records: DataFrame, place: str = "place", stream: str = "stream", action: str = "action", key: str = "key", weight: str = "weight", block: int = BLOCK) -> Log:
    """Decide every change of a log.

    ``changes`` has ``pos``, ``place``, ``stream``, ``key``, ``weight``, ``fate`` (commit, abort, rollback), and ``by_pos``, ``by_place`` of the record
    that decided it (null: the log's end).  ``commits`` has ``pos``, ``place`` and ``number``, from 0 in log order.
    """
    number = F.lit(None).cast("tinyint")
    for k, a in enumerate(ACTIONS):
        number = F.when(records[action] == a, F.lit(k).cast("tinyint")).otherwise(number)
    checked = F.coalesce(number, F.raise_error(F.concat(F.lit("no such action: "), F.coalesce(records[action].cast("string"), F.lit("null")))).cast("tinyint"))
    plain = records.select(records[place].alias("place"), records[stream].alias("stream"), checked.alias("action"), records[key].alias("key"), records[weight].cast("long").alias("weight"))
    plain = stage(plain.where(F.col("place").isNotNull()))
    blocks = max(plain.sparkSession.sparkContext.defaultParallelism, partitions_for(plain.count(), block, 1))
    ordered = plain.repartitionByRange(blocks, "place").sortWithinPartitions("place", "stream", "action", "key", "weight")
    kinds = {f: plain.schema[f].dataType.simpleString() for f in ("place", "stream", "key")}
    arrow = {f.name: f.type for f in _arrow(plain)}
    schema = f"what tinyint, pos long, place {kinds['place']}, stream {kinds['stream']}, action tinyint, key {kinds['key']}, weight long, fate tinyint, by_pos long, by_place {kinds['place']}, part long"
    names = ["what", "pos", "place", "stream", "action", "key", "weight", "fate", "by_pos", "by_place", "part"]
    types = [pa.int8(), pa.int64(), arrow["place"], arrow["stream"], pa.int8(), arrow["key"], pa.int64(), pa.int8(), pa.int64(), arrow["place"], pa.int64()]

    def rows(what: int, table: pa.Table, at: np.ndarray, by: np.ndarray | None = None, part: np.ndarray | None = None):
        """``what`` 0: a decided change (or run of changes), 1: a commit, 2: for the level above, 3: a member of an undecided run."""
        taken = table.take(pa.array(at))
        fate = by_pos = by_place = None
        if by is not None:
            end = by >= table.num_rows
            safe = pa.array(np.where(end, 0, by), pa.int64(), mask=end)
            fate = pc.fill_null(table.column("action").take(safe), pa.scalar(ABORT, pa.int8()))
            by_pos, by_place = table.column("pos").take(safe), table.column("place").take(safe)
        columns = {n: taken.column(n) for n in taken.schema.names} | {"what": pa.array(np.full(len(at), what, np.int8)), "fate": fate, "by_pos": by_pos, "by_place": by_place, "part": None if part is None else pa.array(part)}
        return pa.RecordBatch.from_arrays([flat(columns.get(n), k, len(at)) for n, k in zip(names, types, strict=True)], names=names)

    def settle_runs(table: pa.Table, bounds: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        action, by, up = table.column("action").to_pylist(), np.full(table.num_rows, OPEN, np.int64), np.zeros(table.num_rows, bool)
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            b, u = decide(action[i:j], last)
            b = np.array(b, np.int64)
            by[i:j] = np.where(b == OPEN, OPEN, np.where(b == j - i, table.num_rows, b + i))
            up[i:j] = u
        return by, up

    def first(batches):
        table = read_all(batches)
        if table is None:
            return
        here = TaskContext.get().partitionId()
        table = table.append_column("pos", pa.array((here << 33) + np.arange(table.num_rows)))
        yield rows(1, table, np.flatnonzero(table.column("action").to_numpy() == COMMIT))
        stream = codes_of(table.column("stream"))
        order = np.argsort(stream, kind="stable")
        table, stream = table.take(pa.array(order)), stream[order]
        by, up = settle_runs(table, runs(stream), False)
        action = table.column("action").to_numpy()
        decided = np.flatnonzero(by != OPEN)
        yield rows(0, table, decided, by[decided])
        # undecided changes between the same brackets share one fate: the first of them stands for the run above
        kept = np.flatnonzero(up)
        a, s = action[kept], stream[kept]
        head = np.ones(len(kept), bool)
        head[1:] = (a[1:] != CHANGE) | (a[:-1] != CHANGE) | (s[1:] != s[:-1])
        yield rows(2, table, kept[head])
        member = a == CHANGE
        leader = table.column("pos").to_numpy()[kept[head]][np.cumsum(head) - 1]
        yield rows(3, table, kept[member], part=leader[member])

    def above(last: bool):
        def run(batches):
            table = read_all(batches)
            if table is None:
                return
            by, up = settle_runs(table, runs(table.column("node").to_numpy(), codes_of(table.column("stream"))), last)
            decided = np.flatnonzero(by != OPEN)
            yield rows(0, table, decided, by[decided])
            yield rows(2, table, np.flatnonzero(up))

        return run

    base = stage(ordered.mapInArrow(tidy(first), schema))
    blocks = max(1, base._jdf.queryExecution().toRdd().getNumPartitions())
    left, nodes, level, decided = base.where("what = 2"), blocks, 0, None
    while True:
        nodes, level = -(-nodes // FAN), level + 1
        width = FAN**level
        tokens = left.select("pos", "place", "stream", "action", "key", "weight", F.floor(F.shiftright("pos", 33) / width).alias("node"))
        met = tokens.repartition(blocks, "node", "stream").sortWithinPartitions("node", "stream", "pos")
        found = stage(met.mapInArrow(tidy(above(nodes == 1)), schema))
        own = found.where("what = 0").select("pos", "fate", "by_pos", "by_place")
        decided = own if decided is None else decided.unionByName(own)
        left = found.where("what = 2")
        if nodes == 1:
            break
    members = base.where("what = 3").select("pos", "place", "stream", "key", "weight", "part")
    later = members.join(decided.select(F.col("pos").alias("part"), "fate", "by_pos", "by_place").hint("merge"), "part").drop("part")
    at_once = base.where("what = 0").select(*later.columns)
    names_of = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("fate").cast("int") + 1)
    changes = at_once.unionByName(later).withColumn("fate", names_of)

    commits = base.where("what = 1").select("pos", "place", F.shiftright("pos", 33).alias("block"))
    counts = commits.groupBy("block").agg(F.count("*").alias("n"))
    before = over_blocks(counts, [], "n", blocks, "sum").select("block", F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("pos")) - 1
    numbered = commits.withColumn("rank", rank).join(before.hint("merge"), "block").select("pos", "place", (F.col("rank") + F.col("before")).cast("long").alias("number"))
    return Log(changes, numbered, blocks)


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def states(log: Log, every: int = 4) -> DataFrame:
    """``epoch, n_keys, weight``: after each ``every`` commits (the last epoch: the rest), how many keys are stored and the sum of their weights."""
    epochs = log.commits.select(F.col("pos").alias("_commit"), (F.floor(F.col("number") / every) + 1).alias("epoch"))
    cells = -(-(log.commits.count() // every + 2) // CELL)
    cell = F.floor(F.col("epoch") / CELL).alias("block")
    zero = F.lit(0).cast("long")
    applied = log.changes.where("fate = 'commit'").join(epochs.hint("merge"), F.col("by_pos") == F.col("_commit"))
    value = F.struct(F.col("weight").isNotNull().cast("long").alias("n"), F.coalesce("weight", zero).alias("w"))
    # what an epoch leaves of a key is its last change: by commit, then by place in the log
    now = stage(applied.groupBy("key", "epoch").agg(F.max_by(value, F.struct("by_pos", "pos")).alias("now")).select("key", "epoch", cell, "now"))
    ends = now.groupBy("key", "block").agg(F.max_by("now", "epoch").alias("now"))
    starts = over_blocks(ends, ["key"], "now", cells, "last").select(F.col("key").alias("_key"), F.col("block").alias("_block"), "before")
    own = F.lag("now").over(Window.partitionBy("key", "block").orderBy("epoch"))
    lagged = now.withColumn("_lag", own).join(starts.hint("merge"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")))
    was = F.coalesce("_lag", "before", F.struct(zero.alias("n"), zero.alias("w")))
    deltas = lagged.select("epoch", (F.col("now.n") - was["n"]).alias("n"), (F.col("now.w") - was["w"]).alias("w"))
    per_epoch = deltas.unionByName(epochs.select("epoch", zero.alias("n"), zero.alias("w"))).groupBy("epoch").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    per_epoch = stage(per_epoch.select("epoch", cell, "n", "w"))
    totals = per_epoch.groupBy("block").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    inside = Window.partitionBy("block").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    out = per_epoch.select("block", "epoch", F.sum("n").over(inside).alias("n"), F.sum("w").over(inside).alias("w"))
    for c in ("n", "w"):
        before = over_blocks(totals.select("block", c), [], c, cells, "sum").select(F.col("block").alias("_block"), "before")
        out = out.join(before.hint("merge"), F.col("block") == F.col("_block")).withColumn(c, F.col(c) + F.coalesce("before", zero)).drop("_block", "before")
    return out.select("epoch", F.col("n").alias("n_keys"), F.col("w").alias("weight"))
