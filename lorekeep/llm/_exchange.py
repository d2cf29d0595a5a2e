"""Moving numpy records between map and reduce tasks as packed blocks.

A map task groups its records by ``key mod n_groups`` and emits one binary
block per group; a reduce task gets all blocks of one group.  ``n_groups``
grows with the data, so that a group stays at a bounded number of records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import tidy

BLOCKS = "part int, kind int, block binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])


class Router:
    """Collects structured records and hands them out as blocks, ``flush_at`` records at a time; groups are numbered from ``first``."""

    def __init__(self, n_groups: int, kind: int = 0, flush_at: int = 1 << 20, first: int = 0):
        self.n, self.kind, self.flush_at, self.first = n_groups, kind, flush_at, first
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``records`` has a field ``key`` of type uint64."""
        self.held.append(records)
        self.size += len(records)
        if self.size >= self.flush_at:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        rec = np.concatenate(self.held)
        self.held, self.size = [], 0
        part = ((rec["key"] >> np.uint64(17)) % np.uint64(self.n)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        rec, part = rec[order], part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        lo, hi = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(part)]))
        blocks = [rec[i:j].tobytes() for i, j in zip(lo, hi, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[lo] + self.first, pa.int32()), pa.array(np.full(len(lo), self.kind, np.int32)), pa.array(blocks, pa.binary())],
            schema=_SCHEMA,
        )


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed planes of their bytes: a plane whose bytes are alike takes next to no room."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)
    return np.int32(len(columns[0])).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(block: bytes, *types: str) -> list[np.ndarray]:
    """The columns of ``pack``, which had these types."""
    n, sizes = int(np.frombuffer(block, np.int32, 1)[0]), [np.dtype(t).itemsize for t in types]
    if not n:
        return [np.zeros(0, t) for t in types]
    planes = np.frombuffer(pa.decompress(block[4:], n * sum(sizes), codec="zstd"), np.uint8).reshape(-1, n)
    ends = np.cumsum(sizes)
    return [np.ascontiguousarray(planes[e - k : e].T).reshape(-1).view(t) for t, e, k in zip(types, ends, sizes, strict=True)]


def records_of(table: pa.Table, dtype: np.dtype, kind: int | None = None) -> np.ndarray:
    """All records of one group (of one kind)."""
    parts = []
    for batch in table.to_batches():
        kinds = batch.column(1).to_pylist()
        for k, block in zip(kinds, batch.column(2), strict=True):
            if kind is None or k == kind:
                parts.append(np.frombuffer(block.as_buffer(), dtype))
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


#: Blocks that meet in one step of a tree.
FAN = 32


def node_of() -> int:
    """The number of this map task's node on the first level of a tree."""
    return TaskContext.get().partitionId() // FAN


def tree(blocks: DataFrame, add: Callable[[pa.Table], bytes], nodes: int) -> DataFrame:
    """``part, kind, block`` with one block for each part: those of a part are added up ``FAN`` at a time, level by level.

    ``kind`` is the node's number among ``nodes``; ``add`` makes one block of a node's.  However many map tasks there are, no
    task holds more than ``FAN`` blocks.
    """

    def one(table: pa.Table) -> pa.Table:
        return pa.table({"part": table.column("part")[:1], "kind": table.column("kind")[:1], "block": pa.array([add(table)], pa.binary())})

    while True:
        blocks = blocks.groupBy("part", "kind").applyInArrow(tidy(one), BLOCKS)
        if nodes <= 1:
            return blocks
        blocks, nodes = blocks.withColumn("kind", F.floor(F.col("kind") / FAN).cast("int")), -(-nodes // FAN)


def nodes_of(df: DataFrame) -> int:
    """How many nodes the first level over ``df``'s map tasks has."""
    return -(-max(1, df._jdf.queryExecution().toRdd().getNumPartitions()) // FAN)
