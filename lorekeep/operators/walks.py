"""State machines over ordered rows: each key's rows are walked in order, in sorted partitions and constant memory.

For rules that look back at their own result (buckets that refill, caches that expire, breakers that open), which no
window function says.  A key is one task; its rows stream through it and are never held.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


def walk(rows: DataFrame, by: str, order: list[str], keep: list[str], start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, Any]], name: str, kind: str) -> DataFrame:
    """``by``, ``order``, ``keep`` and the step's result as column ``name`` of SQL type ``kind``, for every row.

    ``start()`` is a key's first state; ``step(state, row)`` gives the next one and the row's result.
    """
    columns = list(dict.fromkeys([by, *order, *keep]))
    picked = rows.select(*columns)
    types = dict(picked.dtypes)
    arrow = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind]

    def run(batches):
        key, state = object(), None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row[by] != key:
                    key, state = row[by], start()
                state, result = step(state, row)
                out.append(result)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, arrow)], names=[*b.schema.names, name])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in columns], f"`{name}` {kind}"])
    return picked.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def token_bucket(events: DataFrame, by: str, at: str, order: str, capacity: float, per_second: float) -> DataFrame:
    """``allowed`` per event: a bucket of ``capacity`` tokens refills at ``per_second``; an event takes one if it can."""

    def step(state, row):
        tokens, last = state
        now = float(row[at])
        tokens = min(capacity, tokens + (now - last) * per_second) if last is not None else capacity
        return ((tokens - 1, now), True) if tokens >= 1 else ((tokens, now), False)

    return walk(events, by, [at, order], [], lambda: (capacity, None), step, "allowed", "boolean")


def cache_hits(lookups: DataFrame, by: str, at: str, order: str, ttl: float) -> DataFrame:
    """``hit`` per lookup of a cache whose entries live ``ttl`` seconds from when they were stored."""

    def step(stored, row):
        now = float(row[at])
        return (stored, True) if stored is not None and now - stored < ttl else (now, False)

    return walk(lookups, by, [at, order], [], lambda: None, step, "hit", "boolean")


def circuit_breaker(calls: DataFrame, by: str, at: str, order: str, failed: str, threshold: int = 5, successes: int = 2, timeout: float = 60.0) -> DataFrame:
    """``state`` in which each call meets its service: closed, open (the call is not made) or half_open.

    ``threshold`` failures open it; after ``timeout`` seconds calls are let through, ``successes`` of them close
    it and a failure opens it again.
    """

    def step(state, row):
        mode, fails, wins, since = state
        now = float(row[at])
        if mode == "open" and now - since >= timeout:
            mode, wins = "half_open", 0
        seen = mode
        if mode != "open":
            if row[failed]:
                fails, since = fails + 1, now
                if mode == "half_open" or fails >= threshold:
                    mode = "open"
            elif mode == "half_open":
                wins += 1
                if wins >= successes:
                    mode, fails = "closed", 0
            else:
                fails = 0
        return (mode, fails, wins, since), seen

    return walk(calls, by, [at, order], [failed], lambda: ("closed", 0, 0, 0.0), step, "state", "string")
