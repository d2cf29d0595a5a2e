"""The log against a plain interpreter of it."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest

from lorekeep.llm import queries, txlog

SCHEMA = "place long, stream string, action string, key long, weight long, pos long, block long, node long, fate string, n string"


def interpret(records, every=4):
    """Record by record: stacks of savepoints, lists of changes, one store."""
    open_changes, open_savepoints, store = {}, {}, {}
    undone, states, commits = Counter(), [], 0
    committed = Counter()
    for place, stream, action, key, weight in records:
        changes, savepoints = open_changes.setdefault(stream, []), open_savepoints.setdefault(stream, [])
        if action == "change":
            changes.append((place, key, weight))
        elif action == "savepoint":
            savepoints.append(len(changes))
        elif action == "rollback":
            keep = savepoints.pop() if savepoints else 0
            undone.update(("rollback", p, place, k) for p, k, _ in changes[keep:])
            del changes[keep:]
        elif action == "abort":
            undone.update(("abort", p, place, k) for p, k, _ in changes)
            changes.clear()
            savepoints.clear()
        else:
            for p, k, w in changes:
                committed[p, k, place] += 1
                if w is None:
                    store.pop(k, None)
                else:
                    store[k] = w
            changes.clear()
            savepoints.clear()
            commits += 1
            if commits % every == 0:
                states.append((commits // every, len(store), sum(store.values())))
    if commits % every:
        states.append((commits // every + 1, len(store), sum(store.values())))
    undone.update(("abort", p, None, k) for changes in open_changes.values() for p, k, _ in changes)
    return states, undone, committed


def log_of(n, streams, keys, odds, seed, hot=0.4):
    r = random.Random(seed)
    out = []
    for i in range(n):
        stream = "hot" if r.random() < hot else r.choice(streams)
        action = r.choices(["change", "savepoint", "rollback", "commit", "abort"], odds)[0]
        out.append((3 * i - n, stream, action, r.randrange(keys) if r.random() < 0.95 else None, r.randrange(1000) if r.random() < 0.8 else None))
    return out


def check(spark, records, every=4, block=1 << 18, shuffle=True):
    rows = [(*r, 1, 2, 3, "f", "n") for r in records]
    if shuffle:
        random.Random(1).shuffle(rows)
    found = txlog.reassemble(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block)
    states, undone, committed = interpret(records, every)
    changes = found.changes.collect()
    assert Counter((c.fate, c.place, c.by_place, c.key) for c in changes if c.fate != "commit") == undone
    assert Counter((c.place, c.key, c.by_place) for c in changes if c.fate == "commit") == committed
    assert sorted((r.epoch, r.n_keys, r.weight) for r in txlog.states(found, every).collect()) == states


@pytest.mark.parametrize(
    ("n", "streams", "keys", "odds", "block", "every"),
    [
        (3000, ["a", "b", None, "c"], 40, [16, 2, 2, 2, 1], 1 << 18, 4),
        (2500, [f"s{k}" for k in range(200)], 7, [16, 3, 3, 1, 1], 60, 4),  # streams rarer than blocks
        (1500, ["a"], 5, [200, 40, 30, 1, 1], 20, 3),  # transactions over many blocks
        (800, ["a", None], 3, [5, 5, 6, 0, 0], 10, 4),  # no end at all
        (500, ["a"], 2, [1, 1, 1, 8, 1], 1 << 18, 1),
    ],
)
def test_log_equals_interpreter(spark, n, streams, keys, odds, block, every):
    check(spark, log_of(n, streams, keys, odds, n), every, block)


def test_levels_of_blocks(spark, monkeypatch):
    """Small fans and cells, so that trees have several levels."""
    monkeypatch.setattr(txlog, "FAN", 3)
    monkeypatch.setattr(txlog, "CELL", 2)
    check(spark, log_of(1200, ["a", "b", None], 6, [30, 6, 5, 2, 1], 5), 2, 25)


def test_ties_and_broken_rows(spark):
    changes = [(5, "a", "change", 1, 10), (5, "a", "change", 1, 10), (6, "a", "commit", None, None), (6, "a", "commit", None, None), (7, "a", "change", None, None), (8, None, "change", 2, 5)]
    check(spark, changes)
    log = txlog.reassemble(spark.createDataFrame([(None, "a", "change", 1, 1, 1, 2, 3, "f", "n")], SCHEMA))
    assert log.changes.collect() == [] and txlog.states(log).collect() == []
    empty = txlog.reassemble(spark.createDataFrame([], SCHEMA))
    assert empty.changes.collect() == [] and empty.commits.collect() == [] and txlog.states(empty).collect() == []
    with pytest.raises(Exception, match="no such action"):
        txlog.reassemble(spark.createDataFrame([(1, "a", None, 1, 1, 1, 2, 3, "f", "n")], SCHEMA))


def test_dead_runs_are_skipped():
    """Nested rollbacks look at each change once."""
    action = [txlog.SAVEPOINT, txlog.CHANGE] * 400 + [txlog.ROLLBACK] * 401 + [txlog.CHANGE, txlog.COMMIT]
    by, up = txlog.decide(action, False)
    assert [by[2 * k + 1] for k in range(400)] == [800 + 399 - k for k in range(400)] and by[1201] == 1202
    assert [k for k, u in enumerate(up) if u] == [1200, 1202]  # the rollback that reaches behind the start, and the end of what began there


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    records = []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect(), key=lambda r: r.doc_id):
        h = zlib.crc32(str(r.doc_id).encode())
        kind, key = h % 23, h // 100 % 300
        action = "commit" if kind < 2 else "abort" if kind == 2 else "savepoint" if kind < 5 else "rollback" if kind < 7 else "change"
        records.append((r.doc_id, r.source, action, key, None if r.text is None or r.doc_id in toxic else zlib.crc32(f"{key}:{r.text}".encode())))
    states, undone, _ = interpret(records)
    got = Counter(tuple(r) for r in queries.op11_txlog(spark, sf).select("kind", "id", "n", "value").collect())
    assert got == Counter(("state", *s) for s in states) + undone
