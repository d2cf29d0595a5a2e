"""Every registered query against its oracle on the smallest tables, as the driver compares them."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lorekeep import registry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
# queries that SQL does not express; test_engine_operators.py holds each against a version of its own
ELSEWHERE = {"i01_ingest", "r01_probed_lists", "x07_child_chunks", "x08_code_blocks", "x45_hunks"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    expected = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())


def test_what_has_no_oracle_is_stated():
    assert set(QUERIES) - set(ORACLES) == ELSEWHERE
