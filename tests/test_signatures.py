"""Signatures are made of a bounded number of sets at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lorekeep.operators import dedup as D


def test_a_large_batch_is_signed_in_parts(spark):
    class Frame:  # takes the function that the workers run
        dtypes = [("doc_id", "bigint")]

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            return f

    r = np.random.default_rng(2)
    sets = [r.integers(0, 1 << 32, k % 7 and k) for k in range(1300)] + [r.integers(0, 1 << 32, 20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "h"])
    got = list(D.signatures(Frame(), F.lit(None))(iter([batch])))
    assert max(b.num_rows for b in got) <= 512 and [i for b in got for i in b.column(0).to_pylist()] == list(range(len(sets)))
    signed = [s for b in got for s in b.column(1).to_pylist()]
    for k in (0, 5, 7, 1299, 1300):
        want = [min(((a * (int(x) % D.PRIME) + b) % D.PRIME for x in sets[k]), default=0) for a, b in D._coefficients(D.PERMUTATIONS)[:3]]
        assert signed[k][:3] == want
