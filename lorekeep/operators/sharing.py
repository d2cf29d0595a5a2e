"""Documents that share names with the documents of a stated set, with the names of each pair.

The result grows with the product of both sets, so no row is made or shuffled for a pair before it is a row of the result: documents
are dealt to cells and asked documents to chunks, a row each, of a bounded number of names; a task takes one cell and one chunk,
which it reads from the shared folder, and puts their pairs together, a bounded number of shared names at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..memory import tidy
from ..staging import stage

#: Names of documents of a cell or chunk; shared names that a task puts together at a time.
NAMES, SHARED = 1 << 17, 1 << 18


def _whole(v: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)


def _flat(x: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(x.chunks)


def _pack(table: pa.Table) -> pa.Table:
    """A cell's documents, its names in order, and which document has which, by document and name."""
    ids, keys = (_flat(table.column(c)).dictionary_encode() for c in ("doc_id", "key"))
    order = pc.sort_indices(keys.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    said = np.unique(ids.indices.to_numpy() * np.int64(len(order)) + rank[keys.indices.to_numpy()])
    doc, name = np.divmod(said, len(order))
    return pa.table({"ids": _whole(ids.dictionary), "names": _whole(keys.dictionary.take(pa.array(order))), "doc": _whole(pa.array(doc.astype(np.int32))), "name": _whole(pa.array(name.astype(np.int32)))})


def _packs(rows: DataFrame, n: int, kind: str) -> DataFrame:
    """``rows`` (``doc_id, key``) in ``n`` packs, whole documents in each; a partition holds about one."""
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).groupBy("cell")
    return stage(dealt.applyInArrow(tidy(_pack), f"ids array<{kind}>, names array<string>, doc array<int>, name array<int>").repartition(n))


def _pairs(ids, names, doc, name, asked, asked_names, asked_doc, asked_name, mark: str | None):
    """The pairs of a cell's documents with a chunk's, a batch of whole documents of the cell at a time."""
    doc, name, asked_doc, asked_name = (x.to_numpy() for x in (doc, name, asked_doc, asked_name))
    code = pc.fill_null(pc.index_in(names, value_set=asked_names), -1).to_numpy()[name]  # the chunk's number of each name
    doc, code = doc[code >= 0].astype(np.int64), code[code >= 0].astype(np.int64)
    if not len(doc):
        return
    own = pc.fill_null(pc.index_in(ids, value_set=asked), -1).to_numpy()
    order = np.argsort(asked_name, kind="stable")
    holder = asked_doc[order].astype(np.int64)
    first = np.searchsorted(asked_name[order], np.arange(len(asked_names) + 1))
    n = np.diff(first)[code]
    ends = np.cumsum(n)
    last = np.append(np.flatnonzero(doc[1:] != doc[:-1]), len(doc) - 1)  # of each document
    done, bits, name_bits = ends[last], len(asked).bit_length(), len(asked_names).bit_length()
    i = 0
    while i < len(last):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + SHARED, "right")))
        rows = slice(last[i - 1] + 1 if i else 0, last[j - 1] + 1)
        here, i = n[rows], j
        left = np.repeat(doc[rows], here)
        at = np.repeat(first[code[rows]] - (ends[rows] - here), here) + np.arange(ends[rows.start] - here[0], ends[rows.stop - 1])
        right = holder[at]
        other, base = own[left] != right, doc[rows.start]
        met = np.sort((((left - base) << bits | right) << name_bits | np.repeat(code[rows], here))[other])
        if not len(met):
            continue
        pair = met >> name_bits
        start = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        pair, border = pair[start], np.append(start, len(met))
        said = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), asked_names.take(pa.array(met & ((1 << name_bits) - 1))))
        columns = [asked.take(pa.array(pair & ((1 << bits) - 1))), ids.take(pa.array((pair >> bits) + base)), pa.array(np.diff(border)), said if mark is None else pc.binary_join(said, mark)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "other_id", "n_shared", "names"])


def shared(keys: DataFrame, asked: DataFrame, n: int, n_asked: int, mark: str | None = None) -> DataFrame:
    """``doc_id, other_id, n_shared, names`` of every document of ``asked`` and every other document of ``keys`` with a common key.

    Both have ``doc_id, key``, without nulls; ``n`` and ``n_asked`` (their rows) size the packs.  ``names`` are in order, joined by ``mark`` if there is one.
    """
    kind, cores = keys.schema["doc_id"].dataType.simpleString(), keys.sparkSession.sparkContext.defaultParallelism
    cells = max(1, -(-n // NAMES), min(4 * cores, n // 4096))
    packs = _packs(keys, cells, kind)
    chunks = _packs(asked, max(1, -(-n_asked // NAMES)), kind).toDF("asked", "asked_names", "asked_doc", "asked_name")

    def put(batches):
        for b in batches:
            for i in range(len(b)):
                yield from _pairs(*(b.column(c)[i].values for c in range(8)), mark)

    said = "array<string>" if mark is None else "string"
    return packs.hint("shuffle_replicate_nl").crossJoin(chunks).mapInArrow(tidy(put), f"doc_id {kind}, other_id {kind}, n_shared long, names {said}")
