"""Search by long queries (whole documents, say), whose terms occur nearly everywhere, so that bounds close no cell.

The postings of the queries' terms are dealt once to groups of cells, a row each; queries are dealt to chunks, a row
each.  A task takes one group and one chunk, which it reads from the shared folder without a shuffle, and gives
the ``k`` best documents of the group for each query.  No row is made for a query's term in a cell, nor for a query and a document.

A posting's part in a score is an integer of 10^-9, so sums in double precision are exact and do not depend on
their order: frequent terms are summed by products of matrices, the others one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..memory import tidy
from ..staging import stage

#: Cells of a group; terms and queries of a chunk; postings that a task sends at a time; terms that are broadcast.
SPAN, TERMS, QUERIES, BATCH, SENT = 8, 1 << 20, 4096, 1 << 19, 1 << 18
#: Sums one by one that cost as much as one product of matrices for all documents and queries, as a share of these; sums made at a time.
RARE, SUMS = 1 / 100, 1 << 20
#: Stands for a part that rounds to 0: the document is found, its score stays.
FOUND = 2.0**-30


def _stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _read(streams) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in streams])


def _flat(x: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


def _sender(batches):
    """Blocks (term, cell, ids, tfs, lengths) as postings packed by group of cells, a document's beside each other."""
    for whole in batches:
        ends = np.cumsum(whole.column(2).value_lengths().to_numpy())
        i = 0
        while i < len(whole):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH, "right")))
            b, i = whole.slice(i, j - i), j
            group = b.column(1).to_numpy() // SPAN
            for g in np.unique(group):
                yield pa.RecordBatch.from_arrays([pa.array([int(g)], pa.int32()), pa.array([_stream(_postings(b.take(pa.array(np.flatnonzero(group == g)))))], pa.binary())], names=["group", "postings"])


def _postings(b: pa.RecordBatch) -> pa.Table:
    terms, n = b.column(0).dictionary_encode(), b.column(2).value_lengths().to_numpy()
    ids = b.column(2).flatten()
    cell, number = np.repeat(b.column(1).to_numpy(), n), np.repeat(terms.indices.to_numpy(), n)
    order = np.lexsort((ids.dictionary_encode().indices.to_numpy(), cell))
    at = pa.array(order)
    return pa.table(
        {
            "id": ids.take(at),
            "cell": cell[order],
            "length": b.column(4).flatten().take(at),
            "term": pa.DictionaryArray.from_arrays(pa.array(number[order]), terms.dictionary),
            "tf": b.column(3).flatten().take(at),
        }
    )


def _whole(v: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)


def _grouper(table: pa.Table) -> pa.Table:
    """A group's documents in order of id, its terms, and the postings of each of its cells."""
    rows = _read(x.as_buffer() for x in table.column("postings")).unify_dictionaries()
    ids, terms = _flat(rows.column("id")).dictionary_encode(), rows.column("term")
    number = np.concatenate([x.indices.to_numpy() for x in terms.chunks])
    order = pc.sort_indices(ids.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    doc = rank[ids.indices.to_numpy()]
    lengths = np.empty(len(order), np.int32)
    lengths[doc] = rows.column("length").to_numpy()
    cell, tf = rows.column("cell").to_numpy(), rows.column("tf").to_numpy()
    cells = []
    for c in np.unique(cell):
        at = np.flatnonzero(cell == c)
        at = at[np.argsort(number[at], kind="stable")]
        cells.append(_stream(pa.table({"doc": doc[at], "number": number[at], "tf": tf[at]})))
    return pa.table({"ids": _whole(ids.dictionary.take(pa.array(order))), "lengths": _whole(pa.array(lengths)), "terms": _whole(terms.chunk(0).dictionary), "cells": _whole(pa.array(cells, pa.binary()))})


def _chunker(table: pa.Table) -> pa.Table:
    """A chunk's queries, its terms and, in order of the terms and their weights, the queries of each."""
    ids, terms = (_flat(table.column(c)).dictionary_encode() for c in ("query_id", "term"))
    query, number, weight = ids.indices.to_numpy(), terms.indices.to_numpy(), table.column("weight").to_numpy()
    order = np.lexsort((query, weight, number))
    said = pa.table({"query": query[order], "number": number[order], "weight": weight[order]})
    return pa.table({"queries": _whole(ids.dictionary), "words": _whole(terms.dictionary), "said": pa.array([_stream(said)], pa.binary())})


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i]`` to ``starts[i] + n[i] - 1``, for all i in turn."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(starts - (ends - n), n)


def _sums(doc, term, part, n_docs, first, n, query, n_queries) -> np.ndarray:
    """Scores of all queries and documents of a cell.

    Postings are ``doc, term, part`` in order of ``term``; the queries of term ``t`` are ``n[t]`` of ``query`` from ``first[t]`` on.
    """
    start = np.flatnonzero(np.diff(term, prepend=-1))
    met, df = term[start], np.diff(np.append(start, len(term)))
    often = df * n[met] > RARE * n_docs * n_queries
    total = np.zeros((n_docs, n_queries))  # a document's sums lie together, and its postings are added one after the other
    for i in range(0, int(often.sum()), 512):
        some = np.flatnonzero(often)[i : i + 512]
        left, right = np.zeros((n_docs, len(some))), np.zeros((len(some), n_queries))
        column = np.arange(len(some))
        right[np.repeat(column, n[met[some]]), query[_ranges(first[met[some]], n[met[some]])]] = 1
        at = _ranges(start[some], df[some])
        left[doc[at], np.repeat(column, df[some])] = part[at]
        total += left @ right
    seldom = _ranges(start[~often], df[~often])
    seldom = seldom[np.argsort(doc[seldom], kind="stable")]
    ends = np.cumsum(n[term[seldom]])
    i = 0
    while i < len(seldom):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SUMS, "right")))
        at, i = seldom[i:j], j
        t = term[at]
        np.add.at(total.reshape(-1), query[_ranges(first[t], n[t])] + np.repeat(doc[at] * n_queries, n[t]), np.repeat(part[at], n[t]))
    return total.T


def _scorer(k: int, parts):
    """A function of batches of groups beside chunks: the ``k`` best documents of the group for each query of the chunk."""

    def score(batches):
        for b in batches:
            for i in range(len(b)):
                yield _unit(*(b.column(c)[i].values for c in range(6)), b.column(6)[i].as_buffer(), k, parts)

    return tidy(score)


def _unit(ids: pa.Array, lengths: pa.Array, terms: pa.Array, cells: pa.Array, queries: pa.Array, words: pa.Array, said: pa.Buffer, k: int, parts) -> pa.RecordBatch:
    said, lengths = _read([said]), lengths.to_numpy()
    asked, number, weight = (said.column(c).to_numpy() for c in ("query", "number", "weight"))
    asked = asked.astype(np.int64)
    word = pc.fill_null(pc.index_in(terms, value_set=words), -1).to_numpy()  # the chunk's number of each of the group's terms
    # a term and a weight that it has in some query, in order of the group's terms: that of its postings
    first = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (weight[1:] != weight[:-1]))))
    n = np.diff(np.append(first, len(number)))
    low = np.searchsorted(number[first], word, "left")
    weights = np.searchsorted(number[first], word, "right") - low  # of each of the group's terms
    at = _ranges(low, weights)
    first, n, weight, low = first[at], n[at], weight[first[at]], np.cumsum(weights) - weights
    bound = np.zeros(len(queries))
    none = np.zeros(0, np.int64)
    best = (none, none, none, none)  # query, rounded score, score, document
    for cell in cells:
        rows = _read([cell.as_buffer()])
        doc, mine, tf = (rows.column(c).to_numpy() for c in ("doc", "number", "tf"))
        times = weights[mine]
        if not times.any():
            continue
        term, at = _ranges(low[mine], times), np.repeat(np.arange(len(mine)), times)
        doc = doc[at]
        found = np.zeros(len(lengths), bool)
        found[doc] = True
        here, doc = np.flatnonzero(found), (np.cumsum(found) - 1)[doc]
        if weights.max() > 1:  # a term's postings once for each weight
            order = np.argsort(term, kind="stable")
            term, at, doc = term[order], at[order], doc[order]
        part = np.floor(parts(weight[term], tf[at].astype(float), lengths[here].astype(float)[doc]) * 1e9 + 0.5)
        part[part == 0] = FOUND
        total = _sums(doc, term, part, len(here), first, n, asked, len(queries))
        if len(here) > k and not len(best[0]):
            bound = np.maximum(bound, np.partition(total, len(here) - k, axis=1)[:, len(here) - k])
        # a lesser sum may still round to the same score
        d, q = np.nonzero(total.T >= np.maximum(bound - 1000, FOUND))
        sums = np.floor(total[q, d]).astype(np.int64)
        best = tuple(np.concatenate(x) for x in zip(best, (q, (sums + 500) // 1000, sums, here[d].astype(np.int64)), strict=True))
        order = np.lexsort((best[3], -best[1], best[0]))
        starts = np.searchsorted(best[0][order], np.arange(len(queries)))
        place = np.arange(len(order)) - starts[best[0][order]]
        best = tuple(x[order[place < k]] for x in best)
        last = place[place < k] == k - 1
        bound[best[0][last]] = np.maximum(bound[best[0][last]], best[1][last] * 1000.0 - 500)
    return pa.RecordBatch.from_arrays([queries.take(pa.array(best[0])), ids.take(pa.array(best[3])), pa.array(best[2])], names=["query_id", "id", "total"])


def scan(blocks: DataFrame, asked: DataFrame, k: int, parts, n_docs: int, cell: int) -> DataFrame:
    """``query_id, id, score`` of documents, among them the ``k`` best of each query.

    ``blocks``: an index's; ``asked``: staged rows ``query_id, folder, term, weight``; ``parts``: a function of arrays of
    weights, numbers and lengths to parts of scores; ``n_docs`` and ``cell`` (documents of a cell) size the shuffle.
    """
    kind, query_kind = blocks.schema["ids"].dataType.elementType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    mine = blocks.select("folder", "term", "cell", "ids", "tfs", "lengths")
    met = stage(asked.select("folder", "term").distinct())
    if met.limit(SENT + 1).count() <= SENT:  # of more terms, those without a query are left out by the tasks that score
        mine = mine.join(F.broadcast(met), ["folder", "term"], "left_semi")
    groups = max(1, -(-n_docs // (cell * SPAN)))
    posted = mine.select("term", "cell", "ids", "tfs", "lengths").mapInArrow(tidy(_sender), "group int, postings binary")
    packs = posted.repartition(groups, "group").groupBy("group").applyInArrow(tidy(_grouper), f"ids array<{kind}>, lengths array<int>, terms array<string>, cells array<binary>")
    packs = stage(packs)
    said = asked.select("query_id", "term", F.col("weight").cast("double").alias("weight"))
    size = said.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("queries")).first()
    chunks = max(1, -(-size["n"] // TERMS), -(-size["queries"] // QUERIES))
    dealt = said.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")).repartition(chunks, "chunk").groupBy("chunk")
    dealt = stage(dealt.applyInArrow(tidy(_chunker), f"queries array<{query_kind}>, words array<string>, said binary"))
    units = packs.hint("shuffle_replicate_nl").crossJoin(dealt)
    best = units.mapInArrow(_scorer(k, parts), f"query_id {query_kind}, id {kind}, total long")
    return best.select("query_id", "id", F.round((F.col("total").cast("decimal(19,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("double"), 6).alias("score"))
