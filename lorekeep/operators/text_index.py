"""Full-text and sparse search by a block-max posting index that is kept as a table.

Documents are dealt to cells of about ``CELL`` by the hash of their id.  A row of the index is a block: the postings of one term in one cell,
with the greatest share that any of them can have in a score; rows lie in folders by the hash of the term.  A search
reads the folders of its terms.  It first takes the blocks' maxima alone, whose sum over a query's terms bounds every score in a
cell.  It opens the ``FIRST`` cells of the highest bounds; the k-th score found there is a threshold, and of all
other cells only those are opened whose bound reaches it.  So results are exact, and most blocks stay closed.
Of queries of more than ``LONG`` terms nearly all cells stay open, so bounds are not made, and ``text_scan`` scores all of their postings.

Defined results: a document whose text is null or without words is in no result, but counts as a document; repeated
rows of one id have their words added up; ties go to the lesser id; without queries or documents there are no results.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..memory import tidy
from ..staging import stage
from .retrieval import B, K1, top
from .text_scan import scan

#: Documents of a cell, folders of the table, postings that one task makes blocks of, and cells that a query opens to begin with.
CELL, FOLDERS, GROUP, FIRST = 1024, 64, 1 << 20, 4
#: Terms of a query above which no bounds are made, and queries above which none are made for any.
LONG, MANY = 64, 256
#: Words of documents that a task counts at a time; one longer document is counted alone.  Each time costs a row for each folder and group.
WORDS = 1 << 20


class Index(NamedTuple):
    blocks: DataFrame  # folder, term, cell, n, best, most_tf, ids, tfs, lengths
    terms: DataFrame  # folder, term, df
    stats: DataFrame  # one row: n_docs, mean_length


def folder_of(term: str = "term") -> Column:
    return (F.crc32(F.col(term).cast("binary")) % FOLDERS).cast("int").alias("folder")


def _sender(span: int):
    """Postings of a batch of documents, packed for the tasks that make blocks of them: a row for each folder and group of cells.

    A document's words are in one row, so its terms are counted on the spot.
    """

    def spans(batches):
        for b in batches:
            ends, i = np.cumsum(b.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while i < len(b):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + WORDS, "right")))
                yield b.slice(i, j - i)
                i = j

    def send(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in spans(batches):
            words = b.column(3)
            flat = words.flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(b)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            n = max(1, len(flat.dictionary))
            pair, tf = np.unique(doc * n + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
            if not len(pair):
                continue
            doc, term = pair // n, pair % n
            folder = np.array([zlib.crc32(t.encode()) % FOLDERS for t in flat.dictionary.to_pylist()], np.int64)[term]
            group = b.column(1).to_numpy()[doc] // span
            order = np.argsort((folder * (int(group.max()) + 1) + group) * n + term, kind="stable")
            doc, term, tf, folder, group = doc[order], term[order], tf[order], folder[order], group[order]
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(folder) != 0) | (np.diff(group) != 0)) + 1, [len(doc)]))
            at = pa.array(doc)
            columns = [b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(tf.astype(np.int32))]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                new = np.diff(term[i:j], prepend=-1) != 0  # a term's rows lie together, and its word is sent once
                said = pa.DictionaryArray.from_arrays(pa.array((np.cumsum(new) - 1).astype(np.int32)), flat.dictionary.take(pa.array(term[i:j][new])))
                rows = pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in columns), said], names=["id", "cell", "length", "tf", "term"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                    out.write_batch(rows)
                yield pa.RecordBatch.from_arrays([pa.array([int(folder[i])], pa.int32()), pa.array([int(group[i])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["folder", "part", "postings"])
            pa.default_memory_pool().release_unused()

    return tidy(send)


def _blocker(mean: float):
    """A group's postings as blocks, in order of term and cell."""

    def make(table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("postings")]).unify_dictionaries()
        one = {c: pa.concat_arrays(rows.column(c).chunks) for c in rows.column_names}
        names = one["term"].dictionary
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        term, cell = rank[one["term"].indices.to_numpy()], one["cell"].to_numpy()
        order = np.lexsort((cell, term))
        term, cell = term[order], cell[order]
        starts = np.concatenate(([0], np.flatnonzero((np.diff(term) != 0) | (np.diff(cell) != 0)) + 1))
        at = pa.array(order)
        tf, length = one["tf"].take(at), one["length"].take(at)
        n, size = tf.to_numpy().astype(float), length.to_numpy()
        part = n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean))
        offsets = pa.array(np.append(starts, len(order)), pa.int32())
        first = pa.array(order[starts])
        return pa.table(
            {
                "folder": pa.array(np.full(len(starts), table.column("folder")[0].as_py(), np.int32)),
                "term": one["term"].take(first).dictionary_decode(),
                "cell": one["cell"].take(first),
                "n": pa.array(np.diff(np.append(starts, len(order)))),
                "best": pa.array(np.maximum.reduceat(part, starts)),
                "most_tf": pa.array(np.maximum.reduceat(tf.to_numpy(), starts).astype(np.int64)),
                "ids": pa.ListArray.from_arrays(offsets, one["id"].take(at)),
                "tfs": pa.ListArray.from_arrays(offsets, tf),
                "lengths": pa.ListArray.from_arrays(offsets, length),
            }
        )

    return tidy(make)


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Write the index of all documents to ``path``, a folder that all machines share."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    words = F.size(T.words(F.col(text_col)))
    docs.agg(F.count("*").alias("n_docs"), F.avg(words).alias("mean_length"), F.sum(words.cast("long")).alias("n_words"), F.lit(None).cast(kind).alias("id")).write.parquet(f"{path}/stats")
    known = spark.read.parquet(f"{path}/stats").first()
    cells = max(1, -(-known["n_docs"] // CELL))
    span = -(-cells // max(1, -(-(known["n_words"] or 0) // (FOLDERS * GROUP))))
    cut = docs.select(F.col(id_col).alias("id"), T.words(F.col(text_col)).alias("w")).filter("w is not null")
    cut = cut.select("id", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias("cell"), F.size("w").alias("length"), "w")
    packed = cut.mapInArrow(_sender(span), "folder int, part int, postings binary")
    blocks = packed.groupBy("folder", "part").applyInArrow(_blocker(known["mean_length"] or 1.0), _schema(kind))
    blocks.write.partitionBy("folder").parquet(f"{path}/blocks")
    _blocks(spark, path, kind).groupBy("folder", "term").agg(F.sum("n").alias("df")).write.partitionBy("folder").parquet(f"{path}/terms")
    return opened(spark, path)


def _schema(kind: str) -> str:
    return f"folder int, term string, cell int, n long, best double, most_tf long, ids array<{kind}>, tfs array<int>, lengths array<int>"


def _blocks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_schema(kind)).parquet(f"{path}/blocks")


def opened(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    stats = spark.read.parquet(f"{path}/stats")
    terms = spark.read.schema("folder int, term string, df long").parquet(f"{path}/terms")
    return Index(_blocks(spark, path, stats.schema["id"].dataType.simpleString()), terms, stats.select("n_docs", "mean_length"))


#: Rows of a search's own (query terms, cells to open) that are sent to the index; more meet it in a shuffle.
SENT = 1 << 17


def sent(rows: DataFrame) -> DataFrame:
    """``rows``, which are staged, marked to be broadcast if they are few."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows


def _bm25(mean: float):
    return lambda weight, tf, length: weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _sparse(weight: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.log(1 + tf) * weight


def search(index: Index, queries: DataFrame, k: int, kind: str = "bm25", first: int = FIRST) -> DataFrame:
    """``query_id, id, score, rank`` of the ``k`` best documents of each query (``query_id, qtext``).

    ``bm25``: a term counts once, by rarity, number and document length; ``sparse``: log(1 + number) times its number in the query.
    """
    if kind not in ("bm25", "sparse"):
        raise ValueError("kind must be bm25 or sparse")
    said = queries.select("query_id", F.explode(T.words(F.col("qtext"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("qw")).withColumn("folder", folder_of())
    said = stage(said)
    folders = [r["folder"] for r in said.select("folder").distinct().collect()]  # FOLDERS at most
    mine = F.col("folder").isin(folders)
    stats = F.broadcast(index.stats)  # one row
    if kind == "bm25":
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = index.terms.filter(mine).join(sent(said), ["folder", "term"]).join(stats).select("query_id", "folder", "term", idf.alias("weight"), "mean_length")
        bound = F.col("best")
        part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    else:
        asked = said.select("query_id", "folder", "term", F.col("qw").alias("weight"))
        bound, part = F.log(1 + F.col("most_tf")), F.log(1 + F.col("tf")) * F.col("weight")
    asked = stage(asked)
    sizes = stage(said.groupBy("query_id").count())
    wordy = sizes.filter(F.col("count") > (LONG if sizes.count() <= MANY else 0)).select("query_id")
    if wordy.isEmpty():
        return _opened(index, asked, mine, bound, part, k, first)
    known = index.stats.first()
    mean = known["mean_length"] or 1.0
    found = scan(index.blocks.filter(mine), stage(asked.join(wordy, "query_id", "left_semi")), k, _bm25(mean) if kind == "bm25" else _sparse, known["n_docs"], CELL)
    found = top(found, ["query_id"], [F.desc("score"), F.asc("id")], k)
    short = stage(asked.join(wordy, "query_id", "left_anti"))
    return found if short.isEmpty() else found.unionByName(_opened(index, short, mine, bound, part, k, first))


def _opened(index: Index, asked: DataFrame, mine: Column, bound: Column, part: Column, k: int, first: int) -> DataFrame:
    """``search`` by bounds: the cells of the highest ones, then those that can still hold one of the best documents."""
    heads = index.blocks.filter(mine).select("folder", "term", "cell", bound.alias("bound"))
    bounds = heads.join(sent(asked), ["folder", "term"]).groupBy("query_id", "cell").agg(F.sum(F.col("weight") * F.col("bound")).alias("most"))
    bounds = stage(bounds)

    def scored(cells: DataFrame) -> DataFrame:
        wanted = stage(asked.join(cells, "query_id"))
        opened_ = index.blocks.filter(mine).join(sent(wanted), ["folder", "term", "cell"])
        zipped = opened_.select("query_id", *(c for c in ("weight", "mean_length") if c in asked.columns), F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p"))
        each = zipped.select("*", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))
        return each.groupBy("query_id", "id").agg(F.round(F.sum(F.round(part, 9).cast("decimal(28,9)")).cast("double"), 6).alias("score"))

    begin = stage(top(bounds, ["query_id"], [F.desc("most"), F.asc("cell")], first, "place").select("query_id", "cell"))
    found = stage(top(scored(begin), ["query_id"], [F.desc("score"), F.asc("id")], k))
    threshold = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("threshold"))
    left = bounds.join(begin, ["query_id", "cell"], "left_anti").join(threshold, "query_id", "left").filter(F.col("threshold").isNull() | (F.col("most") >= F.col("threshold") - 1e-5))
    return top(found.drop("rank").unionByName(scored(left.select("query_id", "cell"))), ["query_id"], [F.desc("score"), F.asc("id")], k)


def open_cells(index: Index, queries: DataFrame, k: int, first: int = FIRST) -> tuple[int, int]:
    """How many cells hold a term of some query, and how many a bm25 search opens: what the maxima save."""
    found = search(index, queries, k, first=first).filter(F.col("rank") == k).select("query_id", F.col("score").alias("threshold"))
    said = queries.select("query_id", F.explode(F.array_distinct(T.words(F.col("qtext")))).alias("term"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = said.join(index.terms, "term").join(F.broadcast(index.stats)).select("query_id", "term", idf.alias("weight"))
    bounds = index.blocks.select("term", "cell", "best").join(asked, "term").groupBy("query_id", "cell").agg(F.sum(F.col("weight") * F.col("best")).alias("most"))
    both = bounds.join(found, "query_id", "left")
    r = both.agg(F.count("*").alias("n"), F.count_if(F.col("threshold").isNull() | (F.col("most") >= F.col("threshold") - 1e-5)).alias("open")).first()
    return r["n"], r["open"]
