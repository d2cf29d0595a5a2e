"""Nearest vectors by an inverted index that is kept as a table, and by blocks without one.

The index has coarse centroids, trained by Lloyd's rounds in Spark on a bounded sample, and a list for each:
the rows nearest to it, with their distance to it, as Parquet partitioned by groups of lists.  A search reads the lists
of the ``probes`` nearest centroids.  With ``exact`` it then reads every other list that may still hold something
nearer than the k-th found so far: by the triangle inequality a list's rows are no nearer than the centroid's distance less
the list's radius, and a row no nearer than the difference of its own and the query's distance to the centroid.

Up to ``QUERIES`` queries are counted first and then sent to the rows, which stay where they are.  More meet
cells of rows in a shuffle, block by block.  Either way a task holds a bounded number of both, and only centroids (``LISTS``
at most) are broadcast.

Defined results: rows whose vector is null, holds a null or a component that is not finite, or has another length than the
centroids, are in no result; a null id is an id; without rows there are no results; ties go to the lesser id.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..memory import tidy
from ..staging import stage

#: Lists of an index at most, rows of the training sample for each, and folders of its table at most.
LISTS, SAMPLE, FOLDERS = 4096, 64, 256
#: Queries that are sent to the rows at most, and rows of a cell that meets a block of as many queries.
QUERIES, CELL = 2048, 1 << 14
#: Rows that are measured against a block of queries at a time.
STEP = 512
SLACK = 1e-6


class Index(NamedTuple):
    rows: DataFrame  # folder, list, id, v, gap: the distance to the list's centroid
    centroids: np.ndarray
    radius: np.ndarray
    size: np.ndarray


def usable(vectors: DataFrame, id_col: str, vec: str) -> DataFrame:
    """``id, v`` of the rows that have a vector."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squared(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows and queries, to choose by; those that are reported are measured again."""
    return np.maximum((x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (x @ q.T), 0)


def closest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's list and its distance to the centroid."""
    lists, gaps = np.empty(len(x), np.int32), np.empty(len(x))
    for i in range(0, len(x), 4096):
        lists[i : i + 4096] = squared(x[i : i + 4096], centroids).argmin(1)
    for i in range(0, len(x), 4096):
        gaps[i : i + 4096] = np.sqrt(((x[i : i + 4096] - centroids[lists[i : i + 4096]]) ** 2).sum(1))
    return lists, gaps


def train(rows: DataFrame, n_lists: int, rounds: int = 6) -> np.ndarray:
    """Centroids of a sample of ``SAMPLE`` rows for each list (those of the least hashes of id and vector)."""
    order = [F.xxhash64("id", "v"), F.col("v")]
    sample = stage(rows.orderBy(*order).limit(SAMPLE * n_lists).select("v"))
    centroids = np.array([r["v"] for r in sample.orderBy(F.xxhash64("v"), "v").limit(n_lists).collect()], float)
    for _ in range(rounds):

        def sums(batches, centroids=centroids):
            total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
            for b in batches:
                x = matrix(b.column(0))
                at, _ = closest(x, centroids) if len(x) else (np.zeros(0, int), None)
                np.add.at(total, at, x) if len(x) else None
                n += np.bincount(at, minlength=len(n))
            had = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(had.astype(np.int32)), pa.array(list(total[had]), pa.list_(pa.float64())), pa.array(n[had])], names=["list", "s", "n"])

        def add(table: pa.Table) -> pa.Table:
            total = matrix(table.column("s").combine_chunks()).sum(0)
            return pa.table({"list": table.column("list")[:1], "s": pa.array([total], pa.list_(pa.float64())), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})

        new = centroids.copy()
        for r in sample.mapInArrow(sums, "list int, s array<double>, n long").groupBy("list").applyInArrow(add, "list int, s array<double>, n long").collect():
            new[r["list"]] = np.array(r["s"]) / r["n"]
        if np.array_equal(new, centroids):
            break
        centroids = new
    return centroids


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vec: str = "embedding", n_lists: int | None = None) -> Index:
    """Write an index of all rows to ``path``, a folder that all machines share; lists default to the square root of the rows, ``LISTS`` at most."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec)
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.filter(F.size("v") == (width[0]["d"] if width else 0))
    n = width[0]["count"] if width else 0
    wanted = max(1, min(LISTS, n_lists or math.isqrt(n)))
    centroids = train(rows, wanted) if n else np.zeros((0, 0))
    kind = vectors.schema[id_col].dataType

    def assign(batches):
        for b in batches:
            lists, gaps = closest(matrix(b.column(1)), centroids) if len(b) else (np.zeros(0, np.int32), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(lists % FOLDERS, pa.int32()), pa.array(lists, pa.int32()), b.column(0), b.column(1), pa.array(gaps)], names=["folder", "list", "id", "v", "gap"])

    assigned = rows.mapInArrow(tidy(assign), f"folder int, list int, id {kind.simpleString()}, v array<double>, gap double")
    # a list of very many rows is split, small ones share a file
    assigned.hint("rebalance", "list").sortWithinPartitions("folder", "list").write.partitionBy("folder").parquet(f"{path}/rows")
    table = spark.read.schema(assigned.schema).parquet(f"{path}/rows")
    about = {r["list"]: (r["n"], r["radius"]) for r in table.groupBy("list").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()}
    lists = [(k, [float(x) for x in c], *(about.get(k, (0, 0.0)))) for k, c in enumerate(centroids)]
    spark.createDataFrame(lists, "list int, centroid array<double>, n long, radius double").coalesce(1).write.parquet(f"{path}/lists")
    return Index(table, centroids, np.array([x[3] for x in lists]), np.array([x[2] for x in lists], np.int64))


def opened(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    lists = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    kind = "folder int, list int, id {}, v array<double>, gap double".format(spark.read.parquet(f"{path}/rows").schema["id"].dataType.simpleString())
    centroids = np.array([r["centroid"] for r in lists], float) if lists else np.zeros((0, 0))
    return Index(spark.read.schema(kind).parquet(f"{path}/rows"), centroids, np.array([r["radius"] for r in lists]), np.array([r["n"] for r in lists], np.int64))


#: What a task makes of rows and queries: numbers of rows and queries, and their scores; the least ones are kept.
Score = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Which of some rows (by their places) and all queries may be near enough; all rows at once would be a cell times a block of them.
Inside = Callable[[slice | np.ndarray], np.ndarray]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, rounded to 9 digits."""
    return ((x - q) ** 2).sum(1).round(9)


class Best:
    """The ``k`` least of each query so far: by score, then id."""

    def __init__(self, k: int):
        self.k, self.query, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0), None

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.query, self.score = np.concatenate((self.query, query)), np.concatenate((self.score, score))
        self.ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        if len(self.query) > 1 << 20:
            self.cut()

    def cut(self) -> None:
        if self.ids is None or not len(self.query):
            return
        ids = self.ids.to_numpy(zero_copy_only=False)
        missing = self.ids.is_null().to_numpy(zero_copy_only=False)
        names = np.unique(ids[~missing], return_inverse=True)[1]
        place = np.full(len(ids), -1, np.int64)  # a null id comes first, as in Spark's ascending order
        place[~missing] = names
        order = np.lexsort((place, self.score, self.query))
        q = self.query[order]
        start = np.searchsorted(q, q, "left")
        keep = order[np.arange(len(q)) - start < self.k]
        self.query, self.score, self.ids = self.query[keep], self.score[keep], self.ids.take(pa.array(keep))


def gather(best: Best, ids: pa.Array, x: np.ndarray, q: np.ndarray, score: Score, within: np.ndarray | None = None, at: Inside | None = None, name: np.ndarray | None = None) -> None:
    """Add what each query may need of these rows; ``within``: squared distance beyond which nothing counts; ``name``: the queries' numbers."""
    for i in range(0, len(x), STEP):
        some, d = x[i : i + STEP], squared(x[i : i + STEP], q)
        limit = np.full(len(q), np.inf) if within is None else within
        if best.k < len(some):
            limit = np.minimum(limit, np.partition(d, best.k - 1, axis=0)[best.k - 1])
        good = d <= limit[None, :] * (1 + SLACK) + SLACK
        if at is not None:
            good &= at(slice(i, i + STEP))
        add_pairs(best, ids, some, q, i, good, score, name)


def add_pairs(best: Best, ids: pa.Array, some: np.ndarray, q: np.ndarray, first: int, good: np.ndarray, score: Score, name: np.ndarray | None) -> None:
    rows, cols = np.nonzero(good)
    for j in range(0, len(rows), 1 << 16):
        r, c = rows[j : j + (1 << 16)], cols[j : j + (1 << 16)]
        best.add(c if name is None else name[c], score(some[r], q[c]), ids.take(pa.array(r + first)))


def gather_first(best: Best, ids: pa.Array, x: np.ndarray, q: np.ndarray, score: Score, within: np.ndarray, at: Inside | None = None, name: np.ndarray | None = None) -> None:
    """Add, for each query, the least id among rows that are near enough, and all rows of which that is not sure; ``score`` has the last word."""
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    ids, x = ids.take(pa.array(order)), x[order]
    for i in range(0, len(x), STEP):
        some, d = x[i : i + STEP], squared(x[i : i + STEP], q)
        sure = d <= within[None, :] * (1 - SLACK) - SLACK
        good = ~sure & (d <= within[None, :] * (1 + SLACK) + SLACK)
        if at is not None:
            inside = at(order[i : i + STEP])
            sure, good = sure & inside, good & inside
        had = sure.any(0)
        good[sure.argmax(0)[had], np.flatnonzero(had)] = True
        add_pairs(best, ids, some, q, i, good, score, name)
        best.cut()


def top_k(found: DataFrame, k: int, name: str = "distance") -> DataFrame:
    from .retrieval import top

    return top(found, ["query_id"], [F.asc(name), F.asc("id")], k)


def _asked(queries: DataFrame, width: int | None = None) -> DataFrame:
    rows = usable(queries, "query_id", "qvec").select(F.col("id").alias("query_id"), F.col("v").alias("qvec"))
    return rows if width is None else rows.filter(F.size("qvec") == width)


def brute(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", score: Score = distances, name: str = "distance") -> DataFrame:
    """``query_id, id`` and the ``k`` least scores of each query over all rows, without an index."""
    rows, asked = usable(vectors, id_col, vec), _asked(queries)
    kinds = rows.schema["id"].dataType, asked.schema["query_id"].dataType
    schema = f"query_id {kinds[1].simpleString()}, id {kinds[0].simpleString()}, `{name}` double"
    names = ["query_id", "id", name]
    few = asked.limit(QUERIES + 1).collect()
    if len(few) <= QUERIES:
        by_width: dict[int, list] = {}
        for r in few:
            by_width.setdefault(len(r["qvec"]), []).append(r)
        sets = {w: ([r["query_id"] for r in rs], np.array([r["qvec"] for r in rs], float)) for w, rs in by_width.items()}

        def run(batches):
            best = {w: Best(k) for w in sets}
            for b in batches:
                lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False) if len(b) else np.zeros(0, int)
                for w in set(lengths.tolist()) & set(sets):
                    own = b.filter(pa.array(lengths == w))
                    gather(best[w], own.column(0), matrix(own.column(1)), sets[w][1], score)
            for w, (ids, _) in sets.items():
                if best[w].ids is not None:
                    best[w].cut()
                    yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kinds[1])).take(pa.array(best[w].query)), best[w].ids, pa.array(best[w].score)], names=names)

        return top_k(rows.mapInArrow(tidy(run), schema), k, name)
    cells, blocks = (-(-n // m) or 1 for n, m in ((rows.count(), CELL), (asked.count(), QUERIES)))
    left = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(cells)).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("query_id", "qvec", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"), F.pmod(F.xxhash64("query_id", "qvec"), F.lit(blocks)).cast("int").alias("block"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        wide = [t.column(c).combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, int) for t, c in ((a, "v"), (b, "qvec"))]
        for w in set(wide[0].tolist()) & set(wide[1].tolist()):
            x, q = (t.filter(pa.array(n == w)).combine_chunks() for t, n in zip((a, b), wide, strict=True))
            best = Best(k)
            gather(best, pa.concat_arrays(x.column("id").chunks), matrix(pa.concat_arrays(x.column("v").chunks)), matrix(pa.concat_arrays(q.column("qvec").chunks)), score)
            best.cut()
            if best.ids is not None:
                out.append(pa.table([pa.concat_arrays(q.column("query_id").chunks).take(pa.array(best.query)), best.ids, pa.array(best.score)], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.nulls(0, to_arrow_type(kinds[1])), pa.nulls(0, to_arrow_type(kinds[0])), pa.nulls(0, pa.float64())], names=names)

    return top_k(left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(_tidy_two(meet), schema), k, name)


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, score: Score = distances, name: str = "distance") -> DataFrame:
    """``query_id, id, distance, rank``: the ``k`` nearest rows of each query among ``probes`` lists; with ``exact``, among all rows."""
    n_lists = len(index.centroids)
    kinds = index.rows.schema["id"].dataType, queries.schema["query_id"].dataType
    schema = f"query_id {kinds[1].simpleString()}, id {kinds[0].simpleString()}, `{name}` double"
    if not n_lists:
        return top_k(queries.sparkSession.createDataFrame([], schema), k, name)
    asked = _asked(queries, index.centroids.shape[1])
    few = asked.limit(QUERIES + 1).collect()
    scan = _scan_few if len(few) <= QUERIES else _scan_many
    given = few if len(few) <= QUERIES else asked
    first = scan(index, given, k, score, name, kinds, schema, lambda far, tau: nearest_lists(far, probes), None)
    if not exact:
        return top_k(first, k, name)
    first = stage(top_k(first, k, name))
    tau = first.filter(F.col("rank") == k).select("query_id", F.col(name).alias("tau"))  # queries with fewer need all lists
    radius = index.radius

    def rest(far: np.ndarray, tau: np.ndarray) -> np.ndarray:
        open_ = np.maximum(far - radius[None, :], 0) ** 2 <= tau[:, None] * (1 + SLACK) + SLACK
        return open_ & ~nearest_lists(far, probes)

    second = scan(index, given, k, score, name, kinds, schema, rest, tau)
    return top_k(first.drop("rank").unionByName(second), k, name)


def probes_for(index: Index, recall: float = 0.9, k: int = 10, sample: int = 64, margin: float = 0.04) -> int:
    """The least number of lists that finds this share of the ``k`` nearest, and ``margin`` more, for a sample of ``sample`` rows; measured against the exact search."""
    if not len(index.centroids):
        return 1
    asked = stage(index.rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).select(F.monotonically_increasing_id().alias("query_id"), F.col("v").alias("qvec")))
    near = search(index, asked, k, exact=True).select("query_id", "id")
    lists = index.rows.select("id", "list").join(F.broadcast(near.select("id").distinct()), "id", "left_semi").distinct()  # sample * k ids at most
    order = {r["query_id"]: np.argsort(np.argsort(squared(np.array([r["qvec"]], float), index.centroids)[0], kind="stable")) for r in asked.collect()}
    places = [order[r["query_id"]][r["list"]] for r in near.join(lists, "id").collect()]
    return int(np.quantile(places, min(1.0, recall + margin), method="higher")) + 1 if places else 1


def unit(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Vectors of length one; those without a direction become null."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn(vec, F.when(norm > 0, F.transform(wide, lambda x: x / norm)))


def first_within(index: Index, queries: DataFrame, cosine: float) -> DataFrame:
    """``query_id, id``: the least id whose vector has this cosine with the query's, rounded to 6 digits, or more; both sides are of length one."""
    n_lists = len(index.centroids)
    kinds = index.rows.schema["id"].dataType, queries.schema["query_id"].dataType
    schema = f"query_id {kinds[1].simpleString()}, id {kinds[0].simpleString()}, score double"
    if not n_lists:
        return queries.sparkSession.createDataFrame([], schema).drop("score")
    asked = _asked(queries, index.centroids.shape[1])
    few = asked.limit(QUERIES + 1).collect()
    reach, radius = max(0.0, 2 - 2 * (cosine - 1e-6)), index.radius

    def near_enough(far: np.ndarray, tau: np.ndarray) -> np.ndarray:
        return np.maximum(far - radius[None, :], 0) ** 2 <= reach * (1 + SLACK) + SLACK

    def score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        c = (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1)))
        return np.where(c.round(6) >= cosine, 0.0, np.inf)

    scan = _scan_few if len(few) <= QUERIES else _scan_many
    found = scan(index, few if len(few) <= QUERIES else asked, 1, score, "score", kinds, schema, near_enough, reach, gather_first)
    return found.filter("score = 0").groupBy("query_id").agg(F.min("id").alias("id"))


def best_of_groups(vectors: DataFrame, exemplars: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``id, tag, similarity``: the greatest cosine of every row with each tag's exemplars (``tag, qvec``), in blocks; 0 where a side has no direction."""
    rows = usable(vectors, id_col, vec)
    known = usable(exemplars, "tag", "qvec").select(F.col("id").alias("tag"), F.col("v").alias("qvec"))
    kinds = rows.schema["id"].dataType, known.schema["tag"].dataType
    schema = f"id {kinds[0].simpleString()}, tag {kinds[1].simpleString()}, similarity double"

    def scores(ids: pa.Array, x: np.ndarray, tags: pa.Array, q: np.ndarray):
        code = tags.dictionary_encode(null_encoding="encode")
        order = np.argsort(code.indices.to_numpy(), kind="stable")
        starts = np.searchsorted(code.indices.to_numpy()[order], np.arange(len(code.dictionary)))
        with np.errstate(invalid="ignore", divide="ignore"):
            x, q = (np.nan_to_num(m / np.sqrt((m * m).sum(1))[:, None]) for m in (x, q[order]))
        for i in range(0, len(x), 1024):
            c = np.maximum.reduceat(x[i : i + 1024] @ q.T, starts, axis=1).round(6)
            n = len(c)
            yield [ids[i : i + 1024].take(pa.array(np.repeat(np.arange(n), len(starts)))), code.dictionary.take(pa.array(np.tile(np.arange(len(starts)), n))), pa.array(c.ravel() + 0.0)]

    names = ["id", "tag", "similarity"]
    few = known.limit(QUERIES + 1).collect()
    if len(few) <= QUERIES:
        widths = {w: [r for r in few if len(r["qvec"]) == w] for w in {len(r["qvec"]) for r in few}}

        def run(batches):
            for b in batches:
                lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False) if len(b) else np.zeros(0, int)
                for w in set(lengths.tolist()) & set(widths):
                    own = b.filter(pa.array(lengths == w))
                    for columns in scores(own.column(0), matrix(own.column(1)), pa.array([r["tag"] for r in widths[w]], to_arrow_type(kinds[1])), np.array([r["qvec"] for r in widths[w]], float)):
                        yield pa.RecordBatch.from_arrays(columns, names=names)

        return rows.mapInArrow(run, schema)
    cells, blocks = (-(-n // m) or 1 for n, m in ((rows.count(), CELL), (known.count(), QUERIES)))
    width = F.size("v").alias("width")
    left = rows.select("id", "v", width, F.pmod(F.xxhash64("id", "v"), F.lit(cells)).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = known.select("tag", F.col("qvec").alias("v")).select("tag", "v", width, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"), F.pmod(F.xxhash64("tag", "v"), F.lit(blocks)).cast("int").alias("block"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.nulls(0, to_arrow_type(kinds[0])), pa.nulls(0, to_arrow_type(kinds[1])), pa.nulls(0, pa.float64())], names=names)
        one = lambda t, c: pa.concat_arrays(t.column(c).chunks)
        return pa.concat_tables([pa.table(c, names=names) for c in scores(one(a, "id"), matrix(one(a, "v")), one(b, "tag"), matrix(one(b, "v")))])

    key = ("width", "cell", "block")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tidy_two(meet), schema).groupBy("id", "tag").agg(F.max("similarity").alias("similarity"))


def _tidy_two(meet: Callable) -> Callable:
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return tidy(lambda both: meet(*both))((a, b))

    return run


def nearest_lists(far: np.ndarray, probes: int) -> np.ndarray:
    """Which lists' centroids are the ``probes`` nearest of each query."""
    out = np.zeros(far.shape, bool)
    if len(far):
        np.put_along_axis(out, np.argsort(far, axis=1, kind="stable")[:, :probes], True, axis=1)
    return out


def _inside(index_gap: np.ndarray, far: np.ndarray, tau: np.ndarray | None) -> Inside | None:
    """Rows that may be as near as ``tau``: their distance to the centroid is not too different from the query's."""
    return None if tau is None else lambda rows: (index_gap[rows][:, None] - far[None, :]) ** 2 <= tau[None, :] * (1 + SLACK) + SLACK


def _scan_few(index: Index, few: list, k: int, score: Score, name: str, kinds: tuple, schema: str, choose: Callable, tau: DataFrame | float | None, gather: Callable = gather) -> DataFrame:
    """The queries go to the rows of their lists."""
    ids, q = pa.array([r["query_id"] for r in few], to_arrow_type(kinds[1])), np.array([r["qvec"] for r in few], float).reshape(len(few), index.centroids.shape[1])
    far = np.sqrt(squared(q, index.centroids)) if len(few) else np.zeros((0, len(index.centroids)))
    if isinstance(tau, DataFrame):
        known = {r["query_id"]: r["tau"] for r in tau.collect()}  # a row for each of the few
        most = np.array([known.get(r["query_id"], np.inf) for r in few])
    else:
        most = None if tau is None else np.full(len(few), tau)
    wanted = choose(far, most)
    lists = np.flatnonzero(wanted.any(0) & (index.size > 0))
    folders = sorted({int(x) % FOLDERS for x in lists})
    rows = index.rows.filter(F.col("folder").isin(folders)).filter(F.array_contains(F.lit([int(x) for x in lists]), F.col("list")) if len(lists) else F.lit(False))

    def run(batches):
        best = Best(k)
        for b in batches:
            own = b.column(0).to_numpy()
            for w in np.unique(own):
                part, asked = b.filter(pa.array(own == w)), np.flatnonzero(wanted[:, w])
                near = _inside(part.column(3).to_numpy(), far[asked, w], None if most is None else most[asked])
                gather(best, part.column(1), matrix(part.column(2)), q[asked], score, None if most is None else most[asked], near, asked)
        best.cut()
        if best.ids is not None:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.query)), best.ids, pa.array(best.score)], names=["query_id", "id", name])

    return rows.select("list", "id", "v", "gap").mapInArrow(tidy(run), schema)


def _scan_many(index: Index, asked: DataFrame, k: int, score: Score, name: str, kinds: tuple, schema: str, choose: Callable, tau: DataFrame | float | None, gather: Callable = gather) -> DataFrame:
    """Queries and cells of rows meet in a shuffle, list by list."""
    centroids = index.centroids
    if isinstance(tau, DataFrame):
        known = tau.select(F.col("query_id").alias("_query"), "tau")
        given = asked.join(known, F.col("query_id").eqNullSafe(F.col("_query")), "left").select("query_id", "qvec", F.coalesce("tau", F.lit(float("inf"))).alias("tau"))
    else:
        given = asked.withColumn("tau", F.lit(tau).cast("double"))

    def visits(batches):
        for b in batches:
            q = matrix(b.column(1))
            for i in range(0, len(q), 16):  # a row for each list
                far = np.sqrt(squared(q[i : i + 16], centroids))
                most = b.column(2)[i : i + 16].to_numpy(zero_copy_only=False)
                r, c = np.nonzero(choose(far, most))
                at = pa.array(r + i)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(far[r, c])], names=["list", "query_id", "qvec", "tau", "far"])

    going = stage(given.mapInArrow(tidy(visits), f"list int, query_id {kinds[1].simpleString()}, qvec array<double>, tau double, far double"))
    blocks = {r["list"]: -(-r["count"] // QUERIES) for r in going.groupBy("list").count().collect()}  # LISTS rows at most
    cells = [max(1, -(-int(n) // CELL)) for n in index.size]
    meta = F.broadcast(asked.sparkSession.createDataFrame([(int(w), n, cells[w]) for w, n in blocks.items()], "list int, blocks int, cells int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    some = lambda c, *of: F.pmod(F.xxhash64(*of), F.col(c)).cast("int")
    left = index.rows.join(meta, "list").select("list", some("cells", "id", "v").alias("cell"), every("blocks").alias("block"), "id", "v", "gap")
    right = going.join(meta, "list").select("list", every("cells").alias("cell"), some("blocks", "query_id", "qvec").alias("block"), "query_id", "qvec", "tau", "far")
    bounded = tau is not None

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        best = Best(k)
        if a.num_rows and b.num_rows:
            one = lambda t, c: pa.concat_arrays(t.column(c).chunks)
            most, far = (one(b, c).to_numpy(zero_copy_only=False) for c in ("tau", "far"))
            gather(best, one(a, "id"), matrix(one(a, "v")), matrix(one(b, "qvec")), score, most if bounded else None, _inside(one(a, "gap").to_numpy(), far, most if bounded else None))
            best.cut()
        if best.ids is None:
            return pa.table([pa.nulls(0, to_arrow_type(kinds[1])), pa.nulls(0, to_arrow_type(kinds[0])), pa.nulls(0, pa.float64())], names=["query_id", "id", name])
        return pa.table([one(b, "query_id").take(pa.array(best.query)), best.ids, pa.array(best.score)], names=["query_id", "id", name])

    key = ("list", "cell", "block")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tidy_two(meet), schema)
