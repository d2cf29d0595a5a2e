"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are seats: sources get them by highest quotients of their targets, none
above its cap, then each source's seats go the same way to its shards (documents
dealt by hash, to as many shards as the source's rows ask for).  A shard's words, in a seeded order of its documents, form a
stream.  Its quota is met to the word by whole passes over the stream and, for
the rest, by a seeded selection of the stream's blocks, the last of them in part.
Blocks are sized by shard, so that small sources are cut as evenly as large ones.

The driver holds one row per source and per (source, shard) cell, a cell being some
50,000 rows or more: at most ``MAX_CELLS`` beside one per source.  More than
``MAX_SOURCES`` sources raise.  All word counts and cuts stay in Spark.

Defined results: null text has size 0 and takes nothing; a null source is a
source of its own, ordered last; repeated rows are mixed row by row, and rows equal
in id, source and text are taken together when the mix is applied; an empty table gives
an empty result; only the three named columns are read.
"""

from __future__ import annotations

import heapq
import math
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import stage

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCKS = 1 << 18
CELL_BLOCKS = 64
ROWS_PER_CELL = 50_000
LEAST_CELLS = 256
MAX_CELLS = 200_000
MAX_SOURCES = 1_000_000


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients vote / (2 k + 1); ties go to the earlier party."""
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    got = [math.floor(v * seats / total + 0.5) for v in votes]
    left = seats - sum(got)
    if left > 0:
        heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v > 0]
        heapq.heapify(heap)
        for _ in range(left):
            _, i = heap[0]
            got[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif left < 0:
        heap = [(votes[i] / (2 * g - 1), -i) for i, g in enumerate(got) if g]
        heapq.heapify(heap)
        for _ in range(-left):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def targets(sizes: list[int], weights: list[float], repeats: int = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight, none above ``repeats`` times its size; what is cut off is shared again."""
    total, fixed = float(sum(sizes)), {i: 0.0 for i, s in enumerate(sizes) if s == 0}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        now = {i: rest * weights[i] / weight for i in free}
        over = [i for i in free if now[i] > repeats * sizes[i]]
        if not over:
            return [fixed[i] if i in fixed else now[i] for i in range(len(sizes))]
        fixed.update({i: float(repeats * sizes[i]) for i in over})


def quotas(goal: list[float], caps: list[int], words: int) -> list[int]:
    """``words`` by highest quotients of ``goal``, none above its cap; what a cap cuts off goes to the others."""
    got, free = [0] * len(goal), list(range(len(goal)))
    while free:
        now = sainte_lague([goal[i] for i in free], words)
        over = {i for i, g in zip(free, now, strict=True) if g > caps[i]}
        for i, g in zip(free, now, strict=True):
            got[i] = caps[i] if i in over else g
        if not over:
            break
        words -= sum(caps[i] for i in over)
        free = [i for i in free if i not in over]
    return got


def _stride(n: int, salt: int) -> int:
    """A step coprime to ``n`` near the golden section, which spreads chosen blocks evenly."""
    a = max(1, round(n * 0.6180339887) + salt % 7)
    while math.gcd(a, n) != 1:
        a += 1
    return a % n or 1


def cell_plan(words: int, quota: int, block: int, salt: int) -> tuple[int, ...]:
    """``passes, extra, rest, n, step, start, width`` that take exactly ``quota`` words of a stream of ``words``.

    Block ``j`` of ``n`` has the rank ``(j step + start) mod n``.  Ranks below ``extra`` are taken whole, and the
    first ``rest`` words of the block of rank ``extra``.  The stream's last block may be shorter than ``width``.
    """
    if not words:
        return 0, 0, 0, 1, 1, 0, 1
    width = max(1, min(block, words // CELL_BLOCKS))
    n = -(-words // width)
    step, start = _stride(n, salt), salt % n
    passes, left = divmod(quota, words)
    short = n * width - words  # what the last block lacks
    rank = ((n - 1) * step + start) % n
    if left >= (rank + 1) * width - short:
        left += short
    elif left >= rank * width:  # the part-block is the last block
        return passes, rank, left - rank * width, n, step, start, width
    return passes, left // width, left % width, n, step, start, width


KEYS = ("__lk_key", "__lk_key2")


def row_keys(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Two hashes of 64 bits that tell rows of different id, source or text apart."""
    columns = [F.col(id_col), F.col(source_col), F.col(text_col)]
    return [F.xxhash64(*columns).alias(KEYS[0]), F.xxhash64(F.lit(31), *columns).alias(KEYS[1])]


def mix(
    docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS, blocks: int = BLOCKS,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, passes, cuts`` for every row, and its keys for ``apply_mix``.

    The mix takes a document ``passes`` times as a whole and once more the words of
    ``cuts``, an array of ``(from, to)`` word positions counted from 0, ``to`` exclusive.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    facts = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("order"), F.xxhash64(F.col(text_col)).alias("tie"), *row_keys(id_col, text_col, source_col),
        )
    )
    sums = facts.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    n_rows = sum(r["n"] for r in sums)
    per_cell = max(1, min(ROWS_PER_CELL, n_rows // LEAST_CELLS), n_rows // MAX_CELLS)
    dealt = spark.createDataFrame([(r["source"], -(-r["n"] // per_cell)) for r in sums], "_of string, _shards long")
    facts = facts.join(F.broadcast(dealt), F.col("source").eqNullSafe(F.col("_of")))  # at most MAX_SOURCES rows
    facts = facts.withColumn("shard", F.pmod(F.col("order"), F.col("_shards")).cast("int")).drop("_of", "_shards")
    cells: dict = {}
    for r in facts.groupBy("source", "shard").agg(F.sum("size").alias("size")).collect():
        cells.setdefault(r["source"], {})[r["shard"]] = r["size"]

    sizes = [r["size"] for r in sums]
    total = sum(sizes)
    block = max(1, total // blocks)
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sums))], repeats) if total else [0.0] * len(sums)
    seats = quotas(goal, [repeats * s for s in sizes], total)
    plan = []
    for r, t, quota in zip(sums, goal, seats, strict=True):
        own = sorted(cells[r["source"]].items())
        for (s, words), q in zip(own, sainte_lague([float(w) for _, w in own], quota), strict=True):
            salt = zlib.crc32(f"{seed}:{r['source']}:{s}".encode())
            plan.append((r["source"], s, r["size"], t, *cell_plan(words, q, block, salt)))
    plan_df = spark.createDataFrame(plan, "source string, shard int, source_size long, target double, passes long, extra long, rest long, n long, step long, start long, width long")
    stream = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = facts.withColumn("hi", F.sum("size").over(stream)).withColumn("lo", F.col("hi") - F.col("size"))
    placed = placed.withColumnsRenamed({"source": "_source", "shard": "_shard"})
    joined = placed.join(F.broadcast(plan_df), F.col("_source").eqNullSafe(F.col("source")) & (F.col("_shard") == F.col("shard")))  # a row per cell
    width = F.col("width")
    first, last = F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)

    def cut(j):
        rank = (j * F.col("step") + F.col("start")) % F.col("n")
        words = F.when(rank < F.col("extra"), width).when(rank == F.col("extra"), F.col("rest")).otherwise(F.lit(0))
        return F.struct(
            (F.greatest(j * width, F.col("lo")) - F.col("lo")).alias("from"),
            (F.least(j * width + words, F.col("hi")) - F.col("lo")).alias("to"),
        )

    cuts = F.filter(F.transform(F.sequence(first, last), cut), lambda c: c["from"] < c["to"])
    none = F.expr("cast(array() as array<struct<`from`:bigint,`to`:bigint>>)")
    out = joined.withColumn("cuts", F.when(F.col("size") > 0, cuts).otherwise(none))
    taken = F.col("passes") * F.col("size") + F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + c["to"] - c["from"])
    return out.select("doc_id", F.col("_source").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"), "passes", "cuts", *KEYS)


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each document ``passes`` times whole, and once more the words of its cuts.

    Rows are matched on id, source and text.  Rows equal in these are one document that is taken as often as they were
    together; of their other columns those of some row stay.  ``n_chars``, if there is one, follows the text.
    """
    # names of its own, so that no column of the documents can be meant by mistake
    keys = [F.col(k).alias(f"_{k}") for k in KEYS]
    plan = mixed.select(*keys, F.col("passes").cast("int").alias("passes"), "cuts").groupBy(*[f"_{k}" for k in KEYS])
    plan = plan.agg(F.sum("passes").cast("int").alias("__lk_passes"), F.collect_list(F.when(F.size("cuts") > 0, F.col("cuts"))).alias("__lk_cuts"))
    own = docs.withColumns({f"_{k}": c for k, c in zip(KEYS, row_keys(id_col, text_col, source_col), strict=True)}).dropDuplicates([f"_{k}" for k in KEYS])
    both = own.join(plan, [f"_{k}" for k in KEYS])
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def part(w):
        return lambda cuts: F.array_join(F.flatten(F.transform(cuts, lambda c: F.slice(w, (c["from"] + 1).cast("int"), (c["to"] - c["from"]).cast("int")))), " ")

    # the one-element array binds the words once; a plain reference inside the lambda would cut the text anew for each piece
    parts = F.element_at(F.transform(F.array(words), lambda w: F.transform("__lk_cuts", part(w))), 1)
    whole = F.array_repeat(F.col(text_col), F.col("__lk_passes"))
    texts = F.when(F.size("__lk_cuts") > 0, F.concat(whole, parts)).otherwise(whole)
    out = both.withColumn("__lk_text", F.explode(texts)).withColumn(text_col, F.col("__lk_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast("long"))
    return out.select(*docs.columns)
