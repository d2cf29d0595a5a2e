"""Sharding by vector bin packing.

Groups of equal texts are the items.  Each has a vector (bytes, tokens, rows);
each shard has the same capacity, an equal part of every total.  Items are
placed, largest first, on the shard where the dot product of the item with the
shard's residual capacity is highest, so the three measures fill up jointly.

At scale the items are too many to place one by one, so small groups are first
gathered, by hash of the text, into a fixed number of parcels per shard; only
the parcels' vectors reach the driver.  A group of copies above half a shard in
any measure is cut, by hash of the id, into parts below that size, so that a
hot group does not outgrow a shard.  The number of parcels depends on the number
of shards alone, never on the number of documents.

Defined results: null text counts as empty (size 8, no tokens) and equals the
empty text; a null id is a value of its own; repeated rows are placed row by
row; an empty table gives an empty result; only the id and text columns are read,
so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import stage

PARCELS_PER_SHARD = 256
ROW_OVERHEAD = 8
ROWS_PER_CELL = 50_000


def place(items: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each item; ``items`` is (n, 3) and holds bytes, tokens, rows."""
    total = items.sum(axis=0)
    unit = items / np.where(total > 0, total, 1.0) * n_shards
    residual = np.ones((n_shards, items.shape[1]))
    out = np.zeros(len(items), np.int32)
    for i in np.lexsort((np.arange(len(items)), -unit.max(axis=1))):
        s = int(np.argmax(residual @ unit[i]))
        residual[s] -= unit[i]
        out[i] = s
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, size, tokens, CRC-32 and a 128-bit hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text, F.lit(2)).alias("h2"),
    )


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, tokens, text_crc32, shard, slot`` for every row of ``docs``."""
    spark = docs.sparkSession
    facts = stage(measured(docs, id_col, text_col))
    measures = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")]
    total = facts.agg(*measures).first()
    part_limit = [max(1.0, (total[k] or 0) / n_shards / 2) for k in ("b", "t", "n")]
    # at most 2 * 3 * n_shards groups can be above half a shard in one of three measures
    over = F.greatest(*[F.ceil(F.col(k) / F.lit(m)) for k, m in zip(("b", "t", "n"), part_limit, strict=True)])
    heavy = facts.groupBy("h1", "h2").agg(*measures).withColumn("parts", over).filter("parts > 1 and n > 1").select("h1", "h2", "parts").collect()
    n_light, bases, at = n_shards * PARCELS_PER_SHARD, [], n_shards * PARCELS_PER_SHARD
    for r in sorted(heavy):
        parts = min(int(r["parts"]), 4 * n_shards)
        bases.append((r["h1"], r["h2"], at, parts))
        at += parts
    cut = spark.createDataFrame(bases, "h1 long, h2 long, base int, parts int")
    parcel = F.coalesce(
        F.col("base") + F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.col("parts")).cast("int"),
        F.pmod(F.col("h1"), F.lit(n_light)).cast("int"),
    )
    routed = facts.join(F.broadcast(cut), ["h1", "h2"], "left").withColumn("parcel", parcel)
    parcels = sorted(routed.groupBy("parcel").agg(*measures).collect())
    vectors = np.array([[r["b"], r["t"], r["n"]] for r in parcels], float).reshape(-1, 3)
    placed = [(r["parcel"], int(s)) for r, s in zip(parcels, place(vectors, n_shards), strict=True)]
    sharded = routed.join(F.broadcast(spark.createDataFrame(placed, "parcel int, shard int")), "parcel")

    cells = max(8, -(-int(total["n"]) // (n_shards * ROWS_PER_CELL)))
    sharded = sharded.withColumn("cell", F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(cells)))
    filled = sharded.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = filled.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "h1", "h2")
    ranked = sharded.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(first, ["shard", "cell"]).select(
        "doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot")
    )
