"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import reach
from ..staging import packed
from . import bpe, codes, fingerprints, jaccard, lm, mixing, packing, pii, quality, sharding, substrings, toxicity, txlog


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus.  An input of fewer splits than cores (one file of one row group is one) is spread over them first, very many splits are packed."""
    reach(spark)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if (cores := spark.sparkContext.defaultParallelism) > rows._jdf.queryExecution().toRdd().getNumPartitions():
        return rows.repartition(cores)
    return packed(rows)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.shard(documents(spark, sf_dir), n_shards=24)
    return packed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), n=4, percent=85)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return toxicity.score(documents(spark, sf_dir), labels, {"abusive_junk": toxic & ~good, "abusive_fluent": toxic & good, "toxic": toxic})


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", pii.spans_column().alias("spans"), F.size("added").cast("long").alias("n_added"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(documents(spark, sf_dir))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeated(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "passes")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers' files are; the only place that knows it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path())


def op11_txlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("_toxic")).distinct()
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    kind, key = h % 23, F.floor(h / 100) % 300
    action = F.when(kind <= 1, "commit").when(kind == 2, "abort").when(kind <= 4, "savepoint").when(kind <= 6, "rollback").otherwise("change")
    weight = F.crc32(F.concat_ws(":", key.cast("string"), F.col("text")).cast("binary"))
    rows = documents(spark, sf_dir).select("doc_id", "source", action.alias("action"), key.alias("key"), F.when(F.col("text").isNotNull(), weight).alias("weight"))
    rows = rows.join(toxic.hint("merge"), F.col("doc_id") == F.col("_toxic"), "left").withColumn("weight", F.when(F.col("_toxic").isNull(), F.col("weight")))
    log = txlog.reassemble(rows, "doc_id", "source", "action", "key", "weight")
    undone = log.changes.where("fate <> 'commit'").select(F.col("fate").alias("kind"), F.col("place").alias("id"), F.col("by_place").alias("n"), F.col("key").alias("value"))
    return txlog.states(log).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), F.col("n_keys").alias("n"), F.col("weight").alias("value")).unionByName(undone)


def _crc32(batches):
    for b in batches:
        ids = b.column(b.schema.get_field_index("ids"))
        flat, cuts = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        found = [zlib.crc32(flat[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length")), pa.array(found, pa.int64()), *(b.column(c) for c in ("doc_tokens", "sequence_id", "offset"))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer_path(), size=2048)
    return pieces.mapInArrow(_crc32, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, spread over the cores if their file has fewer splits."""
    reach(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    if (cores := spark.sparkContext.defaultParallelism) > rows._jdf.queryExecution().toRdd().getNumPartitions():
        return rows.repartition(cores)
    return rows


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = codes.encode(embeddings(spark, sf_dir), carry=("label",))
    digest = hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
    hexes = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codes.with_group_error(rows, "label").select("vec_id", hexes.alias("code"), "error", F.col("group_error").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds one after the other, every part against every entry."""
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"split AS (SELECT rid, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) r(p))",
        f"b0 AS (SELECT p, rid - 1 AS e, x AS c FROM split WHERE rid <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT rid, p, any_value(x) AS x, min_by(e, d * {entries} + e) AS e, min(d) AS d FROM (SELECT s.rid, s.p, s.x, b.e, list_sum(list_transform(list_zip(s.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM split s JOIN b{k} b USING (p)) GROUP BY rid, p)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e)")
            steps.append(f"b{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))")
    steps += [
        f"coded AS (SELECT rid, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)",
        f"book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), book"


def oracle_sql() -> dict[str, str]:
    return {"op13_codes": _codes_sql()}
