"""From raw documents to token ids: five operators in a row, each stage written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import bpe, jaccard, mixing, pii, quality
from lorekeep.llm.queries import tokenizer_path
from lorekeep.staging import checkpoint_folder, packed


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(packed(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays."""
    return packed(jaccard.deduplicate(packed(docs), n=5, percent=80))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets."""
    return packed(pii.redact(packed(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents are taken whole, in part, or more than once."""
    docs = packed(docs)
    return packed(mixing.apply_mix(docs, mixing.mix(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return bpe.encode(packed(docs), tokenizer_path()).selectExpr("doc_id", "cast(size(ids) as bigint) as n_tokens", "ids")


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Estimation, bootstrapping and encoding cannot be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over ``documents``; each stage's rows are Parquet in the shared checkpoint folder until the next ones are written."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path.toString())
        docs = spark.read.parquet(path.toString())
        if before is not None:  # nothing reads it any more
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
        before = path
    return docs
