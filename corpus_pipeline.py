"""The corpus pipeline: documents go through five stages, each written as Parquet and read by the next.

Quality rules drop bad texts, MinHash keeps one document of each group of near copies, decontamination drops documents
with a benchmark passage, personal data is masked, and the rest is encoded. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulse.llm import bpe, decontaminate, minhash, pii, quality
from pulse.session import hadoop_path, scratch, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids as little-endian 32-bit integers."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Compression, trained trees and byte pair merges are nothing that SQL expresses; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows for the documents of a folder of tables.

    Each stage is a table in ``folder``, a new one if none is given; what a stage wrote besides is removed with it.
    A run that is given the folder of a broken one goes on after the last stage that was written whole.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = folder or shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        system, done = hadoop_path(spark, f"{folder}/{name}/_SUCCESS")
        if not system.exists(done):
            with scratch(spark):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
