"""The named queries of the operators, over whole tables, and the SQL beside those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm import bpe, decontaminate, extract, language, manifest, minhash, pii, quality, ranked, sharding, substrings, token_store, warc
from pulse.session import shared_dir

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LARGEST_WORD_ID = 49_407
SHARDS = 16
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_store(spark: SparkSession, folder: str) -> DataFrame:
    with open(WORD_TOKENIZER, encoding="utf-8") as file:
        definition = file.read()
    files, place = token_store.stored(spark, table(spark, folder, "documents"), definition, LARGEST_WORD_ID)
    return token_store.read(files, place, with_ids=False).drop("ids")


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    names = spark.range(SHARDS).select(F.format_string("shard-%03d", "id").alias("shard"))
    ids = table(spark, folder, "documents").select("doc_id")
    return sharding.placed(ids, ["doc_id"], sharding.slot_table(spark, names))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"), shared_dir(spark, "archive")).drop("url")


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(table(spark, folder, "documents")).drop("spans")


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.deduplicated(table(spark, folder, "documents"), with_text=False).drop("kept_text")


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(table(spark, folder, "documents"))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), BYTE_RANKS, public_tokenizers.PATTERN, with_ids=False).drop("ids")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "verdict", "whole_ratio"
    )


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), minhash.Settings(shingle=4))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(ranked.indexed(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    now, changed = manifest.lowered_text()
    proofs = manifest.proved(table(spark, folder, "documents"), now=now, changed=changed, with_siblings=False)
    return proofs.drop("pos", "path", "siblings")


def op13_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extracted(table(spark, folder, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_store,
        op2_sharding,
        op3_warc,
        op4_language_id,
        op5_substring_dedup,
        op6_pii,
        op7_byte_bpe,
        op8_decontamination,
        op9_quality_rules,
        op10_minhash,
        op11_ranked_search,
        op12_manifest,
        op13_html_extraction,
    )
}
