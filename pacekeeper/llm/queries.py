"""The registered queries: thin bindings of the operators to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pacekeeper.llm import bpe, class_lm, decontaminate, exact_dedup, langid, line_dedup, secrets, sharding, simhash, substring_dedup
from pacekeeper.llm.base import table

N_SHARDS = 24


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fold(key: str, folds: int):
    """crc32 of the key as text, modulo the folds; a null key is the text "null"."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")) % folds


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * N_SHARDS)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    return langid.identify(docs, model).select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 4 == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_line_dedup, op4_simhash, op5_bpe, op6_substring_dedup, op7_exact_dedup, op8_class_lm, op9_secrets, op10_language_id)}
