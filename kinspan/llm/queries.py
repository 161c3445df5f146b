"""The llm queries by name, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinspan.llm import chat, embedding_dedup, fingerprints, jaccard_join, mixing, packing, quality, suffix_dedup, token_files, toxicity

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1_mixing(spark, table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2_quality_classifier(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op3_suffix_dedup(spark, table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op4_fingerprints(spark, table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op5_ngram_jaccard_join(spark, table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op6_best_fit_packing(spark, table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op7_token_files(spark, table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op8_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op8_chat_preferences(spark, table(spark, sf_dir, "conversations"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.op10_embedding_dedup(spark, table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_quality_classifier, op3_suffix_dedup, op4_fingerprints, op5_ngram_jaccard_join, op6_best_fit_packing, op7_token_files, op8_chat_preferences, op9_toxicity, op10_embedding_dedup, pipeline)
}
ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op8_chat_preferences": chat.ORACLE,
    "op10_embedding_dedup": embedding_dedup.ORACLE,
}
