"""Corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``:

1. quality: documents that importance resampling rejects go.
2. jaccard: of each group of near-equal documents the smallest doc_id stays.
3. suffix: byte strings of 200 that occur more than once go from the texts;
   n_chars follows. Documents stay, some with an empty text.
4. mixing: documents go or repeat until each source has its share.
5. packing: every document's tokens, in sequences of at most 1,024.

Nulls, empty texts, repeated rows and empty tables are handled as the operators
of each stage say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm import jaccard_join, mixing, packing, quality, suffix_dedup
from kinspan.llm.queries import BYTE_BPE, table, tokenizer_path
from kinspan.llm.staging import staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.resample(docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_group(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op6_best_fit_packing(spark, docs, tokenizer_path(BYTE_BPE))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier, hashes and tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
