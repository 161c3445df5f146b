"""Scans and sinks: delimited sources, truth lists, folders of shards, result files."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinspan.functions import normalize
from kinspan.operators import audits

SOURCE = T.StructType([T.StructField(c, T.StringType(), c != "entity_id") for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("matched_entity_ids", T.StringType())])


def read_source(spark: SparkSession, path: str, quoted: bool = True) -> DataFrame:
    """A tab-separated source; missing-value literals become null. ``quoted=False`` takes quotes and literals as they are."""
    reader = spark.read.schema(SOURCE).option("sep", "\t").option("header", True)
    if not quoted:
        return reader.option("quote", "").csv(path)
    df = reader.csv(path)
    return df.select(*[F.when(~F.col(c).isin(*normalize.MISSING_LITERALS), F.col(c)).alias(c) for c in df.columns])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(TRUTH).option("sep", "\t").option("header", True).csv(path)
    return df.withColumn("matched_entity_ids", F.coalesce("matched_entity_ids", F.lit("")))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(entity_id_s1, entity_id_cand) from comma lists."""
    return truth.select(F.col("source1_entity_id").alias("entity_id_s1"), F.explode(normalize.id_list(F.col("matched_entity_ids"))).alias("entity_id_cand")).distinct()


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """A columnar scan; projection and filter reach the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder of shards as one table, checked against its contract; hidden and temporary files are skipped."""
    df = spark.read.parquet(path)
    found = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in schema if f.name not in found]
    if missing:
        raise ValueError(f"shards lack {missing}")
    wrong = [f"{f.name}: {found[f.name].simpleString()} for {f.dataType.simpleString()}" for f in schema if found[f.name] != f.dataType]
    if wrong:
        raise ValueError(f"shards hold {wrong}")
    return df.select(*[f.name for f in schema])


def read_ids(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """The first column of a delimited file, as distinct ids."""
    df = spark.read.option("sep", sep).option("header", True).csv(path)
    return df.select(F.col(df.columns[0]).alias("entity_id")).distinct()


def read_folds(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """A fold manifest; a repeated or null id is an error when the rows are read, another fingerprint than the given one before."""
    df = spark.read.parquet(path)
    if fingerprint is not None and audits.order_free_hash(df).first()["fingerprint"] != fingerprint:
        raise ValueError("fold manifest: its rows are not those of the fingerprint")
    n = F.count("*").over(_by("source1_entity_id"))
    bad = (n > 1) | F.col("source1_entity_id").isNull() | F.col("fold_id").isNull()
    return df.withColumn("fold_id", F.when(bad, F.raise_error(F.lit("fold manifest: repeated or null id"))).otherwise(F.col("fold_id")))


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Columnar output; the committer makes the folder whole or absent."""
    df.write.mode("overwrite").partitionBy(*partition_by).option("compression", "snappy").parquet(path)


def write_lists(df: DataFrame, path: str) -> None:
    """Tab-separated output with a header; an empty list is an empty, unquoted field."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """A one-row table as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def contract(df: DataFrame, categories: dict[str, str]) -> str:
    """The schema as JSON, each field with its category: A inference, B target, C diagnostic. A field without one is an error."""
    unknown = [c for c in df.columns if categories.get(c) not in ("A", "B", "C")]
    if unknown:
        raise ValueError(f"no category for {unknown}")
    fields = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "category": categories[f.name]} for f in df.schema]
    return json.dumps({"version": 1, "fields": fields}, indent=1)


def entity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business-like records from ``documents``: three sources by doc_id, names and addresses from a text's first words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    words = F.split(F.trim("text"), r"\s+", 19)  # 18 words, and the rest in one piece
    source = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"))
    return docs.select(
        F.concat_ws("-", source, F.col("doc_id").cast("string")).alias("entity_id"), source.alias("source"), F.col("lang").alias("country"),
        F.array_join(F.slice(words, 1, 6), " ").alias("business_name"), F.array_join(F.slice(words, 7, 10), " ").alias("business_address"),
        normalize.numeric_tokens(F.col("text")).alias("addr_numeric_tokens"), F.when(F.size(words) >= 18, F.md5(F.concat("lang", F.lit(" "), F.array_join(F.slice(words, 17, 2), " ")))).alias("truth_key"),
    )


def normalized(entities: DataFrame) -> DataFrame:
    """Name and address views of every record, by the full Unicode definitions."""
    return normalize.exact_views(normalize.exact_views(entities, "business_name", "name"), "business_address", "addr")


def process_sources(raw: dict[str, DataFrame]) -> DataFrame:
    """All sources in one normalized table with a ``source`` column."""
    parts = [df.withColumn("source", F.lit(name)).withColumn("addr_numeric_tokens", normalize.numeric_tokens(F.col("business_address"))) for name, df in raw.items()]
    return normalized(reduce(DataFrame.unionByName, parts))
