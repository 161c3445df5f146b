"""Profiles, consistency audits, parity and fingerprints of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(column, rows, nulls, empties, distinct_values, repeated_keys) of each column, from one pass."""
    total = [F.count("*").alias("rows"), (F.count(key) - F.count_distinct(key)).alias("repeated")]
    per = [x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}|n"), F.count_if(F.col(c) == "").alias(f"{c}|e"), F.count_distinct(c).alias(f"{c}|d"))]
    row = rows.agg(*total, *per)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}|n`").alias("nulls"), F.col(f"`{c}|e`").alias("empties"), F.col(f"`{c}|d`").alias("distinct_values")) for c in columns])
    return row.select("rows", "repeated", F.explode(each).alias("x")).select("x.column", "rows", "x.nulls", "x.empties", "x.distinct_values", F.col("repeated").alias("repeated_keys"))


def country_audit(truth: DataFrame, records: DataFrame) -> DataFrame:
    """True pairs by both sides' countries, and whether they agree; a null agrees with nothing."""
    a = records.select(F.col("entity_id").alias("entity_id_s1"), F.col("country").alias("country_s1"))
    b = records.select(F.col("entity_id").alias("entity_id_cand"), F.col("country").alias("country_cand"))
    rows = truth.join(a, "entity_id_s1", "left").join(b, "entity_id_cand", "left")
    return rows.groupBy("country_s1", "country_cand").agg(F.count("*").alias("pairs")).withColumn("agrees", F.coalesce(F.col("country_s1") == F.col("country_cand"), F.lit(False)))


def parity(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Rows that only one side has, or whose values differ by more than the tolerance."""
    a = old.select(*keys, *[F.col(v).alias(f"{v}_old") for v in values], F.lit(1).alias("in_old"))
    b = new.select(*keys, *[F.col(v).alias(f"{v}_new") for v in values], F.lit(1).alias("in_new"))
    both = a.join(b, keys, "full_outer")

    def differs(v: str) -> Column:
        x, y = F.col(f"{v}_old").cast("double"), F.col(f"{v}_new").cast("double")
        return (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))

    status = F.when(F.col("in_new").isNull(), "only_old").when(F.col("in_old").isNull(), "only_new").when(reduce(lambda p, q: p | q, [differs(v) for v in values]), "differs")
    return both.withColumn("status", status).where(F.col("status").isNotNull()).drop("in_old", "in_new")


def order_free_hash(rows: DataFrame) -> DataFrame:
    """Row count and a hash that does not depend on the order of rows: the sum of the rows' hashes, so that repeated rows count."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in rows.columns]
    row = F.conv(F.substring(F.md5(F.concat_ws(chr(31), *cells)), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("fingerprint"))


def cardinality(matches: DataFrame, candidates: DataFrame, s1: DataFrame) -> DataFrame:
    """Rows of both outputs and of S1, and whether they are equal, one row."""
    sizes = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, df in (("s1_rows", s1), ("match_rows", matches), ("candidate_rows", candidates))]
    row = reduce(DataFrame.unionByName, sizes).groupBy().pivot("k", ["s1_rows", "match_rows", "candidate_rows"]).agg(F.first("n"))
    return row.withColumn("equal", (F.col("s1_rows") == F.col("match_rows")) & (F.col("s1_rows") == F.col("candidate_rows")))


def integrity(pool: DataFrame) -> DataFrame:
    """Rows, repeated pairs, null keys and unknown sources of a candidate pool, one row."""
    return pool.agg(
        F.count("*").alias("rows"), (F.count("*") - F.count_distinct("entity_id_s1", "entity_id_cand")).alias("repeated_or_null"),
        F.count_if(F.col("entity_id_cand").isNull()).alias("null_candidates"), F.count_if(~F.col("candidate_source").isin("S2", "S3")).alias("bad_sources"),
    )


def scale_estimate(seconds: float, entities: int, full: int) -> float:
    """Seconds that ``full`` entities take at the measured rate."""
    return seconds / max(1, entities) * full
