"""Match decisions and their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspan.operators.pairs import violations
from kinspan.operators.retrieval import RULES, UNIQUE


def policy_d0(flags: DataFrame) -> DataFrame:
    """Pairs that any name-and-address rule found."""
    return flags.where(F.greatest(*[F.col(c) for c in RULES]) == 1).select("entity_id_s1", "entity_id_cand")


def policy_d1(flags: DataFrame, records: DataFrame) -> DataFrame:
    """D0, and unique names where either address is empty."""
    address = records.select("entity_id", (F.coalesce("addr_norm_clean", F.lit("")) == "").alias("bare"))
    a = address.select(F.col("entity_id").alias("entity_id_s1"), F.col("bare").alias("bare_a"))
    b = address.select(F.col("entity_id").alias("entity_id_cand"), F.col("bare").alias("bare_b"))
    rows = flags.join(a, "entity_id_s1").join(b, "entity_id_cand")
    sure = F.greatest(*[F.col(c) for c in RULES]) == 1
    return rows.where(sure | ((F.col(UNIQUE) == 1) & (F.col("bare_a") | F.col("bare_b")))).select("entity_id_s1", "entity_id_cand")


def best_policy(scores: DataFrame) -> DataFrame:
    """The policy with the highest macro_f05 as given (unrounded scores decide better); of equals the first by name."""
    return scores.orderBy(F.desc("macro_f05"), "policy").limit(1)


def id_lists(s1: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row per S1 with its ids, sorted and joined by commas; none gives an empty string."""
    lists = pairs.groupBy("entity_id_s1").agg(F.array_join(F.array_sort(F.collect_set("entity_id_cand")), ",").alias(column))
    out = s1.select(F.col("entity_id").alias("entity_id_s1")).join(lists, "entity_id_s1", "left")
    return out.select(F.col("entity_id_s1").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def match_counts(lists: DataFrame) -> DataFrame:
    """How many S1 have no, one or several matches."""
    n = F.when(F.col("matched_entity_ids") == "", 0).otherwise(F.size(F.split("matched_entity_ids", ",")))
    return lists.agg(F.count("*").alias("entities"), F.count_if(n == 0).alias("zero"), F.count_if(n == 1).alias("single"), F.count_if(n > 1).alias("multi"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("pairs"))


def submission_violations(matches: DataFrame, candidates: DataFrame, s1: DataFrame, known: DataFrame) -> DataFrame:
    """(rule, n) of broken output rules: rows per S1, ids in a list, prefixes, known ids, and matches among the candidates."""
    expected = s1.select(F.col("entity_id").alias("source1_entity_id"))
    items = matches.where(F.col("matched_entity_ids") != "").select("source1_entity_id", F.explode(F.split("matched_entity_ids", ",")).alias("id"))
    allowed = candidates.where(F.col("candidate_entity_ids") != "").select("source1_entity_id", F.explode(F.split("candidate_entity_ids", ",")).alias("id"))
    return violations([
        ("missing_s1", expected.join(matches, "source1_entity_id", "left_anti")),
        ("extra_s1", matches.join(expected, "source1_entity_id", "left_anti")),
        ("duplicate_s1", matches.groupBy("source1_entity_id").count().where(F.col("count") > 1)),
        ("duplicate_id", items.groupBy("source1_entity_id", "id").count().where(F.col("count") > 1)),
        ("self_match", items.where(F.col("id") == F.col("source1_entity_id"))),
        ("bad_prefix", items.where(~F.col("id").startswith("S2-") & ~F.col("id").startswith("S3-"))),
        ("unknown_id", items.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti")),
        ("not_a_candidate", items.join(allowed, ["source1_entity_id", "id"], "left_anti")),
    ])


def file_violations(lines: DataFrame, s1: DataFrame, header: tuple[str, str]) -> DataFrame:
    """(rule, severity, n) for the raw lines of a result file (column ``value``), before any parsing."""
    body = lines.where(F.col("value") != "\t".join(header))
    cells = body.withColumn("cells", F.split("value", "\t"))
    rows = cells.where(F.size("cells") == 2).select(F.get("cells", 0).alias("source1_entity_id"), F.get("cells", 1).alias("ids"))
    items = rows.where(F.col("ids") != "").select("source1_entity_id", F.explode(F.split("ids", ",")).alias("id"))
    expected = s1.select(F.col("entity_id").alias("source1_entity_id"))
    found = violations([
        ("malformed_row", cells.where(F.size("cells") != 2)),
        ("duplicate_s1", rows.groupBy("source1_entity_id").count().where(F.col("count") > 1)),
        ("missing_s1", expected.join(rows, "source1_entity_id", "left_anti")),
        ("extra_s1", rows.join(expected, "source1_entity_id", "left_anti")),
        ("duplicate_id", items.groupBy("source1_entity_id", "id").count().where(F.col("count") > 1)),
        ("bad_prefix", items.where(~F.col("id").startswith("S2-") & ~F.col("id").startswith("S3-"))),
    ])
    return found.select("rule", F.lit("error").alias("severity"), "n")
