"""Labelled pairs, their diagnostics and invariants, folds, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspan.functions import normalize

KEY = ("entity_id_s1", "candidate_source", "entity_id_cand")


def labelled(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """label 1 for true pairs; an S1 without truth has none. No candidate is added or lost."""
    hits = truth.select("entity_id_s1", "entity_id_cand").distinct().withColumn("label", F.lit(1))
    return candidates.join(hits, ["entity_id_s1", "entity_id_cand"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def with_folds(pairs: DataFrame, folds: DataFrame, countries: DataFrame) -> DataFrame:
    """Adds fold and country per S1; a missing fold is an error, a missing country is null."""
    named = folds.select(F.col("entity_id").alias("entity_id_s1"), F.col("fold_id").alias("fold"))
    where = countries.select(F.col("entity_id").alias("entity_id_s1"), "country")
    joined = pairs.join(named, "entity_id_s1", "left").join(where, "entity_id_s1", "left")
    return joined.withColumn("fold", F.when(F.col("fold").isNull(), F.raise_error(F.lit("pair without fold"))).otherwise(F.col("fold")))


def diagnostics(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Per pair: how many true matches its S1 has, how many were retrieved, how many are missing."""
    counts = truth.groupBy("entity_id_s1").agg(F.count("*").alias("gt_match_count"))
    found = F.sum("label").over(Window.partitionBy("entity_id_s1"))
    joined = pairs.join(counts, "entity_id_s1", "left").withColumns({"gt_match_count": F.coalesce("gt_match_count", F.lit(0)), "retrieved_positive_count": found})
    return joined.withColumn("missing_positive_count", F.greatest(F.col("gt_match_count") - F.col("retrieved_positive_count"), F.lit(0)))


def entity_manifest(pairs: DataFrame, truth: DataFrame, s1: DataFrame, folds: DataFrame) -> DataFrame:
    """One row per S1: candidates, positives and truth by source, match bucket, missing positives."""
    per = pairs.groupBy("entity_id_s1").agg(
        F.count("*").alias("candidate_count"), F.sum("label").alias("positive_candidate_count"),
        F.count_if(F.col("candidate_source") == "S2").alias("retrieved_s2_count"), F.count_if(F.col("candidate_source") == "S3").alias("retrieved_s3_count"),
    )
    true = truth.groupBy("entity_id_s1").agg(F.count("*").alias("gt_match_count"), F.count_if(F.col("entity_id_cand").startswith("S2-")).alias("gt_s2_count"), F.count_if(F.col("entity_id_cand").startswith("S3-")).alias("gt_s3_count"))
    base = s1.select(F.col("entity_id").alias("entity_id_s1"), "country").join(folds.select(F.col("entity_id").alias("entity_id_s1"), F.col("fold_id").alias("fold")), "entity_id_s1")
    out = base.join(per, "entity_id_s1", "left").join(true, "entity_id_s1", "left").fillna(0)
    out = out.withColumn("has_retrieved_positive", (F.col("positive_candidate_count") > 0).cast("int")).withColumn("match_bucket", normalize.match_bucket(F.col("gt_match_count")))
    return out.withColumn("missing_positive_count", F.greatest(F.col("gt_match_count") - F.col("positive_candidate_count"), F.lit(0)))


def retrieval_audit(manifest: DataFrame) -> DataFrame:
    """Pair recall, any and full coverage over all, by country and by match bucket, for S1 with truth."""
    some = manifest.where(F.col("gt_match_count") > 0)
    recall = F.round(F.sum("positive_candidate_count") / F.sum("gt_match_count"), 6)
    grouped = some.groupingSets([[], ["country"], ["match_bucket"]], "country", "match_bucket").agg(
        F.count("*").alias("entities"), F.sum("gt_match_count").alias("gt_pairs"), recall.alias("pair_recall"),
        F.round(F.avg((F.col("positive_candidate_count") > 0).cast("double")), 6).alias("any_coverage"),
        F.round(F.avg((F.col("positive_candidate_count") >= F.col("gt_match_count")).cast("double")), 6).alias("full_coverage"),
    )
    return grouped


def audit_by_source(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pair recall, any and full coverage of the S1 with truth in a source, source by source."""
    true = truth.select("entity_id_s1", "entity_id_cand", F.substring_index("entity_id_cand", "-", 1).alias("source")).distinct()
    found = pairs.where(F.col("label") == 1).select("entity_id_s1", "entity_id_cand", F.lit(1).alias("hit")).distinct()
    per = true.join(found, ["entity_id_s1", "entity_id_cand"], "left").groupBy("source", "entity_id_s1").agg(F.count("*").alias("t"), F.count("hit").alias("h"))
    return per.groupBy("source").agg(
        F.count("*").alias("entities"), F.sum("t").alias("gt_pairs"), F.round(F.sum("h") / F.sum("t"), 6).alias("pair_recall"),
        F.round(F.avg((F.col("h") > 0).cast("double")), 6).alias("any_coverage"), F.round(F.avg((F.col("h") == F.col("t")).cast("double")), 6).alias("full_coverage"),
    )


def label_distribution(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs, positives, their rate, and how many true pairs were missed."""
    totals = pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("label"), F.lit(0)).alias("positives"))
    true = truth.agg(F.count("*").alias("gt_pairs"))
    return totals.withColumn("gt_pairs", true.scalar()).select("pairs", "positives", "gt_pairs", F.round(F.col("positives") / F.col("pairs"), 6).alias("positive_rate"), F.round(1 - F.col("positives") / F.col("gt_pairs"), 6).alias("miss_rate"))


def pair_violations(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(rule, n) for broken invariants; rules that hold have no row."""
    checks = [
        ("duplicate_key", pairs.groupBy(*KEY).count().where(F.col("count") > 1)),
        ("null_key", pairs.where(F.col("entity_id_s1").isNull() | F.col("entity_id_cand").isNull())),
        ("two_folds", pairs.groupBy("entity_id_s1").agg(F.count_distinct("fold").alias("n")).where(F.col("n") > 1)),
        ("missing_fold", pairs.where(F.col("fold").isNull())),
        ("unknown_label", pairs.where(~F.col("label").isin(0, 1))),
        ("wrong_label", labelled(pairs.withColumnRenamed("label", "given"), truth).where(F.col("label") != F.col("given"))),
        ("bad_source", pairs.where(~F.col("entity_id_cand").startswith(F.concat("candidate_source", F.lit("-"))))),
    ]
    return violations(checks)


def violations(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for rule, bad in checks:
        part = bad.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("n") > 0)


def hash_order(seed: int, key: str = "entity_id") -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))


def match_profile(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """S1 with n_true_matches, match_bucket and source_pattern."""
    ids = truth.groupBy(F.col("entity_id_s1").alias("entity_id")).agg(F.collect_set("entity_id_cand").alias("ids"))
    joined = s1.select("entity_id", "country").join(ids, "entity_id", "left")
    listed = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select("entity_id", "country", F.size(listed).alias("n_true_matches"), normalize.match_bucket(F.size(listed)).alias("match_bucket"), normalize.source_pattern(listed).alias("source_pattern"))


HASH_DIGITS = 2


def hash_places(rows: DataFrame, strata: list[str], seed: int) -> DataFrame:
    """Adds ``place``, a row's number from 1 in its stratum's hash order, and ``n``, the stratum's size.

    A stratum may hold most rows, so tasks order buckets of it (the first digits
    of the hash) and a table of bucket sizes, a row per stratum and bucket, says
    how many rows come before.
    """
    marked = rows.withColumn("_hash", hash_order(seed)).withColumn("_bucket", F.substring("_hash", 1, HASH_DIGITS))
    sizes = marked.groupBy(*strata, "_bucket").agg(F.count("*").alias("_size"))
    w = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("_size").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"_before": before, "n": F.sum("_size").over(w)}).drop("_size")
    inner = F.row_number().over(Window.partitionBy(*strata, "_bucket").orderBy("_hash", "entity_id"))
    joined = marked.withColumn("_inner", inner).alias("x").join(sizes.alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*strata, "_bucket")])
    return joined.select(*[F.col(f"x.`{c}`") for c in rows.columns], (F.col("x._inner") + F.col("y._before")).alias("place"), F.col("y.n").alias("n"))


def stratified_folds(profile: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """A fold per S1, the strata balanced within one.

    Strata are country and bucket; where the smallest has fewer than k members
    country alone; where that fails too, all together.
    """
    by_both = profile.groupBy("country", "match_bucket").count().agg(F.min("count").alias("n"))
    by_country = profile.groupBy("country").count().agg(F.min("count").alias("n"))
    stratum = F.when(by_both.scalar() >= k, F.concat_ws("|", "country", "match_bucket")).when(by_country.scalar() >= k, F.col("country")).otherwise(F.lit("ALL"))
    rows = hash_places(profile.withColumn("stratum", stratum), ["stratum"], seed)
    return rows.withColumn("fold_id", ((F.col("place") - 1) % k).cast("int")).drop("stratum", "place", "n")


def fold_violations(folds: DataFrame, k: int) -> DataFrame:
    present = folds.select("fold_id").distinct()
    return violations([
        ("repeated_id", folds.groupBy("entity_id").count().where(F.col("count") > 1)),
        ("null", folds.where(F.col("entity_id").isNull() | F.col("fold_id").isNull())),
        ("out_of_range", folds.where((F.col("fold_id") < 0) | (F.col("fold_id") >= k))),
        ("absent_fold", present.sparkSession.range(k).select(F.col("id").cast("int").alias("fold_id")).join(present, "fold_id", "left_anti")),
    ])


def split(rows: DataFrame, fraction: float = 0.2, seed: int = 42, strata: tuple[str, ...] = ("country",)) -> DataFrame:
    """Adds ``part``: validation for the first round(fraction * n) of each stratum in hash order, else train."""
    placed = hash_places(rows, list(strata), seed)
    return placed.withColumn("part", F.when(F.col("place") <= F.floor(F.col("n") * fraction + 0.5), "validation").otherwise("train")).drop("place", "n")


def sized_sample(rows: DataFrame, stratum: str, size: int, seed: int = 42) -> DataFrame:
    """The first min(n, floor(size * share)) of each stratum in hash order, share being the stratum's part of all rows."""
    total = rows.agg(F.count("*").alias("n")).scalar()
    placed = hash_places(rows, [stratum], seed).withColumn("_all", total)
    return placed.where(F.col("place") <= F.least(F.col("n"), F.floor(F.lit(size) * F.col("n") / F.col("_all")))).drop("place", "n", "_all")


def stratified_sample(rows: DataFrame, stratum: str, fraction: float, seed: int = 42) -> DataFrame:
    """The first round(fraction * n) of each stratum in hash order."""
    return split(rows, fraction, seed, (stratum,)).where(F.col("part") == "validation").drop("part")
