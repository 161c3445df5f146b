"""Evaluation: macro F0.5, recall, coverage, volume, frontiers, misses, rescue. Every mean is over all S1 records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspan.operators.retrieval import CHANNELS, FLAGS, LEGACY, RANKING, ranked

BUDGETS = (3, 5, 8, 10, 12, 15)


def hit_counts(s1: DataFrame, pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Per S1: predicted, true and common pairs, zero where there are none."""
    both = pairs.select("entity_id_s1", "entity_id_cand").distinct().withColumn("p", F.lit(1)).join(truth.withColumn("t", F.lit(1)), ["entity_id_s1", "entity_id_cand"], "full_outer")
    per = both.groupBy("entity_id_s1").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("n_hit"))
    return s1.join(per.withColumnRenamed("entity_id_s1", "entity_id"), "entity_id", "left").fillna(0, ["n_pred", "n_true", "n_hit"])


def f05(n_pred: Column, n_true: Column, n_hit: Column) -> Column:
    p, r = n_hit / n_pred, n_hit / n_true
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when((n_pred == 0) | (n_true == 0) | (n_hit == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def macro_f05(counts: DataFrame) -> DataFrame:
    """One row: entities and their mean F0.5 (0 without entities)."""
    return counts.agg(F.count("*").alias("entities"), F.round(F.coalesce(F.avg(f05(F.col("n_pred"), F.col("n_true"), F.col("n_hit"))), F.lit(0.0)), 6).alias("macro_f05"))


def f05_by_slice(counts: DataFrame, slices: list[str]) -> DataFrame:
    """Mean F0.5 over all and by each slice column."""
    score = f05(F.col("n_pred"), F.col("n_true"), F.col("n_hit"))
    return counts.withColumn("f", score).groupingSets([[], *[[c] for c in slices]], *slices).agg(F.count("*").alias("entities"), F.round(F.avg("f"), 6).alias("macro_f05"))


def pool_metrics(counts: DataFrame) -> DataFrame:
    """Recall, coverage, candidate volume and noise of a candidate pool, one row."""
    n, t, h = F.col("n_pred"), F.col("n_true"), F.col("n_hit")
    spread = F.percentile(n, F.array(*[F.lit(q) for q in (0.5, 0.9, 0.95, 0.99)]))
    row = counts.agg(
        F.count("*").alias("entities"), F.sum(n).alias("candidates"), F.sum(t).alias("gt_pairs"), F.sum(h).alias("found"),
        F.round(F.sum(h) / F.sum(t), 6).alias("pair_recall"),
        F.round(F.avg(F.when(t > 0, (h == t).cast("double"))), 6).alias("full_coverage"),
        F.round(F.avg(F.when(t > 0, (h > 0).cast("double"))), 6).alias("any_coverage"),
        F.round(F.avg(n), 6).alias("mean_candidates"), spread.alias("q"), F.max(n).alias("max_candidates"),
        F.round(F.avg((n == 0).cast("double")), 6).alias("share_without"),
        F.round(F.avg(F.when(t == 0, n)), 6).alias("mean_candidates_zero_match"),
        F.round(F.avg(F.when(t == 0, (n == 0).cast("double"))), 6).alias("share_clean_zero_match"),
    )
    named = {f"p{int(p * 100)}_candidates": F.round(F.get("q", i), 6) for i, p in enumerate((0.5, 0.9, 0.95, 0.99))}
    return row.withColumns(named).drop("q")


def volume_distribution(counts: DataFrame) -> DataFrame:
    """How many S1 have 0, 1, 2..10 or more candidates."""
    n = F.col("n_pred")
    band = F.when(n == 0, "0").when(n == 1, "1").when(n <= 10, "2-10").otherwise(">10")
    return counts.groupBy(band.alias("band")).agg(F.count("*").alias("entities"), F.sum(n).alias("candidates"))


def frontier(pool: DataFrame, truth: DataFrame, s1: DataFrame, order=RANKING, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """Recall and full coverage at each budget of candidates per S1, and without one (budget 0)."""
    placed = ranked(pool, order).select("entity_id_s1", "entity_id_cand", "candidate_rank")
    hits = truth.join(placed, ["entity_id_s1", "entity_id_cand"], "left").join(s1.select(F.col("entity_id").alias("entity_id_s1")), "entity_id_s1", "left_semi")
    each = hits.select("entity_id_s1", F.col("candidate_rank").alias("place"), F.explode(F.array(*[F.lit(b) for b in (*budgets, 0)])).alias("budget"))
    found = F.coalesce((F.col("budget") == 0) & F.col("place").isNotNull() | (F.col("place") <= F.col("budget")), F.lit(False)).cast("int")
    per = each.groupBy("budget", "entity_id_s1").agg(F.sum(found).alias("h"), F.count("*").alias("t"))
    return per.groupBy("budget").agg(F.round(F.sum("h") / F.sum("t"), 6).alias("recall"), F.round(F.avg((F.col("h") == F.col("t")).cast("double")), 6).alias("full_coverage"))


def ranking_delta(pool: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """Recall of the legacy and the current ranking at each budget."""
    old = frontier(pool, truth, s1, LEGACY).select("budget", F.col("recall").alias("legacy_recall"))
    return frontier(pool, truth, s1).select("budget", "recall").join(old, "budget").withColumn("delta", F.round(F.col("recall") - F.col("legacy_recall"), 6))


def rank_histogram(pool: DataFrame, truth: DataFrame, most: int = 15) -> DataFrame:
    """True pairs by rank, '>most' as most + 1, with cumulative recall over all true pairs."""
    placed = ranked(pool).select("entity_id_s1", "entity_id_cand", "candidate_rank")
    hits = truth.join(placed, ["entity_id_s1", "entity_id_cand"]).groupBy(F.least(F.col("candidate_rank"), F.lit(most + 1)).alias("rank")).agg(F.count("*").alias("positives"))
    total = truth.agg(F.count("*")).scalar()
    upto = F.sum("positives").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hits.select("rank", "positives", F.round(upto / total, 6).alias("cumulative_recall"))


def miss_types(pool: DataFrame, truth: DataFrame, most: int = 15) -> DataFrame:
    """True pairs that the pruned pool lacks: never retrieved, or pruned."""
    placed = ranked(pool).select("entity_id_s1", "entity_id_cand", "candidate_rank")
    joined = truth.join(placed, ["entity_id_s1", "entity_id_cand"], "left").where(F.col("candidate_rank").isNull() | (F.col("candidate_rank") > most))
    return joined.select("entity_id_s1", "entity_id_cand", F.when(F.col("candidate_rank").isNull(), "retrieval_miss").otherwise("pruning_miss").alias("miss_type"))


def with_truth(pool: DataFrame, truth: DataFrame) -> DataFrame:
    return pool.join(truth.withColumn("hit", F.lit(1)), ["entity_id_s1", "entity_id_cand"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def channel_contribution(pool: DataFrame, truth: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Per channel: candidates, true pairs, and those that no other channel has."""
    rows = with_truth(pool, truth)
    count = sum((F.col(c) for c in channels[1:]), F.col(channels[0]))
    named = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("on")) for c in channels])
    each = rows.select("hit", count.alias("k"), F.explode(named).alias("c")).where(F.col("c.on") == 1)
    return each.groupBy(F.col("c.channel").alias("channel")).agg(F.count("*").alias("candidates"), F.sum("hit").alias("gt_found"), F.sum(F.when(F.col("k") == 1, F.col("hit")).otherwise(0)).alias("unique_rescue"))


def channel_overlap(pool: DataFrame, channels: tuple[str, ...] = FLAGS) -> DataFrame:
    """Pairs by the number of channels that found them."""
    count = sum((F.col(c) for c in channels[1:]), F.col(channels[0]))
    return pool.groupBy(count.alias("channels")).agg(F.count("*").alias("pairs"))


def rescue(found: DataFrame, baseline: DataFrame, truth: DataFrame) -> DataFrame:
    """What a pool adds to a baseline: new candidates, new true pairs, and their ratio."""
    new = found.select("entity_id_s1", "entity_id_cand").distinct().join(baseline, ["entity_id_s1", "entity_id_cand"], "left_anti")
    row = with_truth(new, truth).agg(F.count("*").alias("extra_candidates"), F.coalesce(F.sum("hit"), F.lit(0)).alias("gt_rescued"))
    return row.withColumn("efficiency", F.round(F.when(F.col("extra_candidates") > 0, F.col("gt_rescued") / F.col("extra_candidates")).otherwise(0.0), 6))


def collisions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys occur 1, 2, 3-5, 6-10 or more times, with percentiles of the multiplicity, one row."""
    n = F.col("n")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    q = F.percentile(n, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    row = counts.agg(F.count("*").alias("keys"), F.count_if(n == 1).alias("once"), F.count_if(n == 2).alias("twice"), F.count_if(n.between(3, 5)).alias("from_3_to_5"), F.count_if(n.between(6, 10)).alias("from_6_to_10"), F.count_if(n > 10).alias("over_10"), q.alias("q"), F.max(n).alias("most"))
    return row.withColumns({f"p{p}": F.round(F.get("q", i), 6) for i, p in enumerate((50, 95, 99))}).drop("q")


def volume_summary(counts: DataFrame) -> DataFrame:
    """Mean, median and greatest number of candidates over all S1, and the shares with 0, 1, over 1 and over 10, one row."""
    n = F.col("n_pred")
    share = lambda cond, name: F.round(F.avg(cond.cast("double")), 6).alias(name)
    return counts.agg(F.round(F.avg(n), 6).alias("mean"), F.round(F.percentile(n, F.lit(0.5)), 6).alias("median"), F.max(n).alias("most"), share(n == 0, "share_0"), share(n == 1, "share_1"), share(n > 1, "share_over_1"), share(n > 10, "share_over_10"))


def truth_places(pool: DataFrame, truth: DataFrame, profile: DataFrame, order=RANKING) -> DataFrame:
    """Every true pair with its rank (null where not retrieved), its S1's country, match bucket and source pattern, and its source."""
    placed = ranked(pool, order).select("entity_id_s1", "entity_id_cand", "candidate_rank")
    marks = profile.select(F.col("entity_id").alias("entity_id_s1"), "country", "match_bucket", "source_pattern")
    return truth.distinct().join(placed, ["entity_id_s1", "entity_id_cand"], "left").join(marks, "entity_id_s1").withColumn("source", F.substring_index("entity_id_cand", "-", 1))


def sliced_frontier(pool: DataFrame, truth: DataFrame, profile: DataFrame, slices: tuple[str, ...] = ("country", "match_bucket", "source"), budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """Recall at each budget (0: without one) over all and by each slice of the true pairs."""
    each = truth_places(pool, truth, profile).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in (*budgets, 0)])))
    found = F.coalesce((F.col("budget") == 0) & F.col("candidate_rank").isNotNull() | (F.col("candidate_rank") <= F.col("budget")), F.lit(False))
    sets = [["budget"], *[["budget", c] for c in slices]]
    return each.groupingSets(sets, "budget", *slices).agg(F.count("*").alias("gt_pairs"), F.round(F.avg(found.cast("double")), 6).alias("recall"))


def recall_by_profile(pool: DataFrame, truth: DataFrame, profile: DataFrame, most: int = 15) -> DataFrame:
    """Recall of the pruned pool by source pattern and by match bucket."""
    hit = F.coalesce(F.col("candidate_rank") <= most, F.lit(False)).cast("double")
    rows = truth_places(pool, truth, profile)
    return rows.groupingSets([["source_pattern"], ["match_bucket"]], "source_pattern", "match_bucket").agg(F.count("*").alias("gt_pairs"), F.round(F.avg(hit), 6).alias("recall"))


def lost_to_pruning(pool: DataFrame, truth: DataFrame, most: int = 15) -> DataFrame:
    """True pairs in the pool and in the pruned pool, and their difference, one row."""
    placed = ranked(pool).join(truth.distinct(), ["entity_id_s1", "entity_id_cand"], "left_semi")
    row = placed.agg(F.count("*").alias("in_pool"), F.count_if(F.col("candidate_rank") <= most).alias("in_pruned"))
    return row.withColumn("lost", F.col("in_pool") - F.col("in_pruned"))


def coverage_by_sources(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of S1 all of whose true pairs were found: of those in S2, in S3, and of S1 with true pairs in both."""
    found = pairs.select("entity_id_s1", "entity_id_cand", F.lit(1).alias("hit")).distinct()
    true = truth.distinct().withColumn("source", F.substring_index("entity_id_cand", "-", 1))
    per = true.join(found, ["entity_id_s1", "entity_id_cand"], "left").groupBy("entity_id_s1").agg(*[F.count_if((F.col("source") == s) & extra).alias(f"{n}{s}") for s in ("S2", "S3") for n, extra in (("t", F.lit(True)), ("h", F.col("hit").isNotNull()))])
    full = lambda s: F.col(f"t{s}") == F.col(f"h{s}")
    share = lambda some, ok, name: F.round(F.avg(F.when(some, ok.cast("double"))), 6).alias(name)
    two, three = F.col("tS2") > 0, F.col("tS3") > 0
    return per.agg(share(two, full("S2"), "s2_full_coverage"), share(three, full("S3"), "s3_full_coverage"), share(two & three, full("S2") & full("S3"), "both_full_coverage"))
