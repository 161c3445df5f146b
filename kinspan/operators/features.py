"""Pair-local and group-relative features.

Similarities are computed in double and stored as float; relative features are
computed on the stored values, so ties are ties of what is stored. A similarity
with a missing side is null, a count is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspan.functions import normalize, similarity

PASSED = (
    "retrieved_exact", "retrieved_name_word", "retrieved_address_word", "retrieved_rare", "retrieved_numeric",
    "exact_name_address_clean", "exact_name_address_accent", "exact_name_address_punct", "unique_exact_name",
    "name_word_score", "name_word_rank", "address_word_score", "address_word_rank", "rare_token_overlap_count", "rarest_shared_token_df",
    "shared_numeric_count", "numeric_conflict", "retrieval_channel_count", "is_exact", "best_lexical_rank", "both_name_address",
)
#: Columns that no model may see.
FORBIDDEN = ("label", "fold", "country", "gt_match_count", "retrieved_positive_count", "missing_positive_count", "match_bucket", "entity_id_s1", "entity_id_cand", "candidate_source")


def with_texts(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Adds both sides' texts and number lists; ids that are unknown have null texts."""
    lists = records.select("source", "entity_id", "name_norm_clean", "addr_norm_clean", F.filter(F.split("addr_numeric_tokens", " "), lambda t: t != "").alias("numbers"))
    s1 = lists.where(F.col("source") == "S1").select(F.col("entity_id").alias("entity_id_s1"), F.col("name_norm_clean").alias("name_a"), F.col("addr_norm_clean").alias("address_a"), F.col("numbers").alias("numbers_a"))
    cand = lists.where(F.col("source") != "S1").select(F.col("source").alias("candidate_source"), F.col("entity_id").alias("entity_id_cand"), F.col("name_norm_clean").alias("name_b"), F.col("addr_norm_clean").alias("address_b"), F.col("numbers").alias("numbers_b"))
    return pairs.join(s1, "entity_id_s1", "left").join(cand, ["candidate_source", "entity_id_cand"], "left")


def missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def text_features(df: DataFrame, p: str) -> DataFrame:
    """Features of the texts ``{p}_a`` and ``{p}_b``."""
    a, b = F.col(f"{p}_a"), F.col(f"{p}_b")
    df = df.withColumns({f"_{p}_ok": ~missing(a) & ~missing(b), f"_{p}_x": normalize.word_set(a), f"_{p}_y": normalize.word_set(b)})
    ok, x, y = (F.col(f"_{p}_{n}") for n in ("ok", "x", "y"))
    shared, n_x, n_y = F.size(F.array_intersect(x, y)), F.size(x), F.size(y)

    def score(value: Column) -> Column:
        return F.when(ok, value).cast("float")

    def count(value: Column) -> Column:
        return F.when(ok, value).otherwise(0).cast("smallint")

    made = {
        f"{p}_exact_clean": F.coalesce(ok & (a == b), F.lit(False)).cast("tinyint"),
        f"{p}_char_ratio": score(similarity.indel_ratio(a, b)),
        f"{p}_token_set_ratio": score(similarity.token_set_ratio(a, b)),
        f"{p}_token_jaccard": score(similarity.jaccard(x, y)),
        f"{p}_shared_token_count": count(shared),
        f"{p}_s1_token_count": count(n_x),
        f"{p}_cand_token_count": count(n_y),
        f"{p}_length_ratio": score(similarity.length_ratio(a, b)),
        f"{p}_char_length_diff": score(F.abs(F.char_length(a) - F.char_length(b))),
        f"{p}_s1_missing": missing(a).cast("tinyint"),
        f"{p}_cand_missing": missing(b).cast("tinyint"),
        f"{p}_both_missing": (missing(a) & missing(b)).cast("tinyint"),
    }
    if p == "name":
        made |= {
            "name_token_sort_ratio": score(similarity.token_sort_ratio(a, b)),
            "name_token_containment_s1_in_cand": score(similarity.containment(x, y)),
            "name_token_containment_cand_in_s1": score(similarity.containment(y, x)),
            "name_unmatched_token_count": count(F.greatest(n_x, n_y) - shared),
        }
    return df.withColumns(made).drop(f"_{p}_ok", f"_{p}_x", f"_{p}_y")


def numeric_features(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    df = df.withColumns({"_na": F.array_distinct(F.coalesce("numbers_a", none)), "_nb": F.array_distinct(F.coalesce("numbers_b", none))})
    a, b = F.col("_na"), F.col("_nb")
    n_a, n_b, shared, union = F.size(a), F.size(b), F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return df.withColumns({
        "numeric_s1_count": n_a.cast("smallint"), "numeric_cand_count": n_b.cast("smallint"), "shared_numeric_count_pair": shared.cast("smallint"),
        "numeric_jaccard": F.when(union > 0, shared / union).cast("float"),
        "numeric_overlap_ratio_s1": F.when(n_a > 0, shared / n_a).cast("float"),
        "numeric_overlap_ratio_cand": F.when(n_b > 0, shared / n_b).cast("float"),
        "numeric_exact_set_match": ((n_a > 0) & (n_a == n_b) & (shared == n_a)).cast("tinyint"),
        "numeric_agreement_flag": (shared > 0).cast("tinyint"),
        "numeric_conflict_flag": ((n_a > 0) & (n_b > 0) & (shared == 0)).cast("tinyint"),
        "numeric_s1_missing": (n_a == 0).cast("tinyint"), "numeric_cand_missing": (n_b == 0).cast("tinyint"), "numeric_both_missing": ((n_a == 0) & (n_b == 0)).cast("tinyint"),
    }).drop("_na", "_nb")


def relative_features(df: DataFrame) -> DataFrame:
    """Ranks, gaps and counts within an S1's candidates; nulls rank behind all values."""
    w = Window.partitionBy("entity_id_s1")
    made = {"candidate_count": F.count("*").over(w).cast("smallint"), "count_exact_name_candidates": F.sum("name_exact_clean").over(w).cast("smallint")}
    for p in ("name", "address"):
        x = F.col(f"{p}_char_ratio")
        best = F.max(x).over(w)
        place = F.rank().over(w.orderBy(F.desc_nulls_last(x)))
        made |= {
            f"{p}_similarity_rank_within_s1": place.cast("float"),
            f"{p}_gap_from_best": (best - x).cast("float"),
            f"{p}_ratio_to_best": F.when(best > 0, x / best).cast("float"),
            f"count_candidates_with_higher_{p}_sim": (place - 1).cast("smallint"),
        }
    return df.withColumns(made)


def pair_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """All features of every pair: as many rows as ``pairs``, texts dropped."""
    df = numeric_features(text_features(text_features(with_texts(pairs, records), "name"), "address"))
    return relative_features(df).drop("name_a", "name_b", "address_a", "address_b", "numbers_a", "numbers_b")


TEXT = ("exact_clean", "char_ratio", "token_set_ratio", "token_jaccard", "shared_token_count", "length_ratio", "char_length_diff", "s1_missing", "cand_missing", "both_missing")
RELATIVE = ("{}_similarity_rank_within_s1", "{}_gap_from_best", "{}_ratio_to_best", "count_candidates_with_higher_{}_sim")
#: What a model may see, and nothing else.
ALLOWED = (
    *PASSED, *[f"{p}_{n}" for p in ("name", "address") for n in TEXT], "name_s1_token_count", "name_cand_token_count",
    "name_token_sort_ratio", "name_token_containment_s1_in_cand", "name_token_containment_cand_in_s1", "name_unmatched_token_count",
    "numeric_s1_count", "numeric_cand_count", "shared_numeric_count_pair", "numeric_jaccard", "numeric_overlap_ratio_s1", "numeric_overlap_ratio_cand",
    "numeric_exact_set_match", "numeric_agreement_flag", "numeric_conflict_flag", "numeric_s1_missing", "numeric_cand_missing", "numeric_both_missing",
    "candidate_count", "count_exact_name_candidates", *[n.format(p) for n in RELATIVE for p in ("name", "address")],
)


def firewall(allowed: tuple[str, ...] = ALLOWED, forbidden: tuple[str, ...] = FORBIDDEN) -> None:
    """A forbidden column on the list of allowed ones is an error."""
    leaks = sorted(set(allowed) & set(forbidden))
    if leaks:
        raise ValueError(f"leaking columns {leaks}")


firewall()


def model_columns(df: DataFrame) -> list[str]:
    """What a model may see of a table: the allowed columns, all of which must be there."""
    absent = sorted(set(ALLOWED) - set(df.columns))
    if absent:
        raise ValueError(f"features lack {absent}")
    return [c for c in df.columns if c in ALLOWED]


def schema_faults(df: DataFrame) -> list[str]:
    """Features that are absent, of a type that no model takes, or neither features, keys nor known extras."""
    kinds = dict(df.dtypes)
    known = {*ALLOWED, *FORBIDDEN, "address_s1_token_count", "address_cand_token_count", "candidate_rank"}
    out = [f"absent: {c}" for c in ALLOWED if c not in kinds]
    out += [f"type of {c}: {kinds[c]}" for c in ALLOWED if c in kinds and kinds[c] not in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    return out + [f"unknown: {c}" for c in kinds if c not in known]
