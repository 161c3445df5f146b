"""Jobs: ingestion, the pair and feature datasets, submissions and the audits over them.

A job checks what goes in and what comes out, writes tables as resumable stages
(:class:`kinspan.plans.linkage.Stages`) and leaves a manifest that says what made
each. Broken contracts raise; what is merely suspicious is logged.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinspan.operators import audits, decide, features, metrics, pairs, retrieval
from kinspan.plans.linkage import Stages
from kinspan.sources import tables

PROVENANCE = ("retrieved_exact", "retrieved_name_word", "retrieved_address_word", "retrieved_rare", "retrieved_numeric", "retrieval_channel_count")


class ContractError(ValueError):
    """A table that breaks its contract."""


def logger(name: str = "kinspan", level: int = logging.INFO) -> logging.Logger:
    """The named logger with one handler, however often it is asked for."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    log.setLevel(level)
    return log


def none_of(found: DataFrame, what: str) -> None:
    """Raises where a table of violations has rows."""
    rows = [r.asDict() for r in found.limit(20).collect()]
    if rows:
        raise ContractError(f"{what}: {rows}")


def same_size(before: DataFrame, after: DataFrame, what: str) -> None:
    a, b = before.count(), after.count()
    if a != b:
        raise ContractError(f"{what}: {a} rows became {b}")


# --- ingestion -------------------------------------------------------------------------------


def process_source(raw: DataFrame, name: str, stages: Stages) -> DataFrame:
    """One source's records with all text views, as a stage: ids are there and unique, and no record is gained or lost."""
    known = tables.SOURCE.names
    absent = [c for c in known if c not in raw.columns]
    if absent:
        raise ContractError(f"{name} lacks {absent}")
    none_of(pairs.violations([("null_id", raw.where(F.col("entity_id").isNull())), ("repeated_id", raw.groupBy("entity_id").count().where(F.col("count") > 1))]), name)
    mark = audits.order_free_hash(raw.select(*known)).first()["fingerprint"]
    out = stages.run(f"source_{name}", {"source": name, "rows": mark}, lambda: tables.process_sources({name: raw.select(*known)}))
    same_size(raw, out, name)
    return out


def processed_dataset(raw: dict[str, DataFrame], stages: Stages) -> tuple[dict[str, DataFrame], DataFrame]:
    """All sources processed, and a manifest of name, rows and fingerprint."""
    made = {name: process_source(df, name, stages) for name, df in raw.items()}
    rows = [(name, *audits.order_free_hash(df).first()) for name, df in made.items()]
    return made, stages.spark.createDataFrame(rows, "name string, rows long, fingerprint string")


# --- candidates ------------------------------------------------------------------------------


def shard_violations(final: DataFrame, union: DataFrame, most: int) -> DataFrame:
    """(rule, n): more than ``most`` candidates of an S1, pairs that the union lacks, repeated pairs."""
    key = ["entity_id_s1", "entity_id_cand"]
    return pairs.violations([
        ("over_budget", final.groupBy("entity_id_s1").count().where(F.col("count") > most)),
        ("not_in_union", final.join(union, key, "left_anti")),
        ("duplicate_key", final.groupBy(*key).count().where(F.col("count") > 1)),
    ])


def smoke_limit(s1: DataFrame, n: int) -> DataFrame:
    """The first ``n`` S1 records by id."""
    return s1.orderBy("entity_id").limit(n)


def sorted_chunks(s1: DataFrame, chunks: int) -> DataFrame:
    """S1 records with the number of their chunk, chunks being ranges of ids of about equal size."""
    return s1.repartitionByRange(chunks, "entity_id").sortWithinPartitions("entity_id").withColumn("chunk", F.spark_partition_id())


def synthetic_rows(spark: SparkSession, rows: int, columns: int, each: int, seed: int = 42) -> DataFrame:
    """(row, column, value) of a sparse matrix with ``each`` entries a row, for measurements; entries that meet are added up."""
    cells = spark.range(rows).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    column = F.pmod(F.xxhash64("id", "k", F.lit(seed)), F.lit(columns))
    value = F.pmod(F.xxhash64("id", "k", F.lit(seed + 1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return cells.select(F.col("id").alias("row"), column.alias("column"), value.alias("value")).groupBy("row", "column").agg(F.sum("value").alias("value"))


# --- pair and feature datasets ---------------------------------------------------------------


def check_candidates(candidates: DataFrame) -> list[str]:
    """Raises where a key column is absent; warns, and returns, where evidence columns are."""
    absent = [c for c in pairs.KEY if c not in candidates.columns]
    if absent:
        raise ContractError(f"candidates lack {absent}")
    unknown = [c for c in PROVENANCE if c not in candidates.columns]
    if unknown:
        logger().warning("candidates have no %s", unknown)
    return unknown


def label_shard(candidates: DataFrame, truth: DataFrame, folds: DataFrame, s1: DataFrame) -> DataFrame:
    """Candidates with label, fold, country and diagnostics in the stored types, as many rows as came in."""
    check_candidates(candidates)
    joined = pairs.with_folds(pairs.labelled(candidates, truth), folds, s1)
    return retrieval.downcast(pairs.diagnostics(joined, truth))


def pair_dataset(candidates: DataFrame, truth: DataFrame, folds: DataFrame, s1: DataFrame, stages: Stages, settings: dict | None = None) -> dict[str, DataFrame]:
    """The labelled pairs, the S1 manifest and the audits, as stages that run again only if an input changed."""
    inputs = {n: audits.order_free_hash(df).first()["fingerprint"] for n, df in (("candidates", candidates), ("truth", truth), ("folds", folds))} | (settings or {})
    made = stages.run("pairs", inputs, lambda: label_shard(candidates, truth, folds, s1))
    same_size(candidates, made, "pairs")
    none_of(pairs.pair_violations(made, truth), "pairs")
    out = {"pairs": made}
    steps: dict[str, Callable[[], DataFrame]] = {
        "manifest": lambda: pairs.entity_manifest(made, truth, s1, folds),
        "audit": lambda: pairs.retrieval_audit(out["manifest"]),
        "audit_by_source": lambda: pairs.audit_by_source(made, truth),
        "labels": lambda: pairs.label_distribution(made, truth),
    }
    for name, make in steps.items():
        out[name] = stages.run(name, inputs, make)
    return out


def isolation_violations(shards: DataFrame) -> DataFrame:
    """(rule, n): S1 records whose pairs are in several shards (column ``shard``), which relative features do not allow."""
    return pairs.violations([("split_s1", shards.groupBy("entity_id_s1").agg(F.count_distinct("shard").alias("shards")).where(F.col("shards") > 1))])


def feature_dataset(made: DataFrame, records: DataFrame, stages: Stages, settings: dict | None = None) -> DataFrame:
    """The features of every pair, as a stage: the contract's columns, as many rows as pairs."""
    if "shard" in made.columns:
        none_of(isolation_violations(made), "pairs")
        made = made.drop("shard")
    inputs = {"pairs": audits.order_free_hash(made).first()["fingerprint"]} | (settings or {})
    out = stages.run("features", inputs, lambda: features.pair_features(made, records))
    faults = features.schema_faults(out)
    if faults:
        raise ContractError(f"features: {faults}")
    same_size(made, out, "features")
    return out


# --- submissions -----------------------------------------------------------------------------


def read_lists(spark: SparkSession, path: str, column: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", column)])
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", False).csv(path)
    return df.withColumn(column, F.coalesce(column, F.lit("")))


def round_trip_faults(lists: DataFrame, path: str) -> list[str]:
    """Writes the lists, reads the files back and says what differs."""
    tables.write_lists(lists, path)
    column = lists.columns[1]
    back = read_lists(lists.sparkSession, path, column)
    a, b = (audits.order_free_hash(df.select(*lists.columns)).first() for df in (lists, back))
    return [f"{n}: {x} written, {y} read" for n, x, y in (("rows", a["rows"], b["rows"]), ("fingerprint", a["fingerprint"], b["fingerprint"])) if x != y]


def submission_metadata(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Counts and fingerprints of both outputs, one row."""
    total = lambda df, c: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col(c) != "", F.size(F.split(c, ","))).otherwise(0)), F.lit(0)).cast("long").alias("ids")).withColumn("mark", audits.order_free_hash(df).select("fingerprint").scalar())
    m = total(matches, "matched_entity_ids").select(F.col("n").alias("rows"), F.col("ids").alias("matches"), F.col("mark").alias("matches_fingerprint"))
    c = total(candidates, "candidate_entity_ids").select(F.col("ids").alias("candidates"), F.col("mark").alias("candidates_fingerprint"))
    return m.withColumns({n: c.select(n).scalar() for n in c.columns})


def submit(matches: DataFrame, candidates: DataFrame, s1: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """Writes both outputs after every rule has been checked; returns their metadata."""
    none_of(decide.submission_violations(matches, candidates, s1, known).where(F.col("rule") != "not_a_candidate"), "submission")
    if not audits.cardinality(matches, candidates, s1).first()["equal"]:
        raise ContractError("submission: its outputs differ in rows")
    faults = round_trip_faults(matches, f"{path}/matches") + round_trip_faults(candidates, f"{path}/candidates")
    if faults:
        raise ContractError(f"submission: {faults}")
    return submission_metadata(matches, candidates)


def file_report(lines: DataFrame, s1: DataFrame, header: tuple[str, str], allowed: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(rule, severity, n) for the raw lines of a result file.

    Errors are broken rows, a header other than the given one, and ids that are
    unknown (where ``known`` is given); matches outside ``allowed`` are warnings.
    """
    body = lines.where(F.col("value") != "\t".join(header))
    rows = body.where(F.size(F.split("value", "\t")) == 2).select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("source1_entity_id"), F.explode(F.split(F.split_part("value", F.lit("\t"), F.lit(2)), ",")).alias("id")).where(F.col("id") != "")
    out = decide.file_violations(lines, s1, header)
    headers = lines.where(F.col("value") == "\t".join(header))
    wrong = [("no_header", headers.groupBy().count().where(F.col("count") != 1))]
    if known is not None:
        wrong.append(("unknown_id", rows.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti")))
    out = out.unionByName(pairs.violations(wrong).select("rule", F.lit("error").alias("severity"), "n"))
    if allowed is not None:
        listed = allowed.select(F.col("entity_id_s1").alias("source1_entity_id"), F.col("entity_id_cand").alias("id"))
        outside = pairs.violations([("not_a_candidate", rows.join(listed, ["source1_entity_id", "id"], "left_anti"))])
        out = out.unionByName(outside.select("rule", F.lit("warning").alias("severity"), "n"))
    return out


# --- audits ----------------------------------------------------------------------------------


def as_metrics(section: str, row: DataFrame) -> DataFrame:
    """(section, metric, value) of the numbers of a table of one row."""
    numbers = [c for c, t in row.dtypes if t not in ("string", "boolean")]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in numbers]))
    return row.select(each.alias("x")).select(F.lit(section).alias("section"), "x.metric", "x.value")


def exact_audit(flags: DataFrame, truth: DataFrame, s1: DataFrame, records: DataFrame) -> DataFrame:
    """The close audit of the exact rules in sections: volume, recall, coverage, noise, overlap, collisions, score, misses."""
    counts = metrics.hit_counts(s1.select("entity_id", "country"), flags, truth)
    scored = metrics.macro_f05(metrics.hit_counts(s1.select("entity_id", "country"), decide.policy_d1(flags, records), truth))
    overlap = metrics.channel_overlap(flags).select(F.lit("overlap").alias("section"), F.concat(F.lit("pairs_by_"), F.col("channels").cast("string")).alias("metric"), F.col("pairs").cast("double").alias("value"))
    missed = truth.join(flags, ["entity_id_s1", "entity_id_cand"], "left_anti").agg(F.count("*").alias("missed"))
    sections = [
        as_metrics("volume", metrics.volume_summary(counts)), as_metrics("pool", metrics.pool_metrics(counts)), as_metrics("coverage", metrics.coverage_by_sources(flags, truth)),
        as_metrics("collisions", metrics.collisions(records.where((F.col("source") != "S1") & (F.col("name_norm_clean") != "")), ["source", "country", "name_norm_clean"])),
        as_metrics("score", scored), as_metrics("misses", missed), overlap,
    ]
    out = sections[0]
    for part in sections[1:]:
        out = out.unionByName(part)
    return out


def smoke_audit(union: DataFrame, truth: DataFrame, folds: DataFrame, profile: DataFrame, most: int = 15, budgets: tuple[int, ...] = (5, 10, 15, 20, 30)) -> DataFrame:
    """The audit of a trial run in sections: integrity, folds, recall at each budget, losses to pruning, channels."""
    cut = retrieval.rank_and_prune(union, most)
    s1 = profile.select("entity_id")
    at = metrics.frontier(union, truth, s1, budgets=budgets).select(F.lit("budget").alias("section"), F.concat(F.lit("recall_at_"), F.col("budget").cast("string")).alias("metric"), F.col("recall").alias("value"))
    channels = metrics.channel_contribution(union, truth).select(F.lit("channels").alias("section"), F.concat("channel", F.lit("_found")).alias("metric"), F.col("gt_found").cast("double").alias("value"))
    broken = pairs.fold_violations(folds, 5).unionByName(shard_violations(cut, union, most)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    parts = [as_metrics("integrity", audits.integrity(union)), as_metrics("contracts", broken), at, as_metrics("pruning", metrics.lost_to_pruning(union, truth, most)), channels]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def register_run(spark: SparkSession, path: str, name: str, config_fingerprint: str, outputs: dict[str, DataFrame], frozen: bool = False) -> None:
    """Adds a run to the registry: its settings, the fingerprint of every output, and whether it is frozen. A frozen run is not entered twice."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target) and not spark.read.json(path).where((F.col("name") == name) & F.col("frozen")).isEmpty():
        raise ContractError(f"run {name} is frozen")
    marks = {k: audits.order_free_hash(df).first()["fingerprint"] for k, df in outputs.items()}
    row = spark.createDataFrame([(name, config_fingerprint, json.dumps(marks, sort_keys=True), frozen)], "name string, config string, outputs string, frozen boolean")
    row.coalesce(1).write.mode("append").json(path)
