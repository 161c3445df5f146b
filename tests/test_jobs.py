import json

import pytest
from pyspark.sql import functions as F

from kinspan.operators import audits, decide, features, metrics, pairs, retrieval
from kinspan.plans import jobs
from kinspan.plans.linkage import CandidateGenerator, Config, Stages, TargetContext, reads_kept_tables
from kinspan.sources import tables

RAW = "entity_id string, business_name string, business_address string, country string"


def raw(spark, source):
    names = ["Alpha Co", "Beta Trading Ltd", "Gamma Foods", "Delta Works", "Épsilon Bar", "Zeta"]
    rows = [(f"{source}-{i}", names[i % 6] + (" x" if source == "S3" and i % 2 else ""), f"{i % 4 + 1} Main Road", "US" if i % 3 else "India") for i in range(24)]
    return spark.createDataFrame(rows, RAW)


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    return Stages(spark, str(tmp_path_factory.mktemp("stages")))


@pytest.fixture(scope="module")
def records(spark, home):
    made, manifest = jobs.processed_dataset({s: raw(spark, s) for s in ("S1", "S2", "S3")}, home)
    assert {(r["name"], r["rows"]) for r in manifest.collect()} == {("S1", 24), ("S2", 24), ("S3", 24)}
    return made["S1"].unionByName(made["S2"]).unionByName(made["S3"])


def truth_of(spark):
    return spark.createDataFrame([(f"S1-{i}", f"{s}-{i}") for i in range(20) for s in ("S2", "S3") if (i % 3 or s == "S2")], "entity_id_s1 string, entity_id_cand string")


def test_ingestion_checks_its_input(spark, home):
    with pytest.raises(jobs.ContractError):
        jobs.process_source(raw(spark, "S1").unionByName(raw(spark, "S1").limit(1)), "twice", home)
    with pytest.raises(jobs.ContractError):
        jobs.process_source(raw(spark, "S1").drop("country"), "narrow", home)
    out = jobs.process_source(raw(spark, "S1"), "S1", home)
    assert out.where("name_norm_accent_fold = 'epsilon bar'").count() == 4


def test_context_gives_the_same_and_builds_indexes_once(spark, records):
    s1 = records.where("source = 'S1'")
    generator = CandidateGenerator(Config.everything())
    context = TargetContext(records)
    want = generator.generate(s1, {n: records.where(F.col("source") == n) for n in ("S2", "S3")})
    first = generator.generate_with_context(s1, context)
    assert audits.order_free_hash(first).first() == audits.order_free_hash(want.select(first.columns)).first()
    built = context.built
    assert len(built) == 4
    second = generator.generate_with_context(s1.limit(5), context)
    assert second.count() > 0 and context.built == built and reads_kept_tables(second) >= 4
    assert context.has("S2", "US") and not context.has("S9", "US") and {r["source"] for r in context.sources().collect()} == {"S2", "S3"}
    context.release()
    assert context.built == ()
    assert generator.generate(s1, {}).count() == 0


def test_configuration_from_a_file(tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"name_word": {"enabled": True, "k": 9}, "numeric": {"enabled": True}, "budgets": [3, 7]}))
    config = Config.from_file(str(path))
    assert config.name_word.k == 9 and config.numeric.most_df == 50 and config.budgets == (3, 7) and not config.rare_token.enabled
    assert config.fingerprint() != Config().fingerprint()
    path.write_text(json.dumps({"nonsense": {}}))
    with pytest.raises(ValueError):
        Config.from_file(str(path))


def test_pair_and_feature_datasets(spark, records, home):
    truth, s1 = truth_of(spark), records.where("source = 'S1'")
    pool = CandidateGenerator(Config.everything()).generate(s1, {n: records.where(F.col("source") == n) for n in ("S2", "S3")})
    folds = pairs.stratified_folds(pairs.match_profile(s1, truth))
    cut = retrieval.rank_and_prune(pool)
    assert jobs.shard_violations(cut, pool, 15).count() == 0
    assert {r["rule"] for r in jobs.shard_violations(cut.unionByName(cut), pool.where("retrieved_exact = 0"), 3).collect()} == {"over_budget", "not_in_union", "duplicate_key"}
    made = jobs.pair_dataset(cut, truth, folds, s1, home)
    assert dict(made["pairs"].dtypes)["retrieved_exact"] == "tinyint" and dict(made["pairs"].dtypes)["name_word_score"] == "float"
    assert made["manifest"].count() == 24 and made["audit_by_source"].count() == 2
    again = jobs.pair_dataset(cut, truth, folds, s1, home)
    assert audits.order_free_hash(again["pairs"]).first() == audits.order_free_hash(made["pairs"]).first()
    with pytest.raises(Exception, match="pair without fold"):
        jobs.pair_dataset(cut, truth, folds.where("fold_id > 0"), s1, home)
    out = jobs.feature_dataset(made["pairs"], records, home)
    assert len(features.model_columns(out)) == len(features.ALLOWED) == 69
    shards = made["pairs"].withColumn("shard", F.pmod(F.xxhash64("entity_id_cand"), F.lit(3)))
    with pytest.raises(jobs.ContractError):
        jobs.feature_dataset(shards, records, home)
    assert features.schema_faults(out.drop("name_char_ratio").withColumn("odd", F.lit(1)).withColumn("name_gap_from_best", F.lit("x"))) == ["absent: name_char_ratio", "type of name_gap_from_best: string", "unknown: odd"]
    report = {(r["section"], r["metric"]): r["value"] for r in jobs.smoke_audit(pool, truth, folds, pairs.match_profile(s1, truth)).collect()}
    assert report["contracts", "violations"] == 0 and report["pruning", "in_pool"] >= report["pruning", "in_pruned"] > 0
    jobs.register_run(spark, f"{home.root}/registry", "run", "c1", {"pairs": made["pairs"]}, frozen=True)
    with pytest.raises(jobs.ContractError):
        jobs.register_run(spark, f"{home.root}/registry", "run", "c2", {"pairs": made["pairs"]})


def test_repeated_truth_adds_no_pair(spark):
    cand = spark.createDataFrame([("A", "S2", "X")], "entity_id_s1 string, candidate_source string, entity_id_cand string")
    truth = spark.createDataFrame([("A", "X"), ("A", "X")], "entity_id_s1 string, entity_id_cand string")
    assert pairs.labelled(cand, truth).count() == 1


def test_contracts_that_fail(spark, tmp_path):
    with pytest.raises(ValueError):
        features.firewall(("name_exact_clean", "country"))
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(ValueError):
        tables.contract(df, {"k": "A"})
    assert [f["category"] for f in json.loads(tables.contract(df, {"k": "A", "v": "C"}))["fields"]] == ["A", "C"]
    with pytest.raises(jobs.ContractError):
        jobs.check_candidates(df)
    assert jobs.check_candidates(spark.createDataFrame([], "entity_id_s1 string, candidate_source string, entity_id_cand string")) == list(jobs.PROVENANCE)
    df.write.parquet(str(tmp_path / "shards"))
    with pytest.raises(ValueError):
        tables.read_shards(spark, str(tmp_path / "shards"), spark.createDataFrame([], "k int, v string").schema)
    folds = spark.createDataFrame([("S1-1", 0), ("S1-2", 1)], "source1_entity_id string, fold_id int")
    folds.write.parquet(str(tmp_path / "folds"))
    mark = audits.order_free_hash(folds).first()["fingerprint"]
    assert tables.read_folds(spark, str(tmp_path / "folds"), mark).count() == 2
    with pytest.raises(ValueError):
        tables.read_folds(spark, str(tmp_path / "folds"), "0")


def test_hash_counts_repeated_rows(spark):
    of = lambda rows: audits.order_free_hash(spark.createDataFrame(rows, "k int, v string")).first()
    assert of([(1, "a"), (1, "a")])["fingerprint"] != of([(2, "b"), (2, "b")])["fingerprint"]
    assert of([(1, None)]) != of([(1, "-")]) and of([])["rows"] == 0


def test_failed_stage_leaves_earlier_data(spark, tmp_path):
    stages = Stages(spark, str(tmp_path))
    runs = []

    def make(n):
        def plan():
            runs.append(n)
            if n == 2:
                raise RuntimeError("lost")
            return spark.range(n)

        return plan

    stages.run("x", {"a": 1}, make(1))
    stages.run("x", {"a": 1}, make(3))
    with pytest.raises(RuntimeError):
        stages.run("x", {"a": 2}, make(2))
    assert stages.run("x", {"a": 1}, make(4)).count() == 1 and runs == [1, 2]


def test_submission(spark, records, tmp_path):
    s1 = records.where("source = 'S1'").select("entity_id", "country")
    flags = retrieval.exact_flags(records)
    matches, candidates = decide.id_lists(s1, decide.policy_d0(flags)), decide.id_lists(s1, flags, "candidate_entity_ids")
    meta = jobs.submit(matches, candidates, s1, records, str(tmp_path / "out")).first()
    assert meta["rows"] == 24 and meta["candidates"] >= meta["matches"] > 0
    with pytest.raises(jobs.ContractError):
        jobs.submit(matches.limit(5), candidates, s1, records, str(tmp_path / "bad"))
    header = ("source1_entity_id", "matched_entity_ids")
    lines = spark.read.text(str(tmp_path / "out/matches")).where(F.col("value") != "\t".join(header)).unionByName(spark.createDataFrame([("\t".join(header),)], "value string"))
    assert jobs.file_report(lines, s1, header, flags, records).count() == 0
    odd = lines.where(~F.col("value").startswith("source1")).unionByName(spark.createDataFrame([("S1-99\tS2-77",), ("one cell",)], "value string"))
    got = {(r["rule"], r["severity"]) for r in jobs.file_report(odd, s1, header, flags, records).collect()}
    assert got == {("malformed_row", "error"), ("extra_s1", "error"), ("no_header", "error"), ("unknown_id", "error"), ("not_a_candidate", "warning")}


def test_chunks_and_synthetic_rows(spark, records):
    s1 = records.where("source = 'S1'").select("entity_id")
    rows = jobs.sorted_chunks(s1, 4).groupBy("chunk").agg(F.min("entity_id").alias("a"), F.max("entity_id").alias("b")).orderBy("a").collect()
    assert all(x["b"] < y["a"] for x, y in zip(rows, rows[1:])) and [r["chunk"] for r in rows] == sorted(r["chunk"] for r in rows)
    assert [r["entity_id"] for r in jobs.smoke_limit(s1, 3).collect()] == sorted(r["entity_id"] for r in s1.collect())[:3]
    cells = jobs.synthetic_rows(spark, 50, 1000, 8).collect()
    assert cells == jobs.synthetic_rows(spark, 50, 1000, 8).collect() and 380 < len(cells) <= 400 and all(0 <= c["column"] < 1000 for c in cells)


def test_smaller_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "metric string, value double")
    tables.write_metrics(df, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).first()["value"] == "1.5"
    tables.append_log(df, str(tmp_path / "log"))
    tables.append_log(df, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
    tables.write_manifest(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["metric"] == "a"
    (tmp_path / "ids.tsv").write_text("id\tx\nS1-1\t2\nS1-1\t3\nS1-2\t4\n")
    assert {r["entity_id"] for r in tables.read_ids(spark, str(tmp_path / "ids.tsv")).collect()} == {"S1-1", "S1-2"}
    assert audits.scale_estimate(10.0, 100, 1000) == 100.0
    assert jobs.logger().handlers == jobs.logger().handlers and len(jobs.logger().handlers) == 1


def test_unrounded_scores_decide(spark):
    scores = spark.createDataFrame([("A", 0.50000001), ("B", 0.50000002)], "policy string, macro_f05 double")
    assert decide.best_policy(scores).first()["policy"] == "B"
    assert metrics.BUDGETS[0] == 3
