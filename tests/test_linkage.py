import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinspan.operators import audits, decide, features, metrics, pairs, retrieval, topk
from kinspan.plans.linkage import CandidateGenerator, Config, Stages, TargetContext
from kinspan.sources import tables
from kinspan.streaming.incremental import match_stream

RAW = "entity_id string, business_name string, business_address string, country string"


def records(spark, rows):
    df = spark.createDataFrame(rows, RAW).withColumn("source", F.substring_index("entity_id", "-", 1)).withColumn("addr_numeric_tokens", F.lit(""))
    return tables.normalized(df)


def test_exact_rules(spark):
    r = records(spark, [
        ("S1-1", "Alpha Co", "1 Road", "US"), ("S2-1", "ALPHA  co", "1 road", "US"), ("S3-1", "Alphá Co", "1 Road", "US"), ("S2-2", "Alpha Co", "1 Road", "FRANCE"),
        ("S1-2", "", "", "US"), ("S2-3", "", "", "US"), ("S1-3", "Solo", "x", "US"), ("S2-4", "Solo", "y", "US"), ("S1-4", "Twin", "x", "US"), ("S2-5", "Twin", "y", "US"), ("S2-6", "Twin", "z", "US"),
    ])
    got = {(x["entity_id_s1"], x["entity_id_cand"]): x for x in retrieval.exact_flags(r).collect()}
    assert set(got) == {("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-3", "S2-4")}
    assert got["S1-1", "S2-1"]["exact_count"] == 4
    assert [got["S1-1", "S3-1"][f] for f in retrieval.FLAGS] == [0, 1, 0, 0]
    assert [got["S1-3", "S2-4"][f] for f in retrieval.FLAGS] == [0, 0, 0, 1]
    assert retrieval.rule_pairs(r, "exact_name_address_clean", use_country=False).count() == 2


def test_policies(spark):
    r = records(spark, [("S1-1", "A b", "1 x", "US"), ("S2-1", "a b", "1 x", "US"), ("S1-2", "Only", "", "US"), ("S2-2", "only", "9 z", "US"), ("S1-3", "Other", "q", "US"), ("S3-3", "other", "w", "US")])
    flags = retrieval.exact_flags(r)
    assert {tuple(x) for x in decide.policy_d0(flags).collect()} == {("S1-1", "S2-1")}
    assert {tuple(x) for x in decide.policy_d1(flags, r).collect()} == {("S1-1", "S2-1"), ("S1-2", "S2-2")}


def pool(spark, rows):
    """(cand, exact, name, address, name_rank, address_rank, rare) rows of one S1."""
    base = spark.createDataFrame(rows, "entity_id_cand string, e int, n int, a int, nr int, ar int, rare int")
    df = base.select(F.lit("S1-1").alias("entity_id_s1"), "entity_id_cand", F.lit("S2").alias("candidate_source"), *[F.col(c).alias(t) for c, t in (("e", "retrieved_exact"), ("n", "retrieved_name_word"), ("a", "retrieved_address_word"), ("e", "exact_name_address_clean"), ("nr", "name_word_rank"), ("ar", "address_word_rank"), ("rare", "rare_token_overlap_count"))])
    return retrieval.union_evidence([df])


def test_ranking_and_nested_budgets(spark):
    p = pool(spark, [("C1", 0, 1, 0, 1, 9999, 0), ("C2", 0, 0, 1, 9999, 1, 0), ("C3", 0, 1, 1, 2, 2, 0), ("C4", 1, 0, 0, 9999, 9999, 0)])
    assert [r["entity_id_cand"] for r in retrieval.ranked(p).orderBy("candidate_rank").collect()] == ["C4", "C3", "C1", "C2"]
    before = set()
    for k in (1, 2, 3, 4):
        now = {r["entity_id_cand"] for r in retrieval.rank_and_prune(p, k).collect()}
        assert before < now
        before = now


def test_defaults_of_the_union(spark):
    r = pool(spark, [("C1", 0, 1, 0, 1, None, None)]).first()
    assert (r["address_word_rank"], r["rarest_shared_token_df"], r["name_word_score"], r["retrieval_channel_count"]) == (9999, 999999, 0.0, 1)


def test_tfidf_by_hand(spark):
    r = records(spark, [("S1-1", "red apple", "", "US"), ("S2-1", "red apple", "", "US"), ("S2-2", "apple pie", "", "US"), ("S2-3", "blue sky", "", "US"), ("S2-4", "red apple", "", "FR")])
    got = {x["entity_id_cand"]: (x["rank"], x["score"]) for x in retrieval.tfidf_pairs(r, "name_norm_clean").collect()}
    assert set(got) == {"S2-1", "S2-2"} and got["S2-1"] == (1, 1.0) and got["S2-2"][0] == 2 and 0 < got["S2-2"][1] < 1


def brute_tfidf(rows, k):
    """Plain top-k over (id, name, country) rows: every S1 record against every target of its country."""
    terms = {}
    for i, name, country in rows:
        w = re.findall(r"\w{2,}", name.lower())
        terms[i] = Counter((country, t) for t in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    out = {}
    for source in ("S2", "S3"):
        ids = [i for i, name, _ in rows if i.startswith(source) and name]
        docs = Counter(c for i, name, c in rows if i in set(ids))
        df = Counter(t for i in ids for t in terms[i])

        def unit(i):
            w = {t: (1 + math.log(n)) * (math.log((1 + docs[t[0]]) / (1 + df[t])) + 1) for t, n in terms[i].items() if t in df}
            norm = math.sqrt(sum(x * x for x in w.values()))
            return {t: x / norm for t, x in w.items()}

        targets = {i: unit(i) for i in ids}
        for q in (i for i, _, _ in rows if i.startswith("S1")):
            a = unit(q)
            scores = sorted((-round(sum(x * b.get(t, 0.0) for t, x in a.items()), 9), i) for i, b in targets.items())
            out |= {(q, i): (n, -s) for n, (s, i) in enumerate((x for x in scores[:k] if x[0] < 0), 1)}
    return out


def test_tfidf_of_common_words_copies_and_tiles_is_as_brute_force(spark, monkeypatch):
    """Large groups of copies, words that most records hold, several tiles: no pairs of holders of a word are made, and none of the best is lost."""
    dice = random.Random(5)
    words = ["the", "of", "and", *(f"w{i}" for i in range(40))]
    rows = []
    for i in range(900):
        name = "the copy of all" if i % 3 == 0 and i < 400 else " ".join(dice.choice(words[:3] if dice.random() < 0.5 else words) for _ in range(dice.randint(0, 6)))
        rows.append((f"S{i % 3 + 1 if i >= 400 else dice.randint(1, 3)}-{i}", name, "US" if i % 5 else "FR"))
    df = records(spark, [(i, name, "", c) for i, name, c in rows])
    want = brute_tfidf(rows, 4)
    for tile, least, at_once in ((300_000, 1_000, 3), (70, 10, 3)):
        for name, value in (("TILE", tile), ("LEAST", least), ("AT_ONCE", at_once)):
            monkeypatch.setattr(topk, name, value)
        found = retrieval.tfidf_pairs(df, "name_norm_clean", 4)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroups" in plan
        got = {(x["entity_id_s1"], x["entity_id_cand"]): (x["rank"], x["score"]) for x in found.collect()}
        assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 2e-9 for p in want)


def test_tfidf_of_more_slabs_than_parts_is_as_brute_force(spark, monkeypatch):
    dice = random.Random(6)
    rows = [(f"S{1 if i < 4 else 2}-{i}", " ".join(dice.choice(("the", f"w{dice.randint(0, 30)}")) for _ in range(5)), "US") for i in range(94)]
    monkeypatch.setattr(topk, "TILE", 1)
    found = retrieval.tfidf_pairs(records(spark, [(i, name, "", c) for i, name, c in rows]), "name_norm_clean", 4)
    got, want = {(x["entity_id_s1"], x["entity_id_cand"]): (x["rank"], x["score"]) for x in found.collect()}, brute_tfidf(rows, 4)
    assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 2e-9 for p in want)


def test_tfidf_of_an_id_in_several_rows_takes_them_together(spark):
    r = records(spark, [("S1-1", "red apple", "", "US"), ("S2-1", "red", "", "US"), ("S2-1", "apple", "", "US"), ("S2-2", "red pear", "", "US")])
    got = {x["entity_id_cand"]: x["rank"] for x in retrieval.tfidf_pairs(r, "name_norm_clean").collect()}
    assert got == {"S2-1": 1, "S2-2": 2}


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    held = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))


def test_tfidf_shuffles_records_not_their_weights(spark):
    """Rows of a record and a term are not shuffled again and again: a search writes a small multiple of its records' text."""
    dice = random.Random(9)
    rows = [(f"S{i % 3 + 1}-{i}", " ".join(f"w{dice.randint(0, 3000)}" for _ in range(10)), "", "US") for i in range(9000)]
    df = records(spark, rows).persist()
    assert df.count() == len(rows)
    before = shuffled(spark)
    assert retrieval.tfidf_pairs(df, "name_norm_clean").count() > 0
    df.unpersist()
    assert shuffled(spark) - before < 34 * sum(len(name) for _, name, _, _ in rows)


def test_counted_terms_are_the_stretches_of_the_sorted_ones(spark):
    held = [[("US", "to be or not to be"), ("FR", "to be"), (None, "to be")], [("US", "x")], [("US", "aa")]]
    df = spark.createDataFrame([(h,) for h in held], "held array<struct<country: string, view: string>>")
    got = df.select(retrieval.counted_terms(F.col("held")).alias("c"), retrieval.held_terms(F.col("held")).alias("t")).collect()
    for h, row in zip(held, got):
        want = Counter((c, t) for c, v in h if c for w in [re.findall(r"\w{2,}", v)] for t in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
        assert {(x["country"], x["term"]): x["n"] for x in row["c"]} == want and len(row["c"]) == len(want)
        assert Counter(row["t"]) == Counter({f"{c}\x00{t}": n for (c, t), n in want.items()})


def test_rare_and_numeric_tokens(spark):
    rows = [("S1-1", "zed common", "", "US"), ("S2-0", "zed", "", "US")] + [(f"S2-{i}", "common", "", "US") for i in range(1, 13)]
    got = retrieval.rare_token_pairs(records(spark, rows)).collect()
    assert [tuple(x) for x in got] == [("S1-1", "S2-0", "S2", 1, 1)]


def truth_of(spark, rows):
    return spark.createDataFrame(rows, "entity_id_s1 string, entity_id_cand string")


def test_labels_and_diagnostics(spark):
    cand = spark.createDataFrame([("A", "S2", "X"), ("A", "S2", "Y"), ("B", "S2", "Z"), ("B", "S2", "W"), ("C", "S3", "V")], "entity_id_s1 string, candidate_source string, entity_id_cand string")
    truth = truth_of(spark, [("A", "X"), ("A", "Y"), ("A", "Q"), ("B", "Z"), ("C", "U")])
    got = pairs.diagnostics(pairs.labelled(cand, truth), truth).collect()
    assert {(r["entity_id_s1"], r["entity_id_cand"]): r["label"] for r in got} == {("A", "X"): 1, ("A", "Y"): 1, ("B", "Z"): 1, ("B", "W"): 0, ("C", "V"): 0}
    assert {(r["entity_id_s1"], r["gt_match_count"], r["retrieved_positive_count"], r["missing_positive_count"]) for r in got} == {("A", 3, 2, 1), ("B", 1, 1, 0), ("C", 1, 0, 1)}


def test_pair_violations(spark):
    rows = [("A", "S2", "S2-1", 1, 0), ("A", "S2", "S2-1", 1, 1), ("B", "S3", "S2-9", 0, None)]
    df = spark.createDataFrame(rows, "entity_id_s1 string, candidate_source string, entity_id_cand string, label int, fold int")
    got = {r["rule"] for r in pairs.pair_violations(df, truth_of(spark, [("B", "S2-9")])).collect()}
    assert got == {"duplicate_key", "two_folds", "missing_fold", "wrong_label", "bad_source"}


@pytest.mark.parametrize("pred,true,want", [("XY", "XY", 1.0), ("X", "XY", 0.833333), ("XY", "X", 0.555556), ("", "", 1.0), ("X", "", 0.0), ("", "X", 0.0), ("XYZ", "XY", 0.714286)])
def test_f05(spark, pred, true, want):
    s1 = spark.createDataFrame([("A", "US")], "entity_id string, country string")
    counts = metrics.hit_counts(s1, truth_of(spark, [("A", c) for c in pred] + [("other", "X")]), truth_of(spark, [("A", c) for c in true]))
    assert metrics.macro_f05(counts).first()["macro_f05"] == want


def test_folds(spark):
    s1 = spark.createDataFrame([(f"S1-{i}", "US" if i < 10 else "India") for i in range(20)], "entity_id string, country string")
    truth = truth_of(spark, [(f"S1-{i}", f"S2-{i}") for i in range(4, 12)] + [(f"S1-{i}", f"S{k}-{i}") for i in range(12, 20) for k in (2, 3)])
    folds = pairs.stratified_folds(pairs.match_profile(s1, truth), 3)
    rows = folds.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pairs.stratified_folds(pairs.match_profile(s1.repartition(7), truth), 3).collect()))
    assert pairs.fold_violations(folds, 3).count() == 0 and len({r["entity_id"] for r in rows}) == 20
    sizes = [sum(r["fold_id"] == k for r in rows) for k in range(3)]
    assert max(sizes) - min(sizes) <= 2
    assert pairs.fold_violations(folds.where("fold_id < 2"), 3).first()["rule"] == "absent_fold"


def test_relative_features(spark):
    df = spark.createDataFrame([("A", 0.9, 1.0, 1), ("A", 0.95, None, 0), ("A", 0.8, 0.5, 0), ("B", None, None, 0), ("C", 0.9, 0.1, 0), ("C", 0.9, 0.1, 0), ("C", 0.8, 0.1, 0)], "entity_id_s1 string, name_char_ratio float, address_char_ratio float, name_exact_clean int")
    got = features.relative_features(df).collect()
    a = sorted((r for r in got if r["entity_id_s1"] == "A"), key=lambda r: r["name_char_ratio"])
    assert [r["name_similarity_rank_within_s1"] for r in a] == [3, 2, 1]
    assert [r["address_similarity_rank_within_s1"] for r in a] == [2, 1, 3]
    assert [round(r["name_gap_from_best"], 2) for r in a] == [0.15, 0.05, 0.0] and a[0]["count_exact_name_candidates"] == 1
    assert [r["name_similarity_rank_within_s1"] for r in got if r["entity_id_s1"] == "B"] == [1]
    assert sorted(r["name_similarity_rank_within_s1"] for r in got if r["entity_id_s1"] == "C") == [1, 1, 3]


def test_pair_features(spark):
    r = records(spark, [("S1-1", "Apple Inc", "1 Main", "US"), ("S2-1", "apple incorporated", "", "US")]).withColumn("addr_numeric_tokens", F.when(F.col("entity_id") == "S1-1", "456").otherwise("999 123"))
    p = retrieval.ranked(pool(spark, [("S2-1", 0, 1, 0, 1, 9999, 0)]))
    out = features.pair_features(p, r)
    x = out.first()
    assert round(x["name_char_ratio"], 6) == 0.666667 and x["name_shared_token_count"] == 1 and x["address_char_ratio"] is None
    assert (x["numeric_conflict_flag"], x["numeric_agreement_flag"], x["address_cand_missing"], x["address_s1_token_count"]) == (1, 0, 1, 0)
    assert len(features.model_columns(out)) == 69


def test_submission_rules(spark):
    s1 = spark.createDataFrame([(f"S1-{i}",) for i in (1, 2, 3)], "entity_id string")
    known = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    given = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", ""), ("S1-2", "S1-2,S3-1,S2-77"), ("S1-9", "")], "source1_entity_id string, matched_entity_ids string")
    allowed = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "")], "source1_entity_id string, candidate_entity_ids string")
    got = {r["rule"]: r["n"] for r in decide.submission_violations(given, allowed, s1, known).collect()}
    assert got == {"missing_s1": 1, "extra_s1": 1, "duplicate_s1": 1, "duplicate_id": 1, "self_match": 1, "bad_prefix": 1, "unknown_id": 2, "not_a_candidate": 3}
    lines = spark.createDataFrame([("a\tb",), ("S1-1\tS2-1",), ("S1-2\t",), ("broken",), ("S1-2\tS9-1",)], "value string")
    assert {r["rule"] for r in decide.file_violations(lines, s1, ("a", "b")).collect()} == {"malformed_row", "duplicate_s1", "missing_s1", "bad_prefix"}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t"a ""b"" c"\tUS\nS1-2\tX\t\tFRANCE\n')
    rows = tables.read_source(spark, str(tmp_path / "s.tsv")).collect()
    assert rows[0]["business_name"] is None and rows[1]["business_address"] is None
    assert tables.read_source(spark, str(tmp_path / "s.tsv"), quoted=False).first()["business_name"] == "NA"
    lists = spark.createDataFrame([("S1-1", "S2-1,S3-1"), ("S1-2", "")], tables.TRUTH)
    tables.write_lists(lists, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.read_truth(spark, str(tmp_path / "out")).collect())) == [("S1-1", "S2-1,S3-1"), ("S1-2", "")]
    assert "S1-2\t\n" in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert sorted(map(tuple, tables.truth_pairs(lists).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-1")]
    tables.write_table(lists, str(tmp_path / "shards"))
    assert tables.read_shards(spark, str(tmp_path / "shards"), tables.TRUTH).count() == 2
    with pytest.raises(ValueError, match="lack"):
        tables.read_shards(spark, str(tmp_path / "shards"), tables.SOURCE)
    spark.createDataFrame([("a", 1), ("a", 2)], "source1_entity_id string, fold_id int").write.parquet(str(tmp_path / "folds"))
    with pytest.raises(Exception, match="repeated"):
        tables.read_folds(spark, str(tmp_path / "folds")).collect()


def test_generator_paths_agree_and_stages_resume(spark, tmp_path):
    raw = [("S1-1", "Blue River Mills", "5 Quay", "US"), ("S2-1", "Blue River Mill", "5 Quay", "US"), ("S3-1", "Blue River Mills", "5 Quay", "US"), ("S3-2", "Blue Hill", "7 Lane", "India")]
    r = records(spark, raw)
    s1 = r.where("source = 'S1'").drop("source")
    g = CandidateGenerator(Config.everything())
    direct = g.generate(s1, {s: r.where(F.col("source") == s).drop("source") for s in ("S2", "S3")})
    context = TargetContext(r)
    assert sorted(map(str, direct.collect())) == sorted(map(str, g.generate_with_context(s1, context).collect()))
    assert context.has("S3", "India") and not context.has("S2", "India") and context.summary().count() == 3
    assert Config().fingerprint() != Config.everything().fingerprint()
    runs = []
    stages = Stages(spark, str(tmp_path / "job"))
    make = lambda: runs.append(1) or g.rank_and_prune(direct)
    for mark in (1, 1, 2):
        assert stages.run("pool", {"v": mark}, make).count() == 2
    assert len(runs) == 2
    spark.createDataFrame(raw[:1], RAW).withColumn("addr_numeric_tokens", F.lit("5")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    match_stream(stream, context, g, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {x["entity_id_cand"] for x in spark.read.parquet(str(tmp_path / "out")).collect()} == {"S2-1", "S3-1"}
    context.release()


def test_parity_and_hash(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", None)], "k string, v double")
    b = spark.createDataFrame([("x", 1.00001), ("y", 3.0), ("w", 1.0)], "k string, v double")
    assert {r["k"]: r["status"] for r in audits.parity(a, b, ["k"], ["v"]).collect()} == {"y": "differs", "z": "only_old", "w": "only_new"}
    assert audits.order_free_hash(a).first() == audits.order_free_hash(a.orderBy(F.desc("k"))).first()


def test_plans_push_filters_and_limit_windows(spark):
    from kinspan import catalog

    text = catalog.QUERIES["s7_projected_filtered_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_nationkey), EqualTo(c_nationkey,7)]" in text and "c_acctbal" not in text
    text = catalog.QUERIES["t1_t2_rank_prune15"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in text and "Join Cross" not in text


def test_tiles_keep_small_numbers_and_give_their_memory_back(monkeypatch):
    """Places of terms and rows take four bytes, and a tile leaves no unused Arrow memory behind."""
    import numpy as np
    import pyarrow as pa

    from kinspan.operators import topk

    released = []
    real = pa.default_memory_pool()
    pool = type("Pool", (), {"release_unused": lambda self: (released.append(1), real.release_unused())[0]})()
    monkeypatch.setattr(topk.pa, "default_memory_pool", lambda: pool)
    starts, codes, weights = topk.weighed(pa.chunked_array([[["a", "b", "a"], None, ["c", "x"]]]), pa.array(["a", "b", "c"]), np.array([1.0, 2.0, 3.0]))
    assert (list(starts), list(codes), codes.dtype) == ([0, 2, 2, 3], [0, 1, 2], np.int32)
    assert np.allclose(weights, [1 + np.log(2), 2.0, 3.0])
    assert topk.Postings(codes, weights, starts, 3).rows.dtype == np.int32
    queries = pa.table({"entity_id": ["S1-0"], "norm": [1.0], "terms": [["a"]]})
    lists = pa.array([None, ["a", "b"]], pa.list_(pa.string()))
    targets = pa.table({"ids": pa.array([["S2-1"], None], pa.list_(pa.string())), "terms": pa.array([["a", "a"], None], pa.list_(pa.string())), "words": lists, "idf": pa.array([None, [1.0, 1.0]], pa.list_(pa.float64()))})
    before = len(released)
    found = topk.best_of_tile(5)((pa.scalar("S2"),), queries, targets)
    assert found.to_pylist() == [{"candidate_source": "S2", "entity_id": "S1-0", "entity_id_cand": "S2-1", "score": 1.0}]
    assert len(released) == before + 3  # after the targets', the queries' and the whole tile
