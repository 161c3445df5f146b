import pytest
from pyspark.sql import functions as F

from kinspan.functions import normalize, similarity


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value,clean,punct,fold",
    [
        ("  Alpha   Engineering  ", "alpha engineering", "alpha engineering", "alpha engineering"),
        ("a\tb\nc", "a b c", "a b c", "a b c"),
        ("Alpha & Beta", "alpha & beta", "alpha and beta", "alpha & beta"),
        ("Coca-Cola", "coca-cola", "coca-cola", "coca-cola"),
        ("- x -y z- a--b", "- x -y z- a--b", "x y z a b", "- x -y z- a--b"),
        ("Société Alpha S.A.S.", "société alpha s.a.s.", "société alpha s a s", "societe alpha s.a.s."),
        ("Straße_1 $5 — ok", "strasse_1 $5 — ok", "strasse 1 $5 ok", "strasse_1 $5 — ok"),
        (None, "", "", ""), ("", "", "", ""),
    ],
)
def test_views(spark, value, clean, punct, fold):
    df = normalize.views(spark.createDataFrame([(value,)], "v string"), "v", "n").first()
    assert (df["n_norm_clean"], df["n_norm_punct"], df["n_norm_accent_fold"]) == (clean, punct, fold)
    assert normalize.exact_text(value)[1:] == (clean, punct, fold)


def test_exact_views_agree_with_the_native_path(spark):
    data = [("Société",), ("plain Text",), ("टाटा मोटर्स",), ("Mixed टेस्ट Co.",), (None,), ("",), ("ΑΣ ßς",)]
    df = spark.createDataFrame(data, "v string")
    got = {r["v"]: r for r in normalize.exact_views(df, "v", "n").collect()}
    for (v,) in data:
        assert tuple(got[v][f"n_norm_{n}"] for n in normalize.VIEWS) == normalize.exact_text(v)
    assert got["टाटा मोटर्स"]["n_norm_clean"] == "टाटा मोटर्स"


def test_numeric_tokens(spark):
    assert one(spark, normalize.numeric_tokens, "21 Park Road, PIN 400001") == "21 400001"
    assert one(spark, normalize.numeric_tokens, "Main Street") == ""
    assert one(spark, normalize.numeric_tokens, None) == ""
    assert one(spark, normalize.numeric_tokens, "२१ x 7 7") == "२१ 7 7"


def test_buckets_and_patterns(spark):
    df = spark.createDataFrame([(0, []), (1, ["S2-1"]), (2, ["S2-1", "S3-2"]), (10, ["S3-1"])], "n int, ids array<string>")
    got = df.select("n", normalize.match_bucket(F.col("n")).alias("b"), normalize.source_pattern(F.col("ids")).alias("p")).collect()
    assert {r["n"]: (r["b"], r["p"]) for r in got} == {0: ("ZERO_MATCH", "NONE"), 1: ("SINGLE_MATCH", "S2_ONLY"), 2: ("MULTI_MATCH", "BOTH"), 10: ("MULTI_MATCH", "S3_ONLY")}
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1,)], "n int").select(normalize.match_bucket(F.col("n"))).collect()


PAIRS = [("apple inc", "apple incorporated", 0.666667), ("apple inc", "aple inc", 0.941176), ("kitten", "sitting", 0.615385), ("abc", "xyz", 0.0), ("a", "a", 1.0)]


def test_indel_ratio(spark):
    for a, b, want in PAIRS:
        assert round(similarity.indel(a, b), 6) == want
    df = spark.createDataFrame([(a, b) for a, b, _ in PAIRS] + [("", "x"), (None, "x")], "a string, b string")
    got = df.select(similarity.indel_ratio("a", "b").alias("x"), similarity.indel_ratio_native(F.col("a"), F.col("b")).alias("y")).collect()
    for r, want in zip(got, [w for *_, w in PAIRS] + [None, None]):
        assert (r["x"] is None) == (want is None) and (want is None or round(r["x"], 6) == want)
        assert (r["y"] is None) == (want is None) and (want is None or round(r["y"], 6) == want)


def test_token_ratios():
    assert similarity.token_sort("beta alpha", "alpha beta") == 1.0
    assert similarity.token_set("alpha beta", "alpha beta gamma") == 1.0
    assert similarity.token_set("abc", "xyz") == 0.0
    assert round(similarity.token_set("alpha x", "alpha y"), 6) == round(max(1 - 2 / 14, 1 - 2 / 12), 6)


def test_registered_functions(spark):
    similarity.register(spark)
    assert round(spark.sql("SELECT indel_ratio('kitten', 'sitting') AS x").first()["x"], 6) == 0.615385
