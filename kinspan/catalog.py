"""Named linkage queries over the entity view of ``documents``, and their SQL twins.

A key starts with the inventory id that it stands for. Oracles share one list of
common table expressions; an engine only runs those that a query reaches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.functions import normalize
from kinspan.operators import audits, decide, features, metrics, pairs, retrieval
from kinspan.plans import jobs
from kinspan.plans.linkage import CandidateGenerator, Config, TargetContext
from kinspan.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Tables that many queries start from, kept for one application and folder at a time, like those that the jobs leave; spilled where memory is short.
_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def release() -> None:
    """Forgets the kept tables."""
    for df in _KEPT.values():
        df.unpersist()
    _KEPT.clear()


class Data:
    """The tables that queries start from; plans are built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def entities(self) -> DataFrame:
        return tables.entity_view(self.spark, self.sf_dir)

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        home = (self.spark.sparkContext.applicationId, self.sf_dir)
        if any(k[:2] != home for k in _KEPT):
            if all(k[0] == home[0] for k in _KEPT):
                release()
            _KEPT.clear()
        if (*home, name) not in _KEPT:
            _KEPT[*home, name] = make().persist()
        return _KEPT[*home, name]

    @property
    def records(self) -> DataFrame:
        return self.kept("records", lambda: tables.normalized(self.entities))

    @property
    def known(self) -> DataFrame:
        """The entities, out of the kept records where a query has those anyway, so that texts are not read again."""
        at_hand = (self.spark.sparkContext.applicationId, self.sf_dir, "records") in _KEPT
        return self.records.select(*self.entities.columns) if at_hand else self.entities

    @property
    def s1(self) -> DataFrame:
        return self.known.where(F.col("source") == "S1")

    @property
    def truth(self) -> DataFrame:
        """Pairs of an S1 and another source's record of one language with the same words 17 and 18: copies, and texts that differ elsewhere, so that channels miss some."""
        e = self.known.select("entity_id", "source", "truth_key")
        a = e.where(F.col("source") == "S1").select(F.col("entity_id").alias("entity_id_s1"), "truth_key")
        b = e.where(F.col("source") != "S1").select(F.col("entity_id").alias("entity_id_cand"), "truth_key")
        return a.join(b, "truth_key").select("entity_id_s1", "entity_id_cand")

    @property
    def flags(self) -> DataFrame:
        return retrieval.exact_flags(self.records)

    @property
    def pool(self) -> DataFrame:
        return self.kept("pool", lambda: retrieval.evidence(self.records))

    @property
    def folds(self) -> DataFrame:
        return self.kept("folds", lambda: pairs.stratified_folds(pairs.match_profile(self.s1, self.truth)))

    @property
    def profile(self) -> DataFrame:
        return pairs.match_profile(self.s1, self.truth)

    @property
    def labelled(self) -> DataFrame:
        """The pruned pool with labels, folds and countries."""
        cut = retrieval.rank_and_prune(self.pool)
        return pairs.with_folds(pairs.labelled(cut, self.truth), self.folds, self.s1)


def query(name: str, sql: str | None = None, more: str = "") -> Callable[[Callable[[Data], DataFrame]], Callable[[Data], DataFrame]]:
    """Registers a plan under ``name``, with its SQL twin and the common table expressions that only this one needs."""

    def add(plan: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plan(Data(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"WITH {COMMON}{',' + more if more else ''}\n{sql}"
        return plan

    return add


SPACES = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


#: Letters whose case folding is not their lower case, as far as the test rows hold them.
FOLDED = {"ß": "ss", "ς": "σ", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"}


def sql_clean(x: str) -> str:
    held = f"lower(nfc_normalize(coalesce({x}, '')))"
    for a, b in FOLDED.items():
        held = f"replace({held}, '{a}', '{b}')"
    return f"trim(regexp_replace({held}, '{SPACES}', ' ', 'g'))"


def sql_punct(x: str) -> str:
    word = r"[\p{L}\p{N}_]"
    held = f"replace({x}, '&', ' and ')"
    for _ in range(2):
        held = f"regexp_replace({held}, '({word})-({word})', '\\1' || chr(1) || '\\2', 'g')"
    return f"trim(regexp_replace(replace(regexp_replace({held}, '\\p{{P}}', ' ', 'g'), chr(1), '-'), '{SPACES}', ' ', 'g'))"


def sql_exact(name: str, a: str, b: str) -> str:
    return f"""SELECT s.entity_id AS s1, t.entity_id AS cand, t.source AS src, '{name}' AS rule FROM norm s JOIN norm t
      ON s.{a} = t.{a} AND s.{b} = t.{b} AND s.country = t.country WHERE s.source = 'S1' AND t.source <> 'S1' AND s.{a} <> '' AND s.{b} <> ''"""


def sql_tfidf(name: str, view: str, k: int = 5, chars: bool = False, min_df: int = 1, max_df: float = 1.0, max_terms: int | None = None) -> str:
    """CTEs ending in {name}(s1, cand, src, score, rank)."""
    cut = "" if max_terms is None else f" QUALIFY row_number() OVER (PARTITION BY source, country ORDER BY all_n DESC, term) <= {max_terms}"
    if chars:
        words = f"list_filter(string_split({sql_clean(view)}, ' '), lambda w: w <> '')"
        grams = f"flatten(list_transform({words}, lambda w: list_concat(CASE WHEN length(w) + 2 < 3 THEN [' ' || w || ' '] ELSE list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)) END, list_transform(range(1, greatest(length(w), 1)), lambda i: substr(' ' || w || ' ', i, 4)))))"
    else:
        words = f"regexp_extract_all(lower({view}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
        grams = f"list_concat({words}, list_transform(range(1, len({words})), lambda i: ({words})[i] || ' ' || ({words})[i + 1]))"
    return f"""
{name}_t AS (SELECT source, country, entity_id, unnest({grams}) AS term FROM norm WHERE {view} <> ''),
{name}_f AS (SELECT source, country, entity_id, term, count(*) AS n FROM {name}_t GROUP BY ALL),
{name}_n AS (SELECT source, country, count(*) AS docs FROM norm WHERE {view} <> '' AND source <> 'S1' GROUP BY ALL),
{name}_d AS (SELECT f.source, f.country, term, docs, count(*) AS df, sum(f.n) AS all_n FROM {name}_f f JOIN {name}_n USING (source, country) WHERE f.source <> 'S1' GROUP BY f.source, f.country, term, docs),
{name}_i AS (SELECT source, country, term, ln((1.0 + docs::DOUBLE) / (1.0 + df::DOUBLE)) + 1.0 AS idf FROM {name}_d WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * docs{cut}),
{name}_t0 AS (SELECT i.source, i.country, i.term, f.entity_id, (1.0 + ln(f.n::DOUBLE)) * idf AS w FROM {name}_f f JOIN {name}_i i ON f.source = i.source AND f.country = i.country AND f.term = i.term),
{name}_q0 AS (SELECT i.source, i.country, i.term, f.entity_id, (1.0 + ln(f.n::DOUBLE)) * idf AS w FROM {name}_f f JOIN {name}_i i ON f.source = 'S1' AND f.country = i.country AND f.term = i.term),
{name}_tw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY source, entity_id)) AS x FROM {name}_t0),
{name}_qw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY source, entity_id)) AS x FROM {name}_q0),
{name}_s AS (SELECT q.entity_id AS s1, t.entity_id AS cand, q.source AS src, round(sum(q.x * t.x), 9) AS score FROM {name}_qw q JOIN {name}_tw t USING (source, country, term) GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY s1, src ORDER BY score DESC, cand) AS rank FROM {name}_s WHERE score > 0 QUALIFY rank <= {k})"""


COMMON = rf"""
words AS (SELECT *, string_split_regex(trim(text), '\s+') AS w FROM documents),
ent AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, 'S' || (doc_id % 3 + 1) AS source, lang AS country,
  array_to_string(list_slice(w, 1, 6), ' ') AS business_name, array_to_string(list_slice(w, 7, 16), ' ') AS business_address,
  array_to_string(regexp_extract_all(text, '\p{{Nd}}+'), ' ') AS addr_numeric_tokens, CASE WHEN len(w) >= 18 THEN md5(lang || ' ' || array_to_string(list_slice(w, 17, 18), ' ')) END AS truth_key FROM words),
norm0 AS (SELECT *, {sql_clean("business_name")} AS name_norm_clean, {sql_clean("business_address")} AS addr_norm_clean FROM ent),
norm AS (SELECT *, {sql_punct("name_norm_clean")} AS name_norm_punct, {sql_punct("addr_norm_clean")} AS addr_norm_punct,
  strip_accents(name_norm_clean) AS name_norm_accent_fold, strip_accents(addr_norm_clean) AS addr_norm_accent_fold FROM norm0),
s1 AS (SELECT * FROM norm WHERE source = 'S1'),
truth AS (SELECT a.entity_id AS s1, b.entity_id AS cand FROM ent a JOIN ent b ON a.truth_key = b.truth_key WHERE a.source = 'S1' AND b.source <> 'S1'),
single AS (SELECT source, name_norm_clean, country, min(entity_id) AS cand FROM norm WHERE source <> 'S1' AND name_norm_clean <> '' GROUP BY ALL HAVING count(*) = 1),
rules AS ({sql_exact("clean", "name_norm_clean", "addr_norm_clean")} UNION ALL {sql_exact("accent", "name_norm_accent_fold", "addr_norm_accent_fold")}
  UNION ALL {sql_exact("punct", "name_norm_punct", "addr_norm_punct")}
  UNION ALL SELECT s.entity_id, u.cand, u.source, 'unique' FROM s1 s JOIN single u ON s.name_norm_clean = u.name_norm_clean AND s.country = u.country),
flags AS (SELECT s1, cand, src, max((rule = 'clean')::INT) AS exact_name_address_clean, max((rule = 'accent')::INT) AS exact_name_address_accent,
  max((rule = 'punct')::INT) AS exact_name_address_punct, max((rule = 'unique')::INT) AS unique_exact_name FROM rules GROUP BY s1, cand, src),
d0 AS (SELECT s1, cand FROM flags WHERE greatest(exact_name_address_clean, exact_name_address_accent, exact_name_address_punct) = 1),
d1 AS (SELECT f.s1, f.cand FROM flags f JOIN norm a ON a.entity_id = f.s1 JOIN norm b ON b.entity_id = f.cand
  WHERE greatest(exact_name_address_clean, exact_name_address_accent, exact_name_address_punct) = 1 OR (unique_exact_name = 1 AND (a.addr_norm_clean = '' OR b.addr_norm_clean = ''))),
ntok AS (SELECT DISTINCT source, country, entity_id, unnest(string_split(name_norm_clean, ' ')) AS token FROM norm),
ndf AS (SELECT source, country, token, count(*) AS df FROM ntok WHERE token <> '' GROUP BY ALL),
rare_q AS (SELECT t.entity_id AS s1, d.source, d.country, d.token, d.df FROM ntok t JOIN ndf d ON t.country = d.country AND t.token = d.token
  WHERE t.source = 'S1' AND d.source <> 'S1' AND d.df <= 10 QUALIFY row_number() OVER (PARTITION BY t.entity_id, d.source ORDER BY d.df, d.token) <= 3),
rare AS (SELECT s1, t.entity_id AS cand, q.source AS src, count(*)::INT AS overlap, min(df)::INT AS least_df FROM rare_q q JOIN ntok t ON t.source = q.source AND t.country = q.country AND t.token = q.token GROUP BY ALL),
dtok AS (SELECT DISTINCT source, country, entity_id, unnest(string_split(addr_numeric_tokens, ' ')) AS token FROM norm),
ddf AS (SELECT source, country, token, count(*) AS df FROM dtok WHERE token <> '' GROUP BY ALL HAVING count(*) <= 50),
nums AS (SELECT a.entity_id AS s1, b.entity_id AS cand, b.source AS src, count(*)::INT AS shared FROM dtok a JOIN ddf d ON a.country = d.country AND a.token = d.token
  JOIN dtok b ON b.source = d.source AND b.country = d.country AND b.token = d.token WHERE a.source = 'S1' AND d.source <> 'S1' GROUP BY ALL),
{sql_tfidf("nw", "name_norm_clean")}, {sql_tfidf("aw", "addr_norm_clean")}, {sql_tfidf("cw", "name_norm_clean", 10, True)},
parts AS (
  SELECT s1, cand, src, 1 AS ex, 0 AS nm, 0 AS ad, 0 AS ra, 0 AS nu, exact_name_address_clean AS f1, exact_name_address_accent AS f2, exact_name_address_punct AS f3, unique_exact_name AS f4, NULL::DOUBLE AS ns, NULL::INT AS nr, NULL::DOUBLE AS sa, NULL::INT AS ar, NULL::INT AS ro, NULL::INT AS rd, NULL::INT AS sn FROM flags
  UNION ALL SELECT s1, cand, src, 0, 1, 0, 0, 0, 0, 0, 0, 0, score, rank, NULL, NULL, NULL, NULL, NULL FROM nw
  UNION ALL SELECT s1, cand, src, 0, 0, 1, 0, 0, 0, 0, 0, 0, NULL, NULL, score, rank, NULL, NULL, NULL FROM aw
  UNION ALL SELECT s1, cand, src, 0, 0, 0, 1, 0, 0, 0, 0, 0, NULL, NULL, NULL, NULL, overlap, least_df, NULL FROM rare
  UNION ALL SELECT s1, cand, src, 0, 0, 0, 0, 1, 0, 0, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, shared FROM nums),
pool AS (SELECT s1 AS entity_id_s1, cand AS entity_id_cand, min(src) AS candidate_source, max(ex) AS retrieved_exact, max(nm) AS retrieved_name_word, max(ad) AS retrieved_address_word,
  max(ra) AS retrieved_rare, max(nu) AS retrieved_numeric, max(f1) AS exact_name_address_clean, max(f2) AS exact_name_address_accent, max(f3) AS exact_name_address_punct, max(f4) AS unique_exact_name,
  coalesce(max(ns), 0.0)::DOUBLE AS name_word_score, coalesce(min(nr), 9999)::INT AS name_word_rank, coalesce(max(sa), 0.0)::DOUBLE AS address_word_score, coalesce(min(ar), 9999)::INT AS address_word_rank,
  coalesce(max(ro), 0)::INT AS rare_token_overlap_count, coalesce(min(rd), 999999)::INT AS rarest_shared_token_df, coalesce(max(sn), 0)::INT AS shared_numeric_count, 0 AS numeric_conflict,
  max(ex) + max(nm) + max(ad) + max(ra) + max(nu) AS retrieval_channel_count FROM parts GROUP BY 1, 2),
keyed AS (SELECT *, greatest(exact_name_address_clean, exact_name_address_accent, exact_name_address_punct) AS is_exact, least(name_word_rank, address_word_rank) AS best_lexical_rank,
  least(retrieved_name_word, retrieved_address_word) AS both_name_address FROM pool),
placed AS (SELECT *, row_number() OVER (PARTITION BY entity_id_s1 ORDER BY is_exact DESC, retrieval_channel_count DESC, both_name_address DESC, best_lexical_rank, rare_token_overlap_count DESC, shared_numeric_count DESC, entity_id_cand)::INT AS candidate_rank FROM keyed),
legacy AS (SELECT *, row_number() OVER (PARTITION BY entity_id_s1 ORDER BY is_exact DESC, retrieval_channel_count DESC, name_word_score DESC, address_word_score DESC, rare_token_overlap_count DESC, shared_numeric_count DESC, entity_id_cand)::INT AS candidate_rank FROM keyed),
profile AS (SELECT s.entity_id, s.country, count(t.cand)::INT AS n_true_matches, CASE count(t.cand) WHEN 0 THEN 'ZERO_MATCH' WHEN 1 THEN 'SINGLE_MATCH' ELSE 'MULTI_MATCH' END AS match_bucket,
  CASE WHEN count(*) FILTER (t.cand LIKE 'S2-%') > 0 AND count(*) FILTER (t.cand LIKE 'S3-%') > 0 THEN 'BOTH' WHEN count(*) FILTER (t.cand LIKE 'S2-%') > 0 THEN 'S2_ONLY' WHEN count(*) FILTER (t.cand LIKE 'S3-%') > 0 THEN 'S3_ONLY' ELSE 'NONE' END AS source_pattern
  FROM s1 s LEFT JOIN truth t ON t.s1 = s.entity_id GROUP BY s.entity_id, s.country),
strata AS (SELECT *, CASE WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM profile GROUP BY country, match_bucket)) >= 5 THEN country || '|' || match_bucket
  WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM profile GROUP BY country)) >= 5 THEN country ELSE 'ALL' END AS stratum FROM profile),
folds AS (SELECT entity_id, country, n_true_matches, match_bucket, source_pattern, ((row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || entity_id), entity_id) - 1) % 5)::INT AS fold_id FROM strata),
labelled AS (SELECT p.*, (t.cand IS NOT NULL)::INT AS label, f.fold_id AS fold, f.country FROM placed p LEFT JOIN truth t ON t.s1 = p.entity_id_s1 AND t.cand = p.entity_id_cand
  JOIN folds f ON f.entity_id = p.entity_id_s1 WHERE candidate_rank <= 15),
manifest AS (SELECT f.entity_id AS entity_id_s1, f.country, f.fold_id AS fold, coalesce(c.n, 0)::BIGINT AS candidate_count, coalesce(c.pos, 0)::BIGINT AS positive_candidate_count, coalesce(c.n2, 0)::BIGINT AS retrieved_s2_count,
  coalesce(c.n3, 0)::BIGINT AS retrieved_s3_count, f.n_true_matches::BIGINT AS gt_match_count, coalesce(g.n2, 0)::BIGINT AS gt_s2_count, coalesce(g.n3, 0)::BIGINT AS gt_s3_count, (coalesce(c.pos, 0) > 0)::INT AS has_retrieved_positive,
  f.match_bucket, greatest(f.n_true_matches - coalesce(c.pos, 0), 0)::BIGINT AS missing_positive_count
  FROM folds f LEFT JOIN (SELECT entity_id_s1, count(*) AS n, sum(label) AS pos, count(*) FILTER (candidate_source = 'S2') AS n2, count(*) FILTER (candidate_source = 'S3') AS n3 FROM labelled GROUP BY 1) c ON c.entity_id_s1 = f.entity_id
  LEFT JOIN (SELECT s1, count(*) FILTER (cand LIKE 'S2-%') AS n2, count(*) FILTER (cand LIKE 'S3-%') AS n3 FROM truth GROUP BY 1) g ON g.s1 = f.entity_id)"""


def sql_counts(pred: str, columns: str = "") -> str:
    """Per S1 the numbers of predicted, true and common pairs; ``pred`` gives (s1, cand)."""
    return f"""(SELECT s.entity_id, s.country{columns}, (SELECT count(*) FROM (SELECT DISTINCT s1, cand FROM ({pred})) p WHERE p.s1 = s.entity_id)::BIGINT AS n_pred,
  (SELECT count(*) FROM truth t WHERE t.s1 = s.entity_id)::BIGINT AS n_true,
  (SELECT count(*) FROM truth t JOIN (SELECT DISTINCT s1, cand FROM ({pred})) p USING (s1, cand) WHERE t.s1 = s.entity_id)::BIGINT AS n_hit FROM s1 s)"""


F05 = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_pred = 0 OR n_true = 0 OR n_hit = 0 THEN 0.0 ELSE 1.25 * (n_hit / n_pred) * (n_hit / n_true) / (0.25 * (n_hit / n_pred) + n_hit / n_true) END::DOUBLE"

# --- scans, projections and scalar functions -------------------------------------------------


@query("s5_table_scan", "SELECT * FROM region")
def _(d: Data) -> DataFrame:
    return tables.read_table(d.spark, f"{d.sf_dir}/region.parquet")


@query("s7_projected_filtered_scan", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 7")
def _(d: Data) -> DataFrame:
    return tables.read_table(d.spark, f"{d.sf_dir}/customer.parquet", ["c_custkey", "c_name", "c_nationkey"], F.col("c_nationkey") == 7)


@query("s12_id_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(d: Data) -> DataFrame:
    ids = d.table("customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return d.table("orders").select("o_orderkey", "o_custkey").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("n_entity_view", "SELECT * FROM ent")
def _(d: Data) -> DataFrame:
    return d.entities


@query("n4_clean", "SELECT entity_id, name_norm_clean, addr_norm_clean FROM norm")
def _(d: Data) -> DataFrame:
    return d.records.select("entity_id", "name_norm_clean", "addr_norm_clean")


@query("n5_punct", "SELECT entity_id, name_norm_punct, addr_norm_punct FROM norm")
def _(d: Data) -> DataFrame:
    return d.records.select("entity_id", "name_norm_punct", "addr_norm_punct")


@query("n6_accent_fold", "SELECT entity_id, name_norm_accent_fold, addr_norm_accent_fold FROM norm")
def _(d: Data) -> DataFrame:
    return d.records.select("entity_id", "name_norm_accent_fold", "addr_norm_accent_fold")


@query("n8_full_unicode_views", "SELECT entity_id, nfc_normalize(business_name) AS name_norm_unicode, name_norm_clean, name_norm_punct, name_norm_accent_fold FROM norm")
def _(d: Data) -> DataFrame:
    v = normalize.exact_views(d.entities.select("entity_id", "business_name"), "business_name", "name")
    return v.select("entity_id", "name_norm_unicode", "name_norm_clean", "name_norm_punct", "name_norm_accent_fold")


@query("n7_numeric_tokens", r"SELECT c_custkey, array_to_string(regexp_extract_all(c_name, '\p{Nd}+'), ' ') AS numbers FROM customer")
def _(d: Data) -> DataFrame:
    return d.table("customer").select("c_custkey", normalize.numeric_tokens(F.col("c_name")).alias("numbers"))


@query("n13_source_prefix", "SELECT source, count(*) FILTER (entity_id LIKE source || '-%')::BIGINT AS n FROM ent GROUP BY source")
def _(d: Data) -> DataFrame:
    return d.entities.groupBy("source").agg(F.count_if(F.substring_index("entity_id", "-", 1) == F.col("source")).alias("n"))


@query("n16_jaccard_containment", """SELECT entity_id, round(CASE WHEN len(u) > 0 THEN len(i) / len(u) END, 6) AS jaccard, round(CASE WHEN len(a) > 0 THEN len(i) / len(a) END, 6) AS containment FROM (
  SELECT entity_id, a, list_intersect(a, b) AS i, list_distinct(list_concat(a, b)) AS u FROM (SELECT entity_id, list_distinct(list_filter(string_split(name_norm_clean, ' '), lambda x: x <> '')) AS a,
  list_distinct(list_filter(string_split(addr_norm_clean, ' '), lambda x: x <> '')) AS b FROM norm))""")  # fmt: skip
def _(d: Data) -> DataFrame:
    from kinspan.functions import similarity

    a, b = normalize.word_set(F.col("name_norm_clean")), normalize.word_set(F.col("addr_norm_clean"))
    return d.records.select("entity_id", F.round(similarity.jaccard(a, b), 6).alias("jaccard"), F.round(similarity.containment(a, b), 6).alias("containment"))


@query("n18_word_sets", "SELECT entity_id, len(list_distinct(list_filter(string_split(name_norm_clean, ' '), lambda x: x <> '')))::INT AS words FROM norm")
def _(d: Data) -> DataFrame:
    return d.records.select("entity_id", F.size(normalize.word_set(F.col("name_norm_clean"))).alias("words"))


@query("n19_n20_match_profile", "SELECT * FROM profile")
def _(d: Data) -> DataFrame:
    return pairs.match_profile(d.s1, d.truth)


@query("u7_explode_truth", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand FROM truth")
def _(d: Data) -> DataFrame:
    lists = decide.id_lists(d.s1, d.truth)
    return tables.truth_pairs(lists)


@query("k4_o2_match_lists", "SELECT entity_id AS source1_entity_id, coalesce(string_agg(cand, ',' ORDER BY cand), '') AS matched_entity_ids FROM s1 LEFT JOIN truth ON truth.s1 = entity_id GROUP BY 1")
def _(d: Data) -> DataFrame:
    return decide.id_lists(d.s1, d.truth)


# --- exact joins and inverted indexes --------------------------------------------------------

for _rule, _id in (("exact_name_address_clean", "j1"), ("exact_name_address_accent", "j2"), ("exact_name_address_punct", "j3")):
    QUERIES[f"{_id}_{_rule}"] = lambda spark, sf_dir, rule=_rule: retrieval.rule_pairs(Data(spark, sf_dir).records, rule)
    ORACLES[f"{_id}_{_rule}"] = f"WITH {COMMON}\nSELECT s1 AS entity_id_s1, cand AS entity_id_cand, src AS candidate_source FROM rules WHERE rule = '{_rule.rpartition('_')[2]}'"


@query("j4_unique_name", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand, src AS candidate_source FROM rules WHERE rule = 'unique'")
def _(d: Data) -> DataFrame:
    return retrieval.unique_name_pairs(d.records)


@query("j5_without_country", """SELECT s.entity_id AS entity_id_s1, t.entity_id AS entity_id_cand, t.source AS candidate_source FROM norm s JOIN norm t ON s.name_norm_clean = t.name_norm_clean
  AND s.addr_norm_clean = t.addr_norm_clean WHERE s.source = 'S1' AND t.source <> 'S1' AND s.name_norm_clean <> '' AND s.addr_norm_clean <> ''""")
def _(d: Data) -> DataFrame:
    return retrieval.rule_pairs(d.records, "exact_name_address_clean", use_country=False)


@query("j6_rare_tokens", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand, src AS candidate_source, overlap AS rare_token_overlap_count, least_df AS rarest_shared_token_df FROM rare")
def _(d: Data) -> DataFrame:
    return retrieval.rare_token_pairs(d.records)


@query("j7_numeric_tokens", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand, src AS candidate_source, shared AS shared_numeric_count, 0 AS numeric_conflict FROM nums")
def _(d: Data) -> DataFrame:
    return retrieval.numeric_pairs(d.records)


@query("j8_v1_tfidf_name_topk", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand, src AS candidate_source, score, rank::INT AS rank FROM nw")
def _(d: Data) -> DataFrame:
    return retrieval.tfidf_pairs(d.records, "name_norm_clean")


@query("j8_v5_tfidf_address_topk", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand, src AS candidate_source, score, rank::INT AS rank FROM aw")
def _(d: Data) -> DataFrame:
    return retrieval.tfidf_pairs(d.records, "addr_norm_clean")


@query("j9_v3_char_tfidf_topk", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand, src AS candidate_source, score, (rank - 1)::INT AS rank FROM cw")
def _(d: Data) -> DataFrame:
    return retrieval.tfidf_pairs(d.records, "name_norm_clean", 10, retrieval.char_terms, zero_based=True)


@query("j10_word_tfidf_top20", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand, src AS candidate_source, score, rank::INT AS rank FROM t20", sql_tfidf("t20", "name_norm_clean", 20))
def _(d: Data) -> DataFrame:
    return retrieval.tfidf_pairs(d.records, "name_norm_clean", 20)


@query("v4_pruned_vocabulary_tfidf", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand, src AS candidate_source, score, rank::INT AS rank FROM pruned", sql_tfidf("pruned", "name_norm_clean", 10, False, 2, 0.2, 1000))
def _(d: Data) -> DataFrame:
    return retrieval.tfidf_pairs(d.records, "name_norm_clean", 10, min_df=2, max_df=0.2, max_terms=1000)


@query("j11_view_outer_join", """SELECT coalesce(a.s1, b.s1) AS entity_id_s1, coalesce(a.cand, b.cand) AS entity_id_cand, coalesce(a.score, 0.0)::DOUBLE AS name_score, coalesce(b.score, 0.0)::DOUBLE AS address_score
  FROM nw a FULL JOIN aw b ON a.s1 = b.s1 AND a.cand = b.cand""")
def _(d: Data) -> DataFrame:
    a = retrieval.tfidf_pairs(d.records, "name_norm_clean").select("entity_id_s1", "entity_id_cand", F.col("score").alias("name_score"))
    b = retrieval.tfidf_pairs(d.records, "addr_norm_clean").select("entity_id_s1", "entity_id_cand", F.col("score").alias("address_score"))
    return a.join(b, ["entity_id_s1", "entity_id_cand"], "full_outer").fillna(0.0)


@query("j12_pool_outer_join", """SELECT coalesce(f.s1, n.s1) AS entity_id_s1, coalesce(f.cand, n.cand) AS entity_id_cand, (coalesce(exact_name_address_clean, 0) + coalesce(exact_name_address_accent, 0)
  + coalesce(exact_name_address_punct, 0) + coalesce(unique_exact_name, 0) + (n.s1 IS NOT NULL)::INT)::INT AS channels FROM flags f FULL JOIN nw n ON f.s1 = n.s1 AND f.cand = n.cand""")
def _(d: Data) -> DataFrame:
    a = d.flags.select("entity_id_s1", "entity_id_cand", "exact_count")
    b = retrieval.tfidf_pairs(d.records, "name_norm_clean").select("entity_id_s1", "entity_id_cand", F.lit(1).alias("lexical"))
    both = a.join(b, ["entity_id_s1", "entity_id_cand"], "full_outer")
    return both.select("entity_id_s1", "entity_id_cand", (F.coalesce("exact_count", F.lit(0)) + F.coalesce("lexical", F.lit(0))).alias("channels"))


@query("j14_fold_country_lookup", "SELECT entity_id_s1, entity_id_cand, fold, country, label FROM labelled")
def _(d: Data) -> DataFrame:
    return d.labelled.select("entity_id_s1", "entity_id_cand", "fold", "country", "label")


@query("j15_text_lookup", """SELECT f.s1 AS entity_id_s1, f.cand AS entity_id_cand, a.name_norm_clean AS name_a, b.name_norm_clean AS name_b, a.addr_norm_clean AS address_a, b.addr_norm_clean AS address_b
  FROM flags f JOIN norm a ON a.entity_id = f.s1 JOIN norm b ON b.entity_id = f.cand""")
def _(d: Data) -> DataFrame:
    return features.with_texts(d.flags, d.records).select("entity_id_s1", "entity_id_cand", "name_a", "name_b", "address_a", "address_b")


@query("j17_truth_hits", "SELECT t.s1 AS entity_id_s1, t.cand AS entity_id_cand, (f.s1 IS NOT NULL)::INT AS found FROM truth t LEFT JOIN flags f ON t.s1 = f.s1 AND t.cand = f.cand")
def _(d: Data) -> DataFrame:
    found = d.flags.select("entity_id_s1", "entity_id_cand", F.lit(1).alias("found"))
    return d.truth.join(found, ["entity_id_s1", "entity_id_cand"], "left").fillna(0, ["found"])


@query("j18_metric_frame", f"SELECT entity_id, country, n_pred, n_true, n_hit FROM {sql_counts('SELECT s1, cand FROM flags')}")
def _(d: Data) -> DataFrame:
    return metrics.hit_counts(d.s1.select("entity_id", "country"), d.flags, d.truth)


@query("j19_missed_truth", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand FROM truth EXCEPT SELECT s1, cand FROM flags")
def _(d: Data) -> DataFrame:
    return d.truth.join(d.flags, ["entity_id_s1", "entity_id_cand"], "left_anti")


@query("j20_found_truth", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand FROM truth INTERSECT SELECT s1, cand FROM flags")
def _(d: Data) -> DataFrame:
    return d.truth.join(d.flags, ["entity_id_s1", "entity_id_cand"], "left_semi")


@query("j21_q2_country_audit", "SELECT a.country AS country_s1, b.country AS country_cand, count(*)::BIGINT AS pairs, a.country = b.country AS agrees FROM truth JOIN ent a ON a.entity_id = s1 JOIN ent b ON b.entity_id = cand GROUP BY ALL")
def _(d: Data) -> DataFrame:
    return audits.country_audit(d.truth, d.entities)


@query("j22_manifest_with_folds", "SELECT f.entity_id, f.country, f.fold_id, coalesce(n, 0)::BIGINT AS candidates FROM folds f LEFT JOIN (SELECT s1, count(*) AS n FROM flags GROUP BY 1) c ON c.s1 = f.entity_id")
def _(d: Data) -> DataFrame:
    n = d.flags.groupBy(F.col("entity_id_s1").alias("entity_id")).agg(F.count("*").alias("candidates"))
    return d.folds.select("entity_id", "country", "fold_id").join(n, "entity_id", "left").fillna(0, ["candidates"])


@query("j23_missed_names", """SELECT m.s1 AS entity_id_s1, m.cand AS entity_id_cand, a.business_name AS name_s1, b.business_name AS name_cand FROM (SELECT s1, cand FROM truth EXCEPT SELECT s1, cand FROM flags) m
  JOIN ent a ON a.entity_id = m.s1 JOIN ent b ON b.entity_id = m.cand""")
def _(d: Data) -> DataFrame:
    missed = d.truth.join(d.flags, ["entity_id_s1", "entity_id_cand"], "left_anti")
    names = d.entities.select("entity_id", "business_name")
    a = names.select(F.col("entity_id").alias("entity_id_s1"), F.col("business_name").alias("name_s1"))
    b = names.select(F.col("entity_id").alias("entity_id_cand"), F.col("business_name").alias("name_cand"))
    return missed.join(a, "entity_id_s1").join(b, "entity_id_cand").select("entity_id_s1", "entity_id_cand", "name_s1", "name_cand")


@query("j24_q6_parity", """SELECT coalesce(a.s1, b.s1) AS entity_id_s1, coalesce(a.cand, b.cand) AS entity_id_cand, a.score AS score_old, b.score AS score_new,
  CASE WHEN b.s1 IS NULL THEN 'only_old' WHEN a.s1 IS NULL THEN 'only_new' ELSE 'differs' END AS status FROM nw a FULL JOIN aw b ON a.s1 = b.s1 AND a.cand = b.cand
  WHERE a.s1 IS NULL OR b.s1 IS NULL OR abs(a.score - b.score) > 0.0001""")
def _(d: Data) -> DataFrame:
    return audits.parity(retrieval.tfidf_pairs(d.records, "name_norm_clean"), retrieval.tfidf_pairs(d.records, "addr_norm_clean"), ["entity_id_s1", "entity_id_cand"], ["score"])


# --- union, ranking, frontiers ---------------------------------------------------------------


@query("a1_c6_union_evidence", "SELECT * FROM pool")
def _(d: Data) -> DataFrame:
    return d.pool


@query("a2_exact_flags", """SELECT s1 AS entity_id_s1, cand AS entity_id_cand, src AS candidate_source, exact_name_address_clean, exact_name_address_accent, exact_name_address_punct, unique_exact_name,
  exact_name_address_clean + exact_name_address_accent + exact_name_address_punct + unique_exact_name AS exact_count FROM flags""")
def _(d: Data) -> DataFrame:
    return d.flags


@query("a5_document_frequency", "SELECT source, country, token, df::BIGINT AS df FROM ndf")
def _(d: Data) -> DataFrame:
    return retrieval.document_frequency(d.records, "name_norm_clean")


SQL_COLLISIONS = """SELECT count(*)::BIGINT AS keys, count(*) FILTER (n = 1)::BIGINT AS once, count(*) FILTER (n = 2)::BIGINT AS twice, count(*) FILTER (n BETWEEN 3 AND 5)::BIGINT AS from_3_to_5, count(*) FILTER (n BETWEEN 6 AND 10)::BIGINT AS from_6_to_10,
  count(*) FILTER (n > 10)::BIGINT AS over_10, max(n)::BIGINT AS most, round(quantile_cont(n::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(n::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(n::DOUBLE, 0.99), 6) AS p99"""


@query("a4_a6_name_collisions", f"{SQL_COLLISIONS} FROM (SELECT count(*) AS n FROM norm WHERE name_norm_clean <> '' GROUP BY source, country, name_norm_clean)")
def _(d: Data) -> DataFrame:
    return metrics.collisions(d.records.where(F.col("name_norm_clean") != ""), ["source", "country", "name_norm_clean"])


@query("a6_part_collisions", f"{SQL_COLLISIONS} FROM (SELECT count(*) AS n FROM part GROUP BY p_name)")
def _(d: Data) -> DataFrame:
    return metrics.collisions(d.table("part"), ["p_name"])


@query("a8_volume_distribution", f"SELECT CASE WHEN n_pred = 0 THEN '0' WHEN n_pred = 1 THEN '1' WHEN n_pred <= 10 THEN '2-10' ELSE '>10' END AS band, count(*)::BIGINT AS entities, sum(n_pred)::BIGINT AS candidates FROM {sql_counts('SELECT s1, cand FROM flags')} GROUP BY 1")
def _(d: Data) -> DataFrame:
    return metrics.volume_distribution(metrics.hit_counts(d.s1.select("entity_id", "country"), d.flags, d.truth))


@query("a9_a10_value_counts", "SELECT country, source, count(*)::BIGINT AS n, count(DISTINCT business_name)::BIGINT AS names FROM ent GROUP BY ALL")
def _(d: Data) -> DataFrame:
    return d.entities.groupBy("country", "source").agg(F.count("*").alias("n"), F.count_distinct("business_name").alias("names"))


@query("a13_entity_manifest", "SELECT * FROM manifest")
def _(d: Data) -> DataFrame:
    return pairs.entity_manifest(d.labelled, d.truth, d.s1, d.folds)


@query("a14_retrieval_audit", """SELECT country, match_bucket, count(*)::BIGINT AS entities, sum(gt_match_count)::BIGINT AS gt_pairs, round(sum(positive_candidate_count) / sum(gt_match_count), 6) AS pair_recall,
  round(avg((positive_candidate_count > 0)::INT::DOUBLE), 6) AS any_coverage, round(avg((positive_candidate_count >= gt_match_count)::INT::DOUBLE), 6) AS full_coverage
  FROM manifest WHERE gt_match_count > 0 GROUP BY GROUPING SETS ((), (country), (match_bucket))""")
def _(d: Data) -> DataFrame:
    return pairs.retrieval_audit(pairs.entity_manifest(d.labelled, d.truth, d.s1, d.folds))


@query("a15_f3_fold_distribution", "SELECT fold_id, country, match_bucket, count(*)::BIGINT AS n FROM folds GROUP BY GROUPING SETS ((fold_id), (fold_id, country), (fold_id, match_bucket))")
def _(d: Data) -> DataFrame:
    return d.folds.groupingSets([["fold_id"], ["fold_id", "country"], ["fold_id", "match_bucket"]], "fold_id", "country", "match_bucket").agg(F.count("*").alias("n"))


@query("a18_pool_integrity", "SELECT count(*)::BIGINT AS rows, (count(*) - count(DISTINCT (entity_id_s1, entity_id_cand)))::BIGINT AS repeated_or_null, count(*) FILTER (entity_id_cand IS NULL)::BIGINT AS null_candidates, count(*) FILTER (candidate_source NOT IN ('S2', 'S3'))::BIGINT AS bad_sources FROM pool")
def _(d: Data) -> DataFrame:
    return audits.integrity(d.pool)


@query("t1_t2_rank_prune15", "SELECT * FROM placed WHERE candidate_rank <= 15")
def _(d: Data) -> DataFrame:
    return retrieval.rank_and_prune(d.pool)


def sql_frontier(ranking: str) -> str:
    return f"""(SELECT budget, round(sum(h) / sum(t), 6) AS recall, round(avg((h = t)::INT::DOUBLE), 6) AS full_coverage FROM (
  SELECT budget, t.s1, sum(CASE WHEN (budget = 0 AND p.candidate_rank IS NOT NULL) OR p.candidate_rank <= budget THEN 1 ELSE 0 END) AS h, count(*) AS t FROM truth t
  LEFT JOIN {ranking} p ON p.entity_id_s1 = t.s1 AND p.entity_id_cand = t.cand CROSS JOIN (SELECT unnest([3, 5, 8, 10, 12, 15, 0])::INT AS budget) GROUP BY ALL) GROUP BY budget)"""


@query("t3_m9_budget_frontier", f"SELECT * FROM {sql_frontier('placed')}")
def _(d: Data) -> DataFrame:
    return metrics.frontier(d.pool, d.truth, d.s1)


@query("t4_legacy_frontier", f"SELECT * FROM {sql_frontier('legacy')}")
def _(d: Data) -> DataFrame:
    return metrics.frontier(d.pool, d.truth, d.s1, retrieval.LEGACY)


@query("m11_ranking_delta", f"SELECT a.budget, a.recall, b.recall AS legacy_recall, round(a.recall - b.recall, 6) AS delta FROM {sql_frontier('placed')} a JOIN {sql_frontier('legacy')} b USING (budget)")
def _(d: Data) -> DataFrame:
    return metrics.ranking_delta(d.pool, d.truth, d.s1)


@query("w5_candidate_rank", "SELECT entity_id_s1, entity_id_cand, candidate_rank FROM placed")
def _(d: Data) -> DataFrame:
    return retrieval.ranked(d.pool).select("entity_id_s1", "entity_id_cand", "candidate_rank")


@query("w7_m12_rank_histogram", """SELECT rank, positives, round(sum(positives) OVER (ORDER BY rank) / (SELECT count(*) FROM truth), 6) AS cumulative_recall FROM (
  SELECT least(candidate_rank, 16)::INT AS rank, count(*)::BIGINT AS positives FROM truth t JOIN placed p ON p.entity_id_s1 = t.s1 AND p.entity_id_cand = t.cand GROUP BY 1)""")
def _(d: Data) -> DataFrame:
    return metrics.rank_histogram(d.pool, d.truth)


@query("c10_m13_miss_types", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand, CASE WHEN candidate_rank IS NULL THEN 'retrieval_miss' ELSE 'pruning_miss' END AS miss_type FROM truth LEFT JOIN placed ON entity_id_s1 = s1 AND entity_id_cand = cand WHERE candidate_rank IS NULL OR candidate_rank > 15")
def _(d: Data) -> DataFrame:
    return metrics.miss_types(d.pool, d.truth)


@query("c11_c12_channel_contribution", " UNION ALL ".join(f"SELECT '{c}' AS channel, count(*)::BIGINT AS candidates, count(t.cand)::BIGINT AS gt_found, (count(t.cand) FILTER (retrieval_channel_count = 1))::BIGINT AS unique_rescue FROM pool LEFT JOIN truth t ON t.s1 = entity_id_s1 AND t.cand = entity_id_cand WHERE {c} = 1 HAVING count(*) > 0" for c in retrieval.CHANNELS))
def _(d: Data) -> DataFrame:
    return metrics.channel_contribution(d.pool, d.truth)


@query("c14_channel_overlap", "SELECT exact_name_address_clean + exact_name_address_accent + exact_name_address_punct + unique_exact_name AS channels, count(*)::BIGINT AS pairs FROM flags GROUP BY 1")
def _(d: Data) -> DataFrame:
    return metrics.channel_overlap(d.flags)


@query("c15_rescue_vs_exact", """SELECT count(*)::BIGINT AS extra_candidates, count(t.cand)::BIGINT AS gt_rescued, round(CASE WHEN count(*) > 0 THEN count(t.cand) / count(*) ELSE 0 END, 6)::DOUBLE AS efficiency FROM
  (SELECT n.s1, n.cand FROM nw n WHERE NOT EXISTS (SELECT 1 FROM flags f WHERE f.s1 = n.s1 AND f.cand = n.cand)) x LEFT JOIN truth t ON t.s1 = x.s1 AND t.cand = x.cand""")
def _(d: Data) -> DataFrame:
    return metrics.rescue(retrieval.tfidf_pairs(d.records, "name_norm_clean"), d.flags, d.truth)


# --- pairs, folds, features ------------------------------------------------------------------


@query("l1_labels", "SELECT entity_id_s1, entity_id_cand, candidate_source, label FROM labelled")
def _(d: Data) -> DataFrame:
    return pairs.labelled(retrieval.rank_and_prune(d.pool), d.truth).select(*[c for c in ("entity_id_s1", "entity_id_cand", "candidate_source", "label")])


@query("l2_diagnostics", """SELECT entity_id_s1, entity_id_cand, label, f.n_true_matches::BIGINT AS gt_match_count, sum(label) OVER (PARTITION BY entity_id_s1)::BIGINT AS retrieved_positive_count,
  greatest(f.n_true_matches - sum(label) OVER (PARTITION BY entity_id_s1), 0)::BIGINT AS missing_positive_count FROM labelled JOIN folds f ON f.entity_id = entity_id_s1""")
def _(d: Data) -> DataFrame:
    out = pairs.diagnostics(pairs.labelled(retrieval.rank_and_prune(d.pool), d.truth), d.truth)
    return out.select("entity_id_s1", "entity_id_cand", "label", "gt_match_count", "retrieved_positive_count", "missing_positive_count")


@query("l6_pair_violations", "SELECT '' AS rule, 0::BIGINT AS n WHERE false")
def _(d: Data) -> DataFrame:
    return pairs.pair_violations(d.labelled, d.truth)


@query("l9_label_distribution", "SELECT count(*)::BIGINT AS pairs, sum(label)::BIGINT AS positives, (SELECT count(*) FROM truth)::BIGINT AS gt_pairs, round(sum(label) / count(*), 6) AS positive_rate, round(1 - sum(label) / (SELECT count(*) FROM truth), 6) AS miss_rate FROM labelled")
def _(d: Data) -> DataFrame:
    return pairs.label_distribution(d.labelled, d.truth)


@query("f1_folds", "SELECT * FROM folds")
def _(d: Data) -> DataFrame:
    return d.folds


@query("f2_fold_violations", "SELECT '' AS rule, 0::BIGINT AS n WHERE false")
def _(d: Data) -> DataFrame:
    return pairs.fold_violations(d.folds, 5)


SQL_SPLIT = "SELECT entity_id, country, CASE WHEN row_number() OVER (PARTITION BY {s} ORDER BY md5('42|' || entity_id), entity_id) <= floor(count(*) OVER (PARTITION BY {s}) * 0.2::DOUBLE + 0.5::DOUBLE) THEN 'validation' ELSE 'train' END AS part FROM profile"


@query("f4_split", SQL_SPLIT.format(s="country"))
def _(d: Data) -> DataFrame:
    return pairs.split(d.s1.select("entity_id", "country"))


@query("f5_stratified_sample", f"SELECT entity_id, country FROM ({SQL_SPLIT.format(s='match_bucket')}) WHERE part = 'validation'")
def _(d: Data) -> DataFrame:
    return pairs.stratified_sample(pairs.match_profile(d.s1, d.truth), "match_bucket", 0.2).select("entity_id", "country")


def sql_lcs(a: str, b: str) -> str:
    """Longest common subsequence by folding one row of the table over the other string's letters."""
    row = f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, CASE WHEN substr({b}, j, 1) = substr({a}, i, 1) THEN prev[j] + 1 ELSE greatest(acc[j], prev[j + 1]) END), [0::BIGINT])"
    return f"(list_reduce(range(1, length({a}) + 1), lambda prev, i: {row}, list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)))[length({b}) + 1]"


def sql_set(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


def sql_text_features(p: str, view: str) -> str:
    return f"""SELECT entity_id_s1, entity_id_cand, (ok AND a = b)::TINYINT AS {p}_exact_clean, CASE WHEN ok THEN CASE WHEN len(u) > 0 THEN len(i) / len(u) END END AS {p}_token_jaccard,
  (CASE WHEN ok THEN len(i) ELSE 0 END)::SMALLINT AS {p}_shared_token_count, (CASE WHEN ok THEN len(x) ELSE 0 END)::SMALLINT AS {p}_s1_token_count, (CASE WHEN ok THEN len(y) ELSE 0 END)::SMALLINT AS {p}_cand_token_count,
  CASE WHEN ok THEN least(length(a), length(b)) / greatest(length(a), length(b)) END AS {p}_length_ratio, (CASE WHEN ok THEN abs(length(a) - length(b)) END)::DOUBLE AS {p}_char_length_diff
  FROM (SELECT *, a <> '' AND b <> '' AS ok, list_intersect(x, y) AS i, list_distinct(list_concat(x, y)) AS u FROM (SELECT l.entity_id_s1, l.entity_id_cand, s.{view} AS a, t.{view} AS b, {sql_set("s." + view)} AS x, {sql_set("t." + view)} AS y
  FROM labelled l JOIN norm s ON s.entity_id = l.entity_id_s1 JOIN norm t ON t.entity_id = l.entity_id_cand))"""


def _text_query(p: str) -> Callable[[Data], DataFrame]:
    def plan(d: Data) -> DataFrame:
        out = features.text_features(features.with_texts(d.labelled, d.records), p)
        names = [f"{p}_{n}" for n in ("exact_clean", "shared_token_count", "s1_token_count", "cand_token_count")]
        ratios = [F.round(F.col(f"{p}_{n}").cast("double"), 6).alias(f"{p}_{n}") for n in ("token_jaccard", "length_ratio", "char_length_diff")]
        return out.select("entity_id_s1", "entity_id_cand", *names, *ratios)

    return plan


def as_stored(sql: str, p: str) -> str:
    """Ratios as floats before they are rounded, like the features."""
    return f"SELECT * REPLACE (round({p}_token_jaccard::FLOAT::DOUBLE, 6) AS {p}_token_jaccard, round({p}_length_ratio::FLOAT::DOUBLE, 6) AS {p}_length_ratio) FROM ({sql})"


for _p, _view in (("name", "name_norm_clean"), ("address", "addr_norm_clean")):
    query(f"x1_{_p}_features", as_stored(sql_text_features(_p, _view), _p))(_text_query(_p))


@query("x2_numeric_features", """SELECT entity_id_s1, entity_id_cand, len(x)::SMALLINT AS numeric_s1_count, len(y)::SMALLINT AS numeric_cand_count, len(i)::SMALLINT AS shared_numeric_count_pair,
  (len(x) > 0 AND len(x) = len(y) AND len(i) = len(x))::TINYINT AS numeric_exact_set_match, (len(i) > 0)::TINYINT AS numeric_agreement_flag, (len(x) > 0 AND len(y) > 0 AND len(i) = 0)::TINYINT AS numeric_conflict_flag,
  (len(x) = 0)::TINYINT AS numeric_s1_missing, (len(y) = 0)::TINYINT AS numeric_cand_missing, (len(x) = 0 AND len(y) = 0)::TINYINT AS numeric_both_missing,
  round((CASE WHEN len(u) > 0 THEN len(i) / len(u) END)::FLOAT::DOUBLE, 6) AS numeric_jaccard
  FROM (SELECT *, list_intersect(x, y) AS i, list_distinct(list_concat(x, y)) AS u FROM (SELECT l.entity_id_s1, l.entity_id_cand, """ + f"{sql_set('s.addr_numeric_tokens')} AS x, {sql_set('t.addr_numeric_tokens')} AS y" + """
  FROM labelled l JOIN norm s ON s.entity_id = l.entity_id_s1 JOIN norm t ON t.entity_id = l.entity_id_cand))""")
def _(d: Data) -> DataFrame:
    out = features.numeric_features(features.with_texts(d.labelled, d.records))
    kept = ["numeric_s1_count", "numeric_cand_count", "shared_numeric_count_pair", "numeric_exact_set_match", "numeric_agreement_flag", "numeric_conflict_flag", "numeric_s1_missing", "numeric_cand_missing", "numeric_both_missing"]
    return out.select("entity_id_s1", "entity_id_cand", *kept, F.round(F.col("numeric_jaccard").cast("double"), 6).alias("numeric_jaccard"))


SQL_SIM = f"""(SELECT entity_id_s1, entity_id_cand, (CASE WHEN a <> '' AND b <> '' THEN 2.0::DOUBLE * {sql_lcs("a", "b")} / (length(a) + length(b)) END)::FLOAT AS sim, (a <> '' AND b <> '' AND a = b)::INT AS same
  FROM (SELECT f.s1 AS entity_id_s1, f.cand AS entity_id_cand, s.name_norm_clean AS a, t.name_norm_clean AS b FROM flags f JOIN norm s ON s.entity_id = f.s1 JOIN norm t ON t.entity_id = f.cand))"""


@query("w1_x4_relative_features", f"""SELECT entity_id_s1, entity_id_cand, round(sim::DOUBLE, 5) AS name_char_ratio, (count(*) OVER w)::INT AS candidate_count,
  (rank() OVER (PARTITION BY entity_id_s1 ORDER BY sim DESC NULLS LAST))::INT AS name_rank, round((max(sim) OVER w)::DOUBLE - sim::DOUBLE, 5) AS name_gap, (sum(same) OVER w)::INT AS exact_names FROM {SQL_SIM} WINDOW w AS (PARTITION BY entity_id_s1)""")
def _(d: Data) -> DataFrame:
    out = features.relative_features(features.text_features(features.text_features(features.with_texts(d.flags, d.records), "name"), "address"))
    return out.select("entity_id_s1", "entity_id_cand", F.round(F.col("name_char_ratio").cast("double"), 5).alias("name_char_ratio"), F.col("candidate_count").cast("int").alias("candidate_count"), F.col("name_similarity_rank_within_s1").cast("int").alias("name_rank"), F.round(F.col("name_gap_from_best").cast("double"), 5).alias("name_gap"), F.col("count_exact_name_candidates").cast("int").alias("exact_names"))


@query("x6_all_features")
def _(d: Data) -> DataFrame:
    return features.pair_features(d.labelled, d.records)


# --- metrics, decisions, outputs, audits -----------------------------------------------------

D0 = "SELECT s1, cand FROM d0"
D1 = "SELECT s1, cand FROM d1"


@query("m1_macro_f05", f"SELECT count(*)::BIGINT AS entities, round(avg({F05}), 6) AS macro_f05 FROM {sql_counts(D1)}")
def _(d: Data) -> DataFrame:
    return metrics.macro_f05(metrics.hit_counts(d.s1.select("entity_id", "country"), decide.policy_d1(d.flags, d.records), d.truth))


def sliced_f05(d: Data) -> DataFrame:
    slices = d.folds.select("entity_id", "country", "match_bucket", "fold_id")
    return metrics.f05_by_slice(metrics.hit_counts(slices, decide.policy_d1(d.flags, d.records), d.truth), ["country", "match_bucket", "fold_id"])


query("m2_f05_by_slice", f"SELECT country, match_bucket, fold_id, count(*)::BIGINT AS entities, round(avg({F05}), 6) AS macro_f05 FROM (SELECT c.*, f.match_bucket, f.fold_id FROM {sql_counts(D1)} c JOIN folds f USING (entity_id)) GROUP BY GROUPING SETS ((), (country), (match_bucket), (fold_id))")(sliced_f05)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced_f05(Data(spark, sf_dir))


@query("m3_m8_pool_metrics", f"""SELECT count(*)::BIGINT AS entities, sum(n_pred)::BIGINT AS candidates, sum(n_true)::BIGINT AS gt_pairs, sum(n_hit)::BIGINT AS found, round(sum(n_hit) / sum(n_true), 6) AS pair_recall,
  round(avg(CASE WHEN n_true > 0 THEN (n_hit = n_true)::INT::DOUBLE END), 6) AS full_coverage, round(avg(CASE WHEN n_true > 0 THEN (n_hit > 0)::INT::DOUBLE END), 6) AS any_coverage, round(avg(n_pred), 6) AS mean_candidates,
  max(n_pred)::BIGINT AS max_candidates, round(avg((n_pred = 0)::INT::DOUBLE), 6) AS share_without, round(avg(CASE WHEN n_true = 0 THEN n_pred END), 6) AS mean_candidates_zero_match, round(avg(CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE END), 6) AS share_clean_zero_match,
  round(quantile_cont(n_pred::DOUBLE, 0.5), 6) AS p50_candidates, round(quantile_cont(n_pred::DOUBLE, 0.9), 6) AS p90_candidates, round(quantile_cont(n_pred::DOUBLE, 0.95), 6) AS p95_candidates, round(quantile_cont(n_pred::DOUBLE, 0.99), 6) AS p99_candidates
  FROM {sql_counts("SELECT entity_id_s1 AS s1, entity_id_cand AS cand FROM pool")}""")
def _(d: Data) -> DataFrame:
    return metrics.pool_metrics(metrics.hit_counts(d.s1.select("entity_id", "country"), d.pool, d.truth))


@query("d0_policy", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand FROM d0")
def _(d: Data) -> DataFrame:
    return decide.policy_d0(d.flags)


@query("d1_policy", "SELECT s1 AS entity_id_s1, cand AS entity_id_cand FROM d1")
def _(d: Data) -> DataFrame:
    return decide.policy_d1(d.flags, d.records)


@query("d2_best_policy", f"SELECT policy, macro_f05 FROM (SELECT 'D0' AS policy, round(avg({F05}), 6) AS macro_f05 FROM {sql_counts(D0)} UNION ALL SELECT 'D1', round(avg({F05}), 6) FROM {sql_counts(D1)}) ORDER BY macro_f05 DESC, policy LIMIT 1")
def _(d: Data) -> DataFrame:
    s1 = d.s1.select("entity_id", "country")
    scores = [metrics.macro_f05(metrics.hit_counts(s1, p, d.truth)).select(F.lit(n).alias("policy"), "macro_f05") for n, p in (("D0", decide.policy_d0(d.flags)), ("D1", decide.policy_d1(d.flags, d.records)))]
    return decide.best_policy(scores[0].unionByName(scores[1]))


@query("o1_match_counts", """SELECT count(*)::BIGINT AS entities, count(*) FILTER (n = 0)::BIGINT AS zero, count(*) FILTER (n = 1)::BIGINT AS single, count(*) FILTER (n > 1)::BIGINT AS multi, sum(n)::BIGINT AS pairs
  FROM (SELECT entity_id, (SELECT count(DISTINCT cand) FROM d1 WHERE d1.s1 = entity_id) AS n FROM s1)""")
def _(d: Data) -> DataFrame:
    return decide.match_counts(decide.id_lists(d.s1, decide.policy_d1(d.flags, d.records)))


@query("o3_candidate_lists", "SELECT entity_id AS source1_entity_id, coalesce(string_agg(entity_id_cand, ',' ORDER BY entity_id_cand), '') AS candidate_entity_ids FROM s1 LEFT JOIN (SELECT * FROM placed WHERE candidate_rank <= 15) p ON p.entity_id_s1 = entity_id GROUP BY 1")
def _(d: Data) -> DataFrame:
    return decide.id_lists(d.s1, retrieval.rank_and_prune(d.pool), "candidate_entity_ids")


@query("o4_submission_violations", "SELECT 'not_a_candidate' AS rule, count(*)::BIGINT AS n FROM (SELECT s1, cand FROM truth EXCEPT SELECT s1, cand FROM flags) HAVING count(*) > 0")
def _(d: Data) -> DataFrame:
    return decide.submission_violations(decide.id_lists(d.s1, d.truth), decide.id_lists(d.s1, d.flags, "candidate_entity_ids"), d.s1, d.entities)


@query("a16_q1_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS rows, count(*) FILTER ({c} IS NULL)::BIGINT AS nulls, count(*) FILTER ({c} = '')::BIGINT AS empties, count(DISTINCT {c})::BIGINT AS distinct_values, (count(entity_id) - count(DISTINCT entity_id))::BIGINT AS repeated_keys FROM ent" for c in ("entity_id", "business_name", "business_address", "country")))
def _(d: Data) -> DataFrame:
    return audits.profile(d.entities, ["entity_id", "business_name", "business_address", "country"], "entity_id")


def sql_fingerprint(rows: str, columns: list[str]) -> str:
    """(rows, fingerprint) of a query's columns in this order."""
    cells = ", ".join(f"coalesce('=' || {c}::VARCHAR, '-')" for c in columns)
    return f"(SELECT count(*)::BIGINT AS rows, coalesce(sum(('0x' || substr(md5(concat_ws(chr(31), {cells})), 1, 15))::BIGINT::HUGEINT), 0)::VARCHAR AS fingerprint FROM ({rows}))"


SQL_FLAGS = "SELECT s1 AS entity_id_s1, cand AS entity_id_cand, src AS candidate_source, exact_name_address_clean, exact_name_address_accent, exact_name_address_punct, unique_exact_name FROM flags"


@query("q7_order_free_hash", f"SELECT * FROM {sql_fingerprint(SQL_FLAGS + ' UNION ALL ' + SQL_FLAGS, ['entity_id_s1', 'entity_id_cand', 'candidate_source', 'exact_name_address_clean', 'exact_name_address_accent', 'exact_name_address_punct', 'unique_exact_name'])}")
def _(d: Data) -> DataFrame:
    rows = d.flags.select("entity_id_s1", "entity_id_cand", "candidate_source", *retrieval.FLAGS)
    return audits.order_free_hash(rows.unionByName(rows))


@query("t8_sorted_unique_head", "SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 1000")
def _(d: Data) -> DataFrame:
    return d.table("part").select("p_name").distinct().orderBy("p_name").limit(1000)


@query("a7_exact_percentiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, max(o_totalprice) AS most FROM orders GROUP BY 1")
def _(d: Data) -> DataFrame:
    q = F.percentile("o_totalprice", F.array(F.lit(0.5), F.lit(0.95)))
    return d.table("orders").groupBy("o_orderpriority").agg(q.alias("q"), F.max("o_totalprice").alias("most")).select("o_orderpriority", F.round(F.get("q", 0), 4).alias("p50"), F.round(F.get("q", 1), 4).alias("p95"), "most")


@query("w6_top_k_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def _(d: Data) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return d.table("orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("place", F.row_number().over(w)).where(F.col("place") <= 3).drop("place")


# --- contexts, slices, contracts -------------------------------------------------------------


@query("c1_c2_generate", "SELECT * FROM pool")
def _(d: Data) -> DataFrame:
    sources = {name: d.records.where(F.col("source") == name) for name in ("S2", "S3")}
    return CandidateGenerator(Config.everything()).generate(d.records.where(F.col("source") == "S1"), sources)


@query("c3_c5_generate_with_context", "SELECT * FROM pool")
def _(d: Data) -> DataFrame:
    return CandidateGenerator(Config.everything()).generate_with_context(d.records.where(F.col("source") == "S1"), TargetContext(d.records))


@query("c4_context_summary", "SELECT source, country, count(*)::BIGINT AS records, count(DISTINCT name_norm_clean)::BIGINT AS names FROM norm WHERE source <> 'S1' GROUP BY ALL")
def _(d: Data) -> DataFrame:
    return TargetContext(d.records).summary()


@query("c9_shard_violations", "SELECT 'over_budget' AS rule, count(*)::BIGINT AS n FROM (SELECT entity_id_s1 FROM placed WHERE candidate_rank <= 20 GROUP BY 1 HAVING count(*) > 15) HAVING count(*) > 0")
def _(d: Data) -> DataFrame:
    return jobs.shard_violations(retrieval.rank_and_prune(d.pool, 20), d.pool, 15)


@query("t6_smoke_limit", "SELECT entity_id, country FROM s1 ORDER BY entity_id LIMIT 50")
def _(d: Data) -> DataFrame:
    return jobs.smoke_limit(d.s1.select("entity_id", "country"), 50)


@query("f6_sized_sample", """SELECT entity_id, match_bucket FROM (SELECT entity_id, match_bucket, row_number() OVER (PARTITION BY match_bucket ORDER BY md5('42|' || entity_id), entity_id) AS place,
  count(*) OVER (PARTITION BY match_bucket) AS n, count(*) OVER () AS total FROM profile) WHERE place <= least(n, floor(100 * n / total))""")
def _(d: Data) -> DataFrame:
    return pairs.sized_sample(d.profile.select("entity_id", "match_bucket"), "match_bucket", 100)


@query("a8_volume_summary", f"""SELECT round(avg(n_pred), 6) AS mean, round(quantile_cont(n_pred::DOUBLE, 0.5), 6) AS median, max(n_pred)::BIGINT AS most, round(avg((n_pred = 0)::INT::DOUBLE), 6) AS share_0,
  round(avg((n_pred = 1)::INT::DOUBLE), 6) AS share_1, round(avg((n_pred > 1)::INT::DOUBLE), 6) AS share_over_1, round(avg((n_pred > 10)::INT::DOUBLE), 6) AS share_over_10 FROM {sql_counts("SELECT s1, cand FROM flags")}""")
def _(d: Data) -> DataFrame:
    return metrics.volume_summary(metrics.hit_counts(d.s1.select("entity_id", "country"), d.flags, d.truth))


@query("a14_audit_by_source", """SELECT source, count(*)::BIGINT AS entities, sum(t)::BIGINT AS gt_pairs, round(sum(h) / sum(t), 6) AS pair_recall, round(avg((h > 0)::INT::DOUBLE), 6) AS any_coverage, round(avg((h = t)::INT::DOUBLE), 6) AS full_coverage
  FROM (SELECT split_part(t.cand, '-', 1) AS source, t.s1, count(*) AS t, count(p.entity_id_cand) AS h FROM truth t LEFT JOIN (SELECT * FROM placed WHERE candidate_rank <= 15) p ON p.entity_id_s1 = t.s1 AND p.entity_id_cand = t.cand GROUP BY 1, 2) GROUP BY 1""")
def _(d: Data) -> DataFrame:
    return pairs.audit_by_source(d.labelled, d.truth)


@query("m4_coverage_by_sources", """SELECT round(avg(CASE WHEN t2 > 0 THEN (t2 = h2)::INT::DOUBLE END), 6) AS s2_full_coverage, round(avg(CASE WHEN t3 > 0 THEN (t3 = h3)::INT::DOUBLE END), 6) AS s3_full_coverage,
  round(avg(CASE WHEN t2 > 0 AND t3 > 0 THEN (t2 = h2 AND t3 = h3)::INT::DOUBLE END), 6) AS both_full_coverage FROM (SELECT t.s1, count(*) FILTER (t.cand LIKE 'S2-%') AS t2, count(*) FILTER (t.cand LIKE 'S3-%') AS t3,
  count(f.cand) FILTER (t.cand LIKE 'S2-%') AS h2, count(f.cand) FILTER (t.cand LIKE 'S3-%') AS h3 FROM truth t LEFT JOIN flags f ON f.s1 = t.s1 AND f.cand = t.cand GROUP BY 1)""")
def _(d: Data) -> DataFrame:
    return metrics.coverage_by_sources(d.flags, d.truth)


SQL_PLACES = """(SELECT t.cand, p.candidate_rank, f.country, f.match_bucket, f.source_pattern, split_part(t.cand, '-', 1) AS source FROM truth t JOIN profile f ON f.entity_id = t.s1
  LEFT JOIN placed p ON p.entity_id_s1 = t.s1 AND p.entity_id_cand = t.cand)"""


@query("m10_sliced_frontier", f"""SELECT budget, country, match_bucket, source, count(*)::BIGINT AS gt_pairs, round(avg(CASE WHEN (budget = 0 AND candidate_rank IS NOT NULL) OR candidate_rank <= budget THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS recall
  FROM {SQL_PLACES} CROSS JOIN (SELECT unnest([3, 5, 8, 10, 12, 15, 0])::INT AS budget) GROUP BY GROUPING SETS ((budget), (budget, country), (budget, match_bucket), (budget, source))""")
def _(d: Data) -> DataFrame:
    return metrics.sliced_frontier(d.pool, d.truth, d.profile)


@query("m14_lost_to_pruning", f"SELECT count(candidate_rank)::BIGINT AS in_pool, count(*) FILTER (candidate_rank <= 15)::BIGINT AS in_pruned, (count(candidate_rank) - count(*) FILTER (candidate_rank <= 15))::BIGINT AS lost FROM {SQL_PLACES}")
def _(d: Data) -> DataFrame:
    return metrics.lost_to_pruning(d.pool, d.truth)


@query("m15_recall_by_profile", f"SELECT source_pattern, match_bucket, count(*)::BIGINT AS gt_pairs, round(avg(CASE WHEN candidate_rank <= 15 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS recall FROM {SQL_PLACES} GROUP BY GROUPING SETS ((source_pattern), (match_bucket))")
def _(d: Data) -> DataFrame:
    return metrics.recall_by_profile(d.pool, d.truth, d.profile)


@query("l3_p12_label_shard", "SELECT l.* REPLACE (" + ", ".join(f"{c}::{t.upper()} AS {c}" for c, t in retrieval.STORED.items()) + """), f.n_true_matches::BIGINT AS gt_match_count, sum(l.label) OVER (PARTITION BY l.entity_id_s1)::BIGINT AS retrieved_positive_count,
  greatest(f.n_true_matches - sum(l.label) OVER (PARTITION BY l.entity_id_s1), 0)::BIGINT AS missing_positive_count FROM labelled l JOIN folds f ON f.entity_id = l.entity_id_s1""")
def _(d: Data) -> DataFrame:
    return jobs.label_shard(retrieval.rank_and_prune(d.pool), d.truth, d.folds, d.s1)


@query("l6_violations_of_broken_pairs", "SELECT 'wrong_label' AS rule, count(*)::BIGINT AS n FROM labelled WHERE candidate_rank = 1 UNION ALL SELECT 'duplicate_key', count(*)::BIGINT FROM labelled WHERE candidate_rank = 2 UNION ALL SELECT 'bad_source', count(*)::BIGINT FROM labelled WHERE candidate_rank = 3")
def _(d: Data) -> DataFrame:
    rank = F.col("candidate_rank")
    broken = d.labelled.withColumns({"label": F.when(rank == 1, 1 - F.col("label")).otherwise(F.col("label")), "candidate_source": F.when(rank == 3, "S9").otherwise(F.col("candidate_source"))})
    return pairs.pair_violations(broken.unionByName(broken.where(rank == 2)), d.truth)


@query("f2_violations_of_broken_folds", "SELECT 'repeated_id' AS rule, count(*)::BIGINT AS n FROM folds WHERE fold_id = 1 UNION ALL SELECT 'out_of_range', count(*)::BIGINT FROM folds WHERE fold_id = 2 UNION ALL SELECT 'absent_fold', 1")
def _(d: Data) -> DataFrame:
    broken = d.folds.withColumn("fold_id", F.when(F.col("fold_id") == 2, 9).otherwise(F.col("fold_id")))
    return pairs.fold_violations(broken.unionByName(broken.where("fold_id = 1")), 5)


@query("q4_cardinality", "SELECT (SELECT count(*) FROM s1)::BIGINT AS s1_rows, (SELECT count(*) FROM s1)::BIGINT AS match_rows, (SELECT count(*) FROM s1)::BIGINT AS candidate_rows, true AS equal")
def _(d: Data) -> DataFrame:
    return audits.cardinality(decide.id_lists(d.s1, decide.policy_d1(d.flags, d.records)), decide.id_lists(d.s1, d.flags, "candidate_entity_ids"), d.s1)


def sql_lists(pred: str, column: str) -> str:
    return f"SELECT entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT cand, ',' ORDER BY cand), '') AS {column} FROM s1 LEFT JOIN ({pred}) p ON p.s1 = entity_id GROUP BY 1"


@query("o6_submission_metadata", f"""SELECT m.rows, (SELECT count(*) FROM (SELECT DISTINCT s1, cand FROM d1))::BIGINT AS matches, m.fingerprint AS matches_fingerprint, (SELECT count(*) FROM flags)::BIGINT AS candidates, c.fingerprint AS candidates_fingerprint
  FROM {sql_fingerprint(sql_lists(D1, "matched_entity_ids"), ["source1_entity_id", "matched_entity_ids"])} m CROSS JOIN {sql_fingerprint(sql_lists("SELECT s1, cand FROM flags", "candidate_entity_ids"), ["source1_entity_id", "candidate_entity_ids"])} c""")
def _(d: Data) -> DataFrame:
    return jobs.submission_metadata(decide.id_lists(d.s1, decide.policy_d1(d.flags, d.records)), decide.id_lists(d.s1, d.flags, "candidate_entity_ids"))


@query("q3_exact_audit", f"""SELECT * FROM (UNPIVOT (SELECT 'volume' AS section, round(avg(n_pred), 6)::DOUBLE AS mean, round(quantile_cont(n_pred::DOUBLE, 0.5), 6)::DOUBLE AS median, max(n_pred)::DOUBLE AS most, round(avg((n_pred = 0)::INT::DOUBLE), 6) AS share_0,
  round(avg((n_pred = 1)::INT::DOUBLE), 6) AS share_1, round(avg((n_pred > 1)::INT::DOUBLE), 6) AS share_over_1, round(avg((n_pred > 10)::INT::DOUBLE), 6) AS share_over_10 FROM {sql_counts("SELECT s1, cand FROM flags")}) ON COLUMNS(* EXCLUDE section) INTO NAME metric VALUE value)
  UNION ALL SELECT 'misses', 'missed', count(*)::DOUBLE FROM (SELECT s1, cand FROM truth EXCEPT SELECT s1, cand FROM flags)
  UNION ALL SELECT 'overlap', 'pairs_by_' || (exact_name_address_clean + exact_name_address_accent + exact_name_address_punct + unique_exact_name), count(*)::DOUBLE FROM flags GROUP BY 2
  UNION ALL SELECT 'score', 'entities', count(*)::DOUBLE FROM s1 UNION ALL SELECT 'score', 'macro_f05', round(avg({F05}), 6) FROM {sql_counts(D1)}""")
def _(d: Data) -> DataFrame:
    return jobs.exact_audit(d.flags, d.truth, d.s1, d.records).where(F.col("section").isin("volume", "misses", "overlap", "score"))


@query("q5_smoke_audit", f"""SELECT 'budget' AS section, 'recall_at_' || budget AS metric, recall AS value FROM {sql_frontier("placed").replace("[3, 5, 8, 10, 12, 15, 0]", "[5, 10, 15, 20, 30, 0]")}
  UNION ALL SELECT 'pruning', 'in_pool', count(candidate_rank)::DOUBLE FROM {SQL_PLACES} UNION ALL SELECT 'pruning', 'in_pruned', (count(*) FILTER (candidate_rank <= 15))::DOUBLE FROM {SQL_PLACES}
  UNION ALL SELECT 'pruning', 'lost', (count(*) FILTER (candidate_rank > 15))::DOUBLE FROM {SQL_PLACES} UNION ALL SELECT 'contracts', 'violations', 0.0::DOUBLE""")
def _(d: Data) -> DataFrame:
    return jobs.smoke_audit(d.pool, d.truth, d.folds, d.profile).where(F.col("section").isin("budget", "pruning", "contracts"))


SQL_SORTED = {c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')" for c in "ab"}


@query("x1_name_ratios", f"""SELECT entity_id_s1, entity_id_cand, round(CASE WHEN ok THEN 2.0::DOUBLE * {sql_lcs("sa", "sb")} / (length(sa) + length(sb)) END::FLOAT::DOUBLE, 5) AS name_token_sort_ratio,
  round(CASE WHEN ok THEN CASE WHEN len(i) > 0 AND (len(i) = len(x) OR len(i) = len(y)) THEN 1.0 WHEN core = 0 THEN best ELSE greatest(best, 1 - (1 + length(ra)) / (core + core + 1 + length(ra)), 1 - (1 + length(rb)) / (core + core + 1 + length(rb))) END END::FLOAT::DOUBLE, 5) AS name_token_set_ratio,
  round(CASE WHEN ok THEN len(i) / len(x) END::FLOAT::DOUBLE, 5) AS name_token_containment_s1_in_cand, round(CASE WHEN ok THEN len(i) / len(y) END::FLOAT::DOUBLE, 5) AS name_token_containment_cand_in_s1,
  (CASE WHEN ok THEN greatest(len(x), len(y)) - len(i) ELSE 0 END)::SMALLINT AS name_unmatched_token_count, (a = '')::TINYINT AS name_s1_missing, (b = '')::TINYINT AS name_cand_missing, (a = '' AND b = '')::TINYINT AS name_both_missing
  FROM (SELECT *, 1 - (length(ra) + length(rb) - 2 * {sql_lcs("ra", "rb")}) / ((core + (core > 0)::INT + length(ra)) + (core + (core > 0)::INT + length(rb)))::DOUBLE AS best
  FROM (SELECT *, array_to_string(list_sort(list_filter(x, lambda t: NOT list_contains(y, t))), ' ') AS ra, array_to_string(list_sort(list_filter(y, lambda t: NOT list_contains(x, t))), ' ') AS rb, length(array_to_string(list_sort(i), ' ')) AS core
  FROM (SELECT *, a <> '' AND b <> '' AS ok, list_intersect(x, y) AS i, {SQL_SORTED["a"]} AS sa, {SQL_SORTED["b"]} AS sb FROM (SELECT f.s1 AS entity_id_s1, f.cand AS entity_id_cand, s.name_norm_clean AS a, t.name_norm_clean AS b,
  {sql_set("s.name_norm_clean")} AS x, {sql_set("t.name_norm_clean")} AS y FROM (SELECT s1, cand FROM nw WHERE rank <= 1) f JOIN norm s ON s.entity_id = f.s1 JOIN norm t ON t.entity_id = f.cand))))""")
def _(d: Data) -> DataFrame:
    near = retrieval.tfidf_pairs(d.records, "name_norm_clean", 1)
    out = features.text_features(features.with_texts(near, d.records), "name")
    ratios = [F.round(F.col(f"name_{n}").cast("double"), 5).alias(f"name_{n}") for n in ("token_sort_ratio", "token_set_ratio", "token_containment_s1_in_cand", "token_containment_cand_in_s1")]
    return out.select("entity_id_s1", "entity_id_cand", *ratios, "name_unmatched_token_count", "name_s1_missing", "name_cand_missing", "name_both_missing")


@query("x2_numeric_ratios", f"""SELECT entity_id_s1, entity_id_cand, round(CASE WHEN len(x) > 0 THEN len(i) / len(x) END::FLOAT::DOUBLE, 6) AS numeric_overlap_ratio_s1, round(CASE WHEN len(y) > 0 THEN len(i) / len(y) END::FLOAT::DOUBLE, 6) AS numeric_overlap_ratio_cand
  FROM (SELECT *, list_intersect(x, y) AS i FROM (SELECT l.entity_id_s1, l.entity_id_cand, {sql_set("s.addr_numeric_tokens")} AS x, {sql_set("t.addr_numeric_tokens")} AS y FROM labelled l JOIN norm s ON s.entity_id = l.entity_id_s1 JOIN norm t ON t.entity_id = l.entity_id_cand))""")
def _(d: Data) -> DataFrame:
    out = features.numeric_features(features.with_texts(d.labelled, d.records))
    return out.select("entity_id_s1", "entity_id_cand", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("numeric_overlap_ratio_s1", "numeric_overlap_ratio_cand")])


@query("x_passed_features", "SELECT entity_id_s1, entity_id_cand, " + ", ".join(features.PASSED) + " FROM labelled")
def _(d: Data) -> DataFrame:
    return d.labelled.select("entity_id_s1", "entity_id_cand", *features.PASSED)


@query("x4_relative_address_features", f"""SELECT entity_id_s1, entity_id_cand, round(sim::DOUBLE, 5) AS address_char_ratio, (rank() OVER (PARTITION BY entity_id_s1 ORDER BY sim DESC NULLS LAST))::INT AS address_rank,
  round((max(sim) OVER w)::DOUBLE - sim::DOUBLE, 5) AS address_gap, round((CASE WHEN max(sim) OVER w > 0 THEN sim::DOUBLE / (max(sim) OVER w)::DOUBLE END)::FLOAT::DOUBLE, 5) AS address_ratio_to_best, (rank() OVER (PARTITION BY entity_id_s1 ORDER BY sim DESC NULLS LAST) - 1)::INT AS higher_address
  FROM {SQL_SIM.replace("name_norm_clean", "addr_norm_clean")} WINDOW w AS (PARTITION BY entity_id_s1)""")
def _(d: Data) -> DataFrame:
    out = features.relative_features(features.text_features(features.text_features(features.with_texts(d.flags, d.records), "name"), "address"))
    number = lambda c, name: F.round(F.col(c).cast("double"), 5).alias(name)
    return out.select("entity_id_s1", "entity_id_cand", number("address_char_ratio", "address_char_ratio"), F.col("address_similarity_rank_within_s1").cast("int").alias("address_rank"), number("address_gap_from_best", "address_gap"), number("address_ratio_to_best", "address_ratio_to_best"), F.col("count_candidates_with_higher_address_sim").cast("int").alias("higher_address"))


UNICODE_ROWS = ("Tiếng Việt", "ΆΛΦΑ Βήτα ς", "Cafe\u0301 Noe\u0308l", "Eﬁn ﬂuﬀ", "STRASSE Straße", "a\u00a0b\u2003c", "AT&T Co.-op — x", "")


@query("n2_n3_n6_unicode_rows", "SELECT v, nfc_normalize(v) AS v_norm_unicode, c AS v_norm_clean, " + sql_punct("c") + " AS v_norm_punct, strip_accents(c) AS v_norm_accent_fold FROM (SELECT v, " + sql_clean("v") + " AS c FROM (VALUES " + ", ".join(f"('{v}')" for v in UNICODE_ROWS) + ") t(v))")
def _(d: Data) -> DataFrame:
    rows = d.spark.createDataFrame([(v,) for v in UNICODE_ROWS], "v string")
    return normalize.exact_views(rows, "v", "v")


@query("n1_is_missing", "SELECT v, v IS NULL OR trim(v) IN ('', 'NA', 'N/A', 'null', 'None', 'nan', 'NaN', 'NULL', 'n/a') AS is_missing FROM (VALUES (''), (' '), ('NA'), ('N/A'), ('null'), ('None'), ('n/a'), (NULL), ('nana'), ('x')) t(v)")
def _(d: Data) -> DataFrame:
    rows = d.spark.createDataFrame([(v,) for v in ("", " ", "NA", "N/A", "null", "None", "n/a", None, "nana", "x")], "v string")
    return rows.select("v", normalize.is_missing(F.col("v")).alias("is_missing"))
