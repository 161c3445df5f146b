"""Candidate channels between source S1 and the target sources, and their union.

Records carry ``entity_id, source, country`` and the normalized views. Country
and source are join keys, never loops; empty keys are filtered before a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspan.functions import normalize
from kinspan.operators import topk

TERM = r"([\p{L}\p{N}_]{2,})"
RULES = {
    "exact_name_address_clean": ("name_norm_clean", "addr_norm_clean"),
    "exact_name_address_accent": ("name_norm_accent_fold", "addr_norm_accent_fold"),
    "exact_name_address_punct": ("name_norm_punct", "addr_norm_punct"),
}
UNIQUE = "unique_exact_name"
FLAGS = (*RULES, UNIQUE)
PAIR = ("entity_id_s1", "entity_id_cand", "candidate_source")
#: Missing-evidence defaults of the union, by column.
DEFAULTS = {
    "retrieved_exact": 0, "retrieved_name_word": 0, "retrieved_address_word": 0, "retrieved_rare": 0, "retrieved_numeric": 0,
    **dict.fromkeys(FLAGS, 0), "name_word_score": 0.0, "name_word_rank": 9999, "address_word_score": 0.0, "address_word_rank": 9999,
    "rare_token_overlap_count": 0, "rarest_shared_token_df": 999999, "shared_numeric_count": 0, "numeric_conflict": 0,
}
CHANNELS = ("retrieved_exact", "retrieved_name_word", "retrieved_address_word", "retrieved_rare", "retrieved_numeric")
LEAST = ("name_word_rank", "address_word_rank", "rarest_shared_token_df")


def queries_of(records: DataFrame) -> DataFrame:
    return records.where(F.col("source") == "S1")


def targets_of(records: DataFrame) -> DataFrame:
    return records.where(F.col("source") != "S1")


def equi_nonempty(left: DataFrame, right: DataFrame, keys: tuple[str, ...], extra: tuple[str, ...]) -> DataFrame:
    """Join on text keys that are neither null nor empty, and on ``extra`` keys as they are."""
    filled = reduce(lambda a, b: a & b, [F.col(k) != "" for k in keys])
    x = left.where(filled).select(F.col("entity_id").alias("entity_id_s1"), *keys, *extra)
    y = right.where(filled).select(F.col("entity_id").alias("entity_id_cand"), F.col("source").alias("candidate_source"), *keys, *extra)
    return x.join(y, [*keys, *extra]).select(*PAIR)


def rule_pairs(records: DataFrame, rule: str, use_country: bool = True) -> DataFrame:
    """Pairs of one exact name-and-address rule."""
    return equi_nonempty(queries_of(records), targets_of(records), RULES[rule], ("country",) if use_country else ())


def unique_name_pairs(records: DataFrame, use_country: bool = True) -> DataFrame:
    """Pairs by name where the name occurs once in its target source (and country)."""
    extra = ["country"] if use_country else []
    keys = targets_of(records).where(F.col("name_norm_clean") != "").groupBy("source", "name_norm_clean", *extra)
    single = keys.agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id_cand")).where(F.col("n") == 1)
    s1 = queries_of(records).where(F.col("name_norm_clean") != "").select(F.col("entity_id").alias("entity_id_s1"), "name_norm_clean", *extra)
    return s1.join(single.withColumnRenamed("source", "candidate_source"), ["name_norm_clean", *extra]).select(*PAIR)


def exact_flags(records: DataFrame, use_country: bool = True) -> DataFrame:
    """One row per pair with the four exact flags and their sum.

    The three rules are one join: each record gives a row per rule.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(a).alias("name"), F.col(b).alias("address")) for r, (a, b) in RULES.items()]))
    rows = records.select("source", "country", "entity_id", keys.alias("k")).select("source", "country", "entity_id", "k.*").where((F.col("name") != "") & (F.col("address") != ""))
    s1 = queries_of(rows).select(F.col("entity_id").alias("entity_id_s1"), "rule", "name", "address", "country")
    targets = targets_of(rows).select(F.col("entity_id").alias("entity_id_cand"), F.col("source").alias("candidate_source"), "rule", "name", "address", "country")
    if not use_country:
        s1, targets = s1.drop("country"), targets.drop("country")
    pairs = s1.join(targets, [c for c in s1.columns if c != "entity_id_s1"]).select(*PAIR, "rule")
    together = pairs.unionByName(unique_name_pairs(records, use_country).withColumn("rule", F.lit(UNIQUE)))
    found = together.groupBy(*PAIR).agg(*[F.max((F.col("rule") == f).cast("int")).alias(f) for f in FLAGS])
    return found.withColumn("exact_count", sum((F.col(f) for f in FLAGS[1:]), F.col(FLAGS[0])))


def token_rows(records: DataFrame, column: str) -> DataFrame:
    """(source, country, entity_id, token) for the distinct words of a view."""
    return records.select("source", "country", "entity_id", F.explode(normalize.word_set(F.col(column))).alias("token"))


def document_frequency(records: DataFrame, column: str) -> DataFrame:
    """(source, country, token, df): in how many records of a source and country a word occurs."""
    return token_rows(records, column).groupBy("source", "country", "token").agg(F.count("*").alias("df"))


def token_index(targets: DataFrame, column: str, most: int) -> DataFrame:
    """(source, country, token, df, entity_id_cand): the postings of the targets' words with df in 1..most."""
    rows = token_rows(targets, column)
    df = rows.groupBy("source", "country", "token").agg(F.count("*").alias("df")).where(F.col("df") <= most)
    return rows.withColumnRenamed("entity_id", "entity_id_cand").join(df, ["source", "country", "token"])


def token_search(s1: DataFrame, index: DataFrame, column: str, rarest: int | None) -> DataFrame:
    """Pairs by indexed words, of which each S1 record uses its ``rarest`` per source (all if None)."""
    rows = token_rows(s1, column).select("country", "token", F.col("entity_id").alias("entity_id_s1"))
    if rarest is not None:
        df = index.groupBy("source", "country", "token").agg(F.first("df").alias("df"))
        order = Window.partitionBy("entity_id_s1", "source").orderBy("df", "token")
        rows = rows.join(df, ["country", "token"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= rarest).select("source", "country", "token", "entity_id_s1")
    hits = rows.join(index, [c for c in ("source", "country", "token") if c in rows.columns])
    return hits.groupBy("entity_id_s1", "entity_id_cand", F.col("source").alias("candidate_source")).agg(F.count("*").cast("int").alias("shared"), F.min("df").cast("int").alias("least_df"))


def shared_tokens(records: DataFrame, column: str, most: int, rarest: int | None) -> DataFrame:
    """Pairs by words with df in 1..most, of which each S1 record uses its ``rarest`` per source (all if None)."""
    return token_search(queries_of(records), token_index(targets_of(records), column, most), column, rarest)


def rare_evidence(found: DataFrame) -> DataFrame:
    return found.withColumnsRenamed({"shared": "rare_token_overlap_count", "least_df": "rarest_shared_token_df"})


def numeric_evidence(found: DataFrame) -> DataFrame:
    return found.select(*PAIR, F.col("shared").alias("shared_numeric_count"), F.lit(0).alias("numeric_conflict"))


def rare_token_pairs(records: DataFrame, most: int = 10, rarest: int = 3) -> DataFrame:
    return rare_evidence(shared_tokens(records, "name_norm_clean", most, rarest))


def numeric_pairs(records: DataFrame, most: int = 50) -> DataFrame:
    return numeric_evidence(shared_tokens(records, "addr_numeric_tokens", most, None))


def word_terms(view: Column) -> Column:
    """Words of two characters or more and their bigrams."""
    words = F.regexp_extract_all(F.lower(view), F.lit(TERM), F.lit(1))

    def both(w: Column) -> Column:
        pairs = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
        return F.concat(w, pairs)

    return F.element_at(F.transform(F.array(words), both), 1)


def char_terms(view: Column, shortest: int = 3, longest: int = 4) -> Column:
    """Character n-grams inside words padded with a space on both sides; a word shorter than n gives itself, once."""
    words = F.filter(F.split(normalize.whitespace(F.lower(view)), " "), lambda w: w != "")

    def of_length(padded: Column, n: int) -> Column:
        size = F.char_length(padded)
        short = F.array(padded) if n == shortest else F.array().cast("array<string>")
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))).otherwise(short)

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.concat(*[of_length(padded, n) for n in range(shortest, longest + 1)])

    return F.flatten(F.transform(words, grams))


def held_views(records: DataFrame, column: str) -> DataFrame:
    """(source, entity_id, held): the filled views of every record with their countries; an id that occurs in several rows holds all of theirs."""
    filled = records.where(F.coalesce(F.col(column), F.lit("")) != "")
    return filled.groupBy("source", "entity_id").agg(F.sort_array(F.collect_list(F.struct("country", F.col(column).alias("view")))).alias("held"))


def held_terms(held: Column, terms=word_terms) -> Column:
    """Every occurrence of a term in what a record holds, each with its country before it; terms without a country are none."""
    of = lambda h: F.transform(terms(h["view"]), lambda t: F.concat(h["country"], F.lit("\x00"), t))
    return F.filter(F.flatten(F.transform(held, of)), lambda t: t.isNotNull())


def counted_terms(held: Column, terms=word_terms) -> Column:
    """(country, term, n) of each different term in what a record holds: the stretches of the sorted occurrences."""
    of = lambda h: F.transform(terms(h["view"]), lambda t: F.struct(h["country"].alias("country"), t.alias("term")))
    known = F.filter(F.flatten(F.transform(held, of)), lambda t: t["country"].isNotNull() & t["term"].isNotNull())
    named = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  # a value that is used often is made once

    def stretches(all_: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(all_)), lambda i: (i == F.size(all_)) | (i == 0) | (F.get(all_, i) != F.get(all_, i - 1)))  # and the end
        one = lambda at: lambda i, j: F.struct(F.get(all_, i)["country"].alias("country"), F.get(all_, i)["term"].alias("term"), (F.get(at, j + 1) - i).alias("n"))
        return named(opens, lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), one(at)))

    return named(F.sort_array(known), stretches)


#: Terms of a source go to the tiles in so many lists.
LISTS = 1_024


def bits(place: Column) -> Column:
    """A long with that bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def tfidf_index(targets: DataFrame, column: str, terms=word_terms, min_df: int = 1, max_df: float = 1.0, max_terms: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source, country, term, idf, marks), what each target holds, and (source, docs), fitted on the targets of a source and country: idf = ln((1 + n) / (1 + df)) + 1.

    Targets are dealt into 64 parts by what they hold; marks has the bit of each part
    that holds the term. Targets that hold the same count as many but are read once,
    and their terms are shuffled once, summed where they are made.
    """
    held = held_views(targets, column)
    total = targets.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy("source", "country").agg(F.count("*").alias("docs"))
    one = held.groupBy("source", "held").agg(F.count("*").alias("copies"))
    rows = one.select("source", "copies", F.pmod(F.xxhash64("held"), F.lit(64)).cast("int").alias("part"), F.inline(counted_terms(F.col("held"), terms))).where(F.col("source").isNotNull() & F.col("country").isNotNull() & F.col("term").isNotNull())  # said here, as joins would say it for one reader only
    df = rows.groupBy("source", "country", "term").agg(F.sum("copies").alias("df"), F.sum(F.col("n") * F.col("copies")).alias("all_n"), F.bit_or(bits(F.col("part"))).alias("marks"))
    df = df.join(F.broadcast(total), ["source", "country"]).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("docs")))
    if max_terms is not None:
        order = Window.partitionBy("source", "country").orderBy(F.desc("all_n"), "term")
        df = df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_terms)
    return df.select("source", "country", "term", (F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"), "marks"), held, total.groupBy("source").agg(F.sum("docs").alias("docs"))


def tfidf_search(s1: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], column: str, k: int = 5, terms=word_terms, zero_based: bool = False) -> DataFrame:
    """The k most similar targets of an index per S1 record and target source.

    S1 terms unknown there are dropped. Scores are rounded to nine digits before
    they rank; ties go by id. Queries and targets meet in tiles, which give the k
    best of a query each; pairs of holders of a term are never rows. A record goes to
    its tiles with its terms, each slab's terms go there in lists with their idf, and
    terms are weighed there: rows of a record and a term are shuffled for the lengths
    of queries only.
    """
    idf, targets, sizes = index
    queries = held_views(s1, column).drop("source")
    firsts = queries.groupBy("held").agg(F.min("entity_id").alias("entity_id"))
    known = idf.where(F.col("marks") != 0)  # true of all; Spark then shuffles the counts once for both that read them
    w = (1.0 + F.log("n")) * F.col("idf")
    lengths = firsts.select("entity_id", F.inline(counted_terms(F.col("held"), terms))).join(known, ["country", "term"]).groupBy("source", "entity_id").agg(F.sqrt(F.sum(w * w)).alias("norm"))
    place = F.row_number().over(Window.partitionBy("source", "held").orderBy("entity_id"))
    ids = targets.withColumn("place", place).where(F.col("place") <= k).groupBy("source", "held").agg(F.sort_array(F.collect_list("entity_id")).alias("ids")).where(F.size("ids") > 0)  # of equal targets only the k least ids can be among the k best
    word = F.struct(F.concat_ws("\x00", "country", "term").alias("term"), "idf", "marks")
    lists = idf.groupBy("source", F.pmod(F.xxhash64("country", "term"), F.lit(LISTS)).alias("list")).agg(F.collect_list(word).alias("words")).drop("list")
    n_q = s1.where(F.coalesce(F.col(column), F.lit("")) != "").agg(F.count("*").alias("n_q"))
    chunks = F.greatest(F.ceil(F.col("n_q") / topk.TILE), F.least(F.ceil(F.col("n_q") / topk.LEAST), F.lit(topk.AT_ONCE)), F.lit(1)).cast("int")
    slabs = F.ceil(F.col("docs") / topk.TILE).cast("int")
    slabs = F.when(slabs > 64, F.ceil(slabs / 64).cast("int") * 64).otherwise(slabs)  # of whole parts, or parts of whole slabs
    grid = F.broadcast(sizes.crossJoin(n_q).select("source", slabs.alias("slabs"), chunks.alias("chunks")))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tile = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("source", "slab", "chunk")]  # noqa: E731  # new columns: both sides may come from one table
    q = firsts.join(lengths, "entity_id").join(grid, "source").withColumn("chunk", F.pmod(F.xxhash64("entity_id"), F.col("chunks")).cast("int")).withColumn("terms", held_terms(F.col("held"), terms)).withColumn("slab", F.explode(every("slabs"))).select(*tile("q"), "entity_id", "norm", "terms")
    t = ids.select("source", F.xxhash64("held").alias("hash"), "ids", held_terms(F.col("held"), terms).alias("terms")).unionByName(lists, allowMissingColumns=True).join(grid, "source")
    own = F.pmod(F.pmod("hash", F.lit(64)), F.least("slabs", F.lit(64))) + 64 * F.pmod(F.shiftright("hash", 6), F.ceil(F.col("slabs") / 64))
    t = t.withColumn("slab", F.explode(F.when(F.col("words").isNull(), F.array(own.cast("int"))).otherwise(every("slabs"))))
    parts = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i % F.least("slabs", F.lit(64)) == F.col("slab") % 64)
    t = t.withColumn("here", F.when(F.col("words").isNotNull(), F.aggregate(parts, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(bits(i)))))
    t = t.withColumn("words", F.filter("words", lambda x: x["marks"].bitwiseAND(F.col("here")) != 0)).withColumn("chunk", F.explode(every("chunks")))
    t = t.select(*tile("t"), "ids", "terms", F.col("words.term").alias("words"), F.col("words.idf").alias("idf"))
    found = q.groupBy("q_source", "q_slab", "q_chunk").cogroup(t.groupBy("t_source", "t_slab", "t_chunk")).applyInArrow(topk.best_of_tile(k), "candidate_source string, entity_id string, entity_id_cand string, score double")
    order = Window.partitionBy("entity_id", "candidate_source").orderBy(F.desc("score"), "entity_id_cand")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    same = queries.withColumnRenamed("entity_id", "entity_id_s1").join(firsts, "held").drop("held")
    out = same.join(ranked, "entity_id").select(*PAIR, "score", "rank")
    return out.withColumn("rank", F.col("rank") - 1) if zero_based else out


def tfidf_pairs(records: DataFrame, column: str, k: int = 5, terms=word_terms, min_df: int = 1, max_df: float = 1.0, max_terms: int | None = None, zero_based: bool = False) -> DataFrame:
    """The k most similar targets per S1 record and target source under TF-IDF cosine."""
    return tfidf_search(queries_of(records), tfidf_index(targets_of(records), column, terms, min_df, max_df, max_terms), column, k, terms, zero_based)


def channel(df: DataFrame, flag: str, renames: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(renames or {}).withColumn(flag, F.lit(1))


def no_pairs(spark) -> DataFrame:
    """An empty channel."""
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in PAIR))


#: Fixed types of a stored pool.
STORED = {
    **dict.fromkeys((*CHANNELS, *FLAGS, "numeric_conflict", "retrieval_channel_count"), "tinyint"),
    **dict.fromkeys(("name_word_rank", "address_word_rank", "rare_token_overlap_count", "shared_numeric_count"), "smallint"),
    **dict.fromkeys(("name_word_score", "address_word_score"), "float"), "rarest_shared_token_df": "int",
}


def downcast(union: DataFrame) -> DataFrame:
    """The union with the types in which it is stored."""
    return union.withColumns({c: F.col(c).cast(t) for c, t in STORED.items() if c in union.columns})


def union_evidence(channels: list[DataFrame], spark=None) -> DataFrame:
    """One row per pair: flags and scores by their greatest, ranks and df by their least, defaults where a channel is silent. Without channels, no rows."""
    channels = channels or [no_pairs(spark)]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), channels)
    absent = {c: F.lit(None).cast("double" if isinstance(v, float) else "int") for c, v in DEFAULTS.items() if c not in together.columns}
    together = together.withColumns(absent) if absent else together
    out = together.groupBy("entity_id_s1", "entity_id_cand").agg(F.min("candidate_source").alias("candidate_source"), *[F.coalesce((F.min if c in LEAST else F.max)(c), F.lit(v)).alias(c) for c, v in DEFAULTS.items()])
    return out.withColumn("retrieval_channel_count", sum((F.col(c) for c in CHANNELS[1:]), F.col(CHANNELS[0])))


def evidence(records: DataFrame, k: int = 5, enabled: tuple[str, ...] = CHANNELS) -> DataFrame:
    """The union of the enabled channels over normalized records."""
    made = {
        "retrieved_exact": lambda: channel(exact_flags(records).drop("exact_count"), "retrieved_exact"),
        "retrieved_name_word": lambda: channel(tfidf_pairs(records, "name_norm_clean", k), "retrieved_name_word", {"score": "name_word_score", "rank": "name_word_rank"}),
        "retrieved_address_word": lambda: channel(tfidf_pairs(records, "addr_norm_clean", k), "retrieved_address_word", {"score": "address_word_score", "rank": "address_word_rank"}),
        "retrieved_rare": lambda: channel(rare_token_pairs(records), "retrieved_rare"),
        "retrieved_numeric": lambda: channel(numeric_pairs(records), "retrieved_numeric"),
    }
    return union_evidence([made[c]() for c in enabled])


RANKING = (F.desc, "is_exact"), (F.desc, "retrieval_channel_count"), (F.desc, "both_name_address"), (F.asc, "best_lexical_rank"), (F.desc, "rare_token_overlap_count"), (F.desc, "shared_numeric_count"), (F.asc, "entity_id_cand")
LEGACY = (F.desc, "is_exact"), (F.desc, "retrieval_channel_count"), (F.desc, "name_word_score"), (F.desc, "address_word_score"), (F.desc, "rare_token_overlap_count"), (F.desc, "shared_numeric_count"), (F.asc, "entity_id_cand")


def ranked(union: DataFrame, order=RANKING) -> DataFrame:
    """Adds is_exact, best_lexical_rank, both_name_address and the rank within S1 across sources."""
    df = union.withColumns({
        "is_exact": F.greatest(*[F.col(c) for c in RULES]),
        "best_lexical_rank": F.least("name_word_rank", "address_word_rank"),
        "both_name_address": F.least("retrieved_name_word", "retrieved_address_word"),
    })
    return df.withColumn("candidate_rank", F.row_number().over(Window.partitionBy("entity_id_s1").orderBy(*[f(c) for f, c in order])))


def rank_and_prune(union: DataFrame, most: int = 15, order=RANKING) -> DataFrame:
    return ranked(union, order).where(F.col("candidate_rank") <= most)
