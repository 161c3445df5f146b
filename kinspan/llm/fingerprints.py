"""Document fingerprints: I-Match over randomised lexicons, in built-in functions only.

A document's terms are its distinct lower-cased runs of letters and digits, each
known by a class of ``CLASS_BITS`` hash bits. The lexicon holds the classes whose
document frequency, counted over all documents, lies in a band: neither words
that most texts share nor rare ones. Copies do not lift a class out of the band:
the upper end also admits what lies below it among the distinct term sets of the
documents. The lexicon is a bit table of fixed size whatever
the corpus, since a class of rare words stays below the band.

The lexicon has random subsets that are the same for all documents: ``FAMILIES``
families, each of ``LEVELS`` nested subsets with a half, a quarter and so on of the
terms. A fingerprint has one hash of the document's sorted distinct terms in the
whole lexicon, and one of those in each subset (nothing where it has none there).
Texts with the same terms have the same fingerprint; an edit changes the hashes of
the subsets that hold a term which goes or comes, and thin subsets hold few.

Likeness is the share of equal hashes among the subsets of one level in which
either text has terms: the thinnest level in which at least half of the subsets
are such. It is 1 for equal fingerprints.

A text with less than ``LEAST_SHARE`` of its terms in the lexicon (one of a large
group of near copies, say) uses all its terms in the same subsets, so that its
likeness stays graded. A text without terms has "-", which is like an equal one
(1) and no other (0).

Texts are shuffled once: they are dealt by ranges of doc_id, in which a window
has each row's next one; the first text of the following range is a row of both.

Cases: null texts are empty. The next document of rows with one doc_id is that
of the next greater doc_id (nulls come first; after the last, the first); among
rows that share the next doc_id the smallest text counts. Rows of one doc_id lie
in one range and are read by one task, which keeps them on disk if need be. An empty table gives
no rows. A corpus of one document is its own next. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.llm.staging import staged

CLASS_BITS = 21
BAND = (0.0005, 0.03)
BAND_LEAST = (2.0, 16.0)  # the band's ends in documents are never below these
LEAST_SHARE = 1 / 3
FAMILIES = 8
LEVELS = 13
RANK_BITS = 62
NO_TERMS = "-"
NULL_KEY = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def term_classes(text: Column) -> Column:
    """The sorted distinct classes of a text's terms."""
    runs = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_sort(F.array_distinct(F.transform(runs, lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << CLASS_BITS) - 1)))))


def lexicon_bits(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """One row: the lexicon as an array of 2**(CLASS_BITS - 6) words of 64 bits."""
    total = docs.agg(F.count("*").alias("n"))
    sets = docs.select(term_classes(F.col("text")).cast("array<int>").alias("classes")).groupBy(F.xxhash64("classes").alias("set")).agg(F.count("*").alias("copies"), F.first("classes").alias("classes"))
    sets = staged(sets.select("copies", "classes"), "term-sets")
    seen = sets.select("copies", F.explode("classes").alias("class")).groupBy(F.col("class").cast("long").alias("class")).agg(F.sum("copies").alias("df"), F.count("*").alias("sets"))
    n, n_sets = total.scalar().cast("double"), sets.agg(F.count("*").alias("n")).scalar().cast("double")
    most = (F.col("df") <= F.greatest(F.lit(BAND_LEAST[1]), n * band[1])) | (F.col("sets") <= F.greatest(F.lit(BAND_LEAST[1]), n_sets * band[1]))
    inside = seen.where((F.col("df") >= F.greatest(F.lit(BAND_LEAST[0]), n * band[0])) & most)
    bit = F.expr("shiftleft(1L, cast(class & 63 as int))")
    words = inside.groupBy(F.shiftright("class", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    dense = docs.sparkSession.range(1 << (CLASS_BITS - 6)).withColumnRenamed("id", "word").join(words, "word", "left")
    rows = dense.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("rows"))
    return rows.select(F.transform("rows", lambda r: r["bits"]).alias("lexicon"))


def digest(terms: Column) -> Column:
    """The hash of sorted terms, or nothing without any."""
    return F.when(F.size(terms) > 0, F.lpad(F.hex(F.xxhash64(terms).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")).otherwise("")


def fingerprint(classes: Column, lexicon: Column) -> Column:
    """The hashes of a text with these sorted term classes, joined by "-": of the whole lexicon, then family by family from the largest subset on."""
    band = F.filter(classes, lambda c: F.get(lexicon, F.shiftright(c, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))) != 0)

    def family(kept: Column, number: Column) -> Column:
        ranks = F.transform(kept, lambda c: F.xxhash64(c, number).bitwiseAND(F.lit((1 << RANK_BITS) - 1)))
        start = F.struct(ranks.alias("ranks"), F.array().cast("array<string>").alias("hashes"))

        def thinner(held: Column, level: Column) -> Column:
            inside = F.filter(held["ranks"], lambda r: r < F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(RANK_BITS) - level))
            return let(inside, lambda ranks: F.struct(ranks.alias("ranks"), F.concat(held["hashes"], F.array(digest(ranks))).alias("hashes")))

        levels = F.array(*[F.lit(k) for k in range(1, LEVELS + 1)])
        return F.array_join(F.aggregate(levels, start, thinner, lambda held: held["hashes"]), "-")

    def hashes(kept: Column) -> Column:
        each = F.transform(F.array(*[F.lit(k) for k in range(FAMILIES)]), lambda k: family(kept, k))
        return F.when(F.size(kept) > 0, F.concat_ws("-", digest(kept), F.array_join(each, "-"))).otherwise(NO_TERMS)

    return let(let(band, lambda some: F.when(F.size(some) >= F.size(classes) * LEAST_SHARE, some).otherwise(classes)), hashes)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes of two fingerprints, at the thinnest level that tells."""
    pairs = F.arrays_zip(F.split(a, "-").alias("x"), F.split(b, "-").alias("y"))

    def at_level(pairs: Column, level: Column) -> Column:
        own = F.transform(F.array(*[F.lit(k) for k in range(FAMILIES)]), lambda k: F.get(pairs, k * LEVELS + level))
        return let(F.filter(own, lambda p: (p["x"] != "") | (p["y"] != "")), lambda held: F.struct(F.size(held).alias("n"), F.size(F.filter(held, lambda p: p["x"] == p["y"])).alias("equal")))

    def share(pairs: Column) -> Column:
        levels = F.filter(F.transform(F.array(*[F.lit(k) for k in range(1, LEVELS + 1)]), lambda k: at_level(pairs, k)), lambda held: held["n"] >= FAMILIES // 2)
        return let(F.try_element_at(levels, F.lit(-1)), lambda held: F.coalesce(held["equal"] / held["n"], F.lit(0.0)))

    return F.when(a == b, 1.0).when((a == NO_TERMS) | (b == NO_TERMS), 0.0).otherwise(let(pairs, share))


def ranges(docs: DataFrame) -> DataFrame:
    """One row: the first key of each range of keys, ascending. A range for each shuffle partition, of about as many keys."""
    keys = docs.select("key")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = keys.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("range")).agg(F.min("key").alias("first"))
    return staged(firsts.agg(F.array_sort(F.collect_list("first")).alias("firsts")), "ranges")


def range_of(key: Column, firsts: Column, n: int) -> Column:
    """The number of the range that holds a key, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(firsts, at + step) <= key, at + step).otherwise(at))


def with_next(texts: DataFrame) -> DataFrame:
    """Every row of ``texts`` (key, text, ...) with the smallest text of the next key, in windows by range that start at the greatest key.

    ``borrowed`` rows stand for the range after theirs and are to be dropped.
    """
    firsts = ranges(texts)
    n = firsts.select(F.size("firsts")).first()[0]
    dealt = texts.withColumn("firsts", firsts.scalar()).withColumn("range", range_of(F.col("key"), F.col("firsts"), n)).drop("firsts").withColumn("borrowed", F.lit(False))
    heads = firsts.select(F.posexplode("firsts").alias("range", "key"))
    first = texts.join(F.broadcast(heads), "key").groupBy("range", "key").agg(F.min("text").alias("text"))
    borrowed = first.select(F.lit(None).cast("long").alias("doc_id"), "key", "text", F.pmod(F.col("range") - 1, F.lit(max(1, n))).alias("range"), F.lit(True).alias("borrowed"))
    rows = dealt.unionByName(borrowed).repartitionByRange("range")
    ordered = Window.partitionBy("range").orderBy(F.desc("borrowed"), F.desc("key"), F.desc("text"))
    last_of_key = F.lead("key").over(ordered)
    rows = rows.withColumn("leads", F.col("borrowed") | last_of_key.isNull() | (last_of_key != F.col("key")))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("next_text", F.last(F.when(F.col("leads"), F.col("text")), ignorenulls=True).over(before))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Every row with its edited text's hash, both fingerprints and their likeness."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lexicon = staged(lexicon_bits(texts), "lexicon")
    rows = with_next(texts.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY))))
    rows = rows.withColumn("n_chars", F.char_length("text"))
    cut = F.expr("cast(floor(n_chars / 4) as int)")
    edited = F.concat(F.expr("left(text, n_chars - cast(floor(n_chars / 4) as int))"), F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited", F.when(~F.col("borrowed"), edited)).withColumn("lexicon", lexicon.scalar())
    bits = F.col("lexicon")
    marked = rows.select(
        "doc_id", "range", "borrowed", "key", "text", "leads", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(term_classes(F.col("text")), bits).alias("fingerprint"), F.when(~F.col("borrowed"), fingerprint(term_classes(F.col("edited")), bits)).alias("edited_fingerprint"),
    )
    before = Window.partitionBy("range").orderBy(F.desc("borrowed"), F.desc("key"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    both = marked.withColumn("next_fingerprint", F.last(F.when(F.col("leads"), F.col("fingerprint")), ignorenulls=True).over(before)).where(~F.col("borrowed"))
    return both.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op4_fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return fingerprinted(docs)
