"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a target number of words. A source's documents are taken whole
``floor(target / size of the source)`` times, and once more those whose hash
lies below the source's threshold. The threshold is found without sorting: sum
words by source and hash bucket, walk to the bucket in which the budget ends,
split only that bucket, and again. Three levels of 4,096 buckets leave a single
document or a few copies undecided; they go in if that comes closer.

Weights go to the sources in code point order, null last, in turn from
``weights``. The sources share ``share`` times all words; no target exceeds
``most`` times its source, and what is over is shared anew by weight (the level
at which the capped shares add up, found with one ordered pass over sources).

Cases: a null text has size 0; a null source is a source; rows with the same or
no doc_id are rows of their own, taken or left together; an empty table gives no
rows; an empty source has target 0; columns other than doc_id, source and text
are not read and may have any name. The windows over sources read a row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.llm.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
HASH_BITS = 60
LEVEL_BITS = 12
LEVELS = 3
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column) -> Column:
    """60 bits of the md5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source_key, source_size, target. The windows are over a row per source."""
    sizes = slim.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * most
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.partitionBy(F.lit(0)).orderBy("level", F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    s = s.withColumn("budget", F.sum("source_size").over(everything).cast("double") * share)
    s = s.withColumn("caps_below", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weights_from", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("capped", F.col("caps_below") + F.col("level") * F.col("weights_from") <= F.col("budget"))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", left / open_weight * F.col("weight")))
    return s.select("source_key", "source_size", target.alias("target"))


def thresholds(slim: DataFrame, targets: DataFrame, keyed) -> DataFrame:
    """source_key, copies (whole takes) and limit (hashes below it are taken once more)."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    state = goal.select("source_key", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("bucket_size"))
    shift = HASH_BITS
    for _ in range(LEVELS):
        inside = slim.join(keyed(state), "source_key").where(F.shiftright("hash", shift) == F.col("prefix"))
        shift -= LEVEL_BITS
        sums = inside.groupBy("source_key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        upto = F.sum("n").over(Window.partitionBy("source_key").orderBy("bucket"))
        ends = sums.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
        state = ends.select("source_key", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"), F.col("bucket").alias("prefix"), F.col("n").alias("bucket_size"))
    last = F.col("prefix") + F.when(F.col("bucket_size") - F.col("rest") < F.col("rest"), 1).otherwise(0)
    found = state.select("source_key", F.shiftleft(last, shift).alias("limit"))
    return goal.drop("rest").join(found, "source_key", "left").withColumn("limit", F.coalesce("limit", F.lit(0)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row."""
    source_key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    slim = staged(docs.select("doc_id", "source", source_key.alias("source_key"), word_count(F.col("text")).alias("size"), unit_hash(F.col("doc_id")).alias("hash")), "mixing")
    targets = staged(source_targets(slim, weights, share, most), "targets")
    few = targets.count() <= BROADCAST_SOURCES

    def keyed(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if few else small

    found = thresholds(slim, targets, keyed)
    copies = F.col("copies") + F.when(F.col("hash") < F.col("limit"), 1).otherwise(0)
    out = slim.join(keyed(found), "source_key").withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op1_mixing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs).drop("copies")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it."""
    source_key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    slim = staged(docs.select("doc_id", "source", source_key.alias("source_key"), word_count(F.col("text")).alias("size"), unit_hash(F.col("doc_id")).alias("hash")), "mixing")
    targets = staged(source_targets(slim, **how), "targets")
    few = targets.count() <= BROADCAST_SOURCES

    def keyed(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if few else small

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source_key.alias("source_key"), unit_hash(F.col("doc_id")).alias("hash"))
    whole = rows.join(keyed(thresholds(slim, targets, keyed).select("source_key", "copies", "limit")), "source_key")
    times = F.col("copies") + F.when(F.col("hash") < F.col("limit"), 1).otherwise(0)
    taken = whole.select("row", times.alias("times"), F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)))).alias("take")).where(F.col("take") <= F.col("times"))
    return taken.select("row.*")


ORACLE = r"""
WITH slim AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS source_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents),
sizes AS (SELECT source_key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM slim GROUP BY 1),
weighted AS (
  SELECT *, source_size::DOUBLE * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sizes),
leveled AS (SELECT *, cap / weight AS level FROM weighted),
filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_below,
         sum(weight) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_from
  FROM leveled),
capped AS (SELECT *, caps_below + level * weights_from <= budget AS capped FROM filled),
targets AS (
  SELECT source_key, source_size,
         CASE WHEN capped THEN cap ELSE least(cap, (budget - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) / (sum(weight) FILTER (WHERE NOT capped) OVER ()) * weight) END AS target
  FROM capped),
goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM targets),
rests AS (SELECT *, target - copies * source_size AS rest FROM goal),
b1 AS (SELECT source_key, hash >> 48 AS bucket, sum(size)::BIGINT AS n FROM slim GROUP BY ALL),
c1 AS (SELECT *, sum(n) OVER (PARTITION BY source_key ORDER BY bucket)::BIGINT AS upto FROM b1),
s1 AS (SELECT source_key, rest - (upto - n) AS rest, bucket AS prefix FROM c1 JOIN rests USING (source_key) WHERE upto > rest AND upto - n <= rest),
b2 AS (SELECT source_key, hash >> 36 AS bucket, sum(size)::BIGINT AS n FROM slim JOIN s1 USING (source_key) WHERE hash >> 48 = prefix GROUP BY ALL),
c2 AS (SELECT *, sum(n) OVER (PARTITION BY source_key ORDER BY bucket)::BIGINT AS upto FROM b2),
s2 AS (SELECT source_key, rest - (upto - n) AS rest, bucket AS prefix FROM c2 JOIN s1 USING (source_key) WHERE upto > rest AND upto - n <= rest),
b3 AS (SELECT source_key, hash >> 24 AS bucket, sum(size)::BIGINT AS n FROM slim JOIN s2 USING (source_key) WHERE hash >> 36 = prefix GROUP BY ALL),
c3 AS (SELECT *, sum(n) OVER (PARTITION BY source_key ORDER BY bucket)::BIGINT AS upto FROM b3),
s3 AS (SELECT source_key, (bucket + CASE WHEN n - (rest - (upto - n)) < rest - (upto - n) THEN 1 ELSE 0 END) << 24 AS lim FROM c3 JOIN s2 USING (source_key) WHERE upto > rest AND upto - n <= rest)
SELECT doc_id, size, source_size, target, (copies + CASE WHEN hash < coalesce(lim, 0) THEN 1 ELSE 0 END) * size AS taken
FROM slim JOIN goal USING (source_key) LEFT JOIN s3 USING (source_key)
"""
