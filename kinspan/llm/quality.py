"""Quality classifier by importance resampling.

Two generative models over hashed word 1- and 2-grams, one of documents labelled
good and one of the whole raw corpus, give each document the log ratio of its
likelihoods: the sum over its n-grams. That is the log weight with which
importance resampling takes it, as it is, without a temperature. Sampling without
replacement by those weights is Gumbel top-k: the k largest of (log weight +
Gumbel noise), where the noise comes from a hash of the document's id and text, so
reruns agree. k is a share of the documents: ``share``, or the corpus's share of good
documents as estimated by adjusted counting: labelled documents that the model was
not fitted on give the log weight at which the shares of good and of bad ones
above it differ most, and those shares; the share of all documents above it is
then put right by them. So labels need not be as frequent as what they label, and
the cut decides how many documents are taken, not which.

The raw model counts every document; the labels may be a bounded sample
(``most_labels``, the smallest hashes of doc_id of each label). Models are
``BUCKETS`` counts however large the corpus is. The k-th largest key is found
with nested histograms, not by a sort.

Cases: null and empty texts have a log weight of 0; a null doc_id is a row like others;
repeated rows share a key and are taken or left together (k may be passed by
such ties); without labels of both kinds every document stays; an empty table
gives no rows; only doc_id and text are read, other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm import textcore
from kinspan.llm.staging import staged

BUCKETS = 1 << 16
MOST_LABELS = 20_000
PSEUDO = 5.0
LEVEL_BUCKETS = 4096
SCORES = "doc_id long, log_weight double, noise double"


@dataclass(frozen=True)
class Model:
    """log(p_good / p_raw) for each bucket, both counts with ``PSEUDO`` added so that few sightings tell little."""

    ratio: np.ndarray


def bucket_counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the 1- and 2-grams of each row (one array), and the row of each."""
    w, first = textcore.word_hashes(data, offs)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    pairs = textcore.gram_hashes(w, 2)
    same = rows[:-1] == rows[1:]
    grams = np.concatenate([w, pairs[same]])
    return (grams % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([rows, rows[:-1][same]])


def label_sample(labels: DataFrame, column: str, most: int) -> DataFrame:
    """At most ``most`` / 2 labelled ids of each kind, the smallest hashes; ``fitted`` marks about half of them, the others are held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).select("doc_id", F.col(column).cast("int").alias("is_good")).distinct()
    parts = [known.where(F.col("is_good") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for k in (0, 1)]
    return parts[0].union(parts[1]).withColumn("fitted", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0)


def fit(docs: DataFrame, known: list) -> Model | None:
    """The model from a label sample's rows, or None without fitted ones of both kinds."""
    spark = docs.sparkSession
    if len({r["is_good"] for r in known if r["fitted"]}) < 2:
        return None
    shared = spark.sparkContext.broadcast({r["doc_id"] for r in known if r["fitted"] and r["is_good"]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for rows, data, offs in textcore.slabs(batches, "text"):
            buckets, row = bucket_counts(data, offs)
            sums[1] += np.bincount(buckets, minlength=BUCKETS)
            good = np.fromiter((k in shared.value for k in rows.column("doc_id").to_pylist()), bool, len(rows))
            sums[0] += np.bincount(buckets[good[row]], minlength=BUCKETS)
        held = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[0][held]), pa.array(sums[1][held])], names=["bucket", "good", "raw"])

    counts = docs.select("doc_id", "text").mapInArrow(count, "bucket long, good long, raw long")
    table = counts.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("raw").alias("raw")).toPandas()
    good, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    good[table["bucket"]], raw[table["bucket"]] = table["good"], table["raw"]
    expected = raw * good.sum() / max(1, raw.sum())
    return Model(np.log((good + PSEUDO) / (expected + PSEUDO)))


def parting(weights: np.ndarray, good: np.ndarray) -> tuple[float, float, float]:
    """The cut above which the shares of good and of bad ones differ most (the middle of its gap, the lowest of equals), and the two shares."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order] == 1
    above = [1 - np.append(0, np.cumsum(x)) / x.sum() for x in (g, ~g)]
    edges = np.append(True, w[1:] > w[:-1])
    at = int(np.argmax(np.where(edges, above[0][:-1] - above[1][:-1], -np.inf)))
    return float(w[0] if at == 0 else (w[at - 1] + w[at]) / 2), float(above[0][at]), float(above[1][at])


def good_share(weights: DataFrame, known: list) -> float:
    """The corpus's share of good documents by adjusted counting; the share among the labels where the held-out rows don't tell."""
    spark = weights.sparkSession
    held_out = spark.createDataFrame([(r["doc_id"], r["is_good"]) for r in known if not r["fitted"]], "doc_id long, is_good int")
    rows = weights.join(F.broadcast(held_out), "doc_id").groupBy("doc_id", "is_good").agg(F.max("log_weight").alias("log_weight")).toPandas()
    if rows["is_good"].nunique() == 2:
        cut, good, bad = parting(rows["log_weight"].to_numpy(), rows["is_good"].to_numpy())
        above = weights.agg(F.avg((F.col("log_weight") >= cut).cast("double"))).first()[0]
        if good > bad:
            return min(1.0, max(0.0, (above - bad) / (good - bad)))
    return sum(r["is_good"] for r in known) / len(known)


def scored(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row runs with log weight and Gumbel noise."""
    for rows, data, offs in textcore.slabs(batches, "text"):
        buckets, row = bucket_counts(data, offs)
        weight = np.bincount(row, weights=ratio[buckets], minlength=len(rows))
        text_hash = textcore.span_hash(textcore.prefix_hash(data), offs[:-1], offs[1:])
        ids = rows.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64)
        u = (textcore.mix(text_hash ^ textcore.mix(ids)) >> np.uint64(11)).astype(np.float64)
        yield rows, weight, -np.log(-np.log((u + 0.5) / 2**53))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, log weight and Gumbel noise of every row."""
    ratio = model.ratio

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, weight, noise in scored(batches, ratio):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(weight), pa.array(noise)], names=["doc_id", "log_weight", "noise"])

    return docs.select("doc_id", "text").mapInArrow(score, SCORES)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest key, by nested histograms: the bucket that holds it is divided again until all of its keys belong above the limit, or are equal."""
    while True:
        low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
        step = (high - low) / LEVEL_BUCKETS
        if n == k or not step > 0:
            return low
        bucket = F.least(F.lit(LEVEL_BUCKETS - 1), F.floor((F.col("key") - low) / step)).cast("int")
        counts = keys.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).toPandas()
        held = np.zeros(LEVEL_BUCKETS + 1, np.int64)
        held[counts["bucket"]] = counts["n"]
        above = np.cumsum(held[::-1])[::-1]
        at = int(np.flatnonzero(above >= k)[-1])
        k -= int(above[at + 1])
        keys = keys.where(bucket == at)


@dataclass(frozen=True)
class Sampler:
    """What a document's text decides: kept if the key reaches the limit."""

    model: Model
    limit: float


def sampler(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, share: float | None = None) -> tuple[Sampler, DataFrame] | None:
    """The fitted sampler, and doc_id, log_weight, noise, sample_key of every row as a staged table."""
    known = label_sample(labels, "quality", most_labels).collect()
    model = fit(docs, known)
    if model is None:
        return None
    slim = staged(scores(docs, model).withColumn("sample_key", F.col("log_weight") + F.col("noise")), "weights")
    k = math.ceil(slim.count() * (good_share(slim, known) if share is None else share))
    return Sampler(model, kth_largest(slim.select(F.col("sample_key").alias("key")), k) if k else float("inf")), slim


def resample(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that the sample takes, with all their columns."""
    found = sampler(docs, labels, most_labels, share)
    if found is None:
        return docs
    s = found[0]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, weight, noise in scored(batches, s.model.ratio):
            yield rows.filter(pa.array(weight + noise >= s.limit))

    return docs.mapInArrow(keep, docs.schema)


def op2_quality_classifier(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight and sample_key of the documents that the sample takes."""
    found = sampler(docs, labels)
    if found is None:
        return docs.select(F.col("doc_id").cast("long"), *[F.lit(0.0).alias(c) for c in ("log_weight", "sample_key")])
    s, slim = found
    return slim.where(F.col("sample_key") >= s.limit).select("doc_id", "log_weight", "sample_key")
