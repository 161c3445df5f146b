"""Toxicity by nearest labelled examples under TF-IDF cosine.

Examples are a bounded sample of the labelled rows (``MOST_EXAMPLES``, half of
each label, the smallest hashes of doc_id). Terms are runs of letters, digits and
non-ASCII bytes, A-Z lower-cased; the vocabulary is all terms of the examples,
however rare. A term weighs (1 + log tf) * idf * (1 + G2): its document frequency
is counted over all documents, and G2 is the log likelihood ratio of its presence
against the label, so that no term is left out and telling ones count for more.
Terms that no example has are in no vector, as usual where a fitted vocabulary is
applied to new texts.

The index is an inverted one: a posting list per term, in blocks of ``BLOCK``
examples, each block with its largest weight. What the ``COMMON`` terms of most
examples add to the cosines comes from a product with the matrix of their
weights, for ``AT_ONCE`` queries together. The largest of that in a block and the
block maxima of the query's other terms are an upper bound for the block; only
blocks are visited whose bound reaches the ``NEIGHBOURS``-th best product, and
cosines are completed from the postings there: the neighbours are the exact ones. Their labels are
voted on with weights that grow as the distance falls; examples count as their
label's share among the training rows. Votes are calibrated by isotonic
regression of the examples' leave-one-out votes.

Cases: a text without terms (null, empty or other) has the score of such
examples, one whose terms no example has the share of toxic training rows;
repeated rows have equal scores; of several texts of a labelled doc_id one is
taken by its terms, an id with both labels is no example; equally near examples are taken in the order of
the index (by their heaviest terms); without examples of both labels every
score is the share of toxic training rows (0 without any); an empty table gives
no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import InitVar, dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm import textcore
from kinspan.llm.staging import staged

MOST_EXAMPLES = 6_000
BLOCK = 64
COMMON = 512  # terms in a matrix
AT_ONCE = 64  # queries multiplied with it together
NEIGHBOURS = 15
FOLDS = 5
SMOOTH = 0.5

IS_TERM = np.zeros(256, dtype=bool)
IS_TERM[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True
IS_TERM[0x80:] = True


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each term, and row offsets into them."""
    low = textcore.LOWER[data]
    spaced = np.where(IS_TERM[low], low, np.uint8(0x20))
    return textcore.word_hashes(spaced, offs)


class Vectors(NamedTuple):
    """Sparse rows: row i has the terms and weights first[i] to first[i + 1], terms ascending."""

    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


@dataclass
class Index:
    """Examples by term: the vocabulary's hashes (sorted), term weights, unit vectors (sparse or a matrix), and the block maxima."""

    vocabulary: np.ndarray
    idf: np.ndarray
    vectors: InitVar[Vectors | np.ndarray]
    toxic: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    prior: float

    def __post_init__(self, vectors: Vectors | np.ndarray) -> None:
        if isinstance(vectors, np.ndarray):
            row, term = np.nonzero(vectors)
            vectors = Vectors(np.searchsorted(row, np.arange(len(vectors) + 1)), term, vectors[row, term])
        self.n = len(vectors.first) - 1
        self.blocks = -(-self.n // BLOCK)
        row = np.repeat(np.arange(self.n), np.diff(vectors.first))
        order = np.argsort(vectors.terms, kind="stable")
        self.held, self.held_weight = row[order].astype(np.intp), vectors.weights[order]  # of the type that bincount takes without a copy
        spot = vectors.terms[order].astype(np.int64) * self.blocks + self.held // BLOCK
        opens = np.flatnonzero(np.append(True, spot[1:] != spot[:-1])[: len(spot)])
        self.block, self.maxima = (spot[opens] % self.blocks).astype(np.int32), np.maximum.reduceat(self.held_weight, opens) if len(opens) else np.zeros(0)
        self.opens = np.append(opens, len(spot))  # where the postings of a term in a block begin
        self.of_term = np.searchsorted(spot[opens] // self.blocks, np.arange(len(self.vocabulary) + 1))
        sizes = np.diff(self.opens[self.of_term])
        self.common = np.sort(np.argsort(-sizes, kind="stable")[:COMMON])
        self.place = np.full(len(self.vocabulary), -1, np.int32)  # of a common term in the matrix
        self.place[self.common] = np.arange(len(self.common))

    @cached_property
    def matrix(self) -> np.ndarray:
        """The weights of the common terms, by term and example."""
        out = np.zeros((len(self.common), self.n))
        a = self.opens[self.of_term[self.common]]
        sizes = self.opens[self.of_term[self.common + 1]] - a
        posting = textcore.ragged(a, sizes)
        out[np.repeat(np.arange(len(out)), sizes), self.held[posting]] = self.held_weight[posting]
        return out

    def __getstate__(self) -> dict:
        """Without the matrix, which each worker makes for itself."""
        return {k: v for k, v in self.__dict__.items() if k != "matrix"}

    def queries(self, at: np.ndarray, row: np.ndarray) -> Vectors:
        """The unit vectors of the rows that have terms, from the term and row of every occurrence."""
        pairs, counts = np.unique(row * len(self.vocabulary) + at, return_counts=True)
        row, term = np.divmod(pairs, len(self.vocabulary))
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
        w = (1 + np.log(counts)) * self.idf[term]
        sizes = np.diff(np.append(first, len(row)))
        return Vectors(np.append(first, len(row)), term, w / np.repeat(np.sqrt(np.add.reduceat(w * w, first)) if len(first) else w, sizes))

    def nearest(self, term_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples with a positive cosine."""
        return next(self.neighbours(Vectors(np.array([0, len(term_ids)]), term_ids, q), k))

    def neighbours(self, queries: Vectors, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`nearest` of every query, in order."""
        for a in range(0, len(queries.first) - 1, AT_ONCE):
            first = queries.first[a : a + AT_ONCE + 1]
            term, q = (x[first[0] : first[-1]] for x in queries[1:])
            row, place = np.repeat(np.arange(len(first) - 1), np.diff(first)), self.place[term]
            common = place >= 0
            of_common = np.zeros((len(first) - 1, len(self.common)))
            of_common[row[common], place[common]] = q[common]
            scores = of_common @ self.matrix
            least = np.partition(scores, -k, axis=1)[:, -k] if self.n > k else np.zeros(len(scores))
            most = np.maximum.reduceat(scores, np.arange(0, self.n, BLOCK), axis=1)
            term, q, cuts = term[~common], q[~common], np.searchsorted(row[~common], np.arange(len(first)))
            for i, own in enumerate(scores):
                rest = slice(cuts[i], cuts[i + 1])
                yield self.best(own, least[i], most[i], term[rest], q[rest], k)

    def best(self, scores: np.ndarray, least: float, most: np.ndarray, term: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best examples, given what the common terms add up to (``least``: the k-th of that, ``most``: the largest in each block) and the query's other terms."""
        sizes = self.of_term[term + 1] - self.of_term[term]
        entry, q = textcore.ragged(self.of_term[term], sizes), np.repeat(q, sizes)
        block = self.block[entry]
        bounds = most + np.bincount(block, weights=q * self.maxima[entry], minlength=self.blocks)
        visited = (bounds > 0) & (bounds >= least - 1e-9)
        here = np.flatnonzero(visited[block])
        opens = self.opens[entry[here]]
        held = self.opens[entry[here] + 1] - opens
        posting = textcore.ragged(opens, held)
        scores = scores + np.bincount(self.held[posting], weights=np.repeat(q[here], held) * self.held_weight[posting], minlength=self.n)
        at = np.flatnonzero((scores > 0) & (scores >= least - 1e-9) & np.repeat(visited, BLOCK)[: self.n])
        values = scores[at]
        if len(at) > k:
            near = values >= np.partition(values, -k)[-k] - 1e-9
            at, values = at[near], values[near]
        near = np.lexsort((at, -values.round(12)))[:k]
        return at[near], values[near]

    def vote(self, at: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic weight among neighbours, the nearer the heavier, drawn towards the prior."""
        w = self.weight[at] * cosines / (1.05 - np.minimum(cosines, 1.0))
        return float(((w * self.toxic[at]).sum() + SMOOTH * self.prior) / (w.sum() + SMOOTH))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from x upwards, value) of the weighted least squares non-decreasing fit."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], w[order], strict=True):
        if steps and steps[-1][0] == xi:
            steps[-1][1] += yi * wi
            steps[-1][2] += wi
        else:
            steps.append([xi, yi * wi, wi])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, s, n = steps.pop()
            steps[-1][1] += s
            steps[-1][2] += n
    return np.array([s[0] for s in steps]), np.array([s[1] / s[2] for s in steps])


@dataclass
class Scorer:
    index: Index | None
    steps: np.ndarray
    values: np.ndarray
    without_terms: float

    def calibrated(self, vote: float) -> float:
        """Linear between the steps of the fit."""
        return float(np.interp(vote, self.steps, self.values))


def log_likelihood_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """G-squared of presence against label."""
    total = np.zeros(len(pos))
    n = n_pos + n_neg
    for seen, rows in ((pos, n_pos), (neg, n_neg)):
        for observed, column in ((seen, pos + neg), (rows - seen, n - pos - neg)):
            expected = rows * column / n
            total += np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return 2 * total


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, is_toxic) of the labelled ids outside the held-out fold; ids with both labels are left out."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold != 0))
    marks = rows.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("is_toxic"), F.max("toxic").alias("most"))
    return marks.where(F.col("is_toxic") == F.col("most")).select("doc_id", "is_toxic")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES) -> Scorer:
    spark = docs.sparkSession
    train = training_rows(labels)
    n_train = {r["is_toxic"]: r["n"] for r in train.groupBy("is_toxic").agg(F.count("*").alias("n")).collect()}
    prior = n_train.get(1, 0) / max(1, sum(n_train.values()))
    parts = [train.where(F.col("is_toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for k in (0, 1)]
    chosen = {r["doc_id"]: r["is_toxic"] for r in parts[0].union(parts[1]).collect()}
    ids = F.broadcast(spark.createDataFrame(sorted(chosen.items()), "doc_id long, is_toxic int"))

    def example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in textcore.slabs(batches, "text"):
            h, first = terms(data, offs)
            row = np.repeat(np.arange(len(rows)), np.diff(first))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            opens = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)])
            ends = pa.array(np.searchsorted(row[opens], np.arange(len(rows) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h[opens].view(np.int64), np.diff(np.append(opens, len(h))).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *lists], names=["doc_id", "terms", "counts"])

    held = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(example_terms, "doc_id long, terms array<long>, counts array<int>")
    held = held.groupBy("doc_id").agg(F.min(F.struct("terms", "counts")).alias("one")).select("doc_id", "one.*")
    held = staged(held.join(ids, "doc_id"), "examples").toArrow().combine_chunks()
    toxic, doc_ids = held["is_toxic"].to_numpy().astype(float), held["doc_id"].to_numpy()
    sizes = {1: int(toxic.sum()), 0: int((1 - toxic).sum())}
    if min(sizes.values()) == 0:
        return Scorer(None, np.zeros(1), np.array([prior]), prior)
    lengths = held["terms"].combine_chunks().value_lengths().to_numpy()
    vocabulary, term = np.unique(held["terms"].combine_chunks().flatten().to_numpy().view(np.uint64), return_inverse=True)
    counts = held["counts"].combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(toxic)), lengths)
    if not len(vocabulary):
        return Scorer(None, np.zeros(1), np.array([prior]), prior)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary) + 1, np.int64)
        for rows, data, offs in textcore.slabs(batches, "text"):
            at, row, _ = known_terms(data, offs, vocabulary)
            df[:-1] += np.bincount(np.unique(row * len(vocabulary) + at) % len(vocabulary), minlength=len(vocabulary))
            df[-1] += len(rows)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], names=["term", "n"])

    counted = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocabulary) + 1)
    df[counted["term"]] = counted["n"]
    pos = np.bincount(term, weights=toxic[row], minlength=len(vocabulary))
    telling = 1 + np.maximum(0, log_likelihood_ratio(pos, np.bincount(term, minlength=len(vocabulary)) - pos, sizes[1], sizes[0]))
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * telling

    weights = (1 + np.log(counts)) * idf[term]
    weights /= np.sqrt(np.bincount(row, weights=weights * weights, minlength=len(toxic)))[row]
    share = {k: n_train[k] / sum(n_train.values()) / (sizes[k] / len(toxic)) for k in (0, 1)}
    weight = np.where(toxic == 1, share[1], share[0])
    bare = lengths == 0
    without = float(((weight * toxic)[bare].sum() + SMOOTH * prior) / (weight[bare].sum() + SMOOTH))
    first = np.append(0, np.cumsum(lengths))

    def place(i: int) -> tuple:
        """Examples with the same heaviest terms stand together, so that few blocks have high bounds."""
        t, w = term[first[i] : first[i + 1]], weights[first[i] : first[i + 1]]
        return t[np.argsort(-w, kind="stable")[:4]].tolist(), t.tobytes(), w.tobytes(), toxic[i], doc_ids[i]

    kept = np.array(sorted(np.flatnonzero(~bare), key=place))
    own = textcore.ragged(first[kept], lengths[kept])
    unit = Vectors(np.append(0, np.cumsum(lengths[kept])), term[own], weights[own])
    index = Index(vocabulary, idf, unit, toxic[kept], weight[kept], doc_ids[kept], prior)
    votes, led = np.zeros(len(kept)), np.zeros(len(kept), bool)
    for i, (at, cos) in enumerate(index.neighbours(unit, NEIGHBOURS + 1)):
        other = at != i
        votes[i], led[i] = index.vote(at[other][:NEIGHBOURS], cos[other][:NEIGHBOURS]), other.any()
    if not led.any():
        led[:] = True
    steps, values = isotonic(votes[led], index.toxic[led], index.weight[led])
    return Scorer(index, steps, values, without)


def known_terms(data: np.ndarray, offs: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every occurrence of a vocabulary term: its number and its row; and how many terms each row has, known or not."""
    h, first = terms(data, offs)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == h)
    return at[hit], np.searchsorted(first, hit, side="right") - 1, np.diff(first)


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Score, decision and nearest examples of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scorer = shared.value
        for rows, data, offs in textcore.slabs(batches, "text"):
            n = len(rows)
            scores, evidence, cosines = np.full(n, s.without_terms), [[] for _ in range(n)], [[] for _ in range(n)]
            if s.index is not None:
                at, row, sizes = known_terms(data, offs, s.index.vocabulary)
                scores[sizes > 0] = s.index.prior
                known = np.unique(row)
                for i, (near, cos) in zip(known, s.index.neighbours(s.index.queries(at, row), NEIGHBOURS), strict=True):
                    scores[i] = s.calibrated(s.index.vote(near, cos))
                    evidence[i], cosines[i] = s.index.ids[near].tolist(), cos.tolist()
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(scores), pa.array(evidence, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], names=["doc_id", "score", "evidence", "evidence_cosine"])

    out = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, evidence array<long>, evidence_cosine array<double>")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "evidence_cosine")


def op9_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, fit(docs, labels))
