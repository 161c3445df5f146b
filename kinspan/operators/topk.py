"""The k nearest unit vectors of a tile of queries and targets, by an inverted index and length bounds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most queries and targets of a tile; a source's smaller set makes up to AT_ONCE tiles, of LEAST queries at least.
TILE, LEAST, AT_ONCE = 300_000, 1_000, 3
#: Scores are rounded to so many digits; a bound this close to the k-th score does not rule out.
DIGITS, SLACK = 9, 1e-8
RESULT = pa.schema([("candidate_source", pa.string()), ("entity_id", pa.string()), ("entity_id_cand", pa.string()), ("score", pa.float64())])


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.ChunkedArray]:
    """How many values each row of a list column has, and the values."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return sizes, pa.chunked_array([x.flatten() for x in column.chunks], column.type.value_type)


def weighed(column: pa.ChunkedArray, words: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, places in ``words`` and weights (1 + ln n) * idf of the words that each list holds."""
    sizes, values = flat(column)
    codes = pc.index_in(values, value_set=words)
    known = codes.is_valid().to_numpy()
    rows = np.repeat(np.arange(len(sizes)), sizes)[known]
    pairs, n = np.unique(rows * max(1, len(words)) + codes.drop_null().to_numpy(), return_counts=True)
    del values, known, rows, codes
    rows, codes = np.divmod(pairs, max(1, len(words)))
    pa.default_memory_pool().release_unused()
    return np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(sizes))))), codes.astype(np.int32), (1.0 + np.log(n)) * idf[codes]


class Postings:
    """Targets by term and by row, over the terms of queries and targets together."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, starts: np.ndarray, n_terms: int) -> None:
        self.starts, self.codes, self.weights = starts, codes, weights
        order = np.argsort(codes, kind="stable")
        self.rows = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))[order]
        self.values = weights[order]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=n_terms))))
        self.lengths = np.diff(self.at)
        self.partial = np.zeros(len(starts) - 1)
        self.dense = np.zeros(n_terms)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Whole products of the query in ``dense`` with some targets."""
        n = self.starts[rows + 1] - self.starts[rows]
        begins = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(self.starts[rows] - begins, n)
        return np.add.reduceat(self.dense[self.codes[at]] * self.weights[at], begins)

    def best(self, codes: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best targets by rounded score, then row, and those scores.

        Terms come rarest first. Targets are of length one, so one that shares only
        the terms from place i on scores no more than the length of that rest of the
        query: when the k-th partial score reaches it, no further target can enter.
        That score is no more than the length of the terms read, so it is not looked
        at while theirs is the smaller.
        """
        used = self.lengths[codes] > 0
        codes, weights = codes[used], weights[used]
        if not len(codes):
            return np.empty(0, np.int64), np.empty(0)
        order = np.argsort(self.lengths[codes], kind="stable")
        codes, weights = codes[order], weights[order]
        rest = np.append(np.sqrt(np.cumsum((weights * weights)[::-1])[::-1]), 0.0)
        seen, n, kth, i = [], 0, 0.0, 0
        while i < len(codes) and not (n >= k and kth > rest[i] + SLACK):
            a, b = self.at[codes[i]], self.at[codes[i] + 1]
            rows = self.rows[a:b]
            before = self.partial[rows]
            self.partial[rows] = before + weights[i] * self.values[a:b]
            new = rows[before == 0]
            if len(new):
                seen.append(new)
                n += len(new)
            i += 1
            if n >= k and i < len(codes) and 2 * rest[i] ** 2 < rest[0] ** 2:
                if len(seen) > 1:
                    seen = [np.concatenate(seen)]
                kth = np.partition(self.partial[seen[0]], n - k)[n - k]
        seen = np.concatenate(seen)
        partial = self.partial[seen]
        self.partial[seen] = 0.0
        if n > k:
            least = np.partition(partial, n - k)[n - k]
            seen = seen[partial + rest[i] + SLACK >= least]
        self.dense[codes] = weights
        scores = np.round(self.scores(seen), DIGITS)
        self.dense[codes] = 0.0
        first = np.lexsort((seen, -scores))[:k]
        return seen[first], scores[first]


def best_of_tile(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, queries: pa.Table, targets: pa.Table) -> pa.Table:
        """The best of a tile; what it took goes back to the system, as a worker may wait long beside other stages."""
        found = best(key, queries, targets)
        pa.default_memory_pool().release_unused()
        return found

    def best(key: tuple, queries: pa.Table, targets: pa.Table) -> pa.Table:
        """queries: entity_id, norm, terms. targets: rows with ids and terms, and rows with lists of their words and idf."""
        is_list = targets["words"].is_valid()
        listed, targets = targets.filter(is_list), targets.filter(pc.invert(is_list))
        words, idf = flat(listed["words"])[1], flat(listed["idf"])[1].to_numpy()
        if not queries.num_rows or not targets.num_rows or not len(words):
            return RESULT.empty_table()
        words = pa.concat_arrays(words.chunks)
        targets = targets.take(pc.sort_indices(pc.list_element(targets["ids"], 0)))
        t_starts, t_codes, t_weights = weighed(targets["terms"], words, idf)
        lengths = np.sqrt(np.bincount(np.repeat(np.arange(targets.num_rows), np.diff(t_starts)), weights=t_weights * t_weights, minlength=targets.num_rows))
        postings = Postings(t_codes, t_weights / np.repeat(lengths, np.diff(t_starts)), t_starts, len(words))
        q_starts, q_codes, q_weights = weighed(queries["terms"], words, idf)
        q_weights = q_weights / np.repeat(queries["norm"].to_numpy(), np.diff(q_starts))
        id_sizes, ids = flat(targets["ids"])
        id_starts, ids = np.concatenate(([0], np.cumsum(id_sizes))), pa.concat_arrays(ids.chunks)
        owner, at, score = [], [], []
        for i in range(queries.num_rows):
            rows, scores = postings.best(q_codes[q_starts[i] : q_starts[i + 1]], q_weights[q_starts[i] : q_starts[i + 1]], k)
            rows, scores = rows[scores > 0], scores[scores > 0]
            if len(rows):
                owner.append(np.full(len(rows), i))
                at.append(rows)
                score.append(scores)
        if not owner:
            return RESULT.empty_table()
        owner, at, score = np.concatenate(owner), np.concatenate(at), np.concatenate(score)
        n = id_starts[at + 1] - id_starts[at]
        members = np.arange(n.sum()) + np.repeat(id_starts[at] - (np.cumsum(n) - n), n)
        found = pa.table({"candidate_source": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(members)), "entity_id": queries["entity_id"].take(pa.array(np.repeat(owner, n))), "entity_id_cand": ids.take(pa.array(members)), "score": np.repeat(score, n)})
        return found.cast(RESULT)

    return run
