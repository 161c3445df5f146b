"""Best-fit packing of documents into fixed-length sequences.

Documents become pieces of at most ``capacity`` tokens. Only the number of
pieces of each length matters for a packing, so the plan is made from that
histogram (at most ``capacity`` counts, whatever the corpus):

1. Large pieces, above a third of the capacity, pair at most twice per bin: the
   longest unpaired length is matched with the longest one that still fits.
2. Smaller pieces, longest first, go where they leave the least gap; where no
   gap is large enough, a new bin opens.

The plan is a list of runs "the k pieces of length s with ranks r.. go to bins
b.. at offset o". Pieces are numbered within their length by the task that
made them, so no task sees all pieces of a length, and look their run up.

Cases: null and empty texts give the end id alone; a text of any length is cut
into as many pieces as it needs; which of equally long pieces goes where is left
to the order of rows and changes no number of sequences; rows repeated or without
a doc_id are packed as rows of their own; an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.llm import textcore
from kinspan.llm.staging import staged
from kinspan.llm.textcore import ragged
from kinspan.llm.tokens import BYTE_LEVEL, encoder, with_end

PIECES = "batch_no long, rank_in_batch long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: full ones, but for a first that may be shorter."""
    if n <= capacity:
        return [n]
    rest = n % capacity
    return ([rest] if rest else []) + [capacity] * (n // capacity)


def cut_rows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, start, length) of the pieces of rows of these numbers of tokens, as :func:`cut_lengths` has them."""
    pieces = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), pieces)
    piece = ragged(np.zeros(len(sizes), np.int64), pieces)
    first = (sizes - (pieces - 1) * capacity)[row]
    return row, piece, np.where(piece > 0, first + (piece - 1) * capacity, 0), np.where(piece > 0, capacity, first)


def make_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, kind: str = BYTE_LEVEL) -> DataFrame:
    """A row per piece; rank_in_batch numbers the pieces of a length within a task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes = encoder(tokenizer, kind)
        number = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for rows, data, offs in textcore.slabs(batches, "text"):
            ids, at = with_end(*codes.encode(data, offs), end_id)
            row, piece, start, length = cut_rows(np.diff(at), capacity)
            order = np.argsort(length, kind="stable")
            by_size = length[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(by_size, by_size) + seen[by_size]
            seen += np.bincount(length, minlength=capacity + 1)
            blob, begin = memoryview(ids.astype("<u4").view(np.uint8)), (4 * (at[row] + start)).tolist()
            crcs = [zlib.crc32(blob[a : a + n]) for a, n in zip(begin, (4 * length).tolist(), strict=True)]
            keys = rows.column("doc_id").cast(pa.int64()).take(pa.array(row))
            columns = [pa.array(np.full(len(row), number)), pa.array(rank), keys, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first bin, offset) for ``counts`` pieces of each length, and the number of bins."""
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    left = {s: n for s, n in counts.items() if n}
    gaps: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def put(size: int, n: int, first_bin: int, offset: int) -> None:
        runs.append((size, used[size], n, first_bin, offset))
        used[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            other = next((t for t in reversed(large[: bisect.bisect_right(large, capacity - size)]) if left[t] and (t != size or left[t] > 1)), None)
            if other is None:
                n, room = left[size], capacity - size
                put(size, n, bins, 0)
            elif other == size:
                n, room = left[size] // 2, capacity - 2 * size
                put(size, n, bins, 0)
                put(size, n, bins, size)
            else:
                n, room = min(left[size], left[other]), capacity - size - other
                put(size, n, bins, 0)
                put(other, n, bins, size)
            gaps.setdefault(room, []).append((bins, n))
            bins += n
    rooms = sorted(gaps)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                n = max(1, left[size] // each)
                group = (bins, n)
                bins += n
                room = capacity
            else:
                room = rooms[at]
                group = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room]
                    rooms.pop(at)
            first, n = group
            if n > left[size]:
                gaps.setdefault(room, []).append((first + left[size], n - left[size]))
                if room not in rooms:
                    bisect.insort(rooms, room)
                n = left[size]
            put(size, n, first, capacity - room)
            if room - size not in gaps:
                bisect.insort(rooms, room - size)
            gaps.setdefault(room - size, []).append((first, n))
    return runs, bins


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, kind: str = BYTE_LEVEL) -> DataFrame:
    """Every piece with its sequence and offset."""
    pieces = staged(make_pieces(docs, tokenizer, end_id, capacity, kind), "pieces")
    per_batch = pieces.groupBy("length", "batch_no").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_batch.select("length", "batch_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_bins(counts, capacity)
    grouped: dict[int, list] = {}
    for r in sorted(runs):
        grouped.setdefault(r[0], []).append(r)
    by_size = {s: tuple(np.array([r[k] for r in rs], np.int64) for k in (1, 3, 4)) for s, rs in grouped.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                where = np.flatnonzero(size == s)
                firsts, bins, offs = by_size[int(s)]
                run = np.searchsorted(firsts, rank[where], side="right") - 1
                sequence[where] = bins[run] + rank[where] - firsts[run]
                offset[where] = offs[run]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    ranked = pieces.join(offsets, ["length", "batch_no"]).withColumn("rank", F.col("rank_base") + F.col("rank_in_batch"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(docs, tokenizer, end_id=2, capacity=1024)
