"""Removing byte strings that occur more than once, corpus-wide and exact.

A byte goes if a ``LENGTH``-byte string (a window) covers it that also starts
anywhere else. Equal windows are neighbours in suffix order, so windows are
sorted as suffixes; no task may see all suffixes, so they are dealt out first.

1. The window at each position has an anchor: its ``GRAM``-byte string with the
   least hash, the leftmost of equals. Neighbouring windows with one anchor form
   a run. Equal windows have equal anchors at the same place, so they stand in
   runs of the same anchor, and the anchor deals runs to tasks.
2. Runs are counted by anchor and bytes. Equal runs are repeated whole. Runs
   that share only their anchor may share some windows: one of each kind goes on.
3. A task lays the runs of an anchor over one another at the anchor and cuts them
   into symbols, at the places where any of them part: bytes that no two runs
   tell apart are one symbol. The suffix array of the symbols (linear grouping,
   :mod:`kinspan.llm.suffix_arrays`) has the suffixes in order; the longest
   prefix that a suffix shares with its neighbours, in bytes, says which windows
   that begin in its first symbol begin elsewhere too.
4. Each document drops the bytes under its repeated windows.

Anchors of more than ``CROWD`` kinds of runs (a common line, say) would make one
large task. Their runs are cut at fixed distances from the anchor into ``PARTS``
shorter ones, whose anchor is all that their windows have in common, and go
through steps 2 and 3 again. In the end a run is one window and its own anchor,
which leaves nothing to sort.

Runs are counted by the hash of the anchor and a hash of all their bytes by
another base and other keys, 64 bits each.

Cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing; rows
are told apart by doc_id and text, so repeated rows are copies of each other and
lose what copies lose; a null doc_id is a row like others; an empty table gives
no rows; matches never cross documents, and overlapping ones count; a document
of any size is read whole, in steps of ``CHUNK_WINDOWS`` windows; columns other
than doc_id and text pass through :func:`without_repeats` under any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm import textcore
from kinspan.llm.fingerprints import NULL_KEY
from kinspan.llm.staging import dropped, files_for, staged
from kinspan.llm.suffix_arrays import longest_repeats

LENGTH = 200
GRAM = 50
CHUNK_WINDOWS = 1 << 19
CROWD = 256
PARTS = 4
SORTED_RUNS = 512  # sorted together, at least; the runs of one anchor stay together
SYMBOLS = 30_000  # in one suffix array, at least; likewise
RUNS = "key long, text_hash long, starts array<int>, windows int, lead int, anchor long, symbol long, copies int, leads boolean"
_POSITION = np.uint64((1 << 20) - 1)


def anchor_runs(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK_WINDOWS) -> tuple[np.ndarray, ...]:
    """(row, start within the row, windows, bytes before the anchor, anchor, symbol) of every run of the rows' windows, in order."""
    parts = []
    n = len(data)
    ends = np.repeat(offs[1:], np.diff(offs))
    for a in range(0, max(0, n - length + 1), chunk):
        b = min(a + chunk, n - length + 1)
        text = data[a : b + length - 1]
        c = textcore.prefix_hash(text)
        grams = textcore.span_hash(c, np.arange(len(text) - gram + 1), np.arange(gram, len(text) + 1))
        keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_least(keys, length - gram + 1)
        del keys, c
        valid = np.arange(a, b) + length <= ends[a:b]
        at = (least & _POSITION).astype(np.int64)
        opens = np.empty(b - a, bool)
        opens[0] = True
        opens[1:] = (at[1:] != at[:-1]) | (ends[a + 1 : b] != ends[a : b - 1])
        first = np.flatnonzero(opens & valid)
        if not len(first):
            continue
        stops = np.flatnonzero(np.append(opens, True) | np.append(~valid, True))
        last = stops[np.searchsorted(stops, first, side="right")]
        symbol = textcore.span_hash(textcore.prefix_hash(text, True), first, last - 1 + length, True)
        row = np.searchsorted(offs, first + a, side="right") - 1
        parts.append((row, first + a - offs[row], last - first, at[first] - first, grams[at[first]], symbol))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima of blocks."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    square = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(square, axis=1).reshape(-1)
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def find_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Every different run of a document, with all its places, and the number of equal runs in its block; ``leads`` marks one document of the block."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in textcore.slabs(batches, "text"):
            row, start, windows, lead, anchor, symbol = anchor_runs(data, offs, length, gram)
            if not len(row):
                continue
            _, kind, copies = np.unique(symbol, return_inverse=True, return_counts=True)
            _, one, group, times = np.unique(row * len(copies) + kind, return_index=True, return_inverse=True, return_counts=True)
            places = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(times)), pa.int32()), pa.array(start[np.argsort(group, kind="stable")].astype(np.int32)))
            leads = np.zeros(len(one), bool)
            leads[np.unique(kind[one], return_index=True)[1]] = True
            keys, hashes = (rows.column(c).to_numpy() for c in ("key", "text_hash"))
            columns = [pa.array(keys[row[one]]), pa.array(hashes[row[one]]), places, *(pa.array(x[one].astype(np.int32)) for x in (windows, lead)), signed(anchor[one]), signed(symbol[one]), pa.array(copies[kind[one]].astype(np.int32)), pa.array(leads)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RUNS.split(", ")])

    return texts.mapInArrow(runs, RUNS)


def listed_runs(rows: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The runs listed in the rows, and the row of each."""
    lists = rows.column("runs")
    return lists.flatten(), np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())


BODIES = "anchor long, key long, text_hash long, start int, lead int, alone boolean, crowded boolean, body binary"
PARTS_OF_RUNS = "anchor long, symbol long, key long, text_hash long, start int, lead int, alone boolean, body binary"


def binaries(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The spans of ``data`` as binary values."""
    edges = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(data[textcore.ragged(starts, sizes)])])


def run_bodies(docs_with_runs: DataFrame, length: int) -> DataFrame:
    """A row per listed run with its bytes."""

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in textcore.slabs(batches, "text"):
            flat, row = listed_runs(rows)
            begin = flat.field("start").to_numpy() + offs[row]
            size = flat.field("windows").to_numpy().astype(np.int64) - 1 + length
            for a in range(0, len(row), 4096):
                r = slice(a, a + 4096)
                part = flat.slice(a, 4096)
                anchor, start, lead, alone, crowded = (part.field(c) for c in ("anchor", "start", "lead", "alone", "crowded"))
                keys = (rows.column(c).take(pa.array(row[r])) for c in ("key", "text_hash"))
                yield pa.RecordBatch.from_arrays([anchor, *keys, start, lead, alone, crowded, binaries(data, begin[r], size[r])], names=[x.split()[0] for x in BODIES.split(", ")])

    return docs_with_runs.mapInArrow(bodies, BODIES)


def split_runs(bodies: DataFrame, width: int, length: int) -> DataFrame:
    """The runs, cut where their windows' distance to the anchor is a multiple of ``width``.

    What all windows of a part have in common, with the old anchor and the
    part's number, is the new anchor: equal windows still meet.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 2048) for a in range(0, len(whole), 2048)):
                texts = batch.column("body")
                size = pc.binary_length(texts).to_numpy().astype(np.int64)
                data, first = np.frombuffer(b"".join(texts.to_pylist()), np.uint8), np.cumsum(size) - size
                start, lead = (batch.column(c).to_numpy().astype(np.int64) for c in ("start", "lead"))
                windows = size - length + 1
                low = (lead - windows + 1) // width
                n = lead // width - low + 1
                run = np.repeat(np.arange(len(batch)), n)
                part = textcore.ragged(low, n)
                far = np.minimum(lead[run], (part + 1) * width - 1)
                near = np.maximum(lead[run] - windows[run] + 1, part * width)
                at = first[run] + lead[run]  # the old anchor
                core = textcore.span_hash(textcore.prefix_hash(data), at - part * width, at - (part + 1) * width + 1 + length)
                symbol = textcore.span_hash(textcore.prefix_hash(data, True), at - far, at - near + length, True)
                old = batch.column("anchor").to_numpy().view(np.uint64)[run]
                with np.errstate(over="ignore"):
                    anchor = textcore.mix(core ^ textcore.mix(old + part.astype(np.uint64)))
                keys = (batch.column(c).take(pa.array(run)) for c in ("key", "text_hash"))
                places = (pa.array(x.astype(np.int32)) for x in (start[run] + lead[run] - far, far - part * width))
                yield pa.RecordBatch.from_arrays([signed(anchor), signed(symbol), *keys, *places, batch.column("alone").take(pa.array(run)), binaries(data, at - far, far - near + length)], names=[x.split()[0] for x in PARTS_OF_RUNS.split(", ")])

    return bodies.select("anchor", "key", "text_hash", "start", "lead", "alone", "body").mapInArrow(parts, PARTS_OF_RUNS)


def partings(group: np.ndarray, outward: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How runs part, read from the anchor outwards.

    ``outward`` has the bytes of each run from the anchor on, ``sizes`` how many
    they are. Returns, for each run and column, the class of runs of its group
    that equal it up to that column (-1 where it equals no other); how many
    columns each run shares with any other; and for each group and column
    whether runs part before that column.
    """
    n, width = outward.shape
    classes = np.full((n, width), -1, np.int32)
    shared = np.zeros(n, np.int64)
    cuts = np.zeros((int(group[-1]) + 1, width + 1), bool)
    active, own = np.arange(n), group.astype(np.int64)
    for column in range(width):
        going = sizes[active] > column
        cuts[group[active[~going]], column] = True
        active, own = active[going], own[going]
        if not len(active):
            break
        _, new, times = np.unique(own << 8 | outward[active, column], return_inverse=True, return_counts=True)
        kinds = np.zeros(int(own.max()) + 1, np.int64)
        firsts = np.zeros(len(times), np.int64)
        firsts[new] = own
        np.add.at(kinds, firsts, 1)
        cuts[group[active[kinds[own] > 1]], column] = True
        stays = times[new] > 1
        active, own = active[stays], new[stays].astype(np.int64)
        classes[active, column] = own
        shared[active] = column + 1
    cuts[group[active], width] = True
    return classes, shared, cuts


def repeated_in_runs(group: np.ndarray, lead: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first byte, windows) of the windows that another run of the same group has too. Runs of a group stand together and share their anchor."""
    n = len(bodies)
    sizes = np.array([len(b) for b in bodies])
    flat, first = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(sizes) - sizes

    def side(at: np.ndarray, count: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros((n, int(count.max(initial=0))), np.uint8)
        row = np.repeat(np.arange(n), count)
        column = textcore.ragged(np.zeros(n, np.int64), count)
        out[row, column] = flat[at[row] + step * column]
        return out

    left_class, left, left_cuts = partings(group, side(first + lead - 1, lead, -1), lead)
    right_class, right, right_cuts = partings(group, side(first + lead, sizes - lead, 1), sizes - lead)
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    symbols, offsets, spans, runs = [], [], [], []
    held = 0

    def sort() -> None:
        common = np.concatenate(longest_repeats(symbols, spans))
        run, offset, span = (np.concatenate(x) for x in (runs, offsets, spans))
        fitting = np.minimum(np.where(offset == 0, 1, span), common - length + 1)
        hit = (offset <= 0) & (fitting > 0)
        found.append((run[hit], lead[run[hit]] + offset[hit], fitting[hit]))

    last = -1
    for i in np.flatnonzero(left + right >= length):
        if held >= SYMBOLS and group[i] != last:
            sort()
            symbols, offsets, spans, runs, held = [], [], [], [], 0
        last = group[i]
        ends = np.flatnonzero(left_cuts[last, : left[i] + 1])
        ends = ends[ends > 0][::-1]
        begins = np.flatnonzero(right_cuts[last, : right[i] + 1])
        begins = begins[begins > 0]
        symbols.append(np.concatenate([2 * (left_class[i, ends - 1].astype(np.int64) * 512 + ends), 2 * (right_class[i, begins - 1].astype(np.int64) * 512 + begins) + 1]))
        places = np.concatenate([-ends, [0], begins])
        offsets.append(places[:-1])
        spans.append(np.diff(places))
        runs.append(np.full(len(symbols[-1]), i))
        held += len(symbols[-1])
    if symbols:
        sort()
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shared_windows(bodies: DataFrame, length: int) -> DataFrame:
    """Where the windows begin that a run alone of its kind shares with another run of its anchor."""
    out = "key long, text_hash long, starts array<int>, windows int"

    def batch(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        group = np.cumsum(np.append(0, np.diff(rows["anchor"].to_numpy()) != 0))
        run, byte, count = repeated_in_runs(group, rows["lead"].to_numpy().astype(np.int64), rows["body"].to_pylist(), length)
        alone = rows["alone"].to_numpy()[run]
        run, byte, count = run[alone], byte[alone], count[alone]
        starts = pa.ListArray.from_arrays(pa.array(np.arange(len(run) + 1), pa.int32()), pa.array((rows["start"].to_numpy()[run] + byte).astype(np.int32)))
        keys = [pa.array(rows[c].to_numpy()[run]) for c in ("key", "text_hash")]
        return pa.RecordBatch.from_arrays([*keys, starts, pa.array(count.astype(np.int32))], names=["key", "text_hash", "starts", "windows"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for rows in batches:
            anchors = rows.column("anchor").to_numpy()
            opens = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])).tolist() if len(anchors) else []
            a = 0
            for b in opens:
                new = b > 0 or not held or held[-1].column("anchor")[-1].as_py() != int(anchors[0])
                if new and size + b - a >= SORTED_RUNS:
                    held += [rows.slice(a, b - a)] if b > a else []
                    yield batch(held)
                    held, size, a = [], 0, b
            if a < len(rows):
                held.append(rows.slice(a))
                size += len(rows) - a
        if held:
            yield batch(held)

    return bodies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, out)


def mixed_anchors(kinds: DataFrame, crowd: int) -> DataFrame:
    """The anchors of several kinds of runs, one of them alone; ``crowded`` marks those of more than ``crowd``."""
    counts = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("alone").alias("any")).where((F.col("kinds") > 1) & F.col("any"))
    return counts.select("anchor", (F.col("kinds") > crowd).alias("crowded"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(key, text_hash, spans): where the repeated windows of each document that has any begin, and how many follow in a row."""
    return spans_and_files(docs, length, gram, crowd)[0]


def spans_and_files(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> tuple[DataFrame, int]:
    """:func:`repeated_spans`, and how many files a result with a row for each document is worth."""
    texts = keyed(docs)
    runs = staged(find_runs(texts, length, gram), "runs")
    anchors = runs.where("leads").groupBy("anchor").agg(F.sum("copies").alias("n")).where(F.col("n") > 1).select("anchor")
    files = files_for(runs)
    shared = staged(runs.join(anchors.hint("shuffle_hash"), "anchor"), "shared-runs", files)
    dropped(runs)
    one = F.min(F.struct("key", "text_hash", F.get("starts", 0).alias("start"), "windows", "lead")).alias("one")
    kinds = shared.where("leads").groupBy("anchor", "symbol").agg(F.sum("copies").alias("n"), one)
    kinds = staged(kinds.withColumn("alone", F.col("n") == 1), "kinds", files_for(shared))
    whole = shared.join(kinds.where(F.col("n") > 1).select("anchor", "symbol").hint("shuffle_hash"), ["anchor", "symbol"])
    parts = [whole.select("key", "text_hash", "starts", "windows")]
    listed = kinds.join(mixed_anchors(kinds, crowd), "anchor").groupBy("one.key", "one.text_hash").agg(F.collect_list(F.struct("one.start", "one.windows", "one.lead", "anchor", "alone", "crowded")).alias("runs"))
    bodies = staged(run_bodies(texts.join(listed, ["key", "text_hash"]).select("key", "text_hash", "text", "runs"), length), "bodies", files)
    done = [shared, kinds]
    width = length - gram + 1
    while True:
        parts.append(staged(shared_windows(bodies.where(~F.col("crowded")), length), "shared-windows", files_for(bodies)))
        done.append(parts[-1])
        large = bodies.where("crowded")
        if large.isEmpty():
            dropped(bodies)
            break
        width = -(-width // PARTS)
        cut = staged(split_runs(large, width, length), "parts-of-runs", files_for(bodies))
        dropped(bodies)
        kinds = cut.groupBy("anchor", "symbol").agg(F.count("*").alias("n"), F.max("alone").alias("any"), F.min(F.struct("key", "text_hash", "start", "lead", "body")).alias("one"))
        kinds = staged(kinds.withColumn("alone", F.col("any") & (F.col("n") == 1)), "kinds", files_for(cut))
        equal = kinds.where((F.col("n") > 1) & F.col("any")).select("anchor", "symbol")
        parts.append(cut.where("alone").join(equal.hint("shuffle_hash"), ["anchor", "symbol"]).select("key", "text_hash", F.array("start").alias("starts"), (F.length("body") - (length - 1)).alias("windows")))
        met = kinds.join(mixed_anchors(kinds, crowd), "anchor")
        bodies = staged(met.select("anchor", "one.key", "one.text_hash", "one.start", "one.lead", "alone", "crowded", "one.body"), "bodies", files_for(kinds))
        done += [cut, kinds]
    spans = staged(reduce(DataFrame.union, parts).groupBy("key", "text_hash").agg(F.collect_list(F.struct("starts", "windows")).alias("spans")), "spans", files_for(*done))
    for table in done:
        dropped(table)
    return spans, files


def removed_mask(size: int, spans: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which bytes lie under a window that begins in one of the spans."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, spans, 1)
    np.add.at(edges, np.minimum(spans + counts - 1 + length, size), -1)
    return np.cumsum(edges[:-1]) > 0


def span_arrays(spans: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Every place, and how many windows follow there."""
    starts = np.concatenate([np.asarray(x["starts"], np.int64) for x in spans])
    return starts, np.repeat([x["windows"] for x in spans], [len(x["starts"]) for x in spans])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, text, _spans): every row of ``docs`` as a struct, its text, and its spans (null where it has none)."""
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), F.xxhash64(text).alias("text_hash"))
    return named.join(spans.withColumnRenamed("spans", "_spans"), ["key", "text_hash"], "left").select("row", "text", "_spans")


def row_masks(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """Row number, bytes, and mask of removed bytes (None: nothing)."""
    spans = rows.column("_spans")
    for i in range(len(rows)):
        text = data[offs[i] : offs[i + 1]]
        own = spans[i].as_py()
        if own:
            yield i, text, removed_mask(len(text), *span_arrays(own), length)
        else:
            yield i, text, None


def op3_suffix_dedup(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in textcore.slabs(batches, "text"):
            out: list[list] = [[], [], []]
            for _, text, mask in row_masks(rows, data, offs, length):
                kept = text if mask is None else text[~mask]
                edges = 0 if mask is None else int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                for column, v in zip(out, (len(text) - len(kept), edges, hashlib.sha256(kept.tobytes()).hexdigest()), strict=True):
                    column.append(v)
            ids = rows.column("row").field("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offs)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans, files = spans_and_files(docs, length)
    rows = with_spans(docs.select("doc_id", "text"), spans)
    return rows.withColumn("row", F.struct("row.doc_id")).mapInArrow(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").coalesce(files)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes cut out of the texts, all other columns as they are.

    A character that would lose only some of its bytes keeps all of them.
    """
    fields = [f.name for f in docs.schema]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in textcore.slabs(batches, "text"):
            own = rows.column("row")
            texts = own.field("text").to_pylist()
            for i, text, mask in row_masks(rows, data, offs, length):
                if mask is not None:
                    inner = (text & 0xC0) == 0x80
                    letter = np.cumsum(~inner) - 1
                    whole = np.bincount(letter, weights=~mask, minlength=letter[-1] + 1) == 0
                    texts[i] = text[~whole[letter]].tobytes().decode("utf-8")
            columns = [pa.array(texts, own.type.field(c).type) if c == "text" else own.field(c) for c in fields]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    spans, files = spans_and_files(docs, length)
    return with_spans(docs, spans).mapInArrow(cut, docs.schema).coalesce(files)
