"""N-gram Jaccard join with prefix trees.

A text is the set of its 5-word shingles. Two sets link when their Jaccard
similarity is at least 80 / 100, that is when 9 |x & y| >= 4 (|x| + |y|).

All sets are ordered by one global order: shingles that are not frequent by
their hash, then the frequent ones, the rarer first. Linked sets share a shingle
among the first |x| - ceil(0.8 |x|) + 1 of each.

1. Equal sets become one class, so copies are never compared.
2. Each prefix shingle that two classes hold has a hub, the smallest class.
   Classes are tested against the hubs that they share enough of their prefix
   with; the components of those links are found. Big groups of near copies
   shrink to a few components in linear work.
3. Only classes of different components that still share a prefix shingle are
   left to compare; those whose places of a shared shingle, shared prefix
   shingles and remaining lengths cannot reach the bound are dropped. What this loses is nothing: a link
   inside a component changes no component.
4. Tests run in a prefix tree: a hub's partners, as ordered sequences, are
   sorted, so neighbours share their beginning. The tree is walked in that
   order, the overlap with the hub along a shared beginning is counted once,
   and a branch whose overlap and remaining lengths cannot reach the bound is
   cut.

Cases: null, empty and blank texts have empty sets and link with nothing; with
fewer than five words the whole sequence is one shingle; rows with one doc_id
are one document; rows without a doc_id have no links and a null component;
an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.llm import textcore
from kinspan.llm.components import connected_components
from kinspan.llm.staging import dropped, staged

WORDS = 5
HEAVY_LEAST = 8
MOST_HEAVY = 2_000_000
COUNT_EVERY = 2_000_000
HUB_PART = 128
TREE = 256
TOP = np.uint64(1 << 63)


class Order:
    """The global order: light shingles by hash, heavy ones after them by count. Keys are numbers in that order."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        ranks = np.lexsort((tokens, counts))
        by_token = np.argsort(tokens)
        place = np.empty(len(tokens), np.uint64)
        place[ranks] = np.arange(len(tokens), dtype=np.uint64)
        self.tokens, self.places = tokens[by_token], place[by_token]

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """The sorted keys of a set of shingle hashes."""
        out = shingles >> np.uint64(1)
        if len(self.tokens) and len(shingles):
            at = np.minimum(np.searchsorted(self.tokens, shingles), len(self.tokens) - 1)
            heavy = self.tokens[at] == shingles
            out = np.where(heavy, TOP | self.places[at], out)
        return np.unique(out)


def prefix_length(n: int) -> int:
    """How many first elements of a set of n hold one of every partner's first elements."""
    return n - -(-4 * n // 5) + 1 if n else 0


def frequent_shingles(docs: DataFrame) -> Order:
    """The order, from shingles that are frequent in some task's share of the documents.

    Tasks report what occurs in two of their different sets; the sums that reach
    ``HEAVY_LEAST`` make the list, at most the ``MOST_HEAVY`` greatest of them,
    whatever the corpus. Any order gives the same links; this one keeps frequent
    shingles out of the prefixes.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def report() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(list(held.values())), return_counts=True)
            many = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], names=["token", "n"])

        for _, data, offs in textcore.slabs(batches, "text"):
            for s in textcore.shingle_sets(data, offs, WORDS):
                if len(s):
                    mark = hash(s.tobytes())
                    if mark not in held:
                        held[mark] = s
                        size += len(s)
            if size > COUNT_EVERY:
                yield report()
                held.clear()
                size = 0
        if held:
            yield report()

    sums = docs.select("text").mapInArrow(local, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_LEAST)
    sums = staged(sums, "frequent")
    if sums.count() > MOST_HEAVY:
        sums = sums.orderBy(F.desc("n"), "token").limit(MOST_HEAVY)
    found = sums.toPandas()
    return Order(found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64))


SETS = "doc_id long, text_hash long, n_shingles long, mark_a long, mark_b long, prefix array<long>"


def with_text_hash(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def shingle_table(docs: DataFrame, order) -> DataFrame:
    """Set size, two hashes of the set, and its prefix, for every row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in textcore.slabs(batches, "text"):
            sizes, a, b, prefixes, ends = [], [], [], [], [0]
            for s in textcore.shingle_sets(data, offs, WORDS):
                keys = order.value.keys(s)
                sizes.append(len(s))
                with np.errstate(over="ignore"):
                    a.append(int(textcore.mix(s).sum(dtype=np.uint64)) if len(s) else 0)
                    b.append(int(textcore.mix(s ^ np.uint64(textcore.BASE)).sum(dtype=np.uint64)) if len(s) else 0)
                prefixes.append(keys[: prefix_length(len(keys))])
                ends.append(ends[-1] + len(prefixes[-1]))
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
            marks = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(sizes, pa.int64()), *marks, lists], names=[x.split()[0] for x in SETS.split(", ")])

    return with_text_hash(docs).mapInArrow(sets, SETS)


def tree_links(hub: np.ndarray, partners: list[np.ndarray]) -> np.ndarray:
    """Which partners link with the hub; all are sorted arrays of keys."""
    out = np.zeros(len(partners), bool)
    order = sorted(range(len(partners)), key=lambda i: partners[i].astype(">u8").tobytes())
    path = np.zeros(1, np.int64)  # overlap with the hub along the current branch, by depth
    before = np.zeros(0, np.uint64)
    for i in order:
        s = partners[i]
        n = min(len(before), len(s))
        differ = before[:n] != s[:n]
        depth = min(int(differ.argmax()) if differ.any() else n, len(path) - 1)
        need = -(-4 * (len(hub) + len(s)) // 9)
        rest = len(hub) - int(np.searchsorted(hub, s[depth - 1], side="right")) if depth else len(hub)
        if path[depth] + min(len(s) - depth, rest) < need:
            path, before = path[: depth + 1], s[:depth]
            continue
        tail = s[depth:]
        at = np.minimum(np.searchsorted(hub, tail), len(hub) - 1)
        path = np.concatenate([path[: depth + 1], path[depth] + np.cumsum(hub[at] == tail)])
        before = s
        out[i] = path[-1] >= need
    return out


def tested(pairs: DataFrame, classes: DataFrame, docs: DataFrame, order) -> DataFrame:
    """The (a, b) of ``pairs`` (ids of classes) that link.

    Hubs with many partners are split into parts, each with its own copy of the
    hub's text. Pairs meet texts in merge joins that share one exchange of the
    texts, at every size: what is shuffled grows in proportion.
    """
    own = classes.select("id", F.col("rep").alias("doc_id"), "text_hash")
    texts = with_text_hash(docs).where(F.col("doc_id").isNotNull())
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_PART).cast("int").alias("parts"))
    hubs = parts.join(own, F.col("b") == F.col("id")).hint("merge").join(texts, ["doc_id", "text_hash"]).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "text")
    spread = pairs.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a")
    partners = spread.join(own, F.col("a") == F.col("id")).hint("merge").join(texts, ["doc_id", "text_hash"]).select("b", "part", "a", "text")
    rows = hubs.union(partners).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hub, held, names = None, None, [], []

        def close() -> pa.RecordBatch:
            hit = np.zeros(len(held), bool)
            for h in hub or []:
                hit |= tree_links(h, held)
            got = np.array(names, np.int64)[hit]
            return pa.RecordBatch.from_arrays([pa.array(got), pa.array(np.full(len(got), current[0], np.int64))], names=["a", "b"])

        for rows_, data, offs in textcore.slabs(batches, "text"):
            sets = [order.value.keys(s) for s in textcore.shingle_sets(data, offs, WORDS)]
            for b, part, a, s in zip(rows_.column("b").to_pylist(), rows_.column("part").to_pylist(), rows_.column("a").to_pylist(), sets, strict=True):
                if (b, part) != current or len(held) >= TREE and a is not None:
                    if held:
                        yield close()
                    held, names = [], []
                    if (b, part) != current:
                        current, hub = (b, part), []
                if a is None:
                    hub.append(s)
                else:
                    held.append(s)
                    names.append(a)
        if held:
            yield close()

    return rows.mapInArrow(walk, "a long, b long")


def fits(n_a, n_b):
    """Sizes that allow a similarity of 0.8."""
    return 5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)


def reaches(shared, n_a, n_b):
    """Whether ``shared`` common prefix shingles and all that may follow reach the bound."""
    after = F.greatest(*[F.floor(n * 4 / 5 + 0.9) for n in (n_a, n_b)])
    return 9 * (shared + after) >= 4 * (n_a + n_b)


def classes_of(full: DataFrame) -> DataFrame:
    """A row for each different set: its marks and size, the smallest document that has it, and an id.

    The id is that document's, or for all but one of the sets that a repeated doc_id stands for, a hash.
    """
    classes = full.groupBy("mark_a", "mark_b", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    classes = classes.select("mark_a", "mark_b", "n_shingles", F.col("one.doc_id").alias("rep"), F.col("one.text_hash").alias("text_hash"))
    several = classes.groupBy("rep").agg(F.count("*").alias("n"), F.min("text_hash").alias("low")).where(F.col("n") > 1).select("rep", "low")
    other = F.col("low").isNotNull() & (F.col("text_hash") != F.col("low"))
    return classes.join(several, "rep", "left").select(F.when(other, F.xxhash64("rep", "text_hash")).otherwise(F.col("rep")).alias("id"), "rep", "text_hash", "mark_a", "mark_b", "n_shingles")


def classes_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The shingle table; the classes; (a, b) of linked classes, enough of them to know the groups."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(frequent_shingles(docs))
    table = staged(shingle_table(docs, order), "shingles")
    full = table.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = staged(classes_of(full), "classes")
    one = full.join(classes.select(F.col("id").alias("class"), F.col("rep").alias("doc_id"), "text_hash"), ["doc_id", "text_hash"])
    firsts = one.select(F.col("class").alias("rep"), F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    hubs = firsts.groupBy("token").agg(F.count("*").alias("holders"), F.min(F.struct("rep", "n")).alias("hub")).where(F.col("holders") > 1)
    shared = staged(firsts.join(hubs.select("token", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "token"), "prefixes")
    to_hubs = shared.where((F.col("rep") != F.col("hub")) & fits(F.col("n"), F.col("hub_n")))
    to_hubs = to_hubs.groupBy(F.col("rep").alias("a"), F.col("hub").alias("b"), "n", "hub_n").agg(F.count("*").alias("c")).where(reaches(F.col("c"), F.col("n"), F.col("hub_n")))
    links = staged(tested(staged(to_hubs.select("a", "b"), "hub-pairs"), classes, docs, order), "hub-links")
    near = connected_components(links)
    known = shared.select("token", "rep", "n", "pos").join(near.select(F.col("id").alias("rep"), "component"), "rep", "left").select("token", "rep", "n", "pos", F.coalesce("component", "rep").alias("part"))
    known = staged(known, "parted")
    dropped(shared)
    open_tokens = known.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where(F.col("low") != F.col("high")).select("token")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("pos")) - 1
    left = staged(known.join(open_tokens, "token").withColumns({"earlier": place, "open": F.count("*").over(Window.partitionBy("rep"))}), "open")
    dropped(known)
    x, y = (left.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "part", "pos", "earlier", "open")]) for s in "ab")
    # Common shingles before this one are open in both sets; this one and later ones are at most what follows in the shorter rest.
    most = F.least("earlier_a", "earlier_b") + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    able = fits(F.col("n_a"), F.col("n_b")) & (9 * most >= 4 * (F.col("n_a") + F.col("n_b"))) & reaches(F.least("open_a", "open_b"), F.col("n_a"), F.col("n_b"))
    cross = x.join(y, "token").where((F.col("rep_a") < F.col("rep_b")) & (F.col("part_a") != F.col("part_b")) & able)
    cross = cross.groupBy("rep_a", "rep_b", "n_a", "n_b").agg(F.count("*").alias("c")).where(reaches(F.col("c"), F.col("n_a"), F.col("n_b")))
    more = staged(tested(staged(cross.select(F.col("rep_b").alias("a"), F.col("rep_a").alias("b")), "cross-pairs"), classes, docs, order), "cross-links")
    dropped(left)
    order.destroy()
    return table, classes, links.union(more)


def with_groups(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Every class (marks and size) with ``low``, the smallest document of its group."""
    named = classes.join(connected_components(links), "id", "left").select("mark_a", "mark_b", "n_shingles", "rep", F.coalesce("component", "id").alias("component"))
    lows = named.groupBy("component").agg(F.min("rep").alias("low"))
    return named.join(lows, "component").select("mark_a", "mark_b", "n_shingles", "low")


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    table, classes, links = classes_and_links(docs)
    marks = ["mark_a", "mark_b", "n_shingles"]
    mine = table.join(classes.select(*marks, "id"), marks).where(F.col("doc_id").isNotNull()).select("doc_id", "id")
    several = mine.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where(F.col("a") != F.col("b")).select("doc_id", "a")
    same_document = several.join(mine, "doc_id").select("a", F.col("id").alias("b"))
    groups = with_groups(classes, links.union(same_document))
    rows = table.where(F.col("n_shingles") > 0).select("doc_id", *marks).join(groups, marks, "left").select("doc_id", "n_shingles", "low")
    lows = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("low").alias("low"))
    empty = table.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles").join(lows, "doc_id", "left")
    return rows.unionByName(empty).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return join_components(docs)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest that has a text of the group; rows without a doc_id or without words stay."""
    table, classes, links = classes_and_links(docs)
    marks = ["mark_a", "mark_b", "n_shingles"]
    gone = table.join(with_groups(classes, links), marks).where(F.col("doc_id") != F.col("low")).select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return rows.join(gone, ["doc_id", "text_hash"], "left_anti").select("row.*")
