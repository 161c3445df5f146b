"""Token-ID binary output: fixed-width bit packing with block offsets.

Format. A token store is a folder of row-per-block container files in ascending
``doc_id`` order (nulls first, repeated ids by text). Each block holds whole
documents:

``shard``       number of the range of ids that the block belongs to
``block``       number within the shard
``shard_start`` ids of the shard before this block
``n_ids``       ids in this block
``bits``        width of an id: the fewest bits that hold the largest id
``doc_ids``     the block's documents, in order
``doc_ends``    for each document, the block's ids up to and with it
``payload``     the ids, most significant bit first, padded to whole bytes

Every id has the same width, so the id at position p of a block starts at bit
p * bits: numpy unpacks any span of a block at once, and a filter on the
offsets finds a document or a position without reading other blocks.

Cases: a null or empty text gives the end id alone; a document longer than a
block makes a longer block; an empty table gives a store without rows; only
``doc_id`` and ``text`` are read, so further columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.llm import textcore
from kinspan.llm.staging import new_path, written
from kinspan.llm.tokens import WORD_LEVEL, encoder, with_end

BLOCK_IDS = 65_536
STEP = 1 << 14  # ids packed or unpacked at a time; a multiple of 8, so steps end at whole bytes
STORE_SCHEMA = "shard int, block int, shard_start long, n_ids long, bits int, doc_ids array<long>, doc_ends array<long>, payload binary"


def id_bits(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def vocabulary_size(tokenizer: str) -> int:
    """Ids of the tokenizer, added tokens included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` bits each, most significant bit first. An id that needs more is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    out = []
    for a in range(0, len(ids), STEP):
        wide = np.unpackbits(ids[a : a + STEP].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
        out.append(np.packbits(wide[:, 32 - bits :].reshape(-1)).tobytes())
    return b"".join(out)


def unpack(payload, bits: int, start: int, stop: int) -> np.ndarray:
    """The ids at positions start .. stop - 1 of a packed block (bytes or a buffer)."""
    out = [np.zeros(0, np.uint32)]
    for a in range(start, stop, STEP):
        n = min(STEP, stop - a)
        first, skip = divmod(a * bits, 8)
        flat = np.unpackbits(np.frombuffer(payload, np.uint8, -(-(skip + n * bits) // 8), first))
        wide = np.zeros((n, 32), np.uint8)
        wide[:, 32 - bits :] = flat[skip : skip + n * bits].reshape(-1, bits)
        out.append(np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.uint32))
    return np.concatenate(out)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, kind: str = WORD_LEVEL) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the token store ``path``."""
    bits = id_bits(vocabulary)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes = encoder(tokenizer, kind)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())), ("payload", pa.binary())])
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # doc_ids, ids, numbers of ids
        size = 0

        def closed() -> pa.RecordBatch:
            ends = np.cumsum(np.concatenate([n for _, _, n in held]))
            payload = pack(np.concatenate([ids for _, ids, _ in held]), bits)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), x) for x in (pa.concat_arrays([k for k, _, _ in held]), pa.array(ends))]
            head = [pa.array([v], t.type) for v, t in zip((shard, block, before, int(ends[-1]), bits), schema, strict=False)]
            return pa.RecordBatch.from_arrays([*head, *lists, pa.array([payload], pa.binary())], schema=schema)

        for rows, data, offs in textcore.slabs(batches, "text"):
            keys = rows.column("doc_id").cast(pa.int64())
            ids, at = with_end(*codes.encode(data, offs), end_id)
            a = 0
            while a < len(rows):
                b = min(len(rows), int(np.searchsorted(at, at[a] + BLOCK_IDS - size)))
                held.append((keys.slice(a, b - a), ids[at[a] : at[b]], np.diff(at[a : b + 1])))
                size += int(at[b] - at[a])
                a = b
                if size >= BLOCK_IDS:
                    yield closed()
                    block, before, held, size = block + 1, before + size, [], 0
        if held:
            yield closed()

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written(rows.mapInArrow(blocks, STORE_SCHEMA), path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a store with ``start``, the ids of the whole store before each block.

    The sums over shards are a table with a row per shard, never per document.
    """
    blocks = spark.read.schema(STORE_SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def document_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the packed ids."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                bits, n_ids, start = (batch.column(c)[i].as_py() for c in ("bits", "n_ids", "start"))
                ends = np.append(0, batch.column("doc_ends")[i].values.to_numpy())
                blob = memoryview(unpack(batch.column("payload")[i].as_buffer(), bits, 0, n_ids).astype("<u4").view(np.uint8))
                crcs = [zlib.crc32(blob[a:b]) for a, b in zip((4 * ends[:-1]).tolist(), (4 * ends[1:]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(start + ends[:-1]), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("bits", "n_ids", "doc_ids", "doc_ends", "payload", "start").mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the store to the shared folder and reads every document back from it."""
    path = new_path(spark, "token-store")
    write_store(docs, path, tokenizer, end_id, vocabulary_size(tokenizer))
    return document_digests(read_store(spark, path))
