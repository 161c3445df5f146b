"""Vectorised text primitives over Arrow batches.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes; the separators
are ASCII, so bytes and characters give the same words. Hashes are polynomial
prefix sums modulo 2**64 followed by a bit mixer: a function of the bytes
alone, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BASE_B = 0xD1342543DE82EF95
INVERSE_B = pow(BASE_B, -1, 1 << 64)
SLAB_BYTES = 1 << 19

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_KEYS = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
BYTE_KEYS_B = mix(np.arange(513, 769, dtype=U64) * U64(BASE_B))
_powers = {b: np.ones(1, U64) for b in (BASE, INVERSE, BASE_B, INVERSE_B)}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers[base]) < n:
        seq = np.full(max(n, SLAB_BYTES + 1024), base, dtype=U64)
        seq[0] = 1
        _powers[base] = np.multiply.accumulate(seq)
    return _powers[base][:n]


def prefix_hash(data: np.ndarray, second: bool = False) -> np.ndarray:
    """c with c[j] - c[i] = sum of key(data[t]) * base**t for i <= t < j; ``second`` takes other keys and another base."""
    c = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((BYTE_KEYS_B if second else BYTE_KEYS)[data] * powers(len(data), BASE_B if second else BASE), out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span, independent of where it stands."""
    shift = powers(len(c), INVERSE_B if second else INVERSE)[starts]
    return mix((c[ends] - c[starts]) * shift + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def slabs(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLAB_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row runs of at most ``limit`` text bytes (or one row): the rows, their bytes joined, and row offsets. Null texts are empty."""
    for batch in batches:
        col = batch.column(text).cast(pa.large_string()).fill_null("")
        n = len(col)
        if not n:
            continue
        if col.offset:
            col = pa.concat_arrays([col])
        offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
        raw = col.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
            b = min(b, n)
            yield batch.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            a = b


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (n + 1 entries). Words end where a row ends."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = IS_WORD[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offs[(offs > 0) & (offs < n)]
    before[edge] = False
    after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and row offsets into them."""
    starts, ends, first = words(data, offs)
    if not len(starts):
        return np.zeros(0, U64), first
    return span_hash(prefix_hash(data), starts, ends), first


SHINGLE_KEYS = [int(x) | 1 for x in mix(np.arange(11, 11 + 16, dtype=U64) * U64(BASE))]


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word (len(w) - n + 1 of them); rows are not told apart."""
    if len(w) < n:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.full(len(w) - n + 1, n, dtype=U64)
        for k in range(n):
            out += w[k : len(w) - n + 1 + k] * U64(SHINGLE_KEYS[k])
    return mix(out)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct n-word shingle hashes of its text, A-Z lower-cased; with fewer words the whole sequence is one shingle."""
    w, first = word_hashes(LOWER[data], offs)
    grams = gram_hashes(w, n)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(gram_hashes(w[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all spans [start, start + length), one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
