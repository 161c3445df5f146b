"""Token ids of whole texts, with each distinct unit of text encoded once.

Both supported tokenizers split a text into pieces before they merge bytes, and
no piece spans certain points. Texts are cut at such points only, into units, so
the ids of the units joined are the ids of the text. The points stand between
two characters of known kinds (ASCII but for controls, and the letters À to ÿ):

* a white space after any other character; for the word-level tokenizer, which
  drops white space, any edge of one;
* a character after a single white space that is no space between two others;
* a letter after a digit or a mark, and the other way round, but nothing after
  an apostrophe, which may begin a contraction.

Units are found in the bytes of many texts at once and looked up by hash in a
table of this process, where their bytes are compared, too. Units not met before
are encoded many at a time, joined by marks that show in the ids.

The ids are those of the tokenizer's own call with ``add_special_tokens=False``:
a special-token string inside a text gives its special id. A text that could hold
one ("<|") is given to the tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np

from kinspan.llm import textcore
from kinspan.llm.textcore import ragged

BYTE_LEVEL = "byte"
WORD_LEVEL = "word"
CACHE_UNITS = 600_000
CACHE_BYTES = 24 << 20
MOST_UNITS = 200_000  # looked up at a time
LETTER, DIGIT, SIGN, APOSTROPHE, SPACE, BREAK = range(1, 7)
_MARKS = {BYTE_LEVEL: "\n", WORD_LEVEL: " \x01 "}
_kept: dict[tuple[str, str], UnitEncoder] = {}


def _kinds() -> np.ndarray:
    """The kind of each byte: 0 where it alone doesn't tell."""
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = SIGN
    for a, b, kind in (("A", "Z", LETTER), ("a", "z", LETTER), ("0", "9", DIGIT)):
        kinds[ord(a) : ord(b) + 1] = kind
    kinds[ord("'")] = APOSTROPHE
    kinds[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BREAK
    kinds[0x20] = SPACE
    kinds[0xC3] = LETTER  # leads À to ÿ; see kinds_of
    return kinds


KINDS = _kinds()


def _pairs(kind: str) -> np.ndarray:
    """Whether a unit may end between a byte of the first kind and one of the second: 2 if what stands before the first has to be looked at."""
    cut = np.zeros((7, 7), np.uint8)
    shown = (LETTER, DIGIT, SIGN, APOSTROPHE)
    for a in shown:
        cut[a, [SPACE, BREAK]] = 1
        cut[BREAK, a] = 2
    cut[LETTER, [DIGIT, SIGN, APOSTROPHE]] = 1
    cut[DIGIT, [LETTER, SIGN, APOSTROPHE]] = 1
    cut[SIGN, [LETTER, DIGIT]] = 1
    if kind == WORD_LEVEL:
        cut[[SPACE, BREAK], :] = 1
        cut[:, [SPACE, BREAK]] = 1
        cut[SPACE, SPACE] = cut[SPACE, BREAK] = cut[BREAK, SPACE] = cut[BREAK, BREAK] = 0
    return cut


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    kinds = KINDS[data]
    two = np.flatnonzero(data[:-1] == 0xC3)
    letter = (data[two + 1] != 0x97) & (data[two + 1] != 0xB7)
    kinds[two] = kinds[two + 1] = np.where(letter, LETTER, 0)
    return kinds


def encoder(path: str, kind: str) -> UnitEncoder:
    """The encoder of this process: a worker that takes a further task goes on with what it has learnt."""
    if (path, kind) not in _kept:
        _kept.clear()
        _kept[path, kind] = UnitEncoder(path, kind)
    return _kept[path, kind]


class HashTable:
    """Numbers by 64-bit hash, open addressing in two arrays."""

    def __init__(self, most: int) -> None:
        self.bits = max(4, (2 * most).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            own = self.keys[at]
            hit = own == hashes[left]
            out[left[hit]] = self.values[at[hit]]
            going = ~hit & (own != 0)
            left, at = left[going], (at[going] + 1) & (len(self.keys) - 1)
        return out

    def add(self, hashes: np.ndarray, first: int) -> None:
        """New, distinct hashes, numbered from ``first``."""
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[left[free]]
            own = self.keys[at] == hashes[left]
            self.values[at[own]] = first + left[own]
            left, at = left[~own], (at[~own] + 1) & (len(self.keys) - 1)


class Spans:
    """Arrays one after another in one that grows."""

    def __init__(self, kind: type, size: int) -> None:
        self.flat = np.zeros(size, kind)
        self.ends = np.zeros(1 << 16, np.int64)
        self.n = 0

    def start(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers > 0, self.ends[numbers - 1], 0)

    def used(self) -> int:
        return int(self.ends[self.n - 1]) if self.n else 0

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        used = self.used()
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : used + len(flat)] = flat
        self.ends[self.n : self.n + len(sizes)] = used + np.cumsum(sizes)
        self.n += len(sizes)


class UnitEncoder:
    """Encodes texts; keeps about ``CACHE_UNITS`` units of ``CACHE_BYTES`` bytes between calls."""

    def __init__(self, path: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        self.cuts = _pairs(kind)
        self.mark = self.tokenizer.encode(_MARKS[kind], add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.table = HashTable(CACHE_UNITS + MOST_UNITS)
        self.ids, self.bytes = Spans(np.uint32, 1 << 20), Spans(np.uint8, 1 << 21)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(got), np.array([len(x) for x in got], np.int64)

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, and how many each has."""
        mark = _MARKS[self.kind]
        if self.kind == BYTE_LEVEL:
            plain = np.array(["\n" not in u and not u[-1].isspace() and not u[:2].isspace() for u in units], bool)
        else:
            plain = np.array(["\x01" not in u for u in units], bool)
        sizes = np.zeros(len(units), np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(units)
        alone = np.flatnonzero(~plain)
        at = np.flatnonzero(plain)
        for a in range(0, len(at), 1000):
            part = at[a : a + 1000]
            joined = mark + mark.join([units[i] for i in part])
            ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, np.uint32)
            opens = np.flatnonzero(ids == self.mark[0])
            for m, x in enumerate(self.mark[1:], 1):
                opens = opens[ids[np.minimum(opens + m, len(ids) - 1)] == x]
            if len(opens) != len(part):
                alone = np.append(alone, part)
                continue
            ends = np.append(opens[1:], len(ids))
            for i, x, y in zip(part.tolist(), (opens + len(self.mark)).tolist(), ends.tolist()):
                out[i] = ids[x:y]
            sizes[part] = ends - opens - len(self.mark)
        if len(alone):
            flat, own = self._whole([units[i] for i in alone])
            for i, ids in zip(alone.tolist(), np.split(flat, np.cumsum(own)[:-1])):
                out[i] = ids
            sizes[alone] = own
        return np.concatenate(out), sizes

    def _units(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where units begin."""
        kinds = kinds_of(data)
        cut = np.zeros(len(data), np.uint8)
        cut[1:] = self.cuts[kinds[:-1], kinds[1:]]
        near = np.flatnonzero(cut == 2)
        near = near[near >= 2]
        before = kinds[near - 2]
        cut[near] = (before >= LETTER) & (before <= APOSTROPHE)
        cut[1:2] = cut[1:2] == 1
        cut[offs[:-1][offs[:-1] < len(data)]] = 1
        return np.flatnonzero(cut)

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of every unit in the table, new ones learnt; and units whose bytes are not those in the table."""
        if self.ids.n > CACHE_UNITS or self.bytes.used() > CACHE_BYTES:
            self._forget()
        data, start = data[start[0] : end], start - start[0]
        size = np.diff(np.append(start, len(data)))
        hashes = textcore.span_hash(textcore.prefix_hash(data), start, start + size)
        hashes[hashes == 0] = 1
        number = self.table.find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            found, one, group = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            blob = data.tobytes()
            units = [blob[a : a + k].decode("utf-8") for a, k in zip(start[one].tolist(), size[one].tolist(), strict=True)]
            first = self.ids.n
            self.ids.append(*self._encoded(units))
            self.bytes.append(data[ragged(start[one], size[one])], size[one])
            self.table.add(found, first)
            number[new] = first + group
        held = self.bytes.start(number)
        odd = self.bytes.ends[number] - held != size
        if not odd.any():
            there = np.arange(len(data)) + np.repeat(held - start, size)
            differs = np.flatnonzero(self.bytes.flat[there] != data)
            odd[np.searchsorted(start, differs, side="right") - 1] = True
        return number, odd

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts joined (uint32), and the offset of each text (n + 1 entries)."""
        n = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        low = textcore.LOWER[data] if self.kind == WORD_LEVEL else data
        start = self._units(low, offs)
        whole = np.zeros(n, bool)
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        whole[np.searchsorted(offs, special, side="right") - 1] = True
        flats, counts = [], []
        a = 0
        while a < len(start):
            b = min(a + MOST_UNITS, max(a + 1, int(np.searchsorted(start, start[a] + 2 * textcore.SLAB_BYTES))))
            number, odd = self._numbers(low, start[a:b], int(start[b]) if b < len(start) else len(low))
            begin = self.ids.start(number)
            counts.append(self.ids.ends[number] - begin)
            flats.append(self.ids.flat[ragged(begin, counts[-1])])
            whole[np.searchsorted(offs, start[a:b][odd], side="right") - 1] = True
            a = b
        ids = np.concatenate(flats)
        at = np.append(0, np.cumsum(np.concatenate(counts)))[np.searchsorted(start, offs)]
        if whole.any():
            rows = np.split(ids, at[1:-1])
            which = np.flatnonzero(whole).tolist()
            flat, own = self._whole([data[offs[i] : offs[i + 1]].tobytes().decode("utf-8") for i in which])
            for i, x in zip(which, np.split(flat, np.cumsum(own)[:-1]), strict=True):
                rows[i] = x
            ids, at = np.concatenate(rows), np.append(0, np.cumsum([len(x) for x in rows]))
        return ids, at


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    return np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
