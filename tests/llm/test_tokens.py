import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinspan.llm import packing, token_files, tokens

ODD = [None, "a  b c", "a  b c ", " lead", "x \n y", "l1\nl2 w", "\x01 z \x01", "", " ", "a", "  two  spaces\n\n\tx's it's don't ", "é́ ΑΣ ς x y \x1c z", "0123 45 ,,, !!", "naïve " * 900, "x" * 3000, "a", "tab\tand\x0bvt \x0cff\r\ncr", "hello <|endoftext|> world<|startoftext|><| x"]


def plain(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def joined(texts):
    raw = [(x or "").encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)


def test_units_give_the_ids_of_the_text():
    for name, kind in (("byte_bpe_50k.json", tokens.BYTE_LEVEL), ("word_bpe_49k.json", tokens.WORD_LEVEL)):
        ids, at = tokens.encoder(public_tokenizers.path(name), kind).encode(*joined(ODD))
        assert [ids[a:b].tolist() + [9] for a, b in zip(at[:-1], at[1:])] == plain(name, ODD, 9)


def test_units_of_random_texts(monkeypatch):
    """Every pair and triple of kinds of characters, with a cache that is forgotten all the time."""
    rng = random.Random(4)
    letters = ["a", "b", "Z", "é", "×", "÷", "Σ", "7", "4", "'", "'s", "'ll", ".", "&&", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "\x85", "\x1c", "\x01", "\u0301", "世", "🙂", "<|", "<|endoftext|>", "word", " the"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    texts.append("".join(rng.choice(letters) for _ in range(30_000)))
    monkeypatch.setattr(tokens, "CACHE_UNITS", 1000)
    monkeypatch.setattr(tokens, "MOST_UNITS", 700)
    for name, kind in (("byte_bpe_50k.json", tokens.BYTE_LEVEL), ("word_bpe_49k.json", tokens.WORD_LEVEL)):
        codes = tokens.UnitEncoder(public_tokenizers.path(name), kind)
        for a in range(0, len(texts), 1500):
            part = texts[a : a + 1500]
            ids, at = codes.encode(*joined(part))
            want = plain(name, part, 9)
            for i, own in enumerate(want):
                assert ids[at[i] : at[i + 1]].tolist() + [9] == own, (name, part[i])


def test_units_with_equal_hashes(monkeypatch):
    monkeypatch.setattr(tokens.textcore, "span_hash", lambda c, a, b: (b - a).astype(np.uint64))
    codes = tokens.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"), tokens.BYTE_LEVEL)
    texts = ["one two six", "ten", "abc two", "x", ""]
    for _ in range(2):
        ids, at = codes.encode(*joined(texts))
        assert [ids[a:b].tolist() + [9] for a, b in zip(at[:-1], at[1:])] == plain("byte_bpe_50k.json", texts, 9)


def test_ids_that_need_more_bits_are_an_error():
    with pytest.raises(ValueError):
        token_files.pack(np.array([3, 4096], np.uint32), 12)


def test_bit_packing_round_trip_and_random_access():
    ids = np.arange(1000, dtype=np.uint32) * 7 % 4000
    for bits in (12, 13, 16, 17, 32):
        blob = token_files.pack(ids, bits)
        assert len(blob) == -(-1000 * bits // 8)
        assert (token_files.unpack(blob, bits, 0, 1000) == ids).all()
        assert (token_files.unpack(blob, bits, 333, 577) == ids[333:577]).all()
    assert token_files.id_bits(49_408) == 16


def rows(spark):
    data = [(i * 3, x, "extra") for i, x in enumerate(ODD)] + [(None, "null id", "e"), (3, "again", "e")]
    return data, spark.createDataFrame(data, "doc_id long, text string, length string")


def test_token_files(spark):
    data, df = rows(spark)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for (k, _, _), ids in zip(order, plain("word_bpe_49k.json", [r[1] for r in order], 1)):
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.op7_token_files(spark, df, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.op7_token_files(spark, df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing(spark):
    data, df = rows(spark)
    got = packing.op6_best_fit_packing(spark, df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = []
    for (k, _, _), ids in zip(data, plain("byte_bpe_50k.json", [r[1] for r in data], 2)):
        at = 0
        for n, size in enumerate(packing.cut_lengths(len(ids), 1024)):
            want.append((k, n, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at += size
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[4])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 1024)


def check_sequences(placed, capacity):
    by = defaultdict(list)
    for s, o, n in placed:
        by[s].append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_plan_is_gapless_and_close_to_the_bound():
    rng = np.random.default_rng(5)
    for trial in range(30):
        sizes = rng.integers(1, 65 if trial % 2 else 30, 400)
        counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
        runs, bins = packing.plan_bins(counts, 64)
        placed = [(b + i, o, s) for s, _, n, b, o in runs for i in range(n)]
        assert len(placed) == 400
        for s, n in counts.items():
            ranks = sorted(r for size, r0, k, _, _ in runs if size == s for r in range(r0, r0 + k))
            assert ranks == list(range(n))
        assert check_sequences(placed, 64) == bins
        assert bins <= -(-sum(sizes) // 64) * 1.2 + 3
