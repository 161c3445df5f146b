"""Plain reference results and a small corpus of awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import regex
import xxhash

from kinspan.llm import quality, textcore

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=60):
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, nulls, empties, a long text, repeated and null ids."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = say(60)
    texts = [say(rng.randint(1, 120)) for _ in range(n)]
    texts[3] = texts[2]
    texts[5] = texts[2]
    for k in (10, 11, 12, 13):
        words = texts[9].split()
        words[k % len(words)] = "changed"
        texts[k] = " ".join(words)
    for k in (20, 25, 30):
        texts[k] = say(30) + "\n" + passage + "\t" + say(25)
    texts[33] = "x" * 700
    texts[34] = "ab" * 400
    texts[35] = None
    texts[36] = ""
    texts[37] = " \n\t "
    texts[38] = "one two"
    texts[39] = "One TWO"
    texts[40] = say(5000)
    rows = [(2 * i + 1, t, "en", [None, "b", "a", "é", "z"][rng.choice((0, 1, 1, 1, 1, 2, 3, 4))], len(t or "")) for i, t in enumerate(texts)]
    rows.append((None, texts[9], "en", "b", 0))
    rows.append(rows[7])
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word_sets(text, n=5):
    words = [w for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(rows):
    sets = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            sets[r[0]].append(word_sets(r[1]))
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                links.append((a, b))
    return components(ids, links)


def repeats(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def spark_hash(value, seed=42):
    """xxhash64 of a string, a long, or the longs of a list."""
    if isinstance(value, str):
        return xxhash.xxh64_intdigest(value.encode(), seed)
    if isinstance(value, int):
        return xxhash.xxh64_intdigest(value.to_bytes(8, "little"), seed)
    for v in value:
        seed = spark_hash(v, seed)
    return seed


def term_set(text, bits=21):
    return sorted({spark_hash(w) & ((1 << bits) - 1) for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w})


def lexicon(texts, band=(0.0005, 0.03), least=(2.0, 16.0)):
    sets = [tuple(term_set(t)) for t in texts]
    df, kinds = Counter(c for s in sets for c in s), Counter(c for s in set(sets) for c in s)
    low, high, high_sets = max(least[0], len(sets) * band[0]), max(least[1], len(sets) * band[1]), max(least[1], len(set(sets)) * band[1])
    return {c for c in df if df[c] >= low and (df[c] <= high or kinds[c] <= high_sets)}


def fingerprint(text, held, families=8, levels=13):
    terms = term_set(text)
    kept = [c for c in terms if c in held]
    if len(kept) < len(terms) / 3:
        kept = terms
    if not kept:
        return "-"
    digest = lambda x: f"{spark_hash(x) & 0xFFFFFFFF:08X}" if x else ""
    out = [digest(kept)]
    for k in range(families):
        seeded = [xxhash.xxh64_intdigest(k.to_bytes(4, "little"), spark_hash(c)) & ((1 << 62) - 1) for c in kept]
        out += [digest([r for r in seeded if r < 1 << (62 - n)]) for n in range(1, levels + 1)]
    return "-".join(out)


def likeness(a, b, families=8, levels=13):
    if a == b:
        return 1.0
    if "-" in (a, b):
        return 0.0
    found = 0.0
    a, b = a.split("-"), b.split("-")
    for n in range(1, levels + 1):
        pairs = [(a[k * levels + n], b[k * levels + n]) for k in range(families)]
        pairs = [p for p in pairs if any(p)]
        if len(pairs) >= families // 2:
            found = sum(x == y for x, y in pairs) / len(pairs)
    return found


def gram_buckets(text):
    raw = " ".join(WORD.findall(text or "")).encode()
    words = [int(x) for x in textcore.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]]
    pairs = [int(textcore.gram_hashes(np.array(p, np.uint64), 2)[0]) for p in zip(words, words[1:])]
    return [x % quality.BUCKETS for x in words + pairs]


def gumbel(i, text):
    raw = (text or "").encode()
    at = int(textcore.span_hash(textcore.prefix_hash(np.frombuffer(raw, np.uint8)), np.array([0]), np.array([len(raw)]))[0])
    own = int(textcore.mix(np.array([(-1 if i is None else i) % 2**64], np.uint64))[0])
    u = int(textcore.mix(np.array([at ^ own], np.uint64))[0]) >> 11
    return -math.log(-math.log((u + 0.5) / 2**53))


def resampled(data, labels, share=None):
    """Of every (doc_id, text): its log weight, its key, and whether importance resampling takes it."""
    fitted = {i: xxhash.xxh64_intdigest((1).to_bytes(4, "little"), spark_hash(i)) % 2 == 0 for i in labels}
    grams = [gram_buckets(t) for _, t in data]
    raw, good = Counter(), Counter()
    for (i, _), own in zip(data, grams):
        raw.update(own)
        if fitted.get(i) and labels[i]:
            good.update(own)
    rate = sum(good.values()) / sum(raw.values())
    ratio = {g: math.log((good[g] + quality.PSEUDO) / (raw[g] * rate + quality.PSEUDO)) for g in raw}
    weight = [sum(ratio[g] for g in own) for own in grams]
    keys = [w + gumbel(i, t) for w, (i, t) in zip(weight, data)]
    if share is None:
        held = {i: max(w for w, (j, _) in zip(weight, data) if i == j) for i in labels if not fitted[i]}
        part = lambda k, cut: sum(held[i] >= cut for i in held if labels[i] == k) / sum(labels[i] == k for i in held)
        values = sorted(set(held.values()))
        cuts = [values[0]] + [(a + b) / 2 for a, b in zip(values, values[1:])]
        cut = max(cuts, key=lambda c: (round(part(1, c) - part(0, c), 12), -c))
        share = (sum(w >= cut for w in weight) / len(weight) - part(0, cut)) / (part(1, cut) - part(0, cut))
        share = min(1.0, max(0.0, share))
    limit = sorted(keys, reverse=True)[math.ceil(len(data) * share) - 1]
    return [(w, k, k >= limit) for w, k in zip(weight, keys)]
