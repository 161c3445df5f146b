import hashlib
import math
import pickle
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspan.llm import chat, embedding_dedup, fingerprints, jaccard_join, mixing, quality, staging, suffix_arrays, suffix_dedup, textcore, toxicity
from kinspan.llm.components import connected_components
from tests.llm import brute


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], brute.SCHEMA + ", key int").repartition(5)


def test_word_hashes_and_shingles_follow_the_contract(rows):
    texts = [r[1] or "" for r in rows]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    starts, ends, first = textcore.words(data, offs)
    found = [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert found == [brute.WORD.findall(t) for t in texts]
    sets = textcore.shingle_sets(data, offs)
    for i, s in enumerate(sets):
        assert len(s) == len(brute.word_sets(texts[i]))
        for j in (0, 2, 9, 38):
            assert len(np.intersect1d(s, sets[j])) == len(brute.word_sets(texts[i]) & brute.word_sets(texts[j]))


def test_suffix_array_against_sorting():
    rng = random.Random(1)
    for trial in range(400):
        s = [rng.randint(1, rng.choice((1, 2, 3, 9))) for _ in range(rng.randint(1, 40))]
        assert suffix_arrays.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    text = np.frombuffer(b"abracadabra" * 30, np.uint8)
    order = suffix_arrays.suffix_array(text.astype(int) + 1)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tobytes())


def test_longest_repeats_by_suffix_order():
    rng = random.Random(2)
    for _ in range(200):
        data = [np.array([rng.randint(0, 2) for _ in range(rng.randint(0, 15))], np.int64) for _ in range(6)]
        width = [3, 1, 5]
        got = suffix_arrays.longest_repeats(data, [np.array([width[x] for x in r], np.int64) for r in data])
        seen = Counter(tuple(r[i:j]) for r in data for i in range(len(r)) for j in range(i + 1, len(r) + 1))
        for r, own in zip(data, got):
            assert own.tolist() == [max((sum(width[x] for x in r[i:j]) for j in range(i + 1, len(r) + 1) if seen[tuple(r[i:j])] > 1), default=0) for i in range(len(r))]


def test_windows_that_runs_of_an_anchor_share():
    rng = random.Random(3)
    for trial in range(60):
        length, gram = 24, 6
        anchor = bytes(rng.choice(b"ab") for _ in range(gram))
        group, lead, bodies = [], [], []
        for g in range(rng.randint(1, 4)):
            base = [bytes(rng.choice(b"xyz\x00") for _ in range(length - gram)) for _ in range(2)]
            for _ in range(rng.randint(1, 7)):
                sides = [bytearray(x) for x in base]
                for _ in range(rng.randint(0, 3)):
                    sides[rng.randint(0, 1)][rng.randrange(length - gram)] = rng.choice(b"xyz")
                a, b = rng.randint(0, length - gram), rng.randint(0, length - gram)
                if a + b < length - gram:
                    continue
                group.append(g)
                lead.append(a)
                bodies.append(bytes(sides[0][length - gram - a :]) + anchor + bytes(sides[1][:b]))
        if not group:
            continue
        group = np.unique(group, return_inverse=True)[1]
        seen = Counter((g, i - a, w) for g, a, t in zip(group, lead, bodies) for i in range(len(t) - length + 1) for w in [t[i : i + length]])
        want = {(k, i) for k, (g, a, t) in enumerate(zip(group, lead, bodies)) for i in range(min(a, len(t) - length) + 1) if seen[g, i - a, t[i : i + length]] > 1}
        run, byte, count = suffix_dedup.repeated_in_runs(np.array(group), np.array(lead), bodies, length)
        assert {(k, i) for k, a, n in zip(run.tolist(), byte.tolist(), count.tolist()) for i in range(a, a + n)} == want


@pytest.mark.parametrize("length,gram", [(200, 50), (40, 10)])
def test_suffix_dedup(spark, rows, docs, length, gram):
    spans = suffix_dedup.repeated_spans(docs, length, gram)
    assert spans.count() > 5
    want = brute.repeats([r[1] for r in rows], length)
    if length == 200:
        got = suffix_dedup.op3_suffix_dedup(spark, docs).collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[1:])
        assert sorted(map(tuple, got), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)
        assert suffix_dedup.op3_suffix_dedup(spark, docs.limit(0)).count() == 0
    else:
        joined = suffix_dedup.with_spans(docs.select("doc_id", "text"), spans).collect()
        for r in joined:
            size = len((r["text"] or "").encode())
            gone = 0
            if r["_spans"]:
                gone = int(suffix_dedup.removed_mask(size, *suffix_dedup.span_arrays(r["_spans"]), length).sum())
            assert any(gone == w[1] and size == w[0] for w in want)


def near_copies(n=40, seed=6):
    """Near copies in which windows at the edges of equal parts repeat, a common line in many contexts, a long text and clashing columns."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    base = [word() for _ in range(220)]
    line = " ".join(word() for _ in range(36))
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = word()
        out.append((i, " ".join(words), "k", 7))
    out += [(100 + i, f"{word()} {word()} {line} {word()} {word()}", "k", 7) for i in range(n)]
    out.append((500, " ".join(word() for _ in range(3000)) + " " + " ".join(base), "k", 7))
    return out


@pytest.mark.parametrize("crowd", [1024, 12, 1])
def test_suffix_dedup_of_near_copies(spark, crowd):
    data = near_copies()
    df = spark.createDataFrame(data, "doc_id long, text string, _key string, text_hash int").repartition(6)
    spans = suffix_dedup.repeated_spans(df, 200, 50, crowd)
    got = {r["row"]["doc_id"]: r for r in suffix_dedup.with_spans(df, spans).collect()}
    for (k, text, _, _), want in zip(data, brute.repeats([r[1] for r in data], 200)):
        found = got[k]["_spans"]
        assert (int(suffix_dedup.removed_mask(len(text), *suffix_dedup.span_arrays(found), 200).sum()) if found else 0) == want[1]
    if crowd == 1024:
        kept = suffix_dedup.without_repeats(df)
        assert kept.columns == df.columns and {(r["_key"], r["text_hash"]) for r in kept.collect()} == {("k", 7)}


def test_small_partitions_share_files(spark, monkeypatch, tmp_path):
    """Small tables go to few files however many shuffle partitions there are, and with the same results; a file for each core is left."""
    held, folders = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, []
    before = {k: spark.conf.get(k) for k in held}
    written = staging.written
    monkeypatch.setattr(staging, "written", lambda df, path: (written(df, path), folders.append(spark.read.parquet(path).inputFiles())))
    data = near_copies()
    df = spark.createDataFrame(data, "doc_id long, text string, _key string, text_hash int").repartition(6)
    most = 2 * spark.sparkContext.defaultParallelism
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        suffix_dedup.repeated_spans(df, 200, 50, 1)
        assert len(folders) > 10 and max(map(len, folders)) <= most < 64
        for made in (suffix_dedup.op3_suffix_dedup(spark, df), suffix_dedup.without_repeats(df)):
            made.write.parquet(out := str(tmp_path / str(len(made.columns))))
            assert len(spark.read.parquet(out).inputFiles()) <= most
            assert spark.read.parquet(out).count() == len(data)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in spark.read.parquet(str(tmp_path / "5")).collect()}
        assert got == {r[0]: w[:2] for r, w in zip(data, brute.repeats([r[1] for r in data], 200))}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    monkeypatch.setattr(staging, "LEAST_BYTES", 100)
    assert staging.files_for(spark.read.parquet(out)) > most


def test_repeats_need_the_suffix_order(spark, monkeypatch):
    """With suffixes out of order, windows that only parts of runs share are missed."""
    groups = [("x" * 40 + "anchor" + "y" * 60).encode(), ("z" * 20 + "x" * 20 + "anchor" + "y" * 60).encode(), ("w" * 40 + "anchor" + "y" * 60).encode()]
    args = np.zeros(3, np.int64), np.full(3, 40), groups, 70
    assert suffix_dedup.repeated_in_runs(*args)[2].sum() > 0
    right = suffix_arrays.suffix_array
    monkeypatch.setattr(suffix_arrays, "suffix_array", lambda s: np.sort(right(s)))
    assert suffix_dedup.repeated_in_runs(*args)[2].sum() == 0


def test_runs_across_the_steps_of_a_long_text():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    offs = np.array([0, 1500, 1500, 1600, 5000])
    whole, steps = (suffix_dedup.anchor_runs(data, offs, 200, 50, k) for k in (1 << 19, 700))
    for row, start, windows, lead, _, _ in zip(*steps):
        assert start + lead <= start + windows - 1 + 150 and 0 <= lead <= 150
    covered = [{(r, s + i) for r, s, w in zip(*x[:3]) for i in range(w)} for x in (whole, steps)]
    assert covered[0] == covered[1] == {(k, i) for k in range(4) for i in range(offs[k + 1] - offs[k] - 199)}


def test_texts_stay_valid_after_the_cut(spark, docs):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_jaccard_join(spark, rows, docs):
    want = brute.jaccard_components(rows)
    assert len(set(want.values())) < len(want) - 2
    got = jaccard_join.op5_ngram_jaccard_join(spark, docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
    sizes = {(r["doc_id"], r["n_shingles"]) for r in got}
    assert sizes == {(r[0], len(brute.word_sets(r[1]))) for r in rows}
    assert jaccard_join.op5_ngram_jaccard_join(spark, docs.limit(0)).count() == 0
    kept = jaccard_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, *want.values()}


def test_jaccard_join_of_repeated_doc_ids(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"{k}{rng.randint(0, 999)}" for _ in range(40)) for k in "abc")
    near_a = a + " more"
    data = [(3, a), (7, a), (7, b), (9, b)]
    got = jaccard_join.op5_ngram_jaccard_join(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(3, 3), (7, 3), (9, 3)} and len(got) == 4
    data += [(2, near_a), (3, c), (8, c), (3, None), (8, c + " and so on"), (None, a), (20, ""), (3, a)]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id long, text string, _gone int, text_hash string")
    got = jaccard_join.op5_ngram_jaccard_join(spark, df).collect()
    want = brute.jaccard_components(data)
    links = [(3, k) for k in (7, 8)] + [(7, 9)]
    want = brute.components(list(want), [*want.items(), *links])
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got) and len(got) == len(data)
    kept = jaccard_join.one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(2, near_a), (7, b), (3, c), (3, None), (None, a), (20, "")], key=str)


def test_jaccard_join_of_many_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
    data = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(80)] = f"v{rng.randint(0, 10**6)}"
        data.append((i, " ".join(words)))
    data += [(1000 + i, " ".join(f"u{rng.randint(0, 500)}" for _ in range(rng.randint(3, 60)))) for i in range(60)]
    rng.shuffle(data)
    got = jaccard_join.op5_ngram_jaccard_join(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()
    want = brute.jaccard_components(data)
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_tree_links_against_sets():
    rng = np.random.default_rng(4)
    pool = rng.integers(1, 2**62, 60).astype(np.uint64)
    hub = np.unique(pool[:40])
    partners = [np.unique(rng.permutation(pool)[: rng.integers(1, 60)]) if i % 2 else np.unique(np.concatenate([hub[rng.integers(0, 8) :], pool[40 : 40 + rng.integers(0, 9)]])) for i in range(120)]
    want = [9 * len(np.intersect1d(hub, p)) >= 4 * (len(hub) + len(p)) for p in partners]
    assert jaccard_join.tree_links(hub, partners).tolist() == want and any(want) and not all(want)


def test_connected_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    want = brute.components({x for p in links for x in p}, links)
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r["id"]: r["component"] for r in got} == {i: c for i, c in want.items() if i in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, rows, docs):
    got = mixing.op1_mixing(spark, docs).collect()
    assert len(got) == len(rows)
    size = {}
    for _, text, _, source, _ in rows:
        size[source] = size.get(source, 0) + len(brute.WORD.findall(text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, free = 1.5 * sum(size.values()), set(order)
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        over = 0.0
        for s in sorted(free, key=str):
            target[s] += left * weight[s] / total
        for s in list(free):
            if target[s] >= 2 * size[s]:
                over += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                free.discard(s)
        left = over
    taken = {}
    sources = {(r[0], len(brute.WORD.findall(r[1] or ""))): r[3] for r in rows}
    for r in got:
        s = sources[r["doc_id"], r["size"]]
        assert math.isclose(r["target"], target[s], rel_tol=1e-9) and r["source_size"] == size[s]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in order:
        longest = max(len(brute.WORD.findall(r[1] or "")) for r in rows if r[3] == s)
        assert abs(taken[s] - target[s]) <= longest
    assert sorted(map(tuple, mixing.op1_mixing(spark, docs.repartition(3)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.op1_mixing(spark, docs.limit(0)).count() == 0
    whole = mixing.mixture(docs)
    assert whole.columns == docs.columns
    assert sum(len(brute.WORD.findall(r["text"] or "")) for r in whole.collect()) == sum(taken.values())


def test_fingerprints(spark, rows, docs):
    got = fingerprints.op4_fingerprints(spark, docs).collect()
    assert len(got) == len(rows)
    ids = sorted({r[0] for r in rows}, key=lambda i: (i is not None, i or 0))
    by = {i: sorted(r[1] or "" for r in rows if r[0] == i) for i in ids}
    want = set()
    for k, i in enumerate(ids):
        following = by[ids[(k + 1) % len(ids)]][0]
        for text in by[i]:
            cut = len(text) // 4
            edited = text[: len(text) - cut] + following[:cut]
            want.add((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got} == want
    by_text = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        for t in by[r["doc_id"]]:
            if len(t) == r["n_chars"]:
                by_text.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    near = sum(r["near_edited"] for r in got) / len(got)
    assert near > sum(r["near_next"] for r in got) / len(got) + 0.1
    assert fingerprints.op4_fingerprints(spark, docs.limit(0)).count() == 0
    assert fingerprints.op4_fingerprints(spark, docs.where("doc_id = 1")).first()["near_next"] == 1.0


def test_every_column_of_fingerprints(spark, rows, docs):
    held = brute.lexicon([r[1] for r in rows])
    assert held
    ids = sorted({r[0] for r in rows}, key=lambda i: (i is not None, i or 0))
    first = {i: min(r[1] or "" for r in rows if r[0] == i) for i in ids}
    want = []
    for i, text, *_ in rows:
        text, following = text or "", first[ids[(ids.index(i) + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        own, other, after = (brute.fingerprint(t, held) for t in (text, edited, following))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, brute.likeness(own, other), brute.likeness(own, after)))
    got = [tuple(r) for r in fingerprints.op4_fingerprints(spark, docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({w[5] for w in want}) > 5


@pytest.mark.parametrize("edits", [0, 2])
def test_fingerprints_in_a_large_group(spark, edits):
    rng = random.Random(12)
    base = [f"b{k}" for k in range(80)]
    data = []
    for i in range(240):
        words = list(base) if i % 3 == 0 else [f"w{rng.randint(0, 4000)}" for _ in range(80)]
        for k in range(edits if i % 3 == 0 else 0):
            words[rng.randrange(80)] = f"e{i}x{k}"
        data.append((i, " ".join(words)))
    got = {r["doc_id"]: r for r in fingerprints.op4_fingerprints(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()}
    group = [got[i] for i in range(0, 240, 3)]
    assert sum(r["near_edited"] for r in group) / len(group) > 0.3
    marks = [r["fingerprint"].split("-") for r in group]
    shared = [sum(a == b for a, b in zip(x, y)) / len(x) for x, y in zip(marks, marks[1:])]
    assert sum(shared) / len(shared) > 0.7
    assert sum(got[i]["near_next"] for i in range(240)) / 240 < 0.05


def test_quality(spark):
    rng = random.Random(6)
    good = [f"g{i}" for i in range(200)]
    junk = [f"j{i}!!" for i in range(200)]
    data = [(i, " ".join(rng.choice(junk if i % 10 == 0 else good) for _ in range(rng.randint(1, 80)))) for i in range(400)]
    data += [(1000, None), (1001, ""), (None, "g1 g2"), (1, data[1][1])]
    docs = spark.createDataFrame([(a, b, 0.5) for a, b in data], "doc_id long, text string, quality double")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), None) for i in range(0, 400, 2)] + [(None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    kept = [r["doc_id"] for r in quality.op2_quality_classifier(spark, docs, labels).collect()]
    long_junk = {a for a, b in data if a is not None and a % 10 == 0 and a < 400 and len(b.split()) > 3}
    assert len(long_junk & set(kept)) <= 1
    assert len([a for a, _ in data if (a is None or a % 10) and a not in kept]) <= 3
    again = quality.resample(docs, labels)
    assert again.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in again.collect()))) == sorted(map(str, kept))
    assert quality.resample(docs, labels.limit(0)).count() == docs.count()
    assert quality.op2_quality_classifier(spark, docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("share", [None, 0.5])
def test_quality_against_a_plain_version(spark, share):
    rng = random.Random(16)
    data = [(i, " ".join(rng.choice("abcdefgh" if i % 4 else "uvwxyzab") + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    data += [(700, None), (None, data[3][1]), (5, data[5][1])]
    labels = [(i, int(i % 4 != 0)) for i in range(0, 300, 3)]
    docs, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    known = quality.label_sample(marks, "quality", 20_000).collect()
    assert {r["doc_id"]: r["is_good"] for r in known} == dict(labels) and 30 < sum(r["fitted"] for r in known) < 70
    want = sorted(((i, w, k) for (i, _), (w, k, taken) in zip(data, brute.resampled(data, dict(labels), share)) if taken), key=str)
    if share is None:
        got = quality.op2_quality_classifier(spark, docs, marks)
    else:
        sampler, weights = quality.sampler(docs, marks, share=share)
        got = weights.where(F.col("sample_key") >= sampler.limit).select("doc_id", "log_weight", "sample_key")
    got = sorted(got.collect(), key=str)
    assert sorted(str(r[0]) for r in got) == sorted(str(w[0]) for w in want) and 100 < len(want) < 303
    wanted = {(w[0], round(w[2], 6)): w[1] for w in want}
    assert all(math.isclose(r[1], wanted[r[0], round(r[2], 6)], abs_tol=1e-9) for r in got)


def test_kth_largest(spark):
    values = [random.Random(7).gauss(0, 50) for _ in range(500)] + [3.0] * 20
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 17, 250, 520):
        limit = quality.kth_largest(keys, k)
        assert sum(v >= limit for v in values) >= k
        assert sum(v > limit + 1e-3 for v in values) <= k


def test_toxicity(spark):
    rng = random.Random(9)
    plain = [f"w{i}" for i in range(400)]
    bad = ["nasty", "vile", "rotten"]
    data, labels = [], []
    for i in range(600):
        toxic = int(i % 6 == 0)
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if toxic:
            words += [rng.choice(bad).upper() + "," for _ in range(3)]
        rng.shuffle(words)
        data.append((i, " ".join(words), "x"))
        if i % 3 != 1:
            labels.append((i, 1, toxic))
    data += [(900, None, "x"), (901, "", "x"), (None, "vile vile", "x"), (0, data[0][1], "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.op9_toxicity(spark, docs, marks).collect()
    assert len(got) == len(data)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None and r["doc_id"] < 600:
            assert r["predicted"] == int(r["doc_id"] % 6 == 0)
    assert len({r["score"] for r in got if r["doc_id"] == 0}) == 1
    assert toxicity.op9_toxicity(spark, docs.limit(0), marks).count() == 0
    assert toxicity.op9_toxicity(spark, docs, marks.limit(0)).count() == len(data)


def test_toxicity_indexes_rare_terms(spark):
    rng = random.Random(11)
    data = [(i, " ".join([f"c{rng.randint(0, 40)}" for _ in range(20)] + ["vile"] * (i % 5 == 0))) for i in range(300)]
    singular = " ".join(f"seldom{k}" for k in range(12))
    labels = [(i, int(i % 5 == 0)) for i in range(300)]
    free = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5]
    told, asked = free[0], 5000
    data += [(told, singular), (asked, singular), (asked + 1, "never seen"), (asked + 2, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (told, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.op9_toxicity(spark, docs, marks).collect()}
    assert got[asked]["evidence"] == [told] and math.isclose(got[asked]["evidence_cosine"][0], 1.0)
    assert got[asked]["predicted"] == 1
    assert got[asked + 1]["evidence"] == [] and got[asked + 1]["predicted"] == 0
    chosen = {i for i, _ in [*labels, (told, 1)] if zlib.crc32(str(i).encode()) % 5}
    sets = {i: set(t.lower().split()) for i, t in data if i in chosen}
    for i, t in data[:40]:
        assert len(got[i]["evidence"]) == min(15, sum(bool(x & set(t.split())) for x in sets.values()))


def test_every_score_of_toxicity(spark):
    """Neighbours, votes and calibration in plain Python over all terms."""
    rng = random.Random(15)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    data = [(i, " ".join([f"t{rng.randint(0, 60)}" for _ in range(rng.randint(6, 25))] + ["foul"] * rng.randint(0, 2) * (i % 4 == 0))) for i in range(160)]
    labels = [(i, int(i % 4 == 0)) for i in range(0, 160) if i % 5 < 4]
    data += [(700, None), (701, "unseen words"), (702, "!!"), (703, "!?")]
    labels += [(702, 0), (8, 0)]
    got = {r["doc_id"]: r for r in toxicity.op9_toxicity(spark, spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}

    kinds = defaultdict(set)
    for i, k in labels:
        kinds[i].add(k)
    toxic = {i: min(k) for i, k in kinds.items() if len(k) == 1 and fold(i)}
    bags = {i: Counter((t or "").replace("!", " ").replace("?", " ").split()) for i, t in data}
    vocabulary = {w for i in toxic for w in bags[i]}
    df = Counter(w for b in bags.values() for w in b)
    n_pos, n = sum(toxic.values()), len(toxic)

    def g2(word):
        a = sum(word in bags[i] and toxic[i] == 1 for i in toxic)
        b = sum(word in bags[i] and toxic[i] == 0 for i in toxic)
        cells = [(a, n_pos, a + b), (n_pos - a, n_pos, n - a - b), (b, n - n_pos, a + b), (n - n_pos - b, n - n_pos, n - a - b)]
        return 2 * sum(o * math.log(o * n / (r * c)) for o, r, c in cells if o)

    weight = {w: (math.log((1 + len(data)) / (1 + df[w])) + 1) * (1 + max(0, g2(w))) for w in vocabulary}

    def unit(bag):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in bag.items() if w in vocabulary}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    examples = {i: unit(bags[i]) for i in toxic if bags[i]}
    prior = n_pos / n

    def vote(v, without=None):
        near = sorted(((sum(x * e.get(w, 0) for w, x in v.items()), i) for i, e in examples.items() if i != without), reverse=True)
        near = [(c, i) for c, i in near if c > 0][:15]
        w = [c / (1.05 - min(c, 1.0)) for c, _ in near]
        return (sum(x * toxic[i] for x, (_, i) in zip(w, near)) + 0.5 * prior) / (sum(w) + 0.5), [c for c, _ in near]

    left = sorted((vote(v, i)[0], toxic[i]) for i, v in examples.items())
    steps = []
    for x, y in left:
        if steps and steps[-1][0] == x:
            steps[-1][1] += y
            steps[-1][2] += 1
        else:
            steps.append([x, y, 1])
        while len(steps) > 1 and steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]:
            _, y2, n2 = steps.pop()
            steps[-1][1] += y2
            steps[-1][2] += n2
    bare = [toxic[i] for i in toxic if not bags[i]]
    for i, bag in bags.items():
        v = unit(bag)
        if v:
            share, cosines = vote(v)
            want = float(np.interp(share, [s[0] for s in steps], [s[1] / s[2] for s in steps]))
            assert np.allclose(got[i]["evidence_cosine"], cosines)
        else:
            want = prior if bag else (sum(bare) + 0.5 * prior) / (len(bare) + 0.5)
            assert got[i]["evidence"] == []
        assert math.isclose(got[i]["score"], want, abs_tol=1e-9), i


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = rng.random((700, 12)) * (rng.random((700, 12)) < 0.3)
    vectors = vectors[vectors.sum(axis=1) > 0]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    index = toxicity.Index(np.arange(12, dtype=np.uint64), np.ones(12), vectors, np.zeros(len(vectors)), np.ones(len(vectors)), np.arange(len(vectors)), 0.1)
    for _ in range(30):
        q = np.zeros(12)
        t = np.sort(rng.choice(12, 3, replace=False))
        q[t] = rng.random(3) + 0.1
        q /= np.linalg.norm(q)
        at, cos = index.nearest(t, q[t], 10)
        want = np.sort(vectors @ q)[::-1][:10]
        assert np.allclose(cos, want[want > 0])


def test_postings_are_counted_without_a_copy():
    index = toxicity.Index(np.arange(2, dtype=np.uint64), np.ones(2), np.eye(2), np.zeros(2), np.ones(2), np.arange(2), 0.1)
    assert index.held.dtype == np.intp  # bincount copies any other type, for every query
    assert index.nearest(np.array([1]), np.ones(1), 2)[0].tolist() == [1]


def test_postings_of_common_terms_are_not_read_one_by_one(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = np.zeros((900, 140))
    for v in vectors:
        v[:20] = rng.random(20) * (rng.random(20) < 0.7)
        v[rng.integers(20, 140, 3)] = rng.random(3)
    vectors[7] = vectors[600]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    monkeypatch.setattr(toxicity, "COMMON", 20, raising=False)
    index = toxicity.Index(np.arange(140, dtype=np.uint64), np.ones(140), vectors, np.zeros(900), np.ones(900), np.arange(900), 0.1)
    read = []
    ragged = textcore.ragged
    monkeypatch.setattr(textcore, "ragged", lambda starts, lengths: read.append(int(lengths.sum())) or ragged(starts, lengths))
    asked = [*range(100), 600]
    found = []
    for i in asked:
        t = np.flatnonzero(vectors[i])
        found.append(index.nearest(t, vectors[i, t], 15))
    assert sum(read) < 0.1 * len(asked) * (vectors[:, :20] > 0).sum()
    want = [sorted(((-round(c, 12), j) for j, c in enumerate(vectors @ vectors[i]) if c > 0))[:15] for i in asked]
    for (at, cos), own in zip(found, want):
        assert at.tolist() == [j for _, j in own] and np.allclose(cos, [-c for c, _ in own])
    terms = [np.flatnonzero(vectors[i]) for i in asked]
    whole = toxicity.Vectors(np.append(0, np.cumsum([len(t) for t in terms])), np.concatenate(terms), np.concatenate([vectors[i, t] for i, t in zip(asked, terms)]))
    for (at, cos), (at_once, cos_once) in zip(found, index.neighbours(whole, 15), strict=True):
        assert at.tolist() == at_once.tolist() and np.allclose(cos, cos_once)
    assert "matrix" not in pickle.loads(pickle.dumps(index)).__dict__


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 16)).astype(np.float32)
    for k in range(20, 60):
        base[k] = base[k % 7] + rng.normal(size=16).astype(np.float32) * 0.08
    base[70] = base[71] = base[1]
    base[72] = base[1] * 3
    data = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(base)]
    bad = [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [1.0] * 15 + [None], 1), (204, [float("nan")] * 16, 1), (205, [float("inf")] * 16, 0), (206, data[3][1], None), (207, [1.0] * 8, 1)]
    frame = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>, label int")
    links = []
    for i, x, a in data:
        for j, y, b in data:
            if i < j and a == b and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links.append((i, j))
    want = brute.components(range(120), links)
    degree = [sum(i in p for p in links) for i in range(120)]
    assert sum(degree) > 60
    got = {r["vec_id"]: r for r in embedding_dedup.op10_embedding_dedup(spark, frame).collect()}
    assert len(got) == 128
    for i in range(120):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (degree[i], want[i], want[i] == i)
    for i, *_ in bad:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embedding_dedup.op10_embedding_dedup(spark, frame.limit(0)).count() == 0


def test_embeddings_whose_norms_leave_the_range(spark):
    data = [(1, [3e200, 4e200], 1), (2, [3.0, 4.0], 1), (3, [3e-200, 4e-200], 1), (4, [4.0, -3.0], 1), (5, [1.7e308, 1.7e308], 1), (6, [5e-324, 0.0], 1)]
    got = embedding_dedup.op10_embedding_dedup(spark, spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1), 6: (0, 6)}


def test_mixture_keeps_columns_of_any_name(spark, rows):
    df = spark.createDataFrame([(*r, i, "s", 0) for i, r in enumerate(rows)], brute.SCHEMA + ", _mix_take int, source_key string, copies int")
    out = mixing.mixture(df)
    plain = mixing.mixture(df.select("doc_id", "text", "source"))
    assert out.columns == df.columns and out.count() == plain.count()
    assert {(r["source_key"], r["copies"]) for r in out.collect()} == {("s", 0)}


def test_long_and_tied_conversations(spark):
    long = [(1, i, ("user", "assistant")[i % 2], f"turn {i} " + "x" * 50) for i in range(3000)]
    tied = [(2, 0, "user", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "yes"), (2, 1, "assistant", "yes")]
    frame = spark.createDataFrame(long + tied, "conv_id long, turn long, role string, text string")
    got = {r["chosen_id"]: r for r in chat.op8_chat_preferences(spark, frame.repartition(7)).collect()}
    assert got[1]["prompt"].count("<|end|>") == got[1]["n_common"] == 2999 and got[1]["rejected_id"] == 2
    assert got[1]["rejected_completion"] == "<|assistant|>\nyes<|end|>\n"
    assert got[2]["prompt"] == "<|user|>\na<|end|>\n<|user|>\nb<|end|>\n<|assistant|>\nyes<|end|>\n"
    assert got[2]["chosen_loss"] == "14:17"


TURN = "struct<role:string,text:string>"


def test_preference_pairs(spark):
    a = [("user", "hi"), ("assistant", "good day"), ("user", "more"), ("assistant", "no")]
    b = [("user", "hi"), ("assistant", "good day"), ("user", "less"), ("assistant", "yé")]
    given = [(1, a, 2, b), (3, a, 4, a), (5, a, 6, a[:3]), (7, a[:1], None, None), (8, [], 9, b), (10, [("", "")], 11, [("", ""), ("assistant", "")])]
    got = {r["chosen_id"]: r for r in chat.formatted(spark.createDataFrame(given, f"chosen_id long, chosen array<{TURN}>, rejected_id long, rejected array<{TURN}>")).collect()}
    assert [got[i]["n_common"] for i in (1, 3, 5, 7, 8, 10)] == [2, 4, 3, 0, 0, 1]
    r = got[1]
    assert r["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\ngood day<|end|>\n"
    assert r["chosen_completion"] == "<|user|>\nmore<|end|>\n<|assistant|>\nno<|end|>\n"
    begin, end = map(int, r["rejected_loss"].split(":"))
    assert r["rejected_completion"][begin:end] == "yé"
    assert got[3]["chosen_completion"] == got[3]["rejected_completion"] == "" and got[5]["rejected_completion"] == ""
    assert got[7]["rejected_completion"] == "" and got[7]["chosen_completion"] == "<|user|>\nhi<|end|>\n"
    assert len(got[8]["rejected_loss"].split(",")) == 2


def test_chat(spark):
    data = [
        (1, 1, "assistant", "good day"), (1, 0, "user", "hi"), (1, 2, "user", "bye"), (2, 0, "user", "yo"), (2, 1, "assistant", "what"),
        (3, 0, "user", "alone"), (4, 0, None, None), (4, 0, None, None), (None, 0, "user", "x"), (None, 1, "assistant", "y"),
    ]
    got = {r["chosen_id"]: r for r in chat.op8_chat_preferences(spark, spark.createDataFrame([(*r, 1) for r in data], "conv_id long, turn long, role string, text string, turns int")).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert (got[None]["rejected_id"], got[1]["rejected_id"], got[2]["rejected_id"]) == (1, 2, None)
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["chosen_completion"] == "<|assistant|>\ngood day<|end|>\n"
    assert got[1]["rejected_completion"] == "<|assistant|>\nwhat<|end|>\n" and got[1]["rejected_loss"] == "14:18"
    assert got[4]["chosen_completion"].count("<||>\n<|end|>") == 2 and got[4]["chosen_loss"] == "" and got[3]["rejected_id"] is None
    assert chat.op8_chat_preferences(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
