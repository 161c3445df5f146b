"""The pipeline's stages in order, each against a plain version of it."""

import random
from collections import Counter, defaultdict

import duckdb
import tokenizers

import corpus_pipeline
from kinspan.llm import mixing
from kinspan.llm.packing import cut_lengths
from kinspan.llm.queries import BYTE_BPE, tokenizer_path
from tests.llm import brute


def without_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for t, d in zip(texts, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        at, kept = 0, []
        for c in t or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append(None if t is None else "".join(kept))
    return out


def test_stages_in_order(spark, tmp_path):
    rng = random.Random(13)
    good = brute.corpus()
    junk = [(501 + i, " ".join(f"j{rng.randint(0, 30)}!!" for _ in range(60)), "en", "b", 0) for i in range(20)]
    spark.createDataFrame(good + junk, brute.SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int(r[0] < 500), 0) for r in good + junk if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sf_dir, tables = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        tables.append([tuple(r) for r in docs.collect()])
    quality, jaccard, suffix, mixed, packed = tables
    taken = brute.resampled([r[:2] for r in good + junk], {r[0]: r[1] for r in labels})
    assert Counter(quality) == Counter(r for r, (_, _, own) in zip(good + junk, taken) if own)
    assert Counter(quality) == Counter(good)

    first = set(brute.jaccard_components(quality).values())
    assert Counter(jaccard) == Counter(r for r in quality if r[0] is None or r[0] in first)

    texts = without_repeats([r[1] for r in jaccard])
    assert texts != [r[1] for r in jaccard]
    assert Counter(suffix) == Counter((r[0], t, *r[2:4], None if t is None else len(t)) for r, t in zip(jaccard, texts))

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/stage2/*.parquet'")
    taken = defaultdict(int)
    for doc_id, size, _, _, took in c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall():
        taken[doc_id, size] += took
    words = lambda r: len(brute.WORD.findall(r[1] or ""))
    got = defaultdict(int)
    for r in mixed:
        assert r in suffix
        got[r[0], words(r)] += words(r)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}

    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    want = Counter()
    for r in mixed:
        start = 0
        for n in cut_lengths(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1, 1024):
            want[r[0], start, n] += 1
            start += n
    at = {n: i for i, n in enumerate(docs.columns)}
    assert Counter((r[at["doc_id"]], r[at["start"]], r[at["length"]]) for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r[at["sequence_id"]]].append((r[at["offset"]], r[at["length"]]))
    for pieces in bins.values():
        ends = 0
        for a, n in sorted(pieces):
            assert a >= ends
            ends = a + n
        assert ends <= 1024
    assert Counter(r[at["ids_crc32"]] for r in packed) == Counter(r["ids_crc32"] for r in corpus_pipeline.run(spark, sf_dir).collect())
