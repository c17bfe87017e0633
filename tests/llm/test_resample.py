"""Operator 12 against plain crc32 of every feature."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from strophekit.llm import resample as R
from tests.llm.helpers import frame, odd_documents


def features(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    runs = [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in runs]


def plain(docs, target):
    docs = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([n, (i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))])
    fit = sorted((r for n, r in rows if n >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(fit[:5 * len(fit) // 100]):
        rank.setdefault(r, []).append(k + 1)
    return sorted([(*r, rank[r].pop(0) if n >= 20 and rank.get(r) else None) for n, r in rows], key=str)


def given():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "ß" * 40, "日本語", "A" * 70, "x9"]
    docs = [(i, (" " if i % 2 else ", ").join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 19, 20, 60])))) for i in range(200)]
    return docs + [r[:2] for r in odd_documents()]


def test_all_rows_against_plain_features(spark):
    docs, target = given(), ["w1 w2 w3 w4", None, "", "A W1-w2, " + "word1 and then " * 50]
    rows = [(i, t, None, None, None, 0.5, 1, 2, 3, "g") for i, t in docs]
    b = spark.createDataFrame([(1, t, "x") for t in target], "item_id long, text string, doc_id string")
    got = R.importance_sample(frame(spark, rows).repartition(3), b).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, target)
    assert sum(r["rank"] is not None for r in got) == 5 * sum(features(t)[0] >= 20 for _, t in docs) // 100


def test_empty_tables(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert R.importance_sample(frame(spark, []), b).count() == 0
    docs = given()[:60]
    got = R.importance_sample(frame(spark, [(i, t, *[None] * 8) for i, t in docs]), b).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, [])


def test_any_head_gives_the_same_buckets_across_blocks(monkeypatch):
    texts = [(t or "").encode() for _, t in given()] + [b"one two " * 150_000 + b"x" * 3_000_000 + b" end"]
    words = [w for t in texts[:50] for b in R.words_of(t) for w in b]
    pairs = [a + b" " + b for a, b in zip(words, words[1:])]
    want = [features(t.decode()) for t in texts]
    for head in (([], []), (sorted(set(words)), sorted(set(pairs))), (sorted(set(words))[:40], pairs[:100])):
        for size in (200_000, 50):
            monkeypatch.setattr(R, "CHUNK", size)
            got = R.Documents(R.Head(*head)).run(texts)
            for (n, buckets, dense), (n_words, plain_) in zip(got, want):
                assert n == n_words
                assert (buckets if dense else np.bincount(buckets, minlength=10_000)).tolist() == np.bincount(np.array(plain_, int), minlength=10_000).tolist()
    assert got[-1][2]


def test_head_holds_the_frequent_words(spark):
    docs = frame(spark, [(i, f"often seen word{i} twice" + " often seen" * 5, *[None] * 8) for i in range(300)])
    words, pairs = R.head_of(docs)
    assert b"often" in words and b"often seen" in pairs
