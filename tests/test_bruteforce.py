"""Queries without a SQL oracle, checked against independent brute force
on the small tables (numpy / plain Python)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from strophekit.operators import measures as M
from strophekit.plans.q_songs import conversation_songs

SF = "/root/testdata/sf0.001"


def _dtw(x, y):
    n, m = len(x), len(y)
    acc = [[math.inf] * (m + 1) for _ in range(n + 1)]
    acc[0][0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            acc[i][j] = abs(x[i - 1] - y[j - 1]) + min(acc[i - 1][j], acc[i][j - 1], acc[i - 1][j - 1])
    return acc[n][m]


def _syllable_score(a, b):
    long_, short = (a, b) if len(a) >= len(b) else (b, a)
    w = len(short)
    padded = [0] * w + list(long_) + [0] * w
    best, best_j = math.inf, 0
    for j in range(len(padded) - w):
        e = _dtw(padded[j:], short)
        if e < best:
            best, best_j = e, j
    crop = padded[best_j:best_j + w]
    return sum(abs(c - s) for c, s in zip(crop, short)) / 8 / len(crop)


def test_syllable_by_song_brute_force(spark):
    songs = conversation_songs(spark, SF)
    sums = songs.select("id", F.transform("stanzas", lambda s: F.struct(
        s["keyword"].alias("k"), M.line_sums_rule(s["lines"]).alias("x"))).alias("st")).collect()
    expected = {}
    for r in sums:
        st = [(x["k"], list(x["x"])) for x in r["st"]]
        vals = [_syllable_score(st[i][1], st[j][1]) for i in range(len(st)) for j in range(i + 1, len(st))
                if st[i][0] == st[j][0]]
        expected[r["id"]] = sum(vals) / len(vals) if vals else 0.0
    got = {r["id"]: r["score"] for r in E.queries()["syllable_by_song"](spark, SF).collect()}
    assert got.keys() == expected.keys()
    for k in got:
        assert got[k] == pytest.approx(expected[k], abs=1e-6)


def test_pca_similarity_brute_force(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pandas().sort_values(["label", "vec_id"])
    t["position"] = t.groupby("label").cumcount() + 1
    target = t[t.label == 0]
    X = np.stack(target.embedding.to_numpy()).astype(np.float64)
    mu = X.mean(axis=0)
    cov = np.cov(X - mu, rowvar=False)
    w, v = np.linalg.eigh(cov)
    comps = v[:, np.argsort(w)[::-1][:5]]
    proj = lambda A: (A - mu) @ comps
    tp = dict(zip(target.position, proj(X)))
    got = {r["label"]: (r["cosine"], r["l2"]) for r in E.queries()["pca_similarity"](spark, SF).collect()}
    for label, g in t[t.label != 0].groupby("label"):
        P = proj(np.stack(g.embedding.to_numpy()).astype(np.float64))
        pairs = [(p, tp[pos]) for p, pos in zip(P, g.position) if pos in tp]
        cos = np.mean([a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) for a, b in pairs])
        l2 = np.mean([np.linalg.norm(a - b) for a, b in pairs])
        assert got[label][0] == pytest.approx(cos, abs=1e-5)
        assert got[label][1] == pytest.approx(l2, abs=1e-5)


def test_pc_window_centroids_brute_force(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    X0 = np.stack(t[t.label == 0].embedding.to_numpy()).astype(np.float64)
    mu = X0.mean(axis=0)
    w, v = np.linalg.eigh(np.cov(X0 - mu, rowvar=False))
    comps = v[:, np.argsort(w)[::-1][:10]]
    got = {r["label"]: r["centroid"] for r in E.queries()["pc_window_centroids"](spark, SF).collect()}
    for label, g in t.groupby("label"):
        P = (np.stack(g.embedding.to_numpy()).astype(np.float64) - mu) @ comps
        want = P[:, 3:6].mean(axis=0)
        # a component's sign is free: compare absolute values
        assert np.abs(got[label]) == pytest.approx(np.abs(want), abs=1e-5)


def _mtld_ma(tokens):
    n = len(tokens)
    lengths = []
    for s in range(n):
        seen = set()
        for j in range(n):
            seen.add(tokens[(s + j) % n])
            if len(seen) / (j + 1) <= 0.72 and j + 1 >= 10:
                lengths.append(j + 1)
                break
    return sum(lengths) / len(lengths) if lengths else 0.0


def test_diversity_avg_mtld_brute_force(spark):
    songs = conversation_songs(spark, SF)
    toks = songs.select("id", F.transform("stanzas", lambda s: M.diversity_tokens(s["lines"])).alias("t")).collect()
    want = {r["id"]: (sum(-_mtld_ma(list(x)) / 65 for x in r["t"]) / len(r["t"]) if r["t"] else 0.0)
            for r in toks}
    got = {r["id"]: r["score"] for r in E.queries()["diversity_avg_mtld_by_song"](spark, SF).collect()}
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6)
