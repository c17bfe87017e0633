"""Operator 7 against brute force."""

import collections
import math

import numpy as np

from strophekit.llm import embdup, queries
from strophekit.llm.common import table
from tests.llm.helpers import SF, groups

SCHEMA = "vec_id long, embedding array<float>, label int, node long, grp string, key int"


def check(rows, given):
    links, n_links, by_label = [], collections.Counter(), collections.defaultdict(list)
    for vec_id, vec, label in given:
        if label is not None and vec and all(x is not None and math.isfinite(x) for x in vec) and any(vec):
            by_label[label, len(vec)].append((vec_id, np.array(vec, float)))
    for some in by_label.values():
        m = np.stack([v / np.linalg.norm(v) for _, v in some])
        for i, j in zip(*np.where(np.triu(m @ m.T, 1) >= 0.98)):
            links.append((some[i][0], some[j][0]))
            n_links.update((some[i][0], some[j][0]))
    expected = groups([g[0] for g in given], links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}
    assert got == {i: (n_links[i], expected[i], i == expected[i]) for i, _, _ in given}
    return len(links)


def test_op7_over_the_table(spark):
    given = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, SF, "embeddings").collect()]
    check(queries.op7_embedding_near_dedup(spark, SF).collect(), given)


def test_planted_links_and_odd_vectors(spark):
    rng, given = np.random.default_rng(9), []
    for label in range(3):
        for _ in range(30):
            base = rng.standard_normal(64)
            for _ in range(rng.integers(1, 6)):
                given.append((len(given), (base + 0.13 * rng.standard_normal(64)).astype(np.float32).tolist(), label))
    centre = rng.standard_normal(64)
    for _ in range(80):
        given.append((len(given), (centre + 0.09 * rng.standard_normal(64)).astype(np.float32).tolist(), 7))
    same = rng.standard_normal(64).astype(np.float32).tolist()
    odd = [(same, 1), (same, 1), (same, 2), (same, None), ([2 * x for x in same], 1), (None, 1), ([], 1), ([0.0] * 64, 1), ([0.0] * 64, 1),
           ([float("nan")] + same[1:], 1), ([float("inf")] + same[1:], 1), ([None] + same[1:], 1), (same[:3], 1), (same[:3], 1), ([1.0], 1), ([3.0], 1), ([-1.0], 1)]
    given += [(len(given) + i, v, label) for i, (v, label) in enumerate(odd)]
    rows = spark.createDataFrame([(*g, 1, "g", 2) for g in given], SCHEMA)
    assert check(embdup.near_duplicate_vectors(rows).collect(), given) > 500


def test_large_buckets_in_tiles(spark, monkeypatch):
    """Groups far above a tile, chains of links among them, and repeated rows."""
    monkeypatch.setattr(embdup, "LIGHT", 8)
    monkeypatch.setattr(embdup, "TILE", 16)
    rng, given = np.random.default_rng(4), []
    for label in range(2):
        centre = rng.standard_normal(64)
        given += [(len(given) + i, (centre + 0.09 * rng.standard_normal(64)).astype(np.float32).tolist(), label) for i in range(150)]
        step = 0.1 * rng.standard_normal(64)
        given += [(len(given) + i, (rng.standard_normal(64) * 0.02 + centre + i * step).astype(np.float32).tolist(), label) for i in range(40)]
    given += [(len(given) + i, given[i][1], given[i][2]) for i in range(30)]
    rows = spark.createDataFrame([(*g, 1, "g", 2) for g in given], SCHEMA)
    assert check(embdup.near_duplicate_vectors(rows).collect(), given) > 5000


def test_repeats_null_ids_and_empty_table(spark):
    rows = [(1, [1.0, 2.0], 1, 0, "g", 0)] * 3 + [(None, [1.0, 2.0], 1, 0, "g", 0)]
    got = [tuple(r) for r in embdup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 1, True)] * 3 + [(None, 0, None, True)], key=str)
    assert embdup.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(12)
    turns = embdup.rotations(64)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.025 * rng.standard_normal(x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    bits, factor = embdup.codes(y, turns)
    got, spread = embdup.estimates(x, bits, factor, turns)
    error = got - np.einsum("ij,ij->i", x, y)
    assert abs(error.mean()) < 0.002
    assert (np.abs(error) <= embdup.SIGMAS * spread).mean() > 0.999
