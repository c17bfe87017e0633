"""Operator 13: codes, errors and codebooks against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from strophekit.llm import vectorcodes as V

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long"


def plain(rows):
    """The contract with Python integers: no transform, no early end."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // 8)
    whole = [[math.floor(4096 * x) if abs(x) < 2 ** 53 else int(x) * 4096 for x in r[1]] + [0] * (8 * width - len(r[1])) for r in kept]
    parts = [[v[p * width:(p + 1) * width] for p in range(8)] for v in whole]
    books = [[v[p] for v in parts[:16]] for p in range(8)]

    def near(x, book):
        apart = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return apart.index(min(apart)), min(apart)

    for _ in range(6):
        for p in range(8):
            at = [near(v[p], books[p])[0] for v in parts]
            for k in set(at):
                mine = [v[p] for v, a in zip(parts, at) if a == k]
                books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for r, v in zip(kept, parts):
        got = [near(v[p], books[p]) for p in range(8)]
        error = sum(e for _, e in got)
        by_label[r[2]] = by_label.get(r[2], 0) + error
        out.append([r[0], bytes(k for k, _ in got).hex(), min(error, V.GREATEST), r[2]])
    return [(i, c, e, min(by_label[label], V.GREATEST), digest) for i, c, e, label in out]


def same(spark, rows):
    got = V.vector_codes(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_odd_vectors_ties_and_repeats(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += [(7, rows[7][1], 1), (None, rows[3][1], None), (100, None, 1), (101, [None] * 24, 1), (102, [float("nan")] * 24, 1),
             (103, [float("inf")] + [0.0] * 23, 2), (104, [0.5] * 8, 2), (105, [], 2), (106, [0.0] * 24, 2)]
    rows += [(200 + i, [float(rng.choice([-1, 0, 1])) for _ in range(24)], 1) for i in range(40)]  # many ties
    same(spark, rows)


def test_lengths_beyond_64_bits_and_few_rows(spark):
    rng = random.Random(6)
    same(spark, [(i, [rng.gauss(0, 1) * 10 ** rng.randint(-3, 30) for _ in range(13)], 1) for i in range(40)])
    same(spark, [(i, [float(i)] * 8, None) for i in range(3)])


def test_empty_table(spark):
    got = V.vector_codes(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 13])
def test_transform_keeps_distances_and_orders_by_sign_changes(width):
    rng = np.random.default_rng(width)
    x = rng.integers(-99, 99, (20, width))
    m = 1 << (width - 1).bit_length()
    assert ((V.hadamard(x) ** 2).sum(axis=1) == m * (x ** 2).sum(axis=1)).all()
    signs = V.hadamard(np.eye(m, dtype=np.int64)).T
    assert [(np.diff(s) != 0).sum() for s in signs] == list(range(m))


def test_nearest_equals_all_distances():
    rng = np.random.default_rng(1)
    for kind in (np.int64, object):
        x, e = rng.integers(-3, 4, (500, 5)).astype(kind), rng.integers(-3, 4, (16, 5)).astype(kind)
        all_ = ((x[:, None] - e[None]) ** 2).sum(axis=2)
        at, apart = V.nearest(x, e)
        assert (at == all_.argmin(axis=1)).all() and (apart == all_.min(axis=1)).all()
