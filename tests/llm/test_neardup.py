"""Operator 3 against brute force."""

import random

import numpy as np

from strophekit.llm import neardup, queries
from strophekit.llm.common import table
from strophekit.llm.components import components
from tests.llm.helpers import SF, frame, groups, odd_documents, shingles, similar_pairs


def check(rows, texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    expected = groups(sorted(sets), similar_pairs(sets))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert got == {d: (len(sets[d]), expected[d], d == expected[d]) for d in sets}


def test_op3_over_the_table(spark):
    check(queries.op3_minhash_near_dedup(spark, SF).collect(), {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()})


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(copy))
    return out


def test_families_at_the_threshold(spark):
    """Large families whose members are about as similar as the threshold."""
    rng = random.Random(11)
    texts = family(rng, 120, 120, 4) + family(rng, 60, 60, 3) + family(rng, 60, 300, 14) + family(rng, 30, 12, 1)
    texts += ["short one", "Short ONE", "short", "", " "]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", 0, 0.0, 0, 0, 0, "g") for i, t in enumerate(texts)]
    check(neardup.near_duplicates(frame(spark, rows)).collect(), dict(enumerate(texts)))


def test_keys_guarantee_the_distance():
    """Any two signatures within the distance share a key."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = rng.integers(0, 1 << 12, neardup.VALUES).astype(np.uint16)
        b = a.copy()
        at = rng.choice(neardup.VALUES, neardup.DISTANCE, replace=False)
        b[at] ^= rng.integers(1, 1 << 12, len(at)).astype(np.uint16)
        keys = neardup.chunk_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()


def test_odd_documents(spark):
    got = neardup.near_duplicates(frame(spark)).collect()
    assert len(got) == len(odd_documents())
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == 1 and by[1]["kept"] and not by[5]["kept"]
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (2, 3, 4))
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    kept = neardup.first_of_groups(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 8, 9, 10] and ids.count(None) == 2


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 200)]
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == groups(nodes, [(a, b) for a, b in links if a != b])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
