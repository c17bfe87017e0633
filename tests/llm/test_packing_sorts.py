"""Sorts of packing: words by rest, and the rarest word of each rest, against plain ones."""

import numpy as np

from strophekit.llm.packing import by_doc_and_term, routing_word


def test_words_sorted_by_rest_even_when_their_leading_bits_agree():
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(300), 40)
    for term in (rng.integers(0, 1 << 63, len(doc)).astype(np.uint64) * np.uint64(2), rng.integers(0, 9, len(doc)).astype(np.uint64)):
        order, plain = by_doc_and_term(doc, term), np.lexsort((term, doc))
        assert np.array_equal(doc[order], doc[plain]) and np.array_equal(term[order], term[plain])
    assert by_doc_and_term(np.zeros(3, int), np.array([5, 2**64 - 1, 0], np.uint64)).tolist() == [2, 0, 1]


def test_routing_word_is_the_rarest_that_enough_rests_hold():
    rng = np.random.default_rng(4)
    doc = np.repeat(np.arange(50), rng.integers(1, 9, 50))
    term = rng.integers(0, 1 << 63, len(doc)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    often = rng.integers(1, 6, len(doc))
    for least in (1, 2, 4, 9):
        want = []
        for d in range(50):
            held = [(int(f), int(t)) for x, t, f in zip(doc, term, often) if x == d and f >= least]
            want.append(int(np.uint64(min(held)[1]).view(np.int64)) if held else None)
        assert routing_word(doc, term, often, 50, least) == want
