"""Operator 4 against the tokenizers Unigram model."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from strophekit.llm import queries
from strophekit.llm.common import table
from strophekit.llm.viterbi import Counter, piece_vocabulary, token_counts
from tests.llm.helpers import SF, frame, odd_documents

FILE = public_tokenizers.path("piece_bpe_32k.model")
TIES = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", -1.0), ("▁a", -2.0), ("bb", -1.5)]


def library(vocabulary, unknown, byte_fallback):
    tok = Tokenizer(models.Unigram(vocabulary, unknown, byte_fallback))
    tok.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return lambda text: len(tok.encode(text).ids)


@pytest.mark.parametrize("vocabulary,fallback,letters", [(TIES, False, "ab cd"), (None, True, "ab ▁\nжé<0x41>😀te")])
def test_counts_equal_the_library(vocabulary, fallback, letters):
    unknown = 0
    if vocabulary is None:
        vocabulary, unknown = piece_vocabulary(FILE)
    rng, counter, expected = random.Random(5), Counter(vocabulary, fallback), library(vocabulary, unknown, fallback)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert counter.count(text) == expected(text), repr(text)


def test_op4_over_the_table(spark):
    expected = library(*piece_vocabulary(FILE), True)
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op4_viterbi_token_counts(spark, SF).collect()}
    assert got == {r["doc_id"]: expected(r["text"] or "") for r in table(spark, SF, "documents").collect()}


def test_odd_documents(spark):
    vocabulary, unknown = piece_vocabulary(FILE)
    expected = library(vocabulary, unknown, True)
    got = token_counts(frame(spark), vocabulary).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r[0], r[1]) for r in got), key=key) == sorted(((i, expected(t or "")) for i, t, *_ in odd_documents()), key=key)
    assert token_counts(frame(spark, []), vocabulary).count() == 0
