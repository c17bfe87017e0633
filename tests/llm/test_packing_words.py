"""Words looked up and counted once (F1): chunks by words and tails, word counts by ranges of hashes."""

import collections

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from strophekit.llm import packing
from strophekit.llm.tokens import GROUP_CHARS, GROUP_ROWS, encode_texts, load_tokenizer, text_groups
from tests.llm.helpers import frame, odd_documents

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["e.g. and i.e., the end).", "!? ... -- ?", "Wort, Wört. wört; wört", "a\nb.\nc, d", "x", "3. 3.5, 4%", "été. Été, été!", "日本語。 日本語, ok."]


def spec():
    with open(FILE, encoding="utf-8") as f:
        return f.read()


def test_ids_are_those_of_whole_texts_in_every_group():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(FILE)
    texts = [*ODD, *(t or "" for _, t, *_ in odd_documents()), *ODD, "", " ".join(ODD)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for memo in (1 << 26, 1):  # 1: every group starts a generation
        for size in (1, 3, len(texts)):
            got = [ids.tolist() for at in range(0, len(texts), size) for ids in encode_texts(spec(), texts[at:at + size], memo)]
            assert got == want


def test_a_word_with_tails_has_one_entry():
    encoder = load_tokenizer(spec(), 12345)
    encode_texts(spec(), ["so rabarbara, rabarbara. rabarbara; rabarbara), so"], 12345)
    assert [c for c in encoder.memo if "rabarbara" in c] == ["rabarbara"]


def test_texts_are_grouped_by_rows_and_characters():
    long = "y" * (GROUP_CHARS // 2)
    texts = ["x"] * (GROUP_ROWS + 5) + [long] * 5
    ids = list(range(len(texts)))
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[at:at + 512]), pa.array(texts[at:at + 512])], ["doc_id", "text"]) for at in range(0, len(texts), 512)]
    got = list(text_groups(batches))
    assert [i for some, _ in got for i in some] == ids and [t for _, some in got for t in some] == texts
    assert [len(t) for _, t in got] == [GROUP_ROWS, 7, 2, 1]
    assert list(text_groups([])) == []


def test_sums_of_ranges_are_those_of_all_words():
    rng = np.random.default_rng(7)
    words = np.append(rng.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2), np.array([0, 2**64 - 1], np.uint64))
    blocks = [np.unique(rng.choice(words, 120)) for _ in range(9)]
    counts = [rng.integers(1, 5, len(b)).astype("<u4") for b in blocks]
    want = collections.Counter()
    for b, c in zip(blocks, counts):
        for t, n in zip(b.tolist(), c.tolist()):
            want[t] += n
    for ranges in (1, 2, 512):
        for b in blocks:
            cuts = packing.range_cuts(b, ranges)
            assert len(cuts) == ranges + 1 and (cuts[0], cuts[-1]) == (0, len(b))
            assert all((int(t) * ranges) >> 64 == k for k in range(ranges) for t in b[cuts[k]:cuts[k + 1]])
    got = packing.summed(np.concatenate(blocks), np.concatenate(counts))
    assert got.tolist() == [want[t] for b in blocks for t in b.tolist()]
    column = packing.binaries(np.arange(5, dtype="<u4"), [0, 2, 2, 5]).to_pylist()
    assert [np.frombuffer(v, "<u4").tolist() for v in column] == [[0, 1], [], [2, 3, 4]]


def test_packing_is_the_same_by_few_and_by_many_ranges(spark):
    rows = [(i, f"Rare{i // 2} words stand beside common ones, and text {i % 7} goes on.", *[None] * 8) for i in range(60)]
    docs = frame(spark, rows).repartition(3, F.col("doc_id"))
    order = ["doc_id", "start", "sequence_id", "offset"]
    few, many = (packing.pack(docs, FILE, 0, range_words=n).orderBy(order).collect() for n in (1 << 30, 1))
    assert few == many and len({r["doc_id"] for r in few}) == 60
