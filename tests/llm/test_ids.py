"""Operators 1 and 5, and the encoder they share."""

import collections
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strophekit.llm import bitplanes, packing, queries
from strophekit.llm.common import table
from strophekit.llm.tokens import encode_texts
from strophekit.session import scratch_path
from tests.llm.helpers import SF, frame, odd_documents

FILE = public_tokenizers.path("byte_bpe_50k.json")


def whole():
    tok = Tokenizer.from_file(FILE)
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_encoder_equals_the_library():
    rng = random.Random(3)
    texts = [t or "" for _, t, *_ in odd_documents()]
    texts += ["".join(rng.choice("ab, .\n'sé\t1²!   %") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    with open(FILE, encoding="utf-8") as f:
        spec = f.read()
    encode = whole()
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y\nz"]
    for text, got in zip(texts, encode_texts(spec, texts)):
        assert got.tolist() == encode(text), repr(text)
    small = 1 << 14  # generations change often
    for text, got in zip(texts, encode_texts(spec, texts, small)):
        assert got.tolist() == encode(text), repr(text)
    plain = encode_texts(spec, ["a <|endoftext|> b"], control_ids=False)[0]
    assert 50256 not in plain.tolist() and 50256 in encode("a <|endoftext|> b")


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for ids in (np.array([], "<u4"), np.zeros(5, "<u4"), rng.integers(0, 50_000, 4097).astype("<u4"), np.array([2**32 - 1, 0, 7], "<u4")):
        got = bitplanes.from_planes(bitplanes.to_planes(ids, kind), len(ids), kind)
        assert got.tolist() == ids.tolist()


def test_crc32_of_joined_strings():
    rng = random.Random(2)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 300)), rng.randbytes(rng.randint(0, 300))
        assert bitplanes.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("kind,block", [("byte", 64), ("bit", 1 << 16)])
def test_written_ids_read_back(spark, kind, block):
    path = scratch_path(spark, "test-ids")
    bitplanes.write_ids(frame(spark), path, FILE, end_id=2, block_ids=block, kind=kind)
    chunks = bitplanes.read_chunks(spark, path)
    encode = whole()
    expected = sorted(((i is not None, i or 0), tuple(encode(t) + [2])) for i, t, *_ in odd_documents())
    got = sorted((r["start"], r["doc_id"], tuple(r["ids"])) for r in bitplanes.read_documents(chunks).collect())
    assert sorted(((i is not None, i or 0), ids) for _, i, ids in got) == expected
    assert [(i is not None, i or 0) for _, i, _ in got] == [k for k, _ in expected]  # ascending ids, null first
    at = 0
    for start, _, ids in got:
        assert start == at
        at += len(ids)
    told = {r["start"]: (r["n_tokens"], r["ids_crc32"]) for r in bitplanes.digests(chunks).collect()}
    assert told == {s: (len(ids), crc(ids)) for s, _, ids in got}


def test_documents_without_ids_and_empty_table(spark):
    path = scratch_path(spark, "test-ids")
    bitplanes.write_ids(frame(spark, [(1, "", "en", "s", 0, 0.0, 0, 0, 0, "g")]), path, FILE)
    assert [tuple(r) for r in bitplanes.digests(bitplanes.read_chunks(spark, path)).collect()] == [(1, 0, 0, 0)]
    path = scratch_path(spark, "test-ids")
    bitplanes.write_ids(frame(spark, []), path, FILE, end_id=2)
    assert bitplanes.digests(bitplanes.read_chunks(spark, path)).count() == 0


def test_op1_over_the_table(spark):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op1_bitplane_ids(spark, SF).collect()}
    encode, at = whole(), 0
    for r in table(spark, SF, "documents").orderBy("doc_id").collect():
        ids = encode(r["text"]) + [2]
        assert got[r["doc_id"]] == (at, len(ids), crc(ids))
        at += len(ids)


def check_packing(pieces, docs, most):
    """Every id in one piece, sequences gapless and at most 1024 long; padding."""
    encode = whole()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc_id, text in docs:
        ids, at = encode(text) + [0], 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == crc(ids[at:at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for some in by_sequence.values():
        at = 0
        for p in sorted(some, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= most


def test_op5_over_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    check_packing(queries.op5_retrieval_packing(spark, SF).collect(), docs, 1023)


def test_packing_odd_documents(spark):
    rows = [r for r in odd_documents() if r[0] is not None]
    rows = [r for i, r in enumerate(rows) if r[0] not in [x[0] for x in rows[:i]]]
    check_packing(packing.pack(frame(spark, rows), FILE, 0, shard_docs=4).collect(), [(r[0], r[1]) for r in rows], 1023 * 6)
    every = packing.pack(frame(spark), FILE, 0)
    assert every.agg(F.sum("length")).first()[0] == sum(len(whole()(r[1])) + 1 for r in odd_documents())
    assert packing.pack(frame(spark, []), FILE, 0).count() == 0


def test_neighbours_share_a_window():
    """Rests on one subject are packed together, not in the order given."""
    rng = np.random.default_rng(4)
    leads = np.ones(5000, bool)
    rests = []
    for i in range(40):
        base = 1000 * (i % 4)
        rests.append(rng.integers(base, base + 200, 250).astype("<u4"))
    pieces = packing.pack_shard(rests, leads)
    windows = collections.defaultdict(list)
    for rest, _, n, sequence, _ in pieces:
        windows[sequence].append((rest % 4, n))
    same = sum(max(collections.Counter({s: sum(n for x, n in some if x == s) for s, _ in some}).values()) for some in windows.values())
    assert same / (40 * 250) > 0.8


def test_copies_meet_in_any_shard(spark):
    """Near copies far apart in the table share a shard and a window."""
    rng = random.Random(6)
    rows = []
    for i in range(160):
        words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(120)]
        rows += [(i, " ".join(words)), (1000 + i, " ".join(words[:40] + ["changed"] + words[41:]))]
    rows.sort()
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), FILE, 0, shard_docs=16).collect()
    check_packing(pieces, rows, 1023 * 40)
    windows = collections.defaultdict(set)
    for p in pieces:
        windows[p["doc_id"]].add(p["sequence_id"])
    assert sum(bool(windows[i] & windows[1000 + i]) for i in range(160)) >= 110  # a shard border parts some


def test_statistics_cover_all_rests():
    """Weights follow the frequencies among all rests, and every term of a seed counts."""
    leads = np.ones(5000, bool)
    rests = [np.array([1, 2], "<u4"), np.array([1, 3], "<u4"), np.array([2, 4], "<u4")]
    doc, term, _, _ = packing.rest_terms(rests, leads)
    one, two = (packing.rest_terms([np.array([i], "<u4")], leads)[1][0] for i in (1, 2))
    for rare in (one, two):
        often = np.where(term == rare, 2, 900)
        scores = packing.Index(rests, leads, often, 1000, 2.0).scores(0)
        assert (scores[1] > scores[2]) == (rare == one)
    seed = np.arange(100, 140, dtype="<u4")
    scores = packing.Index([seed, *(seed[i:i + 1] for i in range(40))], leads).scores(0)
    assert (scores[1:] > 0).all()
