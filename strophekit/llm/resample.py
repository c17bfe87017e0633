"""Operator 12: target-distribution importance resampling with hashed n-grams.

Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII;
features are all runs of one to three words.  A feature's bucket is the crc32 of its
UTF-8 bytes modulo 10,000.  Bucket totals of the corpus and of the target texts give every
bucket a gain; a document weighs the sum of its gains, and the highest of weight plus
Gumbel noise, drawn from a hash of the id, are taken.

How a crc32 is found: appending L bytes to a text maps its crc32 linearly (one table
per L) and adds the crc32 of what is appended.

* Head: frequent words are broadcast with their exact crc states, and frequent pairs with
  state and bucket.  A word or pair is in the head when it makes up at least one in
  ``HEAD_WORDS`` words or one in ``HEAD_PAIRS`` pairs of the corpus, so the head's size is bounded
  whatever the corpus.  It is found by lossy counting in every task and an addition in
  Spark.  The head only saves work: no result depends on it.
* Tail: every other word takes its crc32 directly; pairs and triples outside the head
  continue the state of their beginning.  Words of over 63 bytes are continued byte by byte.

Both feed exact bucket totals: a task writes each document's buckets (a document of many
features: its 10,000 counts), so every text is read once for the head and once for the
buckets; totals are summed over what was written.

Null text: no words.  Null id: noise as of an empty id, after all ids among ties.  Rows
with equal ids are rows of their own.  Empty corpus: empty result; empty target: gains from
counts of 0.  A document without words weighs 0.  Very long texts are read in blocks.
Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophekit.llm.common import space_blocks, written
from strophekit.operators.relational import global_row_index

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
HEAD_WORDS, HEAD_PAIRS = 1 << 15, 1 << 16
HEAD_BYTES = 32  # of a head word
LONGEST = 64     # appended bytes for which a table is kept
CHUNK = 200_000  # words handled at once
SPARSE = 20_000  # features of a document written one by one

# A-Z to a-z; all that is no word character to a blank
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a block of about a megabyte at a time."""
    data = data.translate(FOLD)
    if len(data) < 1 << 20:
        yield data.split()
        return
    for block in space_blocks(data):
        yield block.tobytes().split()


def shift_tables() -> np.ndarray:
    """``[L, k, b]``: what L appended bytes make of byte b at place k of a crc32."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    step = np.zeros((LONGEST + 1, 4, 256), np.uint32)
    at = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for size in range(LONGEST + 1):
        step[size] = at
        at = (at >> np.uint32(8)) ^ one[at & np.uint32(255)]
    return step


TABLES = shift_tables()


def shifted(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 values after appending ``sizes`` bytes, without what the bytes add."""
    flat = TABLES.reshape(-1)
    at = sizes.astype(np.int64) << 10
    out = flat[at + (crc & np.uint32(255))]
    for k in range(1, 4):
        out ^= flat[at + (256 * k) + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


class Head:
    """Frequent words and pairs with their crc states."""

    SLOTS = 1 << 18

    def __init__(self, words: list[bytes], pairs: list[bytes]):
        self.ids = {w: i for i, w in enumerate(words)}
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.size = np.array([len(w) for w in words], np.int64)
        keys, states = [], []
        for pair in pairs:
            a, b = (self.ids.get(w) for w in pair.split(b" "))
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                states.append(zlib.crc32(pair))
        # one pair a slot: of two that meet the earlier stays, the other is computed
        self.keys, self.states = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, np.uint32)
        self.buckets = np.zeros(self.SLOTS, np.uint16)
        for key, state in reversed(list(zip(keys, states))):
            slot = int(self.slots(np.array([key]))[0])
            self.keys[slot], self.states[slot], self.buckets[slot] = key, state, state % BUCKETS

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


SPACE = np.uint32(zlib.crc32(b" "))


def feature_buckets(words: list[bytes], depth: np.ndarray, head: Head) -> list[np.ndarray]:
    """Buckets of the features that end at each word, per number of words (1, 2, 3), -1
    where there is none.  ``depth``: words before it in its document, as far as 2."""
    n = len(words)
    get = head.ids.get
    ids = np.fromiter((get(w, -1) for w in words), np.int64, n)
    known = ids >= 0
    one, size = np.zeros(n, np.uint32), np.zeros(n, np.int64)
    one[known], size[known] = head.crc[ids[known]], head.size[ids[known]]
    tail = np.flatnonzero(~known)
    one[tail] = np.fromiter((zlib.crc32(words[i]) for i in tail.tolist()), np.uint32, len(tail))
    size[tail] = np.fromiter((len(words[i]) for i in tail.tolist()), np.int64, len(tail))
    short = np.minimum(size, LONGEST - 1)
    added = shifted(np.full(n, SPACE), short) ^ one  # crc32 of a blank and the word
    long = np.flatnonzero(size >= LONGEST)

    def continued(state: np.ndarray) -> np.ndarray:
        """States that end a word earlier, with a blank and the word appended."""
        out = shifted(state, short + 1) ^ added
        for i in long.tolist():
            out[i] = zlib.crc32(words[i], zlib.crc32(b" ", int(state[i])))
        return out

    def before(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x[:1], x[:-1])) if n else x

    keys = before(ids) << 32 | ids
    slot = head.slots(keys)
    held = (head.keys[slot] == keys) & known & before(known)
    two, bucket2 = head.states[slot], head.buckets[slot].astype(np.int64)
    rest = continued(before(one))
    two = np.where(held, two, rest)
    bucket2 = np.where(held, bucket2, (rest % BUCKETS).astype(np.int64))
    three = continued(before(two))
    out = [(one % BUCKETS).astype(np.int64), bucket2, (three % BUCKETS).astype(np.int64)]
    for k in (1, 2):
        out[k][depth < k] = -1
    return out


class Documents:
    """Buckets of whole documents, computed for many short ones at once."""

    def __init__(self, head: Head):
        self.head = head

    def run(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, bool]]:
        """Per text: words, and its buckets or (when many) the counts of all buckets."""
        out: list = [None] * len(texts)
        words, spans = [], []
        for i, text in enumerate(texts):
            lead: list[bytes] = []
            for block in words_of(text):
                spans.append((i, len(lead), len(block)))
                words += lead + block
                lead = (lead + block)[-2:]
                if len(words) >= CHUNK:
                    self._chunk(words, spans, out)
                    words, spans = [], []
        self._chunk(words, spans, out)
        return out

    def _chunk(self, words: list[bytes], spans: list, out: list) -> None:
        depth = np.zeros(len(words), np.int64)
        at = 0
        for _, lead, n in spans:
            depth[at:at + lead + n] = np.minimum(np.arange(lead + n), 2)
            at += lead + n
        buckets = np.stack(feature_buckets(words, depth, self.head), axis=1)
        at = 0
        for i, lead, n in spans:
            mine = buckets[at + lead:at + lead + n].ravel()
            mine = mine[mine >= 0].astype(np.uint16)
            at += lead + n
            if out[i] is None and len(mine) <= SPARSE:
                out[i] = (n, mine, False)
                continue
            counts = np.bincount(mine, minlength=BUCKETS)
            if out[i] is not None:
                had = out[i][1]
                counts = counts + (had if out[i][2] else np.bincount(had, minlength=BUCKETS))
            out[i] = (n + (out[i][0] if out[i] else 0), counts, True)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def head_of(docs: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Frequent words and pairs of all texts, the most frequent first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, total = {}, {}, 0
        chunk: list[bytes] = []

        def take(kept: dict, found: Counter) -> dict:
            """Lossy counting: each chunk takes one from every count, and those at 0 go."""
            for key, n in found.items():
                if n > 1 or key in kept:
                    kept[key] = kept.get(key, 0) + n
            return {key: n - 1 for key, n in kept.items() if n > 1}

        def flush():
            nonlocal words, pairs, total, chunk
            total += len(chunk)
            words = take(words, Counter(chunk))
            ids: dict[bytes, int] = {}
            at = np.fromiter((ids.setdefault(w, len(ids)) for w in chunk), np.int64, len(chunk))
            keys, counts = np.unique(at[:-1] << 32 | at[1:], return_counts=True)
            names = list(ids)
            keys, counts = keys[counts > 1], counts[counts > 1]
            pairs = take(pairs, Counter({names[k >> 32] + b" " + names[k & 0xFFFFFFFF]: n for k, n in zip(keys.tolist(), counts.tolist())}))
            chunk = []

        for batch in batches:
            for text in _texts(batch):
                for block in words_of(text):
                    chunk += block
                    if len(chunk) >= CHUNK:
                        flush()
        flush()
        rows = [(0, b"", total)] + [(1, w, n) for w, n in words.items() if len(w) <= HEAD_BYTES] + \
               [(2, p, n) for p, n in pairs.items() if len(p) <= 2 * HEAD_BYTES]
        for i in range(0, len(rows), 50_000):
            kind, item, n = zip(*rows[i:i + 50_000])
            yield pa.RecordBatch.from_pydict({"kind": list(kind), "item": list(item), "n": list(n)})

    counts = written(docs.select("text").mapInArrow(run, "kind long, item binary, n long").groupBy("kind", "item").agg(F.sum("n").alias("n")), "head")
    total = counts.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    cut = F.when(F.col("kind") == 1, total / HEAD_WORDS).otherwise(total / HEAD_PAIRS)
    # counts are at most the true ones, so no more than HEAD_WORDS and HEAD_PAIRS rows pass
    rows = counts.filter((F.col("kind") > 0) & (F.col("n") >= cut)).collect()
    rows.sort(key=lambda r: (-r["n"], bytes(r["item"])))
    return [bytes(r["item"]) for r in rows if r["kind"] == 1], [bytes(r["item"]) for r in rows if r["kind"] == 2]


def bucketed(docs: DataFrame, head: tuple[list[bytes], list[bytes]]) -> DataFrame:
    """``doc_id, n_words, n_features, dense, buckets``, written once."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Documents(Head(*shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                got = work.run(_texts(some))
                features = [int(b.sum()) if dense else len(b) for _, b, dense in got]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": some.column("doc_id"), "n_words": [n for n, _, _ in got], "n_features": features,
                    "dense": [d for _, _, d in got], "buckets": [b.tobytes() for _, b, _ in got]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(run, "doc_id long, n_words long, n_features long, dense boolean, buckets binary"), "buckets")


def _read(data: bytes, dense: bool) -> np.ndarray:
    return np.frombuffer(data, np.int64 if dense else np.uint16)


def totals(found: DataFrame) -> np.ndarray:
    """Features per bucket over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            sparse = []
            for dense, data in zip(batch.column("dense").to_pylist(), batch.column("buckets").to_pylist()):
                if dense:
                    total += _read(data, True)
                else:
                    sparse.append(data)
            total += np.bincount(_read(b"".join(sparse), False), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    out = np.zeros(BUCKETS, np.int64)
    sums = found.select("dense", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    s_all, t_all = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gains @ _read(b, True) if dense else gains[_read(b, False)].sum())
                      for dense, b in zip(batch.column("dense").to_pylist(), batch.column("buckets").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"),
                                              pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def importance_sample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; rank only of those drawn."""
    head = head_of(docs)
    found = bucketed(docs, head)
    wanted = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), head)
    rows = weighed(found, gains_of(totals(found), totals(wanted)))
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    rows = written(rows.withColumn("score", F.col("weight") + noise), "scores")
    # in the order of the draw: long enough, highest score, least id
    fit = F.col("n_words") >= LEAST_WORDS
    drawn = PERCENT * rows.filter(fit).count() // 100
    rows = rows.withColumn("_short", ~fit).withColumn("_low", -F.col("score")).withColumn("_none", F.col("doc_id").isNull())
    rows = global_row_index(rows, ["_short", "_low", "_none", "doc_id"], "rank", tie=["weight", "n_features"])
    return rows.select("doc_id", "n_features", "weight", "score", F.when(fit & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))
