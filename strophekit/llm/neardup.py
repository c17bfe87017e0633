"""Operator 3: near-duplicate documents by a multi-index Hamming join.

A document is its set of 3-word shingles; two are linked when their Jaccard
similarity is at least 0.85.  Steps:

1. Per document: the set's fingerprint and a signature of 32 MinHash values of
   12 bits.  Documents with equal sets form a class; one goes on for each.
2. The signature is split into 7 chunks of 4 or 5 values.  Two signatures that
   differ in at most 13 values have, by the pigeonhole principle, a chunk that
   differs in at most one.  So each chunk is indexed once with each of its
   values left out: 32 keys, and every pair within distance 13 shares one.
   At similarity 0.85 a pair is farther with probability 5e-5.
3. Buckets of equal keys.  In rounds, each class is paired with the three nearest
   centres of its buckets (a centre is a member drawn by hash), the pairs are
   confirmed on full sets, and components taken.  That settles large groups of near
   copies with few pairs.  Then every remaining pair of a bucket whose members are
   not yet connected is joined: rows outside a bucket's most frequent group against
   all of it, each pair under its first shared key only, within the length bound, the
   signature distance, and a finer distance over 2048 one-bit values (4.5 standard
   deviations).  No bucket is cut, and no such pair that could change a component is
   left out.
4. Candidates are confirmed on full sets, and components taken.

Null or empty text, or no word: set of size 0, linked with nothing.  Rows with
the same ``doc_id`` count as one document.  A null id takes part through its
equal sets only.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophekit.llm.common import mix64, shingle_hashes, small_batches, task, word_hashes, written
from strophekit.llm.components import components

SHINGLE_WORDS = 3
VALUES = 32
DISTANCE = 13
CHUNKS = (5, 5, 5, 5, 4, 4, 4)  # each may differ in one value: sum of (1 + 1) is DISTANCE + 1
LINK_PERCENT = 85
CENTRES = 3  # candidates of a document in one round
ROUND_YIELD = 0.05  # rounds go on while this share of the candidates is linked
MULTIPLIERS = mix64(np.arange(101, 101 + VALUES, dtype=np.uint64)) | np.uint64(1)
VALUE_BITS = 12
FEATURES = "doc_id long, n_shingles long, set_id binary, signature binary"
WORDS = [f"w{i}" for i in range(len(CHUNKS))]
FIRST_BITS = sum(1 << (VALUE_BITS * i) for i in range(max(CHUNKS)))
# Sketch of 2048 one-bit MinHash values; at the threshold 7.5 % of them differ.
SKETCH_WORDS = 32
SKETCH_SIGMAS = 4.5


def shingle_set(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(text.encode().lower()), size))


def set_id(members: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(members.tobytes())


def minima(members: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least member under each permutation."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), 2048):
        some = members[at:at + 2048, None] * multipliers
        least = np.minimum(least, (some ^ (some >> np.uint64(29))).min(axis=0))
    return least


def signature(members: np.ndarray) -> np.ndarray:
    """The low 12 bits of 32 minima."""
    return (minima(members, MULTIPLIERS) & np.uint64((1 << VALUE_BITS) - 1)).astype(np.uint16)


def sketch(members: np.ndarray) -> np.ndarray:
    """One bit of each of 2048 minima, as 64-bit words."""
    factors = mix64(np.arange(1001, 1001 + 64 * SKETCH_WORDS, dtype=np.uint64)) | np.uint64(1)
    bits = np.concatenate([minima(members, factors[at:at + 256]) & np.uint64(1) for at in range(0, len(factors), 256)])
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def features(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    @task("near_duplicates")
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts, ids, signatures = [], [], []
            for text in frame["text"]:
                members = shingle_set(text, size)
                counts.append(len(members))
                ids.append(set_id(members) if len(members) else None)
                signatures.append(signature(members).tobytes() if len(members) else None)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_shingles": counts, "set_id": ids, "signature": signatures})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(run, FEATURES)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of each row of ``signatures``: every chunk with one value left out."""
    keys, at = [], 0
    for chunk, width in enumerate(CHUNKS):
        for left_out in range(width):
            acc = np.full(len(signatures), np.uint64(64 * chunk + left_out + 1), np.uint64)
            for i in range(width):
                if i != left_out:
                    acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + signatures[:, at + i].astype(np.uint64))
            keys.append(acc)
        at += width
    return np.stack(keys, axis=1).view(np.int64)


def index_rows(classes: DataFrame) -> DataFrame:
    """``key, slot, doc``: one row per class and key; the slot says which chunk
    and which left-out value the key stands for."""
    @task("near_duplicates")
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s = np.frombuffer(b"".join(frame["signature"]), np.uint16).reshape(-1, VALUES)
            yield pd.DataFrame({"doc": frame["doc"], "keys": list(chunk_keys(s))})

    rows = classes.select("doc", "signature").mapInPandas(run, "doc long, keys array<long>")
    return rows.select("doc", F.posexplode("keys").alias("slot", "key"))


def signature_words(classes: DataFrame) -> DataFrame:
    """``doc, n`` and the signature as one long per chunk."""
    @task("near_duplicates")
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s = np.frombuffer(b"".join(frame["signature"]), np.uint16).reshape(-1, VALUES).astype(np.uint64)
            out, at = {"doc": frame["doc"], "n": frame["n"]}, 0
            for name, width in zip(WORDS, CHUNKS):
                shift = np.arange(width, dtype=np.uint64) * np.uint64(VALUE_BITS)
                out[name] = (s[:, at:at + width] << shift).sum(axis=1, dtype=np.uint64).view(np.int64)
                at += width
            yield pd.DataFrame(out)

    return classes.select("doc", "n", "signature").mapInPandas(run, "doc long, n long, " + ", ".join(f"{w} long" for w in WORDS))


def _flags(word: str):
    """The first bit of each value of a chunk that differs."""
    x = F.col(word).bitwiseXOR(F.col(word + "_1"))
    for by in (6, 3, 1, 1):  # the low bit gathers all twelve
        x = x.bitwiseOR(F.shiftrightunsigned(x, by))
    return x.bitwiseAND(F.lit(FIRST_BITS))


def _distance():
    return sum((F.bit_count(_flags(w)) for w in WORDS[1:]), F.bit_count(_flags(WORDS[0])))


def _first_shared():
    """Whether a pair that shares this row's key shares no earlier one: no
    earlier chunk differs in at most one value, and within a chunk that does not
    differ at all the first key counts."""
    chunk = F.coalesce(*[F.when(F.bit_count(_flags(w)) <= 1, F.lit(i)) for i, w in enumerate(WORDS)])
    return (chunk == F.col("chunk")) & (F.col("leads") | (F.col("own") != F.col("own_1")))


def _slot_columns(rows: DataFrame) -> DataFrame:
    """The chunk of a key, whether the key is its first, and the chunk's word."""
    firsts = [sum(CHUNKS[:i]) for i in range(len(CHUNKS))]
    chunk = sum((F.col("slot") >= at).cast("int") for at in firsts[1:])
    return rows.select("*", chunk.alias("chunk"), F.col("slot").isin(firsts).alias("leads"),
                       F.element_at(F.array(*WORDS), chunk + 1).alias("own"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    @task("near_duplicates")
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for x, y in zip(frame["x"], frame["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.loc[good, ["a", "b"]]

    with_x = pairs.join(sets.select(F.col("doc").alias("a"), F.col("members").alias("x")), "a")
    return with_x.join(sets.select(F.col("doc").alias("b"), F.col("members").alias("y")), "b").mapInPandas(run, "a long, b long")


def _other(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).alias(c + "_1") for c in rows.columns])


def _near(percent: int):
    """What the lengths and signatures of two linked documents must meet."""
    return (100 * F.least("n", "n_1") >= percent * F.greatest("n", "n_1")) & (_distance() <= DISTANCE)


def _sketch_distance(percent: int) -> int:
    p = (1 - percent / 100) / 2
    size = 64 * SKETCH_WORDS
    return int(np.ceil(size * p + SKETCH_SIGMAS * np.sqrt(size * p * (1 - p))))


def _sketches(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """``doc`` and the sketch, for the documents of ``rows``."""
    @task("near_duplicates")
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = [sketch(np.frombuffer(m, np.uint64)) for m in frame["members"]]
            yield pd.DataFrame({"doc": frame["doc"], "sketch": words})

    return sets.join(rows.select("doc").distinct(), "doc", "left_semi").mapInPandas(run, "doc long, sketch array<long>")


def _to_centres(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Per document the pairs with the nearest centres of its buckets, a centre
    being a member drawn by hash, and of another group."""
    centre = F.min(F.struct(F.xxhash64("key", "doc", F.lit(turn)).alias("draw"), "doc", "n", *WORDS, "grp")).alias("centre")
    open_keys = rows.groupBy("key").agg(centre, F.min("grp").alias("g0"), F.max("grp").alias("g1")).filter("g0 < g1")
    open_keys = open_keys.select(F.col("key").alias("key_1"), *[F.col("centre")[c].alias(c + "_1") for c in ("doc", "n", *WORDS, "grp")])
    met = rows.join(open_keys, (F.col("key") == F.col("key_1")) & (F.col("grp") != F.col("grp_1")) & _near(percent))
    nearest = met.groupBy("doc").agg(F.slice(F.sort_array(F.collect_set(F.struct(_distance().alias("far"), "doc_1"))), 1, CENTRES).alias("c"))
    return nearest.select(F.col("doc").alias("a"), F.explode("c.doc_1").alias("b"))


def _grouped(rows: DataFrame, group: DataFrame) -> DataFrame:
    """``rows`` under their new groups; buckets of a single group are done with."""
    rows = rows.drop("grp").join(group.withColumnRenamed("node", "doc"), "doc", "left")
    rows = written(rows.withColumn("grp", F.coalesce("component", "doc")).drop("component"), "grouped")
    still = rows.groupBy("key").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).filter("g0 < g1").select("key")
    return rows.join(still, "key", "left_semi")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = LINK_PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    small_batches(docs.sparkSession)
    feats = written(features(docs, size), "features")
    classes = written(feats.filter("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")), "classes")
    known = classes.filter("doc is not null")
    index = index_rows(known)
    shared = index.groupBy("key").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).filter("d0 < d1")
    buckets = index.join(shared.select("key"), "key").join(signature_words(known), "doc")
    buckets = written(buckets, "buckets")

    wanted = buckets.select("doc").distinct()

    def member_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc": frame["doc_id"], "members": [shingle_set(t, size).tobytes() for t in frame["text"]]})

    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(texts.join(wanted, texts["doc_id"] == wanted["doc"], "left_semi").mapInPandas(
        member_sets, "doc long, members binary"), "sets")

    # Rounds: each document proposes itself to the nearest centres of its buckets.
    rows, links, turn = buckets.withColumn("grp", F.col("doc")), None, 0
    while True:
        pairs = written(_to_centres(rows, turn, percent), "pairs")
        found = written(confirmed(pairs, sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        proposed, linked = pairs.count(), found.count()
        if not linked:
            break
        turn += 1
        group = written(components(links), "groups")
        rows = _grouped(rows, group)
        if linked < ROUND_YIELD * proposed:
            break

    # The rest: every pair of a bucket that is not yet connected.
    sizes = rows.groupBy("key", "grp").count()
    mixed = sizes.groupBy("key").agg(F.max_by("grp", "count").alias("main"), F.min("grp").alias("g0"), F.max("grp").alias("g1"))
    mixed = mixed.filter("g0 < g1").select("key", "main")
    open_rows = rows.join(mixed, "key")
    open_rows = written(open_rows.join(_sketches(sets, open_rows), "doc"), "open")
    open_rows = _slot_columns(open_rows)
    left = _other(open_rows.filter("grp <> main").select("key", "doc", "n", "grp", "own", *WORDS, "sketch"))
    apart = F.aggregate(F.zip_with("sketch", "sketch_1", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
    near = (F.col("grp_1") != F.col("grp")) & ((F.col("grp") == F.col("main")) | (F.col("doc_1") < F.col("doc"))) \
        & _first_shared() & _near(percent) & (apart <= _sketch_distance(percent))
    more = open_rows.join(left, (F.col("key") == F.col("key_1")) & near)
    more = more.select(F.greatest("doc", "doc_1").alias("a"), F.least("doc", "doc_1").alias("b"))
    links = written(links.unionByName(confirmed(more, sets, percent)), "links")

    group = components(links)
    named = classes.join(group, classes["doc"] == group["node"], "left").select(
        "set_id", F.coalesce("component", "doc").alias("component"))
    out = feats.drop("signature").join(named, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The documents whose id is the smallest of their group, all columns as
    they were.  Of several rows with one id that with the least text hash stays; rows
    without an id cannot be told apart and stay."""
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.join(kept, docs["doc_id"].cast("long") == kept["kept_id"], "left_semi")
    one = rows.groupBy(rows["doc_id"].alias("id")).agg(F.min_by(F.struct(*[rows[f"`{c}`"] for c in docs.columns]), F.xxhash64(rows["text"])).alias("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.filter("doc_id is null"))
