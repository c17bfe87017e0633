"""Operator 8: quality classifier, hashed word n-grams and logistic regression.

Features of a whole text: its runs of letters and digits and its runs of other
characters, as they are and in pairs, hashed into 2^20 places; a
place holds 1 + log of its count, and the vector is scaled to length 1.  Weights are
trained with FTRL-proximal updates (per-coordinate rates and L1), one
document at a time, on ``SHARDS`` shards of a sample of labelled documents in parallel, and
averaged.  The sample is chosen by a hash of the id and holds about
``TRAIN_DOCS`` documents; that bound is a parameter.  A score is the logistic function of a
sparse dot product; scoring is one narrow pass over all documents.

Null or empty text, or white space only: the score of the intercept.  Labels that are null or
without a document are not used; with no usable label every score is 1.  Repeated rows
are rows of their own.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophekit.llm.common import IS_SPACE, crc_fold, mix64, release, run_hashes, small_batches, space_blocks, task, task_cache

BITS = 20
TRAIN_DOCS = 16_000
SHARDS = 4
EPOCHS = 3
RATE, BETA, L1, L2 = 10.0, 1.0, 0.05, 0.0
FOLDS, HELD_OUT, ACCEPT = 4, 2, 0.7
NO_LABELS = 35.0  # the intercept when nothing tells documents apart: all are kept
# 0 white space, 1 letters, digits and all beyond ASCII, 2 the rest
KIND = np.where(IS_SPACE, 0, [1 if b > 127 or chr(b).isalnum() else 2 for b in range(256)])


def run_tokens(text: str) -> np.ndarray:
    """Hashes of the runs of word characters and of other characters, in order."""
    out = []
    for buf in space_blocks(text.encode("utf-8", "surrogatepass")):
        kind = KIND[buf]
        edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts = np.concatenate(([0], edges))
        ends = np.append(edges, len(buf))
        some = kind[starts] > 0
        out.append(run_hashes(buf, starts[some], ends[some]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's hashed n-grams."""
    one = run_tokens(text or "")
    if not len(one):
        return np.empty(0, np.int64), np.empty(0)
    two = mix64(one[:-1] * np.uint64(0xD6E8FEB86659FD93) + one[1:])
    places, counts = np.unique(np.concatenate((one, two)) >> np.uint64(64 - BITS), return_counts=True)
    values = 1 + np.log(counts)
    return places.astype(np.int64), values / np.sqrt(values @ values)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal weights and intercept, documents in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = bias_n = 0.0
    vectors = [vector(t) for t in texts]

    def weights(at):
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= L1, 0.0, (np.sign(za) * L1 - za) / ((BETA + np.sqrt(na)) / RATE + L2))

    for _ in range(epochs):
        for (at, x), y in zip(vectors, labels):
            w = weights(at)
            error = float(sigmoid(w @ x + bias)) - y
            g = error * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / RATE * w
            n[at] += g * g
            bias_n += error * error
            bias -= RATE / (BETA + np.sqrt(bias_n)) * error
    return weights(np.arange(1 << BITS)), bias


def sampled(docs: DataFrame, labels: DataFrame, label: str, usable, bound: int) -> DataFrame:
    """``doc_id, text, y`` of about ``bound`` labelled documents at most."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(usable & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    total = known.count()
    if total > bound:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1e6 * bound / total))
    # at most about ``bound`` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and weights that are not 0, and the intercept."""
    usable = crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT
    sample = sampled(docs, labels, "quality", usable, train_docs)
    sample = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        task_cache("quality")
        frame = frame.sort_values("doc_id", key=lambda ids: mix64(ids.to_numpy(np.int64).view(np.uint64)), kind="stable")
        w, bias = train(frame["text"].tolist(), frame["y"].tolist())
        at = np.flatnonzero(w)
        release()
        return pd.DataFrame({"rows": [len(frame)], "places": [at], "weights": [w[at]], "bias": [bias]})

    shards = sample.groupBy("shard").applyInPandas(run, "rows long, places array<long>, weights array<double>, bias double").collect()
    total = sum(r["rows"] for r in shards)
    w = np.zeros(1 << BITS)
    for r in shards:
        w[np.array(r["places"], np.int64)] += np.array(r["weights"], float) * (r["rows"] / total)
    at = np.flatnonzero(w)
    return at, w[at], sum(r["bias"] * r["rows"] for r in shards) / total if total else NO_LABELS


def scorer(spark, model: tuple[np.ndarray, np.ndarray, float]):
    """A column function: the score of a text."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^20 weights at most

    @task("quality")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, weights, bias = shared.value
        w = np.zeros(1 << BITS)
        w[at] = weights
        for texts in columns:
            out = []
            for text in texts:
                places, values = vector(text)
                out.append(float(sigmoid(w[places] @ values + bias)))
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(score, "double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    out = docs.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be of quality, all columns as they were."""
    return docs.filter(scorer(docs.sparkSession, fit(docs, labels))("text") >= ACCEPT)
