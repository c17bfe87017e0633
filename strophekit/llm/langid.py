"""Operator 11: language identification with a string kernel.

A text's grams are the sequences of one to three characters inside its words, set between
blanks: blended spectrum, presence only.  Words are runs of letters of the lower-cased
whole text.  A gram is held exactly, as up to three 21-bit code points in a 64-bit number,
and what words repeat is never formed twice, since presence alone counts.  The kernel of two
texts is the size of the intersection of their gram sets, over the geometric mean of their sizes.

* Nyström: ``LANDMARKS`` texts, as many of each language, stand for all; a text is its
  vector of kernel values k with them.
* One-versus-rest kernel ridge regression with targets +1 and -1: the coefficients A
  solve (Kᵀ K + ridge n Kmm) A = Kᵀ Y, where K holds the kernel values of n training texts and Kmm
  those among landmarks.  Kᵀ K and Kᵀ Y are added up by Spark's tasks.
* Scoring multiplies the presence matrix of a batch of texts with the landmarks' presence
  matrix, scales to kernel values, and multiplies with A.  The language of the
  largest value f is predicted (the first in order of the names among equals); the score is (f + 1) / 2,
  held to 0 to 1.

Training texts are a sample of about ``TRAIN_DOCS`` documents, as many of each language where it
has them, chosen by a hash of the id; that bound is a parameter.  Every text is scored.

Null text, or no letter: ``und``, score 0.  Null id: scored, not held out, not learned from.
Null languages and texts without a letter are not learned from.  Nothing to learn from: ``und``
everywhere; one language: that one.  Repeated rows are rows of their own.  Empty table:
empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophekit.llm.common import crc_fold, written

FOLDS, HELD_OUT = 3, 1
TRAIN_DOCS, LANDMARKS = 6_000, 128
RIDGE = 1e-4
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
BLOCK = 1 << 20  # characters of one word handled at once
ROWS = 64        # texts of one matrix product
MODEL = tuple[list[str], list[np.ndarray], np.ndarray]


def words_of(text: str | None) -> set[str]:
    """Distinct runs of letters of the lower-cased text."""
    found = set(WORD.findall((text or "").lower()))
    odd = {w for w in found if not w.isalpha()}  # numerals that are neither digits nor letters
    return (found - odd) | {p for w in odd for p in "".join(c if c.isalpha() else " " for c in w).split()}


def grams_of(text: str | None) -> np.ndarray:
    """Sorted distinct grams of a text."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int64)
    out = []
    whole = " " + "  ".join(words) + " "
    for at in range(0, len(whole), BLOCK):
        c = np.frombuffer(whole[at:at + BLOCK + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        letter = c != 32
        out.append(np.unique(c[letter]))
        two = letter[1:] | letter[:-1]
        pair = (c[:-1] << 21) | c[1:]
        out.append(np.unique(pair[two]))
        out.append(np.unique(((pair[:-1] << 21) | c[2:])[two[:-1] & two[1:]]))
    return np.unique(np.concatenate(out))


class Kernel:
    """Kernel values with the landmarks, for batches of gram sets."""

    def __init__(self, landmarks: list[np.ndarray]):
        self.vocabulary = np.unique(np.concatenate(landmarks)) if landmarks else np.empty(0, np.int64)
        self.presence = np.zeros((len(self.vocabulary), len(landmarks)), np.float32)
        for j, grams in enumerate(landmarks):
            self.presence[np.searchsorted(self.vocabulary, grams), j] = 1
        self.sizes = np.array([len(g) for g in landmarks], np.float64)

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        """``(texts, landmarks)``; counts below 2^24 are exact in single precision."""
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == flat
        columns, place = np.unique(at[hit], return_inverse=True)
        x = np.zeros((len(sets), len(columns)), np.float32)
        x[row[hit], place] = 1
        own = np.array([max(1, len(s)) for s in sets], np.float64)
        return (x @ self.presence[columns]).astype(np.float64) / np.sqrt(own[:, None] * self.sizes)


def sampled(docs: DataFrame, bound: int) -> DataFrame:
    """``lang, text, h`` of about ``bound`` learnable documents at most, evenly by language."""
    h = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40))
    known = docs.filter((crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = written(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return known.select("lang", "text", h.alias("h"))
    quota = max(1, bound // languages)
    share = F.least(F.lit(1.0), quota / F.col("n")) * min(1.0, bound / (quota * languages))
    shares = counts.select(F.col("lang").alias("_l"), share.alias("share"))
    rows = known.select("lang", "text", h.alias("h")).join(shares, F.col("lang") == F.col("_l"))
    return rows.filter(F.col("h") < F.col("share") * (1 << 40)).select("lang", "text", "h")


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, landmarks: int = LANDMARKS) -> MODEL:
    """Languages, gram sets of the landmarks, and coefficients ``(landmarks, languages)``."""
    def gram_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"lang": frame["lang"], "h": frame["h"], "grams": [grams_of(t).tobytes() for t in frame["text"]]})

    sample = written(sampled(docs, train_docs).mapInPandas(gram_rows, "lang string, h long, grams binary"), "grams")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # train_docs at most
    if not languages:
        return [], [], np.empty((0, 0))
    each = max(1, landmarks // len(languages))
    # a bounded sample: this window never holds more than it
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "grams"))
    chosen = sample.withColumn("k", first).filter(F.col("k") <= each).orderBy("k", "lang").limit(landmarks).collect()
    sets = [np.frombuffer(r["grams"], np.int64) for r in chosen]
    place = {lang: i for i, lang in enumerate(languages)}

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel = Kernel(sets)
        m = len(sets)
        kk, ky, n = np.zeros((m, m)), np.zeros((m, len(languages))), 0
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                some = frame.iloc[at:at + ROWS]
                k = kernel.values([np.frombuffer(g, np.int64) for g in some["grams"]])
                y = np.full((len(some), len(languages)), -1.0)
                y[np.arange(len(some)), [place[lang] for lang in some["lang"]]] = 1
                kk, ky, n = kk + k.T @ k, ky + k.T @ y, n + len(some)
        yield pd.DataFrame({"n": [n], "kk": [kk.tobytes()], "ky": [ky.tobytes()]})

    m = len(sets)
    kk, ky, n = np.zeros((m, m)), np.zeros((m, len(languages))), 0
    for r in sample.repartition(8, "h").mapInPandas(sums, "n long, kk binary, ky binary").collect():
        kk += np.frombuffer(r["kk"]).reshape(kk.shape)
        ky += np.frombuffer(r["ky"]).reshape(ky.shape)
        n += r["n"]
    kmm = Kernel(sets).values(sets)
    system = kk + RIDGE * n * kmm + 1e-9 * n * np.eye(m)  # the last: equal landmarks
    return languages, sets, np.linalg.solve(system, ky)


def predictor(spark, model: MODEL):
    """A column function of a text: a struct of the language and its score."""
    shared = spark.sparkContext.broadcast(model)  # LANDMARKS gram sets and coefficients

    def predict(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, sets, coefficients = shared.value
        kernel = Kernel(sets)
        names = np.array(languages, object)
        for texts in columns:
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for at in range(0, len(texts), ROWS):
                grams = [grams_of(t) for t in texts.iloc[at:at + ROWS]]
                some = [i for i, g in enumerate(grams) if len(g)] if languages else []
                if some:
                    f = kernel.values([grams[i] for i in some]) @ coefficients
                    best = f.argmax(axis=1)
                    where = at + np.array(some)
                    lang[where] = names[best]
                    score[where] = np.clip((f[np.arange(len(some)), best] + 1) / 2, 0, 1)
            yield pd.DataFrame({"lang": lang, "score": score})

    return F.pandas_udf(predict, "lang string, score double")


def language_predictions(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    docs = docs.select("doc_id", "text", "lang")
    predict = predictor(docs.sparkSession, fit(docs))
    held = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), predict("text").alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
