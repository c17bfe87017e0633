"""Operator 2: toxicity by gradient-boosted trees over dense features.

Features of a whole text: densities of words of a general lexicon and of a learned one,
the same hits near second-person words, hits that show only once an
obfuscated spelling is undone, rates of capitals, punctuation and symbols, mixed
spellings, long repeats, and lengths.  The learned lexicon holds the words and word beginnings
whose document counts tell toxic from clean documents (log-likelihood ratio), at most
``LEXICON_TERMS`` of them.

Labelled documents are dealt by id: some give the lexicon, others train the trees
(``GBTClassifier``), the rest calibrate them (``IsotonicRegression``), so no
document is scored with a lexicon it shaped while training.  The samples are bounded by
documented parameters.  Scoring is one narrow pass.  A score is the calibrated
probability, blended with a thousandth of the raw one, which orders documents within a step.

Null or empty text: features of no word.  Null labels are not used; with no label,
or labels of one kind only, every score is the share of toxic labels (0 without any).
Repeated rows are rows of their own.  Empty table: empty result.  Other columns are
kept or ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophekit.llm.common import crc_fold, mix64, run_hashes, small_batches, space_blocks, task, written

FOLDS, HELD_OUT, TOXIC = 5, 0, 0.5
LEXICON_FOLDS = (1, 2)
LEXICON_DOCS = 8_000
TRAIN_DOCS = 16_000
LEXICON_TERMS = 2_000
BEGINNINGS = (4, 5, 6)  # bytes
LEAST_TOXIC, LEAST_LLR = 4, 18.0
NEAR = 5  # words
TREES, DEPTH, STEP = 30, 3, 0.2
BLEND = 0.001

# Insults, and second-person words, of the four languages.
INSULTS = """
idiot idiots moron stupid scum trash loser pathetic worthless disgusting clown dumb fool jerk
bastard bitch asshole retard imbecile filthy vermin
dumm trottel depp arschloch abschaum dreck versager widerlich hurensohn
imbécile connard salope crétin abruti ordure pourriture minable
imbécil estúpido estúpida basura escoria asqueroso inútil pendejo cabrón
""".split()
SECOND_PERSON = """
you your yours yourself thou thee du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos
tú ti tuyo usted ustedes vosotros
""".split()
# Characters written in place of letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = ("insults", "insults_near_you", "learned", "learned_weight", "learned_top", "learned_near_you", "hidden",
            "you", "capitals", "capital_words", "exclamations", "punctuation", "symbols", "mixed", "repeats", "digits",
            "log_words", "word_length")
_LETTER = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_SYMBOL = np.array([chr(b) in "*#$%&@^~_|+=<>" for b in range(256)])
_MARK = np.array([chr(b) in ".,;:!?'\"()-" for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_UNDO = bytes(ord(LOOKALIKES.get(chr(b), chr(b))) for b in range(256))


def _hash_of(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        buf = np.frombuffer(w.encode(), np.uint8)
        out.append(run_hashes(buf, np.array([0]), np.array([len(buf)]))[0])
    return np.sort(np.array(out, np.uint64))


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded = np.concatenate(([False], inside, [False]))
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return edges[::2], edges[1::2]


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def terms(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words, then of their beginnings of each length (a shorter
    word has the beginning of a length it does not reach as 0)."""
    out = [run_hashes(lower, starts, ends)]
    for size in BEGINNINGS:
        long = ends - starts > size
        some = np.zeros(len(starts), np.uint64)
        some[long] = mix64(run_hashes(lower, starts[long], starts[long] + size) + np.uint64(size))
        out.append(some)
    return out


def _blocks(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the text's bytes, and the same in lower case."""
    for buf in space_blocks((text or "").encode("utf-8", "surrogatepass")):
        lower = buf.tobytes().decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")
        yield buf, np.frombuffer(lower, np.uint8)


def document_terms(text: str | None) -> np.ndarray:
    """Distinct term hashes of a whole text."""
    found = []
    for _, lower in _blocks(text):
        found += terms(lower, *_runs(_LETTER[lower]))
    every = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
    return every[every != 0]


def _near(hits: np.ndarray, you: np.ndarray) -> int:
    """How many hits stand within ``NEAR`` words of a second-person word."""
    at, seconds = np.flatnonzero(hits), np.flatnonzero(you)
    if not len(at) or not len(seconds):
        return 0
    right = np.searchsorted(seconds, at)
    before = at - seconds[np.maximum(right - 1, 0)]
    after = seconds[np.minimum(right, len(seconds) - 1)] - at
    return int(((np.abs(before) <= NEAR) | (np.abs(after) <= NEAR)).sum())


class Extractor:
    """Dense features of texts under one learned lexicon."""

    def __init__(self, lexicon: tuple[np.ndarray, np.ndarray]):
        order = np.argsort(lexicon[0])
        self.learned, self.weight = lexicon[0][order], lexicon[1][order]
        self.insults, self.you = _hash_of(INSULTS), _hash_of(SECOND_PERSON)

    def features(self, text: str | None) -> list[float]:
        sums = dict.fromkeys(("words", "bytes", "insults", "near", "learned", "weight", "learned_near", "hidden", "you",
                              "capitals", "capital_words", "exclaim", "marks", "symbols", "mixed", "repeats", "digits"), 0.0)
        top = 0.0
        for buf, lower in _blocks(text):
            starts, ends = _runs(_LETTER[lower])
            n = len(starts)
            hashes = terms(lower, starts, ends)
            insult, you = _within(hashes[0], self.insults), _within(hashes[0], self.you)
            learned, weight = np.zeros(n, bool), np.zeros(n)
            for some in hashes if len(self.learned) else ():
                at = np.minimum(np.searchsorted(self.learned, some), len(self.learned) - 1)
                hit = self.learned[at] == some
                learned |= hit
                weight = np.maximum(weight, np.where(hit, self.weight[at], 0))
            # spellings: words with look-alikes inside, undone
            data = lower.tobytes()
            spaced = np.flatnonzero(~(_SYMBOL | _LETTER)[lower])
            cut = np.concatenate(([-1], spaced, [len(lower)]))
            s, e = cut[:-1] + 1, cut[1:]
            odd = np.add.reduceat(np.concatenate(((_SYMBOL | _DIGIT)[lower].astype(np.int64), [0])), s) if len(lower) else np.zeros(len(s))
            letters = np.add.reduceat(np.concatenate(((_LETTER & ~_DIGIT)[lower].astype(np.int64), [0])), s) if len(lower) else np.zeros(len(s))
            some = (e > s) & (odd > 0) & (letters > 1)
            if some.any():
                undone = np.frombuffer(data.translate(_UNDO), np.uint8)
                hidden = _within(run_hashes(undone, s[some], e[some]), self.insults)
                plain = _within(run_hashes(lower, s[some], e[some]), self.insults)
                sums["hidden"] += int((hidden & ~plain).sum())
                sums["mixed"] += int(some.sum())
            caps = _CAPITAL[buf]
            up, down = _runs(caps)
            same = np.concatenate(([False], buf[1:] == buf[:-1], [False]))
            rs, re = _runs(same[1:-1]) if len(buf) > 1 else (np.empty(0, int), np.empty(0, int))
            for key, value in (("words", n), ("bytes", len(buf)), ("insults", insult.sum()), ("near", _near(insult, you)),
                               ("learned", learned.sum()), ("weight", weight.sum()), ("learned_near", _near(learned, you)),
                               ("you", you.sum()), ("capitals", caps.sum()), ("capital_words", (down - up > 1).sum()),
                               ("exclaim", (buf == 33).sum()), ("marks", _MARK[buf].sum()), ("symbols", _SYMBOL[buf].sum()),
                               ("repeats", (re - rs >= 2).sum()), ("digits", _DIGIT[buf].sum())):
                sums[key] += float(value)
            top = max(top, float(weight.max()) if n else 0.0)
        words, size = max(1.0, sums["words"]), max(1.0, sums["bytes"])
        return [sums["insults"] / words, sums["near"] / words, sums["learned"] / words, sums["weight"] / words, top,
                sums["learned_near"] / words, sums["hidden"] / words, sums["you"] / words, sums["capitals"] / size,
                sums["capital_words"] / words, sums["exclaim"] / size, sums["marks"] / size, sums["symbols"] / size,
                sums["mixed"] / words, sums["repeats"] / size, sums["digits"] / size, float(np.log1p(sums["words"])), size / words]


def _sample(docs: DataFrame, labels: DataFrame, folds, bound: int, salt: str) -> DataFrame:
    """``doc_id, text, y`` of about ``bound`` labelled documents at most."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter(
        crc_fold(F.col("doc_id"), FOLDS).isin(*folds) & F.col("y").isin(0, 1))
    total = known.count()
    if total > bound:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(1e6 * bound / total))
    # at most about ``bound`` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def learn_lexicon(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes and weights (log odds) that mark toxic documents."""
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels, LEXICON_FOLDS, LEXICON_DOCS, "lexicon")

    @task("toxicity")
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            by = {0: [], 1: []}
            for text, y in zip(frame["text"], frame["y"]):
                by[int(y)].append(document_terms(text))
            for y, found in by.items():
                if found:
                    term, count = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"term": term.view(np.int64), "y": y, "n": count})
            yield pd.DataFrame({"term": [0] * len(by), "y": list(by), "n": [len(f) for f in by.values()]})  # term 0: documents

    counts = sample.mapInPandas(run, "term long, y int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    counts = written(counts.filter(f"term = 0 or t >= {LEAST_TOXIC}"), "terms")
    total = counts.filter("term = 0").first()
    if total is None or not total["t"] or not total["c"]:
        return np.empty(0, np.uint64), np.empty(0)
    nt, nc = float(total["t"]), float(total["c"])
    share = nt / (nt + nc)
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    llr = 2 * (t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
    odds = F.log((t + 0.1) / (nt + 0.2)) - F.log((c + 0.1) / (nc + 0.2))
    best = counts.filter("term <> 0").select("term", llr.alias("llr"), odds.alias("odds")).filter(
        (F.col("llr") >= LEAST_LLR) & (F.col("odds") > 1)).orderBy(F.desc("llr"), "term").limit(LEXICON_TERMS).collect()
    return np.array([r["term"] for r in best], np.int64).view(np.uint64), np.array([r["odds"] for r in best], float)


def _features(spark, lexicon):
    small_batches(spark)
    shared = spark.sparkContext.broadcast(lexicon)  # LEXICON_TERMS entries at most

    @task("toxicity")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extractor = Extractor(shared.value)
        for texts in columns:
            yield pd.Series([extractor.features(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<double>")


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon, trees, calibration, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def with_score(self, docs: DataFrame, column: str) -> DataFrame:
        """``docs`` and their score."""
        if self.trees is None:
            return docs.withColumn(column, F.lit(float(self.share)))
        x, raw, p, label, iso = (f"{n}_{uuid.uuid4().hex}" for n in ("x", "raw", "p", "label", "iso"))
        names = docs.columns
        out = _with_raw(docs, self.lexicon, self.trees, x, raw, p, label)
        if self.calibration is None:
            return out.select(*[F.col(f"`{n}`") for n in names], F.col(p).alias(column))
        out = self.calibration.copy().setFeaturesCol(p).setPredictionCol(iso).transform(out)
        return out.select(*[F.col(f"`{n}`") for n in names], ((1 - BLEND) * F.col(iso) + BLEND * F.col(p)).alias(column))


def _with_raw(docs: DataFrame, lexicon, trees, x: str, raw: str, p: str, label: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    out = docs.withColumn(x, array_to_vector(_features(docs.sparkSession, lexicon)("text")))
    model = trees.copy().setFeaturesCol(x).setRawPredictionCol(raw).setProbabilityCol(p).setPredictionCol(label)
    return model.transform(out).withColumn(p, vector_to_array(p)[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    lexicon = learn_lexicon(docs, labels)
    rest = [f for f in range(FOLDS) if f != HELD_OUT and f not in LEXICON_FOLDS]
    sample = _sample(docs, labels, rest, TRAIN_DOCS, "train")
    rows = sample.select("doc_id", F.col("y").cast("double").alias("y"), _features(docs.sparkSession, lexicon)("text").alias("x"),
                         (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(3)) == 0).alias("calibrate"))
    rows = written(rows, "features").select("y", array_to_vector("x").alias("x"), "calibrate")
    kinds = {(r["calibrate"], r["y"]): r["count"] for r in rows.groupBy("calibrate", "y").count().collect()}
    total = sum(kinds.values())
    share = sum(n for (_, y), n in kinds.items() if y == 1) / total if total else 0.0
    if len({y for _, y in kinds}) < 2:
        return Model(lexicon, None, None, share)
    if len(kinds) < 4:  # too few labels to set some of each kind apart
        trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=2).fit(rows.coalesce(2))
        return Model(lexicon, trees, None, share)
    trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=2).fit(
        rows.filter("not calibrate").coalesce(2))
    raw = trees.transform(rows.filter("calibrate"))
    from pyspark.ml.functions import vector_to_array
    calibration = IsotonicRegression(featuresCol="p", labelCol="y").fit(raw.select("y", vector_to_array("probability")[1].alias("p")))
    return Model(lexicon, trees, calibration, share)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    scored = fit(docs, labels).with_score(docs.select("doc_id", "text"), "score")
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted to be toxic, all columns as they were."""
    mark = "toxicity_" + uuid.uuid4().hex
    model = fit(docs, labels)
    if model.trees is None:  # nothing tells documents apart: all stay
        return docs
    return model.with_score(docs, mark).filter(F.col(mark) < TOXIC).drop(mark)
