"""Operators 2 and 8: held-out accuracy and odd inputs."""

import zlib

import numpy as np
import pytest

from strophekit.llm import quality, queries, toxicity
from strophekit.llm.common import table
from tests.llm.helpers import frame, odd_documents

SF = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"))
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(label) - ones))


@pytest.mark.parametrize("query,label,folds,held,cut,least", [
    (queries.op8_quality_classifier, "quality", 4, 2, 0.7, 0.95), (queries.op2_toxicity, "toxic", 5, 0, 0.5, 0.85)])
def test_held_out_accuracy(spark, query, label, folds, held, cut, least):
    got = query(spark, SF).toPandas()
    docs = table(spark, SF, "documents")
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= cut)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % folds == held for i in got["doc_id"]]).all()
    both = got.merge(table(spark, SF, "labels").toPandas(), on="doc_id")
    both = both[both["held_out"]]
    assert auc(both["score"].to_numpy(), both[label].to_numpy()) >= least


def test_odd_documents_and_labels(spark):
    rows = [(1, 1, 0), (5, 0, 1), (2, None, None), (99, 1, 1), (None, 1, 0), (6, 1, 0), (6, 1, 0), (7, 0, 1)]
    for labels in (rows, [], [(6, 1, 0)]):
        given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        for module, scores in ((quality, quality.quality_scores), (toxicity, toxicity.toxicity_scores)):
            got = scores(frame(spark), given).collect()
            assert len(got) == len(odd_documents()) and all(0 <= r["score"] <= 1 for r in got)
            kept = module.accepted(frame(spark), given)
            assert kept.columns == frame(spark).columns
            assert scores(frame(spark, []), given).count() == 0


def test_trained_on_toxic_words(spark):
    """A word list that only the labels tell, and insults in disguise."""
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(900):
        words = [f"w{rng.integers(400)}" for _ in range(80)]
        toxic = int(rng.random() < 0.3)
        for at in rng.integers(0, 80, 3 * toxic):
            words[at] = "zorble" + "abcdefgh"[rng.integers(8)]
        docs.append((i, " ".join(words), "en", "s", 0, 0.0, 0, 0, 0, "g"))
        labels.append((i, 1, toxic))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(
        frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert auc(np.array([got[i] for i in held]), np.array([labels[i][2] for i in held])) > 0.95


def test_features():
    names, extract = toxicity.FEATURES, toxicity.Extractor((np.empty(0, np.uint64), np.empty(0))).features
    of = lambda text: dict(zip(names, extract(text)))
    assert of("you are an idiot")["insults_near_you"] == 0.25
    assert of("an IDIOT speaks of trees")["insults"] == 0.2
    assert of("an 1d10t! speaks")["hidden"] > 0 and of("an idiot speaks")["hidden"] == 0
    assert of("ABC def")["capitals"] == 3 / 7
    assert all(np.isfinite(extract(t)).all() for t in ("", None, " ", "!!!", "é", "a" * 10_000))


def test_vector_is_of_unit_length():
    at, x = quality.vector("the cat, the cat")
    assert abs(x @ x - 1) < 1e-9 and len(set(at)) == len(at)
    assert len(quality.vector(None)[0]) == 0


def test_few_labels_of_both_kinds_train_and_none_keep_all(spark):
    """An empty cell of fold and label neither stops training nor drops documents."""
    docs = [(i, "you idiot fool" if i % 3 == 0 else "a calm walk by the sea", "en", "s", 0, 0.0, 0, 0, 0, "g") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(12)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in toxicity.accepted(frame(spark, docs), labels).collect()}
    assert {i for i in range(40) if i % 3} <= kept
    one = spark.createDataFrame([(i, 1, 1) for i in range(12)], "doc_id long, quality int, toxic int")
    assert toxicity.accepted(frame(spark, docs), one).count() == 40
