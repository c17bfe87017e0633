"""Compositions of the corpus-preparation and reporting plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophekit.plans import prep as P


def test_catalogue(spark):
    a = spark.createDataFrame([(1, "la la", "12 contributors Great song Expand +more"),
                               (2, "oh", "inside scoop here")], "id long, lyrics string, annotation string")
    b = spark.createDataFrame([(1, "dup", "x"), (3, "hey", None)], "id long, lyrics string, annotation string")
    meta = spark.createDataFrame([("Ann", 7, "Song A", 1)], "artist string, artist_id long, song string, song_id long")
    got = [tuple(r) for r in P.build_catalogue([a, b], meta).collect()]
    assert got == [(1, "la la", " Great song ", "Ann", 7, "Song A")]


def test_split(spark):
    songs = spark.createDataFrame(
        [(1, "Love Story (Taylor's Version)", "Ann"), (2, "love story", "Ann"), (3, "Red", "Ann"),
         (4, "Gone", "Ann"), (5, "Red", "Bob"), (6, "Extra", "Ann")],
        "id long, song string, artist string")
    allowed = spark.createDataFrame([("Love Story",), ("Red",), ("Gone",)], "title string")
    test_ids = spark.createDataFrame([(4,)], "id long")
    train, test = P.split_train_test(songs, "Ann", allowed, ["Extra"], test_ids)
    assert sorted(r["id"] for r in train.collect()) == [1, 3, 6]
    assert [r["id"] for r in test.collect()] == [4]


def test_check_songs(spark):
    df = spark.createDataFrame(
        [(1, "a", "t"), (1, "b", "t"), (2, None, "t"), (3, "I apologize, but I cannot fulfill your request", "t")],
        "id long, model_response string, target_response string")
    good, rejects = P.check_songs(df, ["id"], ["model_response", "target_response"], ["model_response"],
                                  refusal_col="model_response")
    assert [(r["id"], r["model_response"]) for r in good.collect()] == [(1, "a")]
    assert sorted(tuple(r) for r in rejects.collect()) == [(1, "duplicate"), (2, "missing:model_response"),
                                                           (3, "refused")]


def test_scored_records(spark):
    songs = spark.createDataFrame([(1, "x")], "id long, song string")
    scores = spark.createDataFrame([(1, "pred", "meter", 0.5), (1, "target", "meter", 0.25)],
                                   "id long, side string, measure string, score double")
    r = P.scored_records(songs, scores, ["id"]).first()
    assert r["pred_scores"] == {"meter": 0.5} and r["target_scores"] == {"meter": 0.25}


def test_vote_study(spark):
    votes = spark.createDataFrame([(1, "tuned"), (2, "base"), (1, "tuned")], "id long, chosen_model string")
    outs = spark.createDataFrame([(1, "Ann"), (2, "Ann")], "id long, artist string")
    rates, overall = P.vote_study(votes, outs, "tuned", "base", min_votes=1)
    r = rates.first()
    assert (r["tuned"], r["base"], r["num_votes"]) == (2, 1, 3)
    assert abs(overall.first()["win_rate"] - 2 / 3) < 1e-12


def test_counts_by_checkpoint(spark):
    df = spark.createDataFrame(
        [("tuned-chat-checkpoint-100-temp-1-test-outputs.json", 3),
         ("tuned-chat-checkpoint-50-test-outputs.json", 2),
         ("llama-2-7b-chat-test-outputs.json", 5), ("tuned-checkpoint-150-test-outputs.json", 1)],
        "path string, n long")
    got = [tuple(r) for r in P.counts_by_checkpoint(df).collect()]
    assert got == [("tuned", 150, 1), ("tuned-chat", 0, 5), ("tuned-chat", 50, 2), ("tuned-chat-temp-1", 100, 3)]


def test_curves_long(spark):
    df = spark.createDataFrame([(1, 1.5, 1.6, None), (2, 1.2, None, None)],
                               "Step int, `a - train/loss` double, `b - train/loss` double, "
                               "`a - train/loss__MIN` double")
    got = sorted(tuple(r) for r in P.curves_long(df).collect())
    assert got == [(1, "a", 1.5), (1, "b", 1.6), (2, "a", 1.2)]
