"""Checked songs (X1 with its input rules): the parse stands once in the plan of either result."""

from strophekit.operators.structure import DOUBLE_NL
from strophekit.plans.scoring import score_checked_songs

MANY = "\n\n".join(f"[label{chr(97 + i)}]\nla la" for i in range(11))
SONG = "[Verse 1]\nsun and moon\n\n[Verse 2]\nsun or moon"


def checked(spark):
    df = spark.createDataFrame([(1, 1, SONG, SONG), (1, 2, SONG, SONG), (2, 1, f"[Intro]\nla\n\n{MANY}", SONG),
                                (3, 1, SONG, None), (4, 1, " ", "")], "id long, seen int, text string, other string")
    return score_checked_songs(df, ["id"], {"pred": "text", "target": "other"}, ["string_similarity"], ["seen"], ["text", "other"])


def test_the_parse_stands_once_in_the_plan(spark):
    for df in checked(spark):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(DOUBLE_NL) == 1


def test_scores_and_rejects_split_by_side(spark):
    scores, rejects = checked(spark)
    got = {(r["id"], r["side"]): (round(r["score"], 6), r["n_pairs"]) for r in scores.collect()}
    one = (round(3 / 11, 6), 1)  # "and" against "or": three edits, the shorter line has 11 letters
    assert got == {(1, "pred"): one, (1, "target"): one, (2, "target"): one, (4, "pred"): (0.0, 0), (4, "target"): (0.0, 0)}
    assert sorted(map(tuple, rejects.collect())) == [(1, "duplicate"), (2, "labels:pred"), (3, "missing:other")]
