"""Plan-shape guards: the scale properties the README promises."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from strophekit.plans.scoring import score_songs

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_song_scoring_has_no_shuffle(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="stk-plan-"), "songs")
    spark.createDataFrame(
        [(1, "[Verse]\na b\n[Verse]\na c", "[Chorus]\nx\n[Chorus]\ny")],
        "id long, model_response string, target_response string").write.parquet(path)
    songs = spark.read.parquet(path)
    s = score_songs(songs, ["id"], {"pred": "model_response", "target": "target_response"},
                    ["string_similarity", "meter", "diversity_avg_ttr"])
    plan = _plan(s)
    assert "Exchange" not in plan and "Join" not in plan
    assert s.count() == 2 * 3


def test_filter_reaches_scan_without_shuffle(spark):
    df = E.queries()["equality_filter"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src3)]" in plan
    assert "text" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_conversation_scoring_single_exchange(spark):
    plan = _plan(E.queries()["scored_songs"](spark, SF))
    assert plan.count("Exchange") == 1


def test_dedup_is_partial_aggregation(spark):
    plan = _plan(E.queries()["dedup_first"](spark, SF))
    assert "Window" not in plan
    assert "partial_min" in plan


def test_term_counts_no_cross_join(spark):
    plan = _plan(E.queries()["term_counts"](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_ngram_overlap_ships_no_text(spark):
    """Grams are formed in the scan's own tasks; nothing is hinted to be broadcast."""
    from strophekit.operators import corpus as C
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    df = C.ngram_overlap(d, ["doc_id", "source"], "text", b, "text")
    assert "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString()
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = text.split("\n")
    docs = next(i for i, line in enumerate(lines) if "Scan parquet" in line and "doc_id" in line)
    above = lines[:docs]
    generate = max(i for i, line in enumerate(above) if "Generate" in line)
    assert not any("Exchange hashpartitioning" in line for line in above[generate:])


def test_lexicon_lookup_shuffles_no_occurrence(spark):
    """Distinct words of a row meet the lexicon; the row keeps its occurrences."""
    for name in ("line_syllables_lexicon", "diversity_lexicon_by_song"):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(array_distinct(" in plan
        for line in plan.split("\n"):
            if "posexplode" in line:
                assert "split" in line or "_split" in line or "line" in line  # lines of a text, not words
        assert "CartesianProduct" not in plan


def test_ngram_overlap_is_a_semi_join(spark):
    from strophekit.operators import corpus as C
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    key = "spark.sql.autoBroadcastJoinThreshold"
    had = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = C.ngram_overlap(d, ["doc_id"], "text", b, "text")
        assert "LeftSemi" in _plan(df) and "LeftOuter" not in _plan(df)
        assert df.filter("shared > 0").count() > 0 and df.count() == 4 * d.count()
    finally:
        spark.conf.set(key, had)
