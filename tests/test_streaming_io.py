"""Streaming scorer and source readers on small files written by the test."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from strophekit.sources import io as IO
from strophekit.streaming.incremental import score_stream

SONG = "[Verse 1]\nred sky\nlow tide\n[Chorus]\nsing it on\n[Verse 2]\nred sea\nlow tide now"


def test_score_stream(spark):
    root = tempfile.mkdtemp(prefix="stk-stream-")
    src = os.path.join(root, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        for i in range(3):
            f.write(json.dumps({"id": i, "model_response": SONG, "target_response": SONG}) + "\n")
    q = score_stream(spark, src, os.path.join(root, "out"), os.path.join(root, "ckpt"), once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(root, "out"))
    assert out.count() == 3 * 2 * 3
    r = out.filter("measure = 'string_similarity'").select(F.max("score")).first()[0]
    assert abs(r - (2 / 7 + 4 / 8) / 2) < 1e-9


def test_readers(spark):
    root = tempfile.mkdtemp(prefix="stk-io-")
    arr = os.path.join(root, "db.json")
    with open(arr, "w") as f:
        json.dump([{"id": 1, "model_response": "a", "target_response": "b"},
                   {"id": 2, "model_response": "c", "target_response": "d"}], f)
    assert IO.read_json_array(spark, arr).count() == 2
    lex = os.path.join(root, "syl.txt")
    with open(lex, "w") as f:
        f.write("table=ta-ble\nrhythm=rhythm\ntable=t-a-b-l-e\n")
    got = {r["word"]: r["num_syllables"] for r in IO.read_syllable_lexicon(spark, lex).collect()}
    assert got == {"table": 2, "rhythm": 1}
    words = os.path.join(root, "w.txt")
    with open(words, "w") as f:
        f.write("hot\n\ncold\n")
    assert sorted(r["word"] for r in IO.read_word_list(spark, words, pad=True).collect()) == [" cold ", " hot "]
    votes = os.path.join(root, "votes.txt")
    with open(votes, "w") as f:
        f.write('[{"1": "tuned", "2": "base"}, {"1": "base"}]')
    v = IO.read_votes(spark, votes)
    assert v.count() == 3
    csv = os.path.join(root, "c")
    df = spark.createDataFrame([(1, "line one\nline \"two\"", "x")], IO.LYRICS_SCHEMA)
    IO.write_csv(df, csv)
    back = IO.read_csv(spark, csv, IO.LYRICS_SCHEMA).first()
    assert back["lyrics"] == "line one\nline \"two\""
