"""First entries over many files and splits, many model files in one scan; M11."""

from __future__ import annotations

import json
import random
import time

import numpy as np
from pyspark.sql import functions as F

from strophekit.operators import measures as M
from strophekit.sources import io as IO


def test_first_entry_over_files_and_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"w{i}=a-{i}" for i in range(2000)) + "\nw3=late-late-late\n")
    (tmp_path / "b.txt").write_text("w3=b\nonly=b-b\n")
    key = "spark.sql.files.maxPartitionBytes"
    had = spark.conf.get(key)
    try:
        for size in (had, "4k"):  # one split a file, and many
            spark.conf.set(key, size)
            got = {r["word"]: r["num_syllables"] for r in IO.read_syllable_lexicon(spark, str(tmp_path)).collect()}
            assert len(got) == 2001 and got["w3"] == 1 and got["only"] == 2
    finally:
        spark.conf.set(key, had)


def _files(tmp_path):
    for name, ids in (("one.json", [1, 2]), ("two.json", [3]), ("stray.json", [4, 5])):
        (tmp_path / name).write_text("".join(json.dumps({"id": i, "song": name}) + "\n" for i in ids))


def test_many_models_in_one_scan(spark, tmp_path):
    _files(tmp_path)
    models = spark.createDataFrame([("one.json", "m1"), ("two.json", "m2"), ("none.json", "m3")], "file string, model string")
    rows, rejects = IO.read_model_folder(spark, str(tmp_path), models, multiline=False)
    assert sorted((r["id"], r["model"]) for r in rows.collect()) == [(1, "m1"), (2, "m1"), (3, "m2")]
    assert [tuple(r) for r in rejects.collect()] == [("stray.json", 2)]
    assert rows.select("*")._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1


def test_named_files_and_folders_in_one_scan(spark, tmp_path):
    _files(tmp_path)
    inner = tmp_path / "folder"
    inner.mkdir()
    (inner / "part.json").write_text(json.dumps({"id": 9}) + "\n")
    paths = {"m1": str(tmp_path / "one.json"), "m2": f"file://{tmp_path}/two.json", "m3": str(inner), "out": str(tmp_path / "stray.json")}
    got = IO.read_model_outputs(spark, paths, skip="stray", multiline=False)
    assert sorted((r["id"], r["model"]) for r in got.collect()) == [(1, "m1"), (2, "m1"), (3, "m2"), (9, "m3")]
    assert got.select("*")._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    assert got.filter(F.col("model") == "m2").count() == 1


def _plain(tokens):
    n, out = len(tokens), []
    for s in range(n):
        seen = set()
        for j in range(n):
            seen.add(tokens[(s + j) % n])
            if j + 1 >= 10 and len(seen) / (j + 1) <= 0.72:
                out.append(j + 1)
                break
    return float(np.mean(out)) if out else 0.0


def test_moving_average_mtld_equals_the_definition_and_is_fast():
    rng = random.Random(1)
    for _ in range(300):
        tokens = [f"w{rng.randint(0, rng.choice([3, 8, 30, 200]))}" for _ in range(rng.randint(0, 120))]
        assert _plain(tokens) == M.mtld_ma_wrap_value(tokens)
    began = time.process_time()
    assert M.mtld_ma_wrap_value([str(i) for i in range(20_000)]) == 0.0
    assert time.process_time() - began < 3  # about 0.2 s; walking every window takes minutes
