"""Numbers over any orderable key, ties, heavy values, nulls."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strophekit.operators import relational as R


def _rows(n=3000):
    day = dt.datetime(2020, 1, 1)
    return [("hot" if i % 2 else [None, "a", "é", "zz"][i % 4], day + dt.timedelta(minutes=i % 7), i, f"g{i % 3}" if i % 5 else None)
            for i in range(n)]


def _key(*vals):
    return [(v is not None, v.encode() if isinstance(v, str) else v) for v in vals]


def test_string_and_timestamp_keys_with_a_value_on_half_the_rows(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "s string, t timestamp, i long, g string").repartition(5)
    for order, at in (("s", 0), ("t", 1)):
        got = R.global_row_index(df, order, tie=["i"]).collect()
        want = sorted(rows, key=lambda r: _key(r[at], r[2]))
        assert [r["i"] for r in sorted(got, key=lambda r: r["row_no"])] == [r[2] for r in want]
        assert sorted(r["row_no"] for r in got) == list(range(1, len(rows) + 1))


def test_whole_row_breaks_ties_and_equal_rows_get_distinct_numbers(spark):
    df = spark.createDataFrame([("k", 1), ("k", 2), ("k", 2), (None, 3)], "s string, i long")
    got = R.global_row_index(df, "s").collect()
    assert sorted(r["row_no"] for r in got) == [1, 2, 3, 4]
    assert next(r["row_no"] for r in got if r["s"] is None) == 1


def test_positions_inside_groups_null_group_included(spark):
    rows = _rows(900)
    df = spark.createDataFrame(rows, "s string, t timestamp, i long, g string")
    got = R.position_index(df, ["g"], "s").collect()
    for g in {r[3] for r in rows}:
        mine = sorted((r["position"], r["s"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1))
        assert [s for _, s in mine] == sorted((s for _, s in mine), key=_key)


def test_slices_and_shards_of_a_string_key(spark):
    df = spark.createDataFrame([(f"w{i:03d}",) for i in range(100)], "w string")
    got = sorted((r["row_no"], r["w"]) for r in R.row_slice(df, "w", 10, 5).collect())
    assert got == [(i, f"w{i:03d}") for i in range(10, 15)]
    shards = {r["w"]: r["shard"] for r in R.round_robin_shard(df, "w", 8).collect()}
    assert all(shards[f"w{i:03d}"] == (i + 1) % 8 for i in range(100))
    assert R.global_row_index(df.filter("w is null"), "w").count() == 0


def test_no_job_while_the_plan_is_built(spark):
    df = spark.range(50).withColumn("s", F.col("id").cast("string"))
    sc = spark.sparkContext
    sc.setJobGroup("numbers", "numbers")
    try:
        R.round_robin_shard(df, "s", 3)
        assert not sc.statusTracker().getJobIdsForGroup("numbers")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_numbers_hold_when_columns_are_pruned(spark):
    df = spark.createDataFrame(_rows(), "s string, t timestamp, i long, g string").repartition(7)
    numbers = [r[0] for r in R.global_row_index(df, "s").select("row_no").collect()]
    assert sorted(numbers) == list(range(1, 3001))


def test_buckets_are_even(spark):
    """No bucket holds much more than its share, the last one included."""
    n = 64 * 32 * 2 - 100  # nearly two rows for every sampled key
    df = spark.range(n).withColumn("s", F.format_string("%05d", "id")).repartition(4)
    keyed = R._bucketed(df, ["s"], 64, None)
    sizes = [r["count"] for r in keyed.groupBy("_bkt").count().collect()]
    assert len(sizes) > 48 and max(sizes) < 3 * n / 64
