"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.  Each query is forced to completion with the
``noop`` sink (every row computed, nothing collected)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "string_similarity_by_song",   # X1 slice: stanzas -> pairs -> M3 -> A12 -> M16
    "parsed_stanzas",              # T1-T8 parser over rebuilt song texts
    "scored_songs",                # X1 end to end: parse + pair + score in-row
    "meter_by_song",               # M6 with the syllable rule
    "syllable_by_song",            # M7/M8 DTW (batched pandas UDF)
    "diversity_mtld_by_song",      # M9 (batched pandas UDF)
    "ngram_overlap_by_model",      # M20
    "term_totals",                 # A10
    "aligned_similarity",          # M17
    "scores_by_model_and_measure", # X4: prune, scale, exact median/mean table
    "vote_win_rates",              # X5: A3/A4
    "box_summary",                 # A8
    "dedup_first",                 # D1
    "round_robin_shard",           # W3
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from strophekit.session import get_spark
    from strophekit.plans.catalog import load
    QUERIES = load()[0]

    spark = get_spark("strophekit-bench", cores=cpus)
    # Session warm-up (JVM JIT, Python workers); not a headline query.
    spark.range(0, 100000, numPartitions=cpus).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
