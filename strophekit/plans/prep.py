"""Corpus-preparation and reporting compositions: catalogue build (C8),
train/test split with leak guard (C9), input checks and rejects (X3),
scored records (K1), vote study (X5), counts by model family and checkpoint
(A11) and training curves wide -> long (R1, P8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophekit.functions.text import annotation_trim, title_key
from strophekit.operators import relational as R
from strophekit.plans.scoring import REFUSAL_SENTENCES

ANNOTATION_NOISE = ("inside scoop", "bio is unreviewed")  # fixed values


def build_catalogue(lyric_parts: Sequence[DataFrame], songs_meta: DataFrame,
                    order_col: str | None = None) -> DataFrame:
    """Union the scraped parts (id, lyrics, annotation) -> one row per id
    (first by ``order_col``, else by read order) -> drop noise annotations and
    rows with NULLs -> trim annotations -> left join song metadata
    (artist, artist_id, song, song_id) on id = song_id."""
    parts = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(lyric_parts)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    if order_col is None:
        u = u.withColumn("_o", F.monotonically_increasing_id())
        order = ["_part", "_o"]
    else:
        order = [order_col]
    u = R.dedup_first(u, ["id"], order).drop("_part", "_o")
    u = R.drop_substrings(u.select("id", "lyrics", "annotation"), "annotation", ANNOTATION_NOISE)
    u = u.withColumn("annotation", annotation_trim(F.col("annotation")))
    j = R.left_join_keys(u, songs_meta, "id", "song_id")
    return j.select("id", "lyrics", "annotation", "artist", "artist_id", "song")


def split_train_test(songs: DataFrame, artist: str, allowed_titles: DataFrame,
                     raw_titles: Sequence[str], test_ids: DataFrame,
                     order_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """One artist's songs whose cleaned title is in the allowed list (or
    whose raw title is listed), de-duplicated by cleaned title; the test set
    is the chosen ids; training rows whose cleaned title occurs in the test
    set are removed (J6)."""
    a = songs.filter(F.col("artist") == artist).withColumn("_k", title_key(F.col("song")))
    allowed = allowed_titles.select(title_key(F.col(allowed_titles.columns[0])).alias("_k")).distinct() \
        .withColumn("_ok", F.lit(True))
    a2 = a.join(allowed, on="_k", how="left")
    raw = list(raw_titles)
    keep = F.coalesce(F.col("_ok"), F.lit(False)) | (F.col("song").isin(raw) if raw else F.lit(False))
    cand = R.dedup_first(a2.filter(keep).drop("_ok"), ["_k"], [order_col])
    test = R.filter_members(a.drop("_k"), "id", test_ids)
    train = R.leak_guard(cand.drop("_k"), test, title_key(F.col("song")), title_key(F.col("song")))
    return train, test


def check_songs(df: DataFrame, keys: Sequence[str], required: Sequence[str], order: Sequence[str],
                refusal_col: str | None = None,
                sentences: Sequence[str] = REFUSAL_SENTENCES) -> tuple[DataFrame, DataFrame]:
    """Rows failing a check go to a reject table ``(keys, reason)``
    instead of raising: a missing required field, a refusal, or a duplicate
    id (the first valid row by ``order`` wins, a refused one does not
    count)."""
    keys = list(keys)
    reasons = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in required]
    if refusal_col:
        refused = F.lit(False)
        for s in sentences:
            refused = refused | F.coalesce(F.col(refusal_col).contains(s), F.lit(False))
        reasons.append(F.when(refused, F.lit("refused")))
    d = df.withColumn("_why", F.filter(F.array(*reasons), lambda x: x.isNotNull()))
    bad = d.filter(F.size("_why") > 0).select(*keys, F.explode("_why").alias("reason"))
    good = d.filter(F.size("_why") == 0).drop("_why")
    # First valid row per key by a partial (map-side) aggregation; one
    # reject row per extra copy from the per-key count.
    first = R.dedup_first(good, keys, order)
    extra = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    dups = extra.select(*keys, F.explode(F.array_repeat(F.lit("duplicate"), (F.col("_c") - 1).cast("int")))
                        .alias("reason"))
    return first, bad.unionByName(dups)


def scored_records(songs: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K1: song rows with ``pred_scores`` and ``target_scores`` maps
    (measure -> score) from the long score table ``(keys, side, measure,
    score)``; write with ``sources.io.write_json`` to a new path."""
    keys = list(keys)

    def side_map(side):
        return F.map_from_entries(F.collect_list(
            F.when(F.col("side") == side, F.struct("measure", "score"))))
    m = scores.groupBy(*keys).agg(side_map("pred").alias("pred_scores"),
                                  side_map("target").alias("target_scores"))
    return songs.join(m, on=keys, how="inner")


def vote_study(votes: DataFrame, outputs: DataFrame, winner: str, loser: str,
               min_votes: int = 12) -> tuple[DataFrame, DataFrame]:
    """Votes (id, chosen_model) joined to outputs (id, artist) -> counts
    per artist spread by model, win rate with a minimum-vote cut; and the
    overall rate counted before the join."""
    j = R.join_narrowed(votes, outputs, "id", ["artist"])
    counts = R.count_pivot(j, "artist", "chosen_model", [loser, winner])
    return R.win_rates(counts, winner, loser, min_votes), R.overall_rate(votes, "chosen_model", winner, loser)


def counts_by_checkpoint(per_file: DataFrame, path_col: str = "path", count_col: str = "n") -> DataFrame:
    """Per-file counts -> model family and checkpoint (P11) -> sums,
    ordered by family and checkpoint."""
    family, ckpt = R.classify_model_file(F.col(path_col))
    d = per_file.select(family.alias("model"), ckpt.alias("checkpoint"), F.col(count_col).alias("n"))
    out = d.groupBy("model", "checkpoint").agg(F.sum("n").cast("long").alias("count"))
    return out.orderBy("model", "checkpoint")


def curves_long(df: DataFrame, step_col: str = "Step", suffix: str = " - train/loss") -> DataFrame:
    """R1 + P8: a wide training-curve table (one loss column per run, plus
    __MIN/__MAX helper columns) -> ``(step, run, loss)`` without blanks."""
    runs = [c for c in df.columns if c.endswith(suffix)]
    long = df.select(F.col(step_col).alias("step"), *[F.col(f"`{c}`").alias(c[: -len(suffix)]) for c in runs])
    long = long.unpivot(["step"], [c[: -len(suffix)] for c in runs], "run", "loss")
    return long.dropna(subset=["loss"])
