"""Scoring plans (X1-X4): songs -> stanzas -> pairs -> measures -> averages.

Everything is keyed by the song identity ``keys``.  The song table is hash
partitioned on those keys once; the stanza explode is narrow, the pair
self-join and the per-song aggregation reuse that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophekit.operators import measures as M
from strophekit.operators.structure import matching_from_array, parse_song_arrays

REFUSAL_SENTENCES = ("I apologize, but I cannot fulfill your request",)  # fixed value


def score_stanzas(stanzas: DataFrame, songs: DataFrame, keys: Sequence[str],
                  measure_names: Sequence[str], empty: str = "zero") -> DataFrame:
    """Song-level scores ``(keys, measure, score, n_pairs)`` from a stanza
    table (rows).  The stanzas of a song are gathered into one row (one
    aggregation keyed by the song) and scored there."""
    arrays = M.stanza_rows_to_arrays(stanzas, songs, keys)
    return M.score_song_arrays(arrays, keys, measure_names, "stanzas", empty)


def refuse_filter(df: DataFrame, text_col: str,
                  sentences: Sequence[str] = REFUSAL_SENTENCES) -> DataFrame:
    """P5: drop songs whose answer holds a refusal sentence."""
    cond = F.lit(True)
    for s in sentences:
        cond = cond & ~F.coalesce(F.col(text_col).contains(s), F.lit(False))
    return df.filter(cond)


def score_songs(songs: DataFrame, keys: Sequence[str], sides: dict[str, str],
                measure_names: Sequence[str], refusal_col: str | None = None,
                empty: str = "zero") -> DataFrame:
    """Score every side (e.g. ``{'pred': 'model_response', 'target':
    'target_response'}``) of every song.  Missing sides (NULL text) yield no
    rows for that side.  Output ``(keys, side, measure, score, n_pairs)``.

    Parsing, pairing and scoring all happen inside the song row: the plan
    is scan -> project -> generate, with no shuffle."""
    keys = list(keys)
    names = M.resolve_measures(measure_names)  # fail before any job
    if refusal_col:
        songs = refuse_filter(songs, refusal_col)
    skeys = keys + ["side"]
    arrays = parse_song_arrays(_sides(songs, keys, sides), "text", skeys)
    return M.score_song_arrays(arrays, skeys, names, "stanzas", empty)


def _sides(songs: DataFrame, keys: Sequence[str], sides: dict[str, str]) -> DataFrame:
    """One row per song and side that has a text."""
    stack = F.inline_outer(F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(c).cast("string").alias("text"))
        for s, c in sides.items()]))
    return songs.select(*keys, stack).filter(F.col("text").isNotNull())


def score_checked_songs(songs: DataFrame, keys: Sequence[str], sides: dict[str, str], measure_names: Sequence[str],
                        order: Sequence[str], required: Sequence[str] = (), refusal_col: str | None = None,
                        empty: str = "zero") -> tuple[DataFrame, DataFrame]:
    """X1 with its input rules: ``(scores, rejects)``.  Rows with a missing required
    field or a refusal, further rows of an id (the first by ``order`` counts), and sides
    with too many labels (T9) go to ``rejects`` as ``(keys, reason)``; all others are
    scored as by ``score_songs``."""
    from strophekit.plans.prep import check_songs
    keys = list(keys)
    names = M.resolve_measures(measure_names)
    good, rejects = check_songs(songs, keys, required, order, refusal_col)
    skeys = keys + ["side"]
    arrays = parse_song_arrays(_sides(good, keys, sides), "text", skeys)
    error = matching_from_array(F.col("stanzas"))[1]
    # Both sides of the split pass through a generator: a filter on a parsed column would
    # be pushed below the parse, which is then written out once per use inside it.
    labels = arrays.select(*keys, F.explode_outer(F.array(F.concat(error, F.lit(":"), F.col("side")))).alias("reason")).filter(F.col("reason").isNotNull())
    kept = arrays.select(*skeys, F.explode_outer(F.when(error.isNull(), F.array("stanzas"))).alias("stanzas"))
    scores = M.score_song_arrays(kept.filter(F.col("stanzas").isNotNull()), skeys, names, "stanzas", empty)
    return scores, rejects.unionByName(labels)
