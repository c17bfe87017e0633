"""Song-structure job (T1-T10, W1): raw song text -> stanza table.

All parsing steps are column expressions evaluated per row, followed by a
single ``posexplode``; no shuffle, no Python.  Output schema::

    <keys...>, pos INT, keyword STRING, lines ARRAY<STRING>

``pos`` is renumbered after blank stanzas are removed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophekit.functions.text import fold_ascii, non_blank_lines, strip_ws

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
# Stanza keywords (29), in the reference's order:
STANZA_KEYWORDS = (
    "pre-hook", "post-hook", "pre-drop", "pre-chorus", "post-chorus",
    "pre-coro", "post-coro", "breakdown", "drop", "hook", "verse", "chorus",
    "bridge", "intro", "outro", "refrain", "guitar solo", "solo", "letra de",
    "instrumental", "verso", "coro", "couplet", "pont", "ponte", "interlude",
    "part", "refrão", "refrao",
)
# Clean-up patterns (regular expressions), in the order they are applied:
NOISE_SQUARE = r"\[\?\]|\[chuckles\]|\[laughs\]|\[Mumbling\]"
NOISE_ROUND = r"\(\?\)|\(chuckles\)|\(laughs\)|\(Mumbling\)"
DOTS_SQUARE = r"\[\.*?\]"
DOTS_ROUND = r"\(\.*?\)"
HEADER = r"((\[|\()([\s\S]*?)(\]|\)))|(?<=\n)[^:\n]*:"
SQUARE = r"\[([\s\S]*?)\]"
SQUARE_NOGROUP = r"\[(?:[\s\S]*?)\]"
DOUBLE_NL = r"(?<!\])\n\n(?!(\[)([\s\S]*?)(\]))"
# ---------------------------------------------------------------------------

# Keyword tests.  Any keyword may prefix a header (a boolean test); when a
# stanza is labelled, the longest keyword prefix wins (the reference iterates
# a hash set, so its choice between 'pont' and 'ponte' is arbitrary).
_KW_ALT = "|".join(re.escape(k) for k in sorted(STANZA_KEYWORDS, key=len, reverse=True))
_KW_PREFIX = f"^(?:{_KW_ALT})"
_KW_CAPTURE = f"^({_KW_ALT})"


def header_keyword(m: Column) -> Column:
    """Keyword text of a header candidate: part before ':', digits and
    brackets removed, stripped."""
    head = F.split_part(m, F.lit(":"), F.lit(1))
    head = F.regexp_replace(F.regexp_replace(head, r"\d+", ""), r"[\[\]()]", "")
    return strip_ws(head)


def is_keyword_header(m: Column) -> Column:
    return header_keyword(m).rlike(_KW_PREFIX)


def _canonical_header(m: Column) -> Column:
    kw = header_keyword(m)
    return F.when(kw.rlike(_KW_PREFIX), F.concat(F.lit("["), kw, F.lit("]\n"))).otherwise(m)


def clean_song(df: DataFrame, text_col: str, out_col: str = "_clean",
               cut: str = "first") -> DataFrame:
    """T1-T6 as a chain of projections (see module doc).

    Each intermediate is its own projection: an expensive expression used
    more than once is then computed once per row (the optimizer does not
    collapse projections that would duplicate it).
    """
    keep = [c for c in df.columns]
    t = F.concat(F.lit("\n"), F.lower(fold_ascii(F.col(text_col))))
    t = F.regexp_replace(t, NOISE_SQUARE, "nan")
    t = F.regexp_replace(t, NOISE_ROUND, "nan")
    t = F.replace(t, F.lit("]:"), F.lit("]\n"))
    t = F.replace(t, F.lit("):"), F.lit(")\n"))
    t = F.regexp_replace(t, DOTS_SQUARE, "nan")
    t = F.regexp_replace(t, DOTS_ROUND, "nan")
    d = df.withColumn("_t", t)

    # T4: rewrite keyword headers.  Matches and the pieces between them come
    # from the same regex engine, so they interleave exactly.
    d = d.withColumns({"_ms": F.regexp_extract_all("_t", F.lit(HEADER), 0),
                       "_ps": F.split("_t", HEADER, -1)})
    rest = F.zip_with("_ms", F.slice("_ps", 2, F.size("_ps") - 1),
                      lambda m, p: F.concat(_canonical_header(m), F.coalesce(p, F.lit(""))))
    d = d.select(*keep, F.concat(F.element_at("_ps", 1), F.array_join(rest, "")).alias("_t2"))

    # T5: cut the preamble before the first keyword header in square brackets.
    d = d.withColumns({"_bs": F.regexp_extract_all("_t2", F.lit(r"\[[\s\S]*?\]"), 0),
                       "_qs": F.split("_t2", r"\[[\s\S]*?\]", -1)})
    d = d.withColumn("_k", F.array_position(F.transform("_bs", is_keyword_header), True).cast("int"))
    fdi = F.when(
        F.col("_k") > 0,
        F.length(F.array_join(F.slice("_qs", F.lit(1), F.col("_k")), ""))
        + F.length(F.array_join(F.slice("_bs", F.lit(1), F.col("_k") - 1), "")),
    ).otherwise(F.lit(0))
    d = d.select(*keep, "_t2", fdi.alias("_fdi"))
    d = d.select(*keep, "_fdi", F.col("_t2").substr(F.col("_fdi") + 1, F.length("_t2") + 1).alias("_t3"))
    if cut == "none":
        return d.select(*keep, F.col("_t3").alias(out_col))

    # Cut at the first paragraph break (not after ']' and not before a
    # bracket) whose offset, counted in the sliced text, is >= the preamble
    # length (the reference compares after slicing).
    d = d.withColumn("_pc", F.split("_t3", DOUBLE_NL, -1))
    cut_at = F.aggregate(
        F.slice("_pc", 1, F.size("_pc") - 1),
        F.struct(F.lit(0).alias("off"), F.lit(-1).alias("cut")),
        lambda acc, p: F.struct(
            (acc["off"] + F.length(p) + 2).alias("off"),
            F.when((acc["cut"] < 0) & (acc["off"] + F.length(p) >= F.col("_fdi")),
                   acc["off"] + F.length(p)).otherwise(acc["cut"]).alias("cut"),
        ),
        lambda acc: acc["cut"],
    )
    d = d.select(*keep, "_t3", cut_at.alias("_cut"))
    return d.select(*keep, F.when(F.col("_cut") >= 0, F.col("_t3").substr(F.lit(1), F.col("_cut")))
                    .otherwise(F.col("_t3")).alias(out_col))


def stanza_array(df: DataFrame, text_col: str, out_col: str = "_st",
                 cut: str = "first") -> DataFrame:
    """Adds ``ARRAY<STRUCT<keyword, body>>`` of non-blank stanzas."""
    keep = list(df.columns)
    d = clean_song(df, text_col, "_clean", cut)
    d = d.select(*keep, F.regexp_extract_all("_clean", F.lit(SQUARE), 1).alias("_h"),
                 F.split("_clean", SQUARE_NOGROUP, -1).alias("_b"))
    bodies = F.slice("_b", 2, F.size("_b") - 1)
    pairs = F.zip_with(
        "_h", bodies,
        lambda h, b: F.struct(
            F.when(F.regexp_extract(h, _KW_CAPTURE, 1) != "",
                   F.regexp_extract(h, _KW_CAPTURE, 1)).otherwise(h).alias("keyword"),
            F.coalesce(b, F.lit("")).alias("body"),
        ),
    )
    return d.select(*keep, F.filter(pairs, lambda s: strip_ws(s["body"]) != "").alias(out_col))


def parse_songs(df: DataFrame, text_col: str, keys: Sequence[str],
                cut: str = "first") -> DataFrame:
    """Songs -> stanza table ``(keys, pos, keyword, lines)``."""
    keys = list(keys)
    arr = stanza_array(df.select(*keys, text_col), text_col, "_st", cut)
    # posexplode_outer + a NULL filter: a plain explode makes the optimizer
    # infer ``size(_st) > 0`` and push that copy of the whole parse below
    # the projections, which would run it twice.
    out = arr.select(*keys, F.posexplode_outer("_st").alias("pos", "_s"))
    out = out.filter(F.col("pos").isNotNull())
    return out.select(*keys, out["pos"].cast("int").alias("pos"),
                      F.col("_s.keyword").alias("keyword"),
                      non_blank_lines(F.col("_s.body")).alias("lines"))


def parse_song_arrays(df: DataFrame, text_col: str, keys: Sequence[str],
                      cut: str = "first") -> DataFrame:
    """Songs -> one row per song with ``stanzas ARRAY<STRUCT<pos, keyword,
    lines>>`` (T1-T8 without leaving the row)."""
    keys = list(keys)
    arr = stanza_array(df.select(*keys, text_col), text_col, "_st", cut)
    st = F.transform("_st", lambda s, i: F.struct(i.alias("pos"), s["keyword"].alias("keyword"),
                                                  non_blank_lines(s["body"]).alias("lines")))
    return arr.select(*keys, st.alias("stanzas"))


def stanza_arrays_from_rows(df: DataFrame, keys: Sequence[str], order_col: str,
                            keyword_col: str, text_col: str) -> DataFrame:
    """Rows that are already stanzas -> one row per song with its ordered
    stanza array (same normalisation as the parser; blank stanzas dropped,
    ``pos`` renumbered).  One aggregation keyed by the song; a group holds
    the stanzas of one song."""
    keys = list(keys)
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col(order_col).alias("o"), F.col(keyword_col).alias("keyword"),
        non_blank_lines(normalise_text(F.col(text_col))).alias("lines")))).alias("_s"))
    kept = F.filter("_s", lambda s: F.size(s["lines"]) > 0)
    st = F.transform(kept, lambda s, i: F.struct(i.alias("pos"), s["keyword"].alias("keyword"),
                                                 s["lines"].alias("lines")))
    return g.select(*keys, st.alias("stanzas"))


def matching_from_array(st: Column) -> tuple[Column, Column]:
    """W1 + T9 inside a song row: label code = number of distinct labels
    seen before the label's first stanza; error when some stanza follows
    the 10th distinct label."""
    kws = F.transform(st, lambda s: s["keyword"])
    codes = F.transform(kws, lambda k: F.size(F.array_distinct(
        F.slice(kws, 1, F.array_position(kws, k).cast("int") - 1))))
    matching = F.array_join(F.transform(codes, lambda c: c.cast("string")), "-")
    n = F.size(kws)
    before_last = F.size(F.array_distinct(F.slice(kws, 1, F.greatest(n - 1, F.lit(0)))))
    return matching, F.when(before_last >= 10, F.lit("labels"))


def normalise_text(c: Column) -> Column:
    """The song-level normalisation the parser applies (fold, lower)."""
    return F.lower(fold_ascii(c))


def stanzas_from_rows(df: DataFrame, keys: Sequence[str], order_col: str,
                      keyword_col: str, text_col: str) -> DataFrame:
    """Stanza table from rows that are already stanzas (one row per stanza).

    Text gets the same normalisation as parsed songs; blank stanzas are
    dropped and ``pos`` is renumbered densely within each song.
    """
    keys = list(keys)
    lines = non_blank_lines(normalise_text(F.col(text_col)))
    st = df.select(*keys, F.col(order_col).alias("_o"),
                   F.col(keyword_col).alias("keyword"), lines.alias("lines"))
    st = st.filter(F.size("lines") > 0)
    from strophekit.operators.relational import position_index
    return position_index(st, keys, "_o", "_n").select(*keys, (F.col("_n") - 1).cast("int").alias("pos"),
                                                       "keyword", "lines")


def stanza_matching(stanzas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """W1 + T9: label code by first appearance, matching string '0-1-0', and
    the label-cap flag (a stanza after the 10th distinct label fails)."""
    keys = list(keys)
    w_kw = Window.partitionBy(*keys, "keyword")
    first = stanzas.withColumn("_first", F.min("pos").over(w_kw))
    coded = first.withColumn(
        "code", (F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first")) - 1).cast("int"))
    # A group holds the stanzas of one text, so it is bounded by text size.
    agg = coded.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("_c"),
        F.max("pos").alias("_last"),
    )
    codes = F.transform("_c", lambda s: s["code"])
    # match_idx before stanza i = number of distinct labels among stanzas < i
    # = max code among them + 1; it fails when that reaches 10.
    before_last = F.filter("_c", lambda s: s["pos"] < F.col("_last"))
    max_before = F.aggregate(before_last, F.lit(-1), lambda a, s: F.greatest(a, s["code"]))
    return agg.select(
        *keys,
        F.array_join(F.transform(codes, lambda c: c.cast("string")), "-").alias("matching"),
        F.when(max_before + 1 >= 10, F.lit("labels")).alias("error"),
    )


def keyword_in_context(df: DataFrame, text_col: str, pattern: str, keys: Sequence[str],
                       before: int = 50, after: int = 50) -> DataFrame:
    """Every match of ``pattern`` with up to ``before``/``after``
    characters of context on the same line."""
    rx = f".{{0,{before}}}{pattern}.{{0,{after}}}"
    out = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(rx), 0))
                    .alias("match_no", "context"))
    return out.withColumn("match_no", F.col("match_no").cast("int"))
