"""Line-encoding jobs (E1-E8, J7): tokens -> feature tables.

Shared plan: the distinct words of a row are looked up in the lexicon (a
salted join), what is found comes back as one map column, and the row's
occurrences read that map in place, with the rule for the misses.  Lexica are
inputs; an absent lexicon means the rule alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophekit.functions.syllables import word_syllables as syllable_rule
from strophekit.functions.text import prep_encoding

WORD_RX = r"(?U)\b\w+\b"


def tokens(line: Column) -> Column:
    """``\\b\\w+\\b`` tokens of the T1-folded line."""
    return F.regexp_extract_all(prep_encoding(line), F.lit(WORD_RX), 0)


def distinct_words(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.explode(tokens(F.col(text_col))).alias("word")).distinct()


def syllables_with_lexicon(words: DataFrame, word_col: str, lexicon: DataFrame | None) -> DataFrame:
    """Syllable count from the lexicon (case-sensitive key, first
    entry kept by the lexicon reader) else the rule (E2)."""
    if lexicon is None:
        return words.withColumn("syllables", syllable_rule(F.col(word_col))) \
                    .withColumn("from_lexicon", F.lit(False))
    lex = lexicon.select(F.col("word").alias("_lw"), F.col("num_syllables").alias("_ls"))
    j = words.join(lex, words[word_col] == F.col("_lw"), "left")
    return j.select(*words.columns,
                    F.coalesce(F.col("_ls"), syllable_rule(F.col(word_col))).cast("int").alias("syllables"),
                    F.col("_lw").isNotNull().alias("from_lexicon"))


SALTS = 16


def with_word_map(rows: DataFrame, keys: Sequence[str], words: Column, lexicon: DataFrame, value: Column,
                  name: str) -> DataFrame:
    """``rows`` with a map column: the lexicon's ``value`` of each of the row's ``words``
    that it holds (NULL when it holds none).

    Only distinct (row, word) pairs meet the lexicon, and a word that nearly every
    row holds is dealt over ``SALTS`` places; no occurrence is shuffled by its word.
    A word that the lexicon lists more than once has its least value."""
    keys = list(keys)
    asked = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(F.array_distinct(words)).alias("_w"))
    asked = asked.withColumn("_s", F.pmod(F.xxhash64(*[f"_k{i}" for i in range(len(keys))]), F.lit(SALTS)).cast("int"))
    known = lexicon.select(F.col("word").alias("_w"), value.alias("_v")).groupBy("_w").agg(F.min("_v").alias("_v"))
    known = known.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = asked.join(known, on=["_w", "_s"]).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(
        F.map_from_entries(F.collect_set(F.struct("_w", "_v"))).alias(name))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(found, same, "left").select(*rows.columns, name)


def line_syllables(lines: DataFrame, keys: Sequence[str], line_col: str,
                   lexicon: DataFrame | None = None) -> DataFrame:
    """E5: per line, the syllable count of each word and their total."""
    keys = list(keys)
    toks = tokens(F.col(line_col))
    if lexicon is None:
        enc = F.transform(toks, syllable_rule)
    else:
        lines = with_word_map(lines, keys, toks, lexicon, F.col("num_syllables").cast("int"), "_syl")
        none = F.array().cast("array<string>")
        enc = F.transform(F.coalesce(toks, none), lambda w: F.coalesce(F.try_element_at("_syl", w), syllable_rule(w)))
    out = lines.select(*keys, enc.alias("syllables"))
    return out.withColumn("total", F.aggregate("syllables", F.lit(0), lambda a, x: a + x))


# --- pronunciation lexicon (E6-E8) ----------------------------------------------------
def stress_of(phonemes: Column) -> Column:
    """Last digit of every vowel phoneme of the first pronunciation."""
    return F.array_join(F.transform(F.filter(phonemes, lambda p: p.rlike("[0-9]$")),
                                    lambda p: F.substring(p, -1, 1)), "")


def phoneme_syllables(phonemes: Column) -> Column:
    """Consonants attach to the next vowel; trailing consonants form a
    last syllable."""
    init = F.struct(F.array().cast("array<string>").alias("s"), F.lit("").alias("cur"))
    st = F.aggregate(phonemes, init, lambda acc, p: F.when(
        p.rlike("[0-9]$"),
        F.struct(F.concat(acc["s"], F.array(F.concat(acc["cur"], p))).alias("s"), F.lit("").alias("cur")),
    ).otherwise(F.struct(acc["s"].alias("s"), F.concat(acc["cur"], p).alias("cur"))))
    return F.when(st["cur"] != "", F.concat(st["s"], F.array(st["cur"]))).otherwise(st["s"])


def pronunciation_table(lexicon: DataFrame) -> DataFrame:
    """Per lexicon word: stress digits and phoneme syllables (computed once
    per word, then joined)."""
    return lexicon.select("word", stress_of(F.col("phonemes")).alias("stress"),
                          phoneme_syllables(F.col("phonemes")).alias("phon_syllables"))


def _phonetic_words(line: Column) -> Column:
    clean = F.regexp_replace(line, r"[^\w\s']", "")
    clean = F.regexp_replace(F.translate(clean, ",.!", ""), r"^\s+|\s+$", "")
    return F.transform(F.split(clean, " ", -1), F.lower)


def _phonemes_of(line: Column, pron: str) -> Column:
    """The phoneme syllables of a line's known words, one after another."""
    return F.flatten(F.filter(F.transform(_phonetic_words(line), lambda w: F.try_element_at(pron, w)["phon_syllables"]),
                              lambda p: p.isNotNull()))


def _pronunciation() -> Column:
    """A pronunciation lexicon's value: stress digits and phoneme syllables."""
    return F.struct(stress_of(F.col("phonemes")).alias("stress"), phoneme_syllables(F.col("phonemes")).alias("phon_syllables"))


def line_phonetics(lines: DataFrame, keys: Sequence[str], line_col: str, lexicon: DataFrame) -> DataFrame:
    """E8 per line: keep word characters, spaces and apostrophes, split on
    spaces, look words up lower-cased, unknown words skipped; the line's
    syllables as one array."""
    keys = list(keys)
    none = F.array().cast("array<string>")
    rows = with_word_map(lines, keys, F.coalesce(_phonetic_words(F.col(line_col)), none), lexicon, _pronunciation(), "_pron")
    return rows.select(*keys, F.coalesce(_phonemes_of(F.col(line_col), "_pron"), none).alias("phonemes"))


# --- lexicon-driven stanza encodings (E4-E8 for M6, M7, M15) -------------------------
PHON_SEP = "\u001f"  # joins a line's phoneme syllables into one comparable symbol


def with_lexicon_encodings(arrays: DataFrame, keys: Sequence[str], pron: DataFrame | None = None,
                           syl: DataFrame | None = None, stem: DataFrame | None = None,
                           lemma: DataFrame | None = None,
                           partitions: int | None = None) -> DataFrame:
    """Add lexicon-driven encodings to every stanza of a song-array table:
    ``stress`` (M6 input), ``syl_sums`` (M7 input), ``phon`` (M15 input, one
    symbol per line) and ``div_tokens`` (diversity tokens mapped through the
    lemma lexicon, M12).  The distinct words of a song meet each lexicon once
    (``with_word_map``); stanzas stay in their row and read the maps there.
    ``keys`` name a song."""
    from strophekit.operators.measures import diversity_tokens, stress_tokens
    keys = list(keys)
    songs = arrays.repartition(partitions, *keys) if partitions else arrays
    songs = songs.select(*keys, "stanzas")
    lines = F.flatten(F.transform("stanzas", lambda s: s["lines"]))

    def every(of) -> Column:
        """The words of all lines."""
        return F.flatten(F.transform(lines, of))

    def mapped(songs: DataFrame, words: Column, lexicon: DataFrame | None, value: Column, kind: str, name: str) -> DataFrame:
        if lexicon is None:
            return songs.withColumn(name, F.lit(None).cast(f"map<string,{kind}>"))
        return with_word_map(songs, keys, words, lexicon, value, name)

    def stemmed(line: Column) -> Column:
        return F.transform(stress_tokens(line), lambda w: F.when(w.endswith("ing") | w.endswith("ly"), w).otherwise(
            F.coalesce(F.try_element_at("_stem", w), w)))

    def stress(line: Column) -> Column:
        return F.array_join(F.transform(stemmed(line), lambda w: F.coalesce(
            F.try_element_at("_pron", w)["stress"],
            F.repeat(F.lit("0"), F.coalesce(F.try_element_at("_syl", w), syllable_rule(w))))), "")

    def syllable_sum(line: Column) -> Column:
        counts = F.transform(tokens(line), lambda w: F.coalesce(F.try_element_at("_syl", w), syllable_rule(w)))
        return F.aggregate(counts, F.lit(0), lambda a, x: a + x)

    songs = mapped(songs, every(stress_tokens), stem, F.col("value"), "string", "_stem")
    songs = mapped(songs, F.concat(every(stemmed), every(_phonetic_words)), pron, _pronunciation(),
                   "struct<stress:string,phon_syllables:array<string>>", "_pron")
    songs = mapped(songs, F.concat(every(stemmed), every(tokens)), syl, F.col("num_syllables").cast("int"), "int", "_syl")
    songs = mapped(songs, F.flatten(F.transform("stanzas", lambda s: diversity_tokens(s["lines"]))), lemma, F.col("value"),
                   "string", "_lemma")
    return songs.select(*keys, F.transform("stanzas", lambda s: F.struct(
        s["pos"].alias("pos"), s["keyword"].alias("keyword"), s["lines"].alias("lines"),
        F.regexp_replace(F.array_join(F.transform(s["lines"], stress), ""), r"\s+", "").alias("stress"),
        F.transform(s["lines"], syllable_sum).alias("syl_sums"),
        F.transform(s["lines"], lambda l: F.array_join(_phonemes_of(l, "_pron"), PHON_SEP)).alias("phon"),
        F.transform(diversity_tokens(s["lines"]), lambda w: F.coalesce(F.try_element_at("_lemma", w), w)).alias("div_tokens"))).alias("stanzas"))
