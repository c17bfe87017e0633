"""Line-encoding queries (E1, E2, E5, E7 with empty lexicons, M6, M7 at
offset 0) and the lexicon lookup job (J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophekit.functions import syllables as SY
from strophekit.functions.text import prep_encoding
from strophekit.operators import encode as EN
from strophekit.operators import measures as M
from strophekit.operators.structure import non_blank_lines, normalise_text
from strophekit.plans.catalog import ORACLES, r6, register, table
from strophekit.plans.q_songs import SONG_MEAN, SQL_STANZAS, conversation_songs

_V = "('e', 'a', 'o', 'u', 'i')"


def _in(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def sql_syllable(x: str) -> str:
    """DuckDB form of the syllable rule (E2) for a word expression ``x``
    (numbers spelled first, E3); the lower-cased word is bound once through
    a one-element ``list_transform``."""
    w = "_lw"
    cnt = lambda p: f"len(regexp_extract_all({w}, '{p}'))"
    pairs, triples = cnt("[eaoui][eaoui]"), cnt("[eaoui][eaoui][eaoui]")
    vc, vowels = cnt("[eaoui][^eaoui]"), cnt("[eaoui]")
    sfx = lambda s: f"suffix({w}, '{s}')"
    ch = lambda i: f"substr({w}, {i}, 1)"
    disc = (f"(CASE WHEN ({sfx('es')} OR {sfx('ed')}) AND ({pairs} > 1 OR {vc} > 1) AND NOT ("
            f"{sfx('ted')} OR {sfx('tes')} OR {sfx('ses')} OR {sfx('ied')} OR {sfx('ies')}) THEN 1 ELSE 0 END"
            f" + CASE WHEN {sfx('e')} AND NOT ({sfx('le')} AND {w} NOT IN {_in(SY.LE_EXCEPT)}) THEN 1 ELSE 0 END"
            f" + {pairs} + {triples} + CASE WHEN {w} IN {_in(SY.EXCEPTION_DEL)} THEN 1 ELSE 0 END)")
    p4, p5, p6 = f"substr({w}, 1, 4)", f"substr({w}, 1, 5)", f"substr({w}, 1, 6)"
    add = (f"(CASE WHEN starts_with({w}, 'mc') THEN 1 ELSE 0 END"
           f" + CASE WHEN {sfx('y')} AND substr({w}, length({w}) - 1, 1) NOT IN {_V} THEN 1 ELSE 0 END"
           f" + len(list_filter(range(2, length({w})), lambda i: substr({w}, i, 1) = 'y'"
           f" AND substr({w}, i - 1, 1) NOT IN {_V} AND substr({w}, i + 1, 1) NOT IN {_V}))"
           f" + CASE WHEN starts_with({w}, 'tri') AND {ch(4)} IN {_V} THEN 1 ELSE 0 END"
           f" + CASE WHEN starts_with({w}, 'bi') AND {ch(3)} IN {_V} THEN 1 ELSE 0 END"
           f" + CASE WHEN {sfx('ian')} AND NOT ({sfx('cian')} OR {sfx('tian')}) THEN 1 ELSE 0 END"
           f" + CASE WHEN starts_with({w}, 'co') AND {ch(3)} IN {_V} AND ("
           f"{p4} IN {_in(SY.CO_TWO)} OR {p5} IN {_in(SY.CO_TWO)} OR {p6} IN {_in(SY.CO_TWO)} OR NOT ("
           f"{p4} IN {_in(SY.CO_ONE)} OR {p5} IN {_in(SY.CO_ONE)} OR {p6} IN {_in(SY.CO_ONE)})) THEN 1 ELSE 0 END"
           f" + CASE WHEN starts_with({w}, 'pre') AND {ch(4)} IN {_V} AND {p6} NOT IN {_in(SY.PRE_ONE)}"
           f" THEN 1 ELSE 0 END"
           f" + CASE WHEN {sfx(chr(110) + chr(39) + chr(39) + 't')} AND {w} IN {_in(SY.NEGATIVE)} THEN 1 ELSE 0 END"
           f" + CASE WHEN {w} IN {_in(SY.EXCEPTION_ADD)} THEN 1 ELSE 0 END)")
    rule = f"(CASE WHEN length({w}) <= 3 THEN 1 ELSE {vowels} - {disc} + {add} END)::INT"
    return f"list_transform([lower({sql_spell(x)})], lambda _lw: {rule})[1]"


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _sql_below100(t: str) -> str:
    small, tens = _sql_list(SY.SMALL_NUMBERS), _sql_list(SY.TENS)
    return (f"(CASE WHEN {t} < 20 THEN {small}[{t} + 1] ELSE {tens}[{t} // 10 + 1] || "
            f"CASE WHEN {t} % 10 <> 0 THEN '-' || {small}[{t} % 10 + 1] ELSE '' END END)")


def _sql_below1000(v: str) -> str:
    small = _sql_list(SY.SMALL_NUMBERS)
    inner = (f"CASE WHEN _h >= 100 THEN {small}[_h // 100 + 1] || ' hundred' || "
             f"CASE WHEN _h % 100 <> 0 THEN ' and ' || list_transform([_h % 100], lambda _t: "
             f"{_sql_below100('_t')})[1] ELSE '' END ELSE {_sql_below100('_h')} END")
    return f"list_transform([{v}], lambda _h: {inner})[1]"


def sql_spell(x: str) -> str:
    """DuckDB form of E3 (same rule as ``spell_number``), for numbers that fit a
    64-bit integer; longer ones are covered by the fixtures."""
    parts = ", ".join(f"CASE WHEN (_n // {sc}) % 1000 <> 0 THEN {_sql_below1000(f'(_n // {sc}) % 1000')} "
                      f"|| ' {name}' END" for sc, name in ((1000 ** k, SY.POWERS[k]) for k in range(5, 0, -1)))
    head = f"concat_ws(', ', {parts})"
    spelled = (f"CASE WHEN _n < 1000 THEN {_sql_below1000('_n')} WHEN _n % 1000 = 0 THEN {head} "
               f"WHEN _n % 1000 < 100 THEN {head} || ' and ' || "
               f"list_transform([_n % 1000], lambda _t: {_sql_below100('_t')})[1] "
               f"ELSE {head} || ', ' || {_sql_below1000('_n % 1000')} END")
    return (f"CASE WHEN regexp_full_match({x}, '[0-9]+') AND length({x}) <= 18 "
            f"THEN list_transform([CAST({x} AS BIGINT)], lambda _n: {spelled})[1] ELSE {x} END")


SQL_FOLD = "replace(strip_accents({x}), 'ß', 'ss')"
SQL_PREP = "regexp_replace(" + SQL_FOLD + ", '^\\s+|\\s+$', '', 'g')"


@register("syllable_rule_words", f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all({SQL_PREP.format(x='text')}, '\\b\\w+\\b')) AS word
           FROM documents)
SELECT word, {sql_syllable('word')} AS syllables FROM w
""")
def q_syllable_words(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    words = EN.distinct_words(d, "text")
    return words.select("word", SY.word_syllables(F.col("word")).alias("syllables"))


@register("line_syllables", f"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no,
                  unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, line_no, regexp_extract_all({SQL_PREP.format(x='line')}, '\\b\\w+\\b') AS toks FROM l)
SELECT doc_id, line_no::INT AS line_no,
       list_transform(toks, lambda w: {sql_syllable('w')}) AS syllables,
       coalesce(list_sum(list_transform(toks, lambda w: {sql_syllable('w')})), 0)::BIGINT AS total
FROM t
""")
def q_line_syllables(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    enc = EN.line_syllables(lines, ["doc_id", "line_no"], "line")
    return enc.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "syllables",
                      F.col("total").cast("long").alias("total"))


_PUNCT_SQL = M.METER_PUNCT.replace("'", "''")
_STRESS_LINE = (f"array_to_string(list_transform(CASE WHEN translate({SQL_PREP.format(x='ln')}, '{_PUNCT_SQL}', '') = ''"
                f" THEN []::VARCHAR[] ELSE string_split_regex(translate({SQL_PREP.format(x='ln')}, '{_PUNCT_SQL}', ''),"
                f" '[\\s-]+') END, lambda w: repeat('0', greatest({sql_syllable('w')}, 0))), '')")


ORACLES_METER = f"""
WITH {SQL_STANZAS},
ps AS (SELECT id, pos1, pos2, array_to_string(list_transform(l1, lambda ln: {_STRESS_LINE}), '') AS s1,
              array_to_string(list_transform(l2, lambda ln: {_STRESS_LINE}), '') AS s2 FROM pairs),
pscore AS (SELECT id, pos1, pos2, levenshtein(s1, s2)::DOUBLE / least(length(s1), length(s2)) AS s FROM ps),
agg AS (SELECT id, {SONG_MEAN} FROM pscore GROUP BY id)
SELECT songs.id, 'meter' AS measure,
       round(coalesce(agg.score, 0.0), 6) AS score,
       coalesce(agg.n_pairs, 0)::BIGINT AS n_pairs,
       round(100 * exp(-coalesce(agg.score, 0.0)), 6) AS score_100
FROM songs LEFT JOIN agg ON songs.id = agg.id
"""


@register("meter_by_song", ORACLES_METER)
def q_meter(spark, sf_dir):
    s = M.score_song_arrays(conversation_songs(spark, sf_dir), ["id"], ["meter"])
    return s.select("id", "measure", r6(F.col("score")).alias("score"), "n_pairs",
                    r6(M.scale_score(F.col("measure"), F.col("score"))).alias("score_100"))


@register("syllable_offset0_by_song", f"""
WITH {SQL_STANZAS},
sums AS (SELECT id, pos1, pos2,
   list_transform(l1, lambda ln: coalesce(list_sum(list_transform(regexp_extract_all({SQL_PREP.format(x='ln')},
       '\\b\\w+\\b'), lambda w: {sql_syllable('w')})), 0)) AS a,
   list_transform(l2, lambda ln: coalesce(list_sum(list_transform(regexp_extract_all({SQL_PREP.format(x='ln')},
       '\\b\\w+\\b'), lambda w: {sql_syllable('w')})), 0)) AS b FROM pairs),
pscore AS (SELECT id, pos1, pos2,
                  list_sum(list_transform(range(1, least(len(a), len(b)) + 1), lambda k: abs(a[k] - b[k])))::DOUBLE
                  * (1.0::DOUBLE / 8) / least(len(a), len(b)) AS s FROM sums),
agg AS (SELECT id, {SONG_MEAN} FROM pscore GROUP BY id)
SELECT songs.id, 'syllable_offset0' AS measure, round(coalesce(agg.score, 0.0), 6) AS score,
       coalesce(agg.n_pairs, 0)::BIGINT AS n_pairs,
       round(100 * exp(-coalesce(agg.score, 0.0)), 6) AS score_100
FROM songs LEFT JOIN agg ON songs.id = agg.id
""")
def q_syllable_offset0(spark, sf_dir):
    s = M.score_song_arrays(conversation_songs(spark, sf_dir), ["id"], ["syllable_offset0"])
    return s.select("id", "measure", r6(F.col("score")).alias("score"), "n_pairs",
                    r6(M.scale_score(F.col("measure"), F.col("score"))).alias("score_100"))


@register("lexicon_syllables", f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all({SQL_PREP.format(x='text')}, '\\b\\w+\\b')) AS word
           FROM documents),
lex AS (SELECT DISTINCT unnest(regexp_extract_all({SQL_PREP.format(x='text')}, '\\b\\w+\\b')) AS word
        FROM benchmark)
SELECT w.word, CASE WHEN lex.word IS NOT NULL THEN {sql_syllable('w.word')} + 100
                    ELSE {sql_syllable('w.word')} END AS syllables,
       lex.word IS NOT NULL AS from_lexicon
FROM w LEFT JOIN lex ON w.word = lex.word
""")
def q_lexicon_syllables(spark, sf):
    """Lexicon hit first, rule otherwise.  The lexicon here is built
    from the benchmark words (count = rule + 100, so hits are visible)."""
    d = table(spark, sf, "documents", spread=True)
    b = table(spark, sf, "benchmark")
    lex = EN.distinct_words(b, "text").select(
        "word", (SY.word_syllables(F.col("word")) + 100).alias("num_syllables"))
    words = EN.distinct_words(d, "text")
    out = EN.syllables_with_lexicon(words, "word", lex)
    return out.select("word", "syllables", "from_lexicon")


# --- lexica derived from the benchmark words, by rules both engines state -----
# Hits and misses: words whose length divides by 3 are in no pronunciation lexicon,
# those whose length is even in no syllable lexicon.
_VOWEL_DIGITS = ("aeiouy", "110200")


def _lexicon_words(spark, sf):
    b = table(spark, sf, "benchmark").select(F.lower("text").alias("text"))
    return EN.distinct_words(b, "text").filter(F.col("word").rlike("^[a-z]+$"))


def derived_lexica(spark, sf) -> dict:
    """``pron``: each vowel a vowel phoneme with a digit, each other letter a
    consonant; ``syl``: twice the letters; ``stem``: words in 'e' without it; ``lemma``:
    the first three letters of longer words."""
    words = _lexicon_words(spark, sf)
    phoneme = lambda c: F.concat(F.upper(c), F.when(c.rlike("[aeiouy]"), F.translate(c, *_VOWEL_DIGITS)).otherwise(F.lit("")))
    letters = F.regexp_extract_all("word", F.lit("[a-z]"), 0)
    return {
        "pron": words.filter(F.length("word") % 3 != 0).select("word", F.transform(letters, phoneme).alias("phonemes")),
        "syl": words.filter(F.length("word") % 2 == 1).select("word", (2 * F.length("word")).alias("num_syllables")),
        "stem": words.filter(F.col("word").endswith("e") & (F.length("word") > 3)).select("word", F.expr("left(word, length(word) - 1)").alias("value")),
        "lemma": words.filter(F.length("word") > 4).select("word", F.expr("left(word, 3)").alias("value")),
    }


_LEXICA_SQL = f"""
lexw AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all({SQL_PREP.format(x='lower(text)')}, '\\b\\w+\\b')) AS word FROM benchmark)
         WHERE regexp_full_match(word, '[a-z]+')),
pron AS (SELECT map(list(word ORDER BY word), list(translate(regexp_replace(word, '[^aeiouy]', '', 'g'), '{_VOWEL_DIGITS[0]}', '{_VOWEL_DIGITS[1]}') ORDER BY word)) AS pm,
                map(list(word ORDER BY word), list(array_to_string(regexp_extract_all(word, '[^aeiouy]*[aeiouy]|[^aeiouy]+$'), '|') ORDER BY word)) AS hm
         FROM lexw WHERE length(word) % 3 <> 0),
syl AS (SELECT map(list(word ORDER BY word), list(2 * length(word) ORDER BY word)) AS sm FROM lexw WHERE length(word) % 2 = 1),
stem AS (SELECT map(list(word ORDER BY word), list(word[:-2] ORDER BY word)) AS tm FROM lexw WHERE word LIKE '%e' AND length(word) > 3)
"""


def _scored_with_lexica(spark, sf_dir, measure):
    enc = EN.with_lexicon_encodings(conversation_songs(spark, sf_dir), ["id"], **derived_lexica(spark, sf_dir))
    s = M.score_song_arrays(enc, ["id"], [measure])
    return s.select("id", "measure", r6(F.col("score")).alias("score"), "n_pairs",
                    r6(M.scale_score(F.col("measure"), F.col("score"))).alias("score_100"))


def _song_sql(measure: str, ctes: str) -> str:
    """``ctes`` end with ``pscore (id, pos1, pos2, s)``."""
    return f"""
WITH {SQL_STANZAS}, {_LEXICA_SQL}, {ctes},
agg AS (SELECT id, {SONG_MEAN} FROM pscore GROUP BY id)
SELECT songs.id, '{measure}' AS measure, round(coalesce(agg.score, 0.0), 6) AS score,
       coalesce(agg.n_pairs, 0)::BIGINT AS n_pairs,
       round(100 * exp(-coalesce(agg.score, 0.0)), 6) AS score_100
FROM songs LEFT JOIN agg ON songs.id = agg.id
"""


_METER_WORDS = (f"CASE WHEN translate({SQL_PREP.format(x='ln')}, '{_PUNCT_SQL}', '') = '' THEN []::VARCHAR[] "
                f"ELSE string_split_regex(translate({SQL_PREP.format(x='ln')}, '{_PUNCT_SQL}', ''), '[\\s-]+') END")
_STEMMED = "CASE WHEN w LIKE '%ing' OR w LIKE '%ly' THEN w ELSE coalesce(tm[w], w) END"
_METER_LINE = (f"array_to_string(list_transform(list_transform({_METER_WORDS}, lambda w: {_STEMMED}), "
               f"lambda w: coalesce(pm[w], repeat('0', greatest(coalesce(sm[w], {sql_syllable('w')}), 0)))), '')")


@register("meter_lexicon_by_song", _song_sql("meter_lexicon", f"""
ps AS (SELECT id, pos1, pos2, array_to_string(list_transform(l1, lambda ln: {_METER_LINE}), '') AS s1,
              array_to_string(list_transform(l2, lambda ln: {_METER_LINE}), '') AS s2 FROM pairs, pron, syl, stem),
pscore AS (SELECT id, pos1, pos2, levenshtein(s1, s2)::DOUBLE / least(length(s1), length(s2)) AS s FROM ps)"""))
def q_meter_lexicon(spark, sf_dir):
    """M6 over lexica: stems, pronunciations, syllable counts, then the rule."""
    return _scored_with_lexica(spark, sf_dir, "meter_lexicon")


_PHON_LINE = ("array_to_string(list_filter(list_transform(string_split(trim(translate(regexp_replace(ln, '[^\\w\\s'']', '', 'g'), ',.!', '')), ' '), "
              "lambda w: hm[lower(w)]), lambda x: x IS NOT NULL), '|')")
# Lines of a pair become letters (33 on), so that the string distance is the distance of line sequences.
_PHON_CODE = "array_to_string(list_transform({x}, lambda v: chr(32 + list_position(u, v)::INT)), '')"


@register("phonetics_by_song", _song_sql("phonetics", f"""
ph AS (SELECT id, pos1, pos2, list_transform(l1, lambda ln: {_PHON_LINE}) AS p1,
              list_transform(l2, lambda ln: {_PHON_LINE}) AS p2 FROM pairs, pron),
pu AS (SELECT *, list_sort(list_distinct(list_concat(p1, p2))) AS u FROM ph),
pscore AS (SELECT id, pos1, pos2, levenshtein({_PHON_CODE.format(x='p1')}, {_PHON_CODE.format(x='p2')})::DOUBLE
                  / least(len(p1), len(p2)) AS s FROM pu)"""))
def q_phonetics(spark, sf_dir):
    """Edit distance of the lines' phoneme syllables."""
    return _scored_with_lexica(spark, sf_dir, "phonetics")


# --- X1 from stanza rows, songs spread over tasks: both sides, every measure that SQL can state
TILED = ("string_similarity", "head_similarity", "tail_similarity", "meter", "syllable_offset0", "diversity", "diversity_avg_ttr")


def _tiled_sql() -> str:
    cells = [ORACLES[f"{m}_by_song"] for m in ("string_similarity", "head_similarity", "tail_similarity", "meter",
                                               "syllable_offset0", "diversity_mtld", "diversity_avg_ttr")]
    rows = " UNION ALL ".join(f"SELECT id, measure, score, n_pairs, score_100 FROM ({c}) c{i}" for i, c in enumerate(cells))
    return f"SELECT id, side, measure, score, n_pairs, score_100 FROM ({rows}) r, (VALUES ('pred'), ('target')) v(side)"


@register("scored_songs_tiled", _tiled_sql())
def q_scored_songs_tiled(spark, sf_dir):
    """The second side is the text in capitals, which folding undoes."""
    conv = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "id")
    conv = conv.withColumn("side", F.lit("pred")).unionByName(conv.withColumn("side", F.lit("target")).withColumn("text", F.upper("text")))
    keys = ["id", "side"]
    stanzas = conv.select(*keys, F.col("turn").alias("pos"), F.col("role").alias("keyword"),
                          non_blank_lines(normalise_text(F.col("text"))).alias("lines")).filter(F.size("lines") > 0)
    s = M.score_stanza_tiles(stanzas, conv, keys, TILED)
    return s.select(*keys, "measure", r6(F.col("score")).alias("score"), "n_pairs",
                    r6(M.scale_score(F.col("measure"), F.col("score"))).alias("score_100"))


# --- lexica in checked queries: E5's lexicon branch, M12's lemmas
@register("line_syllables_lexicon", f"""
WITH {_LEXICA_SQL},
l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, line_no, list_transform(regexp_extract_all({SQL_PREP.format(x='line')}, '\\b\\w+\\b'),
             lambda w: coalesce(sm[w], {sql_syllable('w')})) AS counts FROM l, syl)
SELECT doc_id, line_no::INT AS line_no, counts AS syllables, coalesce(list_sum(counts), 0)::BIGINT AS total FROM t
""".replace("lexw AS", "lexw AS MATERIALIZED"))
def q_line_syllables_lexicon(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    enc = EN.line_syllables(lines, ["doc_id", "line_no"], "line", derived_lexica(spark, sf)["syl"])
    return enc.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "syllables", F.col("total").cast("long").alias("total"))


_LEMMA_SQL = ORACLES["diversity_mtld_by_song"].replace(
    "dirs AS (SELECT id, pos, 'f' AS d, t FROM tok UNION ALL SELECT id, pos, 'b' AS d, list_reverse(t) FROM tok)",
    f"""{_LEXICA_SQL},
lemma AS (SELECT map(list(word ORDER BY word), list(word[:3] ORDER BY word)) AS lm FROM lexw WHERE length(word) > 4),
tokl AS (SELECT id, pos, list_transform(t, lambda w: coalesce(lm[w], w)) AS t FROM tok, lemma),
dirs AS (SELECT id, pos, 'f' AS d, t FROM tokl UNION ALL SELECT id, pos, 'b' AS d, list_reverse(t) FROM tokl)""").replace(
    "'diversity' AS measure", "'diversity_lexicon' AS measure")


@register("diversity_lexicon_by_song", _LEMMA_SQL)
def q_diversity_lexicon(spark, sf):
    """M9 over lemmas."""
    return _scored_with_lexica(spark, sf, "diversity_lexicon")
