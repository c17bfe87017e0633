"""Song queries over ``conversations`` (X1 slice: T8, J5, M1-M7, A12, M16,
W1) and the parser round trip (T1-T8)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strophekit.operators import measures as M
from strophekit.operators.structure import (matching_from_array, parse_songs,
                                            stanza_arrays_from_rows)
from strophekit.plans.catalog import ORACLES, r6, register, table

KEYS = ["id"]


def conversation_songs(spark: SparkSession, sf_dir: str):
    """One row per conversation with its ordered stanza array (the only
    shuffle of the song queries: turns grouped by conversation)."""
    conv = table(spark, sf_dir, "conversations", spread=True)
    return stanza_arrays_from_rows(conv.withColumnRenamed("conv_id", "id"), KEYS,
                                   "turn", "role", "text")


def _scored(spark, sf_dir, measure):
    s = M.score_song_arrays(conversation_songs(spark, sf_dir), KEYS, [measure])
    return s.select("id", "measure", r6(F.col("score")).alias("score"), "n_pairs",
                    r6(M.scale_score(F.col("measure"), F.col("score"))).alias("score_100"))


# --- oracle building blocks ---------------------------------------------------
SQL_FOLD = "lower(replace(strip_accents({x}), 'ß', 'ss'))"
SQL_STANZAS = """
st0 AS (
  SELECT conv_id AS id, turn, role AS keyword,
         list_filter(string_split(""" + SQL_FOLD.format(x="text") + """, chr(10)),
                     lambda l: regexp_replace(l, '\\s+', '', 'g') <> '') AS lines
  FROM conversations
),
st AS (
  SELECT id, keyword, lines,
         row_number() OVER (PARTITION BY id ORDER BY turn) - 1 AS pos
  FROM st0 WHERE len(lines) > 0
),
pairs AS (
  SELECT a.id, a.keyword, a.pos AS pos1, b.pos AS pos2, a.lines AS l1, b.lines AS l2
  FROM st a JOIN st b ON a.id = b.id AND a.keyword = b.keyword AND a.pos < b.pos
),
songs AS (SELECT DISTINCT conv_id AS id FROM conversations)
"""

SQL_WORDS = "list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
# Song means are summed in pair order (pos1, pos2) or stanza order, as the
# Spark side does, so both produce the same double (an unordered parallel
# average can differ in the last bit and flip a 6-place rounding).
SONG_MEAN = "list_sum(list(s ORDER BY pos1, pos2)) / count(*) AS score, count(*) AS n_pairs"
STANZA_MEAN = "list_sum(list(s ORDER BY pos)) / count(*) AS score, count(*) AS n_pairs"


def _line_sql(ctx: int, x: str) -> str:
    w = SQL_WORDS.format(x=x)
    if ctx > 0:
        w = f"({w})[1:{ctx}]"
    elif ctx < 0:
        w = f"({w})[{ctx}:]"
    return f"array_to_string({w}, ' ')"


def similarity_sql(measure: str, ctx: int) -> str:
    a, b = _line_sql(ctx, "l1[i]"), _line_sql(ctx, "l2[i]")
    return f"""
WITH {SQL_STANZAS},
li AS (
  SELECT id, pos1, pos2, l1, l2, unnest(range(1, least(len(l1), len(l2)) + 1)) AS i FROM pairs
),
ld AS (
  SELECT id, pos1, pos2, i, {a} AS a, {b} AS b FROM li
),
pscore AS (
  SELECT id, pos1, pos2,
         list_sum(list(levenshtein(a, b)::DOUBLE / least(length(a), length(b)) ORDER BY i)) / count(*) AS s
  FROM ld GROUP BY id, pos1, pos2
),
agg AS (SELECT id, {SONG_MEAN} FROM pscore GROUP BY id)
SELECT songs.id, '{measure}' AS measure,
       round(coalesce(agg.score, 0.0), 6) AS score,
       coalesce(agg.n_pairs, 0)::BIGINT AS n_pairs,
       round(100 * exp(-coalesce(agg.score, 0.0)), 6) AS score_100
FROM songs LEFT JOIN agg ON songs.id = agg.id
"""


for _m, _ctx in (("string_similarity", 0), ("head_similarity", 2), ("tail_similarity", -2)):
    register(f"{_m}_by_song", similarity_sql(_m, _ctx))(
        (lambda m: lambda spark, sf: _scored(spark, sf, m))(_m))


@register("stanza_pairs", f"""
WITH {SQL_STANZAS}
SELECT id, keyword, pos1::INT AS pos1, pos2::INT AS pos2 FROM pairs
""")
def q_stanza_pairs(spark, sf_dir):
    songs = conversation_songs(spark, sf_dir)
    st = F.col("stanzas")
    p = songs.select("id", "stanzas", F.explode(M.pair_index(st)).alias("ij"))
    return p.select("id", st[F.col("ij.i")]["keyword"].alias("keyword"),
                    st[F.col("ij.i")]["pos"].alias("pos1"), st[F.col("ij.j")]["pos"].alias("pos2"))


@register("stanza_matching", f"""
WITH {SQL_STANZAS},
firsts AS (SELECT id, keyword, min(pos) AS fp FROM st GROUP BY id, keyword),
codes AS (
  SELECT st.id, st.pos, dense_rank() OVER (PARTITION BY st.id ORDER BY f.fp) - 1 AS code
  FROM st JOIN firsts f ON st.id = f.id AND st.keyword = f.keyword
),
lastp AS (SELECT id, max(pos) AS lp FROM st GROUP BY id)
SELECT c.id,
       string_agg(c.code::VARCHAR, '-' ORDER BY c.pos) AS matching,
       CASE WHEN max(CASE WHEN c.pos < l.lp THEN c.code ELSE -1 END) + 1 >= 10
            THEN 'labels' END AS error
FROM codes c JOIN lastp l ON c.id = l.id
GROUP BY c.id
""")
def q_stanza_matching(spark, sf_dir):
    songs = conversation_songs(spark, sf_dir)
    matching, error = matching_from_array(F.col("stanzas"))
    return songs.select("id", matching.alias("matching"), error.alias("error"))


@register("song_score_grid", f"""
WITH {SQL_STANZAS},
pc AS (SELECT id, count(*) AS n FROM pairs GROUP BY id)
SELECT songs.id, coalesce(pc.n, 0)::BIGINT AS n_pairs
FROM songs LEFT JOIN pc ON songs.id = pc.id
""")
def q_song_score_grid(spark, sf_dir):
    """A12 zero rule: every song, with its pair count (0 when none)."""
    songs = conversation_songs(spark, sf_dir)
    return songs.select("id", F.size(M.pair_index(F.col("stanzas"))).cast("long").alias("n_pairs"))


# --- parser round trip (T1-T8) ----------------------------------------------
# Fixed headers used to rebuild a song text from the conversation turns.
ROLE_HEADERS = {"user": "[Verse 1]", "assistant": "[Chorus]", "system": "[Intro]"}
ROLE_KEYWORDS = {"user": "verse", "assistant": "chorus", "system": "intro"}


def rebuilt_songs(spark, sf_dir, after_header="\n", marks=""):
    """One raw song text per conversation: a header per turn by role, turns
    joined by blank lines.  The group is one conversation."""
    conv = table(spark, sf_dir, "conversations", spread=True)
    hdr = F.create_map(*[x for k, v in ROLE_HEADERS.items() for x in (F.lit(k), F.lit(v))])
    header = F.coalesce(hdr[F.col("role")], F.concat(F.lit("["), F.coalesce("role", F.lit("none")), F.lit("]")))
    piece = F.concat(header, F.lit(after_header), F.coalesce("text", F.lit("")), F.lit(marks))
    g = conv.groupBy(F.col("conv_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))).alias("_p"))
    return g.select("id", F.array_join(F.transform("_p", lambda s: s["p"]), "\n\n").alias("text"))


@register("parsed_stanzas", """
WITH st0 AS (
  SELECT conv_id AS id, turn,
         CASE role WHEN 'user' THEN 'verse' WHEN 'assistant' THEN 'chorus'
                   WHEN 'system' THEN 'intro' END AS keyword,
         list_filter(string_split(lower(replace(strip_accents(text), 'ß', 'ss')), chr(10)),
                     lambda l: regexp_replace(l, '\\s+', '', 'g') <> '') AS lines
  FROM conversations
)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY turn) - 1)::INT AS pos,
       keyword, array_to_string(lines, chr(10)) AS lines_text, len(lines)::BIGINT AS n_lines
FROM st0 WHERE len(lines) > 0
""")
def q_parsed_stanzas(spark, sf_dir):
    st = parse_songs(rebuilt_songs(spark, sf_dir), "text", KEYS)
    return st.select("id", "pos", "keyword", F.array_join("lines", "\n").alias("lines_text"),
                     F.size("lines").cast("long").alias("n_lines"))


# What the parser must take away or rewrite: text before the first header, a colon behind
# headers, four kinds of marks inside a stanza, and a paragraph behind the last stanza.
DIRTY_HEAD, DIRTY_TAIL = "Notes\n\n", "\n\nYou might also like\nmore songs"
DIRTY_MARKS, CLEAN_MARKS = " [?] (laughs) [...] (..)", " nan nan nan nan"


@register("parsed_stanzas_dirty", f"""
WITH st0 AS (
  SELECT conv_id AS id, turn,
         CASE role WHEN 'user' THEN 'verse' WHEN 'assistant' THEN 'chorus'
                   WHEN 'system' THEN 'intro' END AS keyword,
         list_filter(string_split(lower(replace(strip_accents(coalesce(text, '') || '{CLEAN_MARKS}'), 'ß', 'ss')), chr(10)),
                     lambda l: regexp_replace(l, '\\s+', '', 'g') <> '') AS lines
  FROM conversations
)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY turn) - 1)::INT AS pos,
       keyword, array_to_string(lines, chr(10)) AS lines_text, len(lines)::BIGINT AS n_lines
FROM st0
""")
def q_parsed_stanzas_dirty(spark, sf_dir):
    """Raw songs with a preamble, noise marks, ``]:`` and a closing paragraph."""
    songs = rebuilt_songs(spark, sf_dir, after_header=":", marks=DIRTY_MARKS)
    songs = songs.withColumn("text", F.concat(F.lit(DIRTY_HEAD), "text", F.lit(DIRTY_TAIL)))
    st = parse_songs(songs, "text", KEYS)
    return st.select("id", "pos", "keyword", F.array_join("lines", "\n").alias("lines_text"),
                     F.size("lines").cast("long").alias("n_lines"))


# --- meter / syllable / phonetics / diversity on conversation stanzas --------
@register("syllable_by_song")
def q_syllable(spark, sf_dir):
    return _scored(spark, sf_dir, "syllable")


@register("diversity_mtld_by_song")
def q_diversity(spark, sf_dir):
    return _scored(spark, sf_dir, "diversity")


@register("diversity_avg_ttr_by_song", f"""
WITH {SQL_STANZAS},
tok AS (
  SELECT id, pos, list_filter(string_split_regex(lower(regexp_replace(
           replace(strip_accents(array_to_string(lines, ' ')), 'ß', 'ss'),
           '[!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~]', ' ', 'g')), '\\s+'), lambda w: w <> '') AS t
  FROM st
),
sc AS (
  SELECT id, pos, -((len(list_distinct(t))::DOUBLE / len(t)) / len(t)) * (1.0::DOUBLE / 65) AS s FROM tok
),
agg AS (SELECT id, {STANZA_MEAN} FROM sc GROUP BY id)
SELECT songs.id, 'diversity_avg_ttr' AS measure,
       round(coalesce(agg.score, 0.0), 6) AS score,
       coalesce(agg.n_pairs, 0)::BIGINT AS n_pairs,
       round(100 * exp(coalesce(agg.score, 0.0)), 6) AS score_100
FROM songs LEFT JOIN agg ON songs.id = agg.id
""")
def q_avg_ttr(spark, sf_dir):
    return _scored(spark, sf_dir, "diversity_avg_ttr")


# --- X1 end to end on raw song texts -----------------------------------------
def _x1_sql() -> str:
    parts = []
    for m, ctx in (("string_similarity", 0), ("head_similarity", 2), ("tail_similarity", -2)):
        parts.append(f"SELECT id, 'pred' AS side, measure, score, n_pairs, score_100 FROM ({similarity_sql(m, ctx)})")
    return "\nUNION ALL\n".join(parts)


@register("scored_songs", _x1_sql())
def q_scored_songs(spark, sf_dir):
    """X1 on raw texts: every conversation rebuilt as one song text, then
    parsed, paired and scored inside its row."""
    from strophekit.plans.scoring import score_songs
    songs = rebuilt_songs(spark, sf_dir)
    s = score_songs(songs, KEYS, {"pred": "text"},
                    ["string_similarity", "head_similarity", "tail_similarity"])
    return s.select("id", "side", "measure", r6(F.col("score")).alias("score"), "n_pairs",
                    r6(M.scale_score(F.col("measure"), F.col("score"))).alias("score_100"))


def _songs_to_reject(spark, sf_dir):
    """Every third song comes twice, every fifth has eleven labels more, every
    seventh has no text on the second side."""
    songs = rebuilt_songs(spark, sf_dir)
    many = "[Intro]\nla la\n\n" + "\n\n".join(f"[label{chr(97 + i)}]\nla la" for i in range(11))
    text = F.when(F.col("id") % 5 == 0, F.concat(F.lit(many + "\n\n"), "text")).otherwise(F.col("text"))
    songs = songs.select("id", F.lit(1).alias("seen"), text.alias("text"), F.when(F.col("id") % 7 != 0, F.col("text")).alias("other"))
    return songs.unionByName(songs.filter("id % 3 = 0").withColumn("seen", F.lit(2)))


@register("scored_songs_rejects", """
WITH s AS (SELECT DISTINCT conv_id AS id FROM conversations)
SELECT id, 'missing:other' AS reason FROM s WHERE id % 7 = 0
UNION ALL SELECT id, 'missing:other' FROM s WHERE id % 7 = 0 AND id % 3 = 0
UNION ALL SELECT id, 'duplicate' FROM s WHERE id % 3 = 0 AND id % 7 <> 0
UNION ALL SELECT id, 'labels:pred' FROM s WHERE id % 5 = 0 AND id % 7 <> 0
""")
def q_scored_songs_rejects(spark, sf_dir):
    """X1's input rules: the reject table."""
    from strophekit.plans.scoring import score_checked_songs
    return score_checked_songs(_songs_to_reject(spark, sf_dir), KEYS, {"pred": "text", "target": "other"}, ["string_similarity"],
                               ["seen"], ["text", "other"])[1]


def _checked_sql() -> str:
    parts = []
    for side, rule in (("pred", "id % 7 <> 0 AND id % 5 <> 0"), ("target", "id % 7 <> 0")):
        for m, ctx in (("string_similarity", 0), ("head_similarity", 2), ("tail_similarity", -2)):
            parts.append(f"SELECT id, '{side}' AS side, measure, score, n_pairs FROM ({similarity_sql(m, ctx)}) WHERE {rule}")
        parts.append(f"SELECT id, '{side}' AS side, measure, score, n_pairs FROM ({ORACLES['diversity_avg_ttr_by_song']}) WHERE {rule}")
    return "\nUNION ALL\n".join(parts)


@register("scored_songs_checked", _checked_sql())
def q_scored_songs_checked(spark, sf_dir):
    """X1 with its input rules, both sides: every accepted side scored once."""
    from strophekit.plans.scoring import score_checked_songs
    names = ["string_similarity", "head_similarity", "tail_similarity", "diversity_avg_ttr"]
    s = score_checked_songs(_songs_to_reject(spark, sf_dir), KEYS, {"pred": "text", "target": "other"}, names,
                            ["seen"], ["text", "other"])[0]
    return s.select("id", "side", "measure", r6(F.col("score")).alias("score"), "n_pairs")


# MTLD oracle: a recursive CTE walks every stanza's tokens forward and
# backward with the same factor rule (threshold 0.72, segments of at least
# 10 tokens, partial factor at the end).
_MTLD_SQL = f"""
WITH RECURSIVE {SQL_STANZAS},
tok AS (
  SELECT id, pos, list_filter(string_split_regex(lower(regexp_replace(
           replace(strip_accents(array_to_string(lines, ' ')), 'ß', 'ss'),
           '[!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~]', ' ', 'g')), '\\s+'), lambda w: w <> '') AS t
  FROM st
),
dirs AS (SELECT id, pos, 'f' AS d, t FROM tok UNION ALL SELECT id, pos, 'b' AS d, list_reverse(t) FROM tok),
r(id, pos, d, i, types, seg_n, factors, ttr, t) AS (
  SELECT id, pos, d, 0, []::VARCHAR[], 0, 0.0::DOUBLE, 1.0::DOUBLE, t FROM dirs
  UNION ALL
  SELECT id, pos, d, i + 1,
         CASE WHEN cl THEN []::VARCHAR[] ELSE nt END,
         CASE WHEN cl THEN 0 ELSE nn END,
         factors + CASE WHEN cl THEN 1.0 ELSE 0.0 END,
         CASE WHEN cl THEN 1.0::DOUBLE ELSE nttr END,
         t
  FROM (SELECT *, nttr <= 0.72::DOUBLE AND nn >= 10 AS cl FROM (
          SELECT r.*, list_distinct(list_append(types, t[i + 1])) AS nt, seg_n + 1 AS nn,
                 len(list_distinct(list_append(types, t[i + 1])))::DOUBLE / (seg_n + 1) AS nttr
          FROM r WHERE i < len(t)))
),
fin AS (
  SELECT id, pos, d, len(t) AS n,
         factors + (1.0::DOUBLE - ttr) / (1.0::DOUBLE - 0.72::DOUBLE) AS f
  FROM r WHERE i = len(t)
),
per AS (
  SELECT id, pos, CASE WHEN max(n) = 0 THEN 0.0
                       ELSE (max(CASE WHEN d = 'f' THEN (CASE WHEN f > 0 THEN n / f ELSE 0.0 END) END)
                             + max(CASE WHEN d = 'b' THEN (CASE WHEN f > 0 THEN n / f ELSE 0.0 END) END)) / 2.0
                  END AS mtld
  FROM fin GROUP BY id, pos
),
sc AS (SELECT id, pos, -(mtld * (1.0::DOUBLE / 65)) AS s FROM per),
agg AS (SELECT id, {STANZA_MEAN} FROM sc GROUP BY id)
SELECT songs.id, 'diversity' AS measure,
       round(coalesce(agg.score, 0.0), 6) AS score,
       coalesce(agg.n_pairs, 0)::BIGINT AS n_pairs,
       round(100 * exp(coalesce(agg.score, 0.0)), 6) AS score_100
FROM songs LEFT JOIN agg ON songs.id = agg.id
"""
ORACLES["diversity_mtld_by_song"] = _MTLD_SQL


# Moving average: from every start of the doubled token list the least window of at least
# 10 tokens whose distinct share is 0.72 or less.
_MTLD_MA_SQL = f"""
WITH {SQL_STANZAS},
tok AS (
  SELECT id, pos, list_filter(string_split_regex(lower(regexp_replace(
           replace(strip_accents(array_to_string(lines, ' ')), 'ß', 'ss'),
           '[!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]\\^_`{{|}}~]', ' ', 'g')), '\\s+'), lambda w: w <> '') AS t
  FROM st
),
places AS (SELECT id, pos, len(t) AS n, unnest(list_concat(t, t)) AS w, unnest(range(1, 2 * len(t) + 1)) AS i FROM tok),
seen AS (SELECT id, pos, n, i, coalesce(lag(i) OVER (PARTITION BY id, pos, w ORDER BY i), 0) AS before FROM places),
steps AS (SELECT id, pos, i, before, unnest(range(greatest(1, i - n + 1), least(i, n) + 1)) AS s FROM seen),
windows AS (SELECT id, pos, s, i - s + 1 AS l,
                   sum((before < s)::INT) OVER (PARTITION BY id, pos, s ORDER BY i) AS types FROM steps),
closed AS (SELECT id, pos, s, min(l) AS l FROM windows
           WHERE l >= 10 AND types::DOUBLE / l <= 0.72::DOUBLE GROUP BY id, pos, s),
per AS (SELECT id, pos, avg(l) AS v FROM closed GROUP BY id, pos),
sc AS (SELECT st.id, st.pos, -(coalesce(v, 0.0) * (1.0::DOUBLE / 65)) AS s FROM st LEFT JOIN per ON st.id = per.id AND st.pos = per.pos),
agg AS (SELECT id, {STANZA_MEAN} FROM sc GROUP BY id)
SELECT songs.id, 'diversity_avg_mtld' AS measure,
       round(coalesce(agg.score, 0.0), 6) AS score,
       coalesce(agg.n_pairs, 0)::BIGINT AS n_pairs,
       round(100 * exp(coalesce(agg.score, 0.0)), 6) AS score_100
FROM songs LEFT JOIN agg ON songs.id = agg.id
"""


@register("diversity_avg_mtld_by_song", _MTLD_MA_SQL)
def q_diversity_avg_mtld(spark, sf_dir):
    return _scored(spark, sf_dir, "diversity_avg_mtld")


@register("semantics_by_song", f"""
WITH {SQL_STANZAS},
ln AS (SELECT id, pos, unnest(range(len(lines))) AS line_no FROM st),
v AS (SELECT ln.*, embedding FROM ln JOIN embeddings
      ON vec_id = (id * 31 + pos * 7 + line_no) % (SELECT count(*) FROM embeddings)),
x AS (SELECT id, pos, line_no, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM v),
c AS (SELECT id, pos, d, avg(x) AS m FROM x GROUP BY ALL),
apart AS (SELECT p.id, p.pos1, p.pos2, sqrt(sum((a.m - b.m) ** 2)) AS s
          FROM pairs p JOIN c a ON p.id = a.id AND p.pos1 = a.pos
          JOIN c b ON p.id = b.id AND p.pos2 = b.pos AND a.d = b.d GROUP BY ALL),
far AS (SELECT x.id, x.pos, line_no, sqrt(sum((x - m) ** 2)) AS s
        FROM x JOIN c ON x.id = c.id AND x.pos = c.pos AND x.d = c.d GROUP BY ALL),
inside AS (SELECT id, pos, avg(s) AS s FROM far GROUP BY ALL),
a AS (SELECT id, avg(s) AS score FROM apart GROUP BY id),
i AS (SELECT id, avg(s) AS score FROM inside GROUP BY id)
SELECT songs.id, 'semantics' AS measure, round(coalesce(a.score, 0.0), 6) AS score FROM songs LEFT JOIN a ON songs.id = a.id
UNION ALL
SELECT songs.id, 'semantics_internal', round(coalesce(i.score, 0.0), 6) FROM songs LEFT JOIN i ON songs.id = i.id
""")
def q_semantics_by_song(spark, sf_dir):
    """E9 with M13 and M14 inside the song: every line takes a vector of ``embeddings`` by a computed key."""
    from strophekit.operators.embeddings import attach_line_embeddings
    songs = conversation_songs(spark, sf_dir)
    stanzas = songs.select("id", F.explode("stanzas").alias("s"))
    lines = stanzas.select("id", F.col("s.pos").alias("pos"), F.posexplode("s.lines").alias("line_no", "line"))
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    key = F.pmod(F.col("id") * 31 + F.col("pos") * 7 + F.col("line_no"), given.agg(F.count(F.lit(1)).alias("n")).scalar())
    vectors = lines.select("id", "pos", "line_no", key.alias("vec_id")).join(given, "vec_id")
    s = M.score_song_arrays(attach_line_embeddings(songs, KEYS, vectors), KEYS, ["semantics", "semantics_internal"])
    return s.select("id", "measure", r6(F.col("score")).alias("score"))
