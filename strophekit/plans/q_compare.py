"""Model comparison (X4) and side-by-side (X6) queries.

Stand-in: in ``conversations`` every role is a model and a conversation is
a song each model answered with its turns (stanzas labelled by the role).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strophekit.operators import measures as M
from strophekit.operators import relational as R
from strophekit.operators.structure import stanza_arrays_from_rows
from strophekit.plans.catalog import r6, register, table
from strophekit.session import cut_lineage
from strophekit.plans.q_songs import _line_sql

MODELS = ("assistant", "system", "user")
TARGET = "user"
X4_MEASURES = (("string_similarity", 0), ("head_similarity", 2), ("tail_similarity", -2))


def model_scores(spark, sf):
    """J4 (ids every model answered, found on two narrow columns) -> X1 for every model -> M16."""
    conv = table(spark, sf, "conversations", spread=True).select(
        F.col("conv_id").alias("id"), F.col("role").alias("model"), "turn", "text")
    answered = R.common_keys(conv.select("id", "model"), "id", "model").select("id")
    conv = conv.join(answered, on="id", how="left_semi")
    arrays = stanza_arrays_from_rows(conv.withColumn("keyword", F.col("model")), ["model", "id"],
                                     "turn", "keyword", "text")
    s = M.score_song_arrays(arrays, ["model", "id"], [m for m, _ in X4_MEASURES])
    return s.withColumn("scaled", M.scale_score(F.col("measure"), F.col("score")))


def _x4_cte() -> str:
    sims = []
    for m, ctx in X4_MEASURES:
        a, b = _line_sql(ctx, "l1[i]"), _line_sql(ctx, "l2[i]")
        sims.append(f"""
SELECT model, id, pos1, pos2, '{m}' AS measure,
       list_sum(list(levenshtein({a}, {b})::DOUBLE / least(length({a}), length({b})) ORDER BY i)) / count(*) AS s
FROM li GROUP BY model, id, pos1, pos2""")
    return f"""
st0 AS (
  SELECT conv_id AS id, role AS model, turn,
         list_filter(string_split(lower(replace(strip_accents(text), 'ß', 'ss')), chr(10)),
                     lambda l: regexp_replace(l, '\\s+', '', 'g') <> '') AS lines
  FROM conversations),
st AS (SELECT model, id, lines, row_number() OVER (PARTITION BY model, id ORDER BY turn) - 1 AS pos
       FROM st0 WHERE len(lines) > 0),
pairs AS (SELECT a.model, a.id, a.pos AS pos1, b.pos AS pos2, a.lines AS l1, b.lines AS l2
          FROM st a JOIN st b ON a.model = b.model AND a.id = b.id AND a.pos < b.pos),
li AS (SELECT model, id, pos1, pos2, l1, l2, unnest(range(1, least(len(l1), len(l2)) + 1)) AS i FROM pairs),
ps AS ({' UNION ALL '.join(sims)}),
agg AS (SELECT model, id, measure, list_sum(list(s ORDER BY pos1, pos2)) / count(*) AS score
        FROM ps GROUP BY model, id, measure),
songs AS (SELECT DISTINCT role AS model, conv_id AS id FROM conversations),
grid AS (SELECT songs.model, songs.id, m.measure FROM songs,
         (SELECT unnest({[m for m, _ in X4_MEASURES]}) AS measure) m),
full_ AS (SELECT g.model, g.id, g.measure, coalesce(agg.score, 0.0) AS score FROM grid g
          LEFT JOIN agg ON g.model = agg.model AND g.id = agg.id AND g.measure = agg.measure),
common AS (SELECT id FROM songs GROUP BY id
           HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM songs)),
scaled AS (SELECT model, id, measure, score, 100 * exp(-score) AS scaled FROM full_
           WHERE id IN (SELECT id FROM common))
"""


@register("model_scores", f"""
WITH {_x4_cte()}
SELECT model, id, measure, round(score, 6) AS score, round(scaled, 6) AS scaled FROM scaled
""")
def q_model_scores(spark, sf):
    s = model_scores(spark, sf)
    return s.select("model", "id", "measure", r6(F.col("score")).alias("score"),
                    r6(F.col("scaled")).alias("scaled"))


def _a1_sql() -> str:
    cols = []
    for m in MODELS:
        cols.append(f"round_even(median(CASE WHEN model = '{m}' THEN scaled END), 2) AS \"{m} median score\"")
        cols.append(f"round_even(avg(CASE WHEN model = '{m}' THEN scaled END), 2) AS \"{m} mean score\"")
    return (f"WITH {_x4_cte()} SELECT measure AS \"Measure\", " + ", ".join(cols)
            + f" FROM scaled GROUP BY measure ORDER BY \"{TARGET} median score\" DESC, \"{TARGET} mean score\" DESC")


@register("scores_by_model_and_measure", _a1_sql())
def q_scores_table(spark, sf):
    s = cut_lineage(model_scores(spark, sf))  # read once per histogram
    return R.mean_median_table(s, "measure", "model", "scaled", MODELS, TARGET)


@register("score_distribution", f"""
WITH {_x4_cte()},
q AS (SELECT measure, model, quantile_cont(scaled, 0.25) AS q1, quantile_cont(scaled, 0.5) AS median,
             quantile_cont(scaled, 0.75) AS q3, count(*) AS n FROM scaled GROUP BY measure, model),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.measure, f.model, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       n::BIGINT AS n, round(q3 - q1, 6) AS iqr,
       round(min(CASE WHEN s.scaled BETWEEN lo AND hi THEN s.scaled END), 6) AS lo_whisker,
       round(max(CASE WHEN s.scaled BETWEEN lo AND hi THEN s.scaled END), 6) AS hi_whisker,
       sum(CASE WHEN s.scaled BETWEEN lo AND hi THEN 0 ELSE 1 END)::BIGINT AS n_outliers
FROM f JOIN scaled s ON s.measure = f.measure AND s.model = f.model
GROUP BY f.measure, f.model, q1, median, q3, n
""")
def q_score_distribution(spark, sf):
    """A8 on the comparison scores: box-plot table per measure x model."""
    s = cut_lineage(model_scores(spark, sf))  # read once per histogram
    b = R.box_summary(s, ["measure", "model"], "scaled")
    return b.select("measure", "model", *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3")],
                    F.col("n").cast("long").alias("n"), r6(F.col("iqr")).alias("iqr"),
                    r6(F.col("lo_whisker")).alias("lo_whisker"), r6(F.col("hi_whisker")).alias("hi_whisker"),
                    "n_outliers")


@register("mean_score_by_measure", f"""
WITH {_x4_cte()}
SELECT measure, model, round(avg(score), 6) AS mean_score, count(*)::BIGINT AS n_songs
FROM scaled GROUP BY measure, model
""")
def q_mean_by_measure(spark, sf):
    """A2: average song score per measure for every model (targets too)."""
    s = model_scores(spark, sf)
    out = s.groupBy("measure", "model").agg(F.avg("score").alias("m"), F.count(F.lit(1)).alias("n"))
    return out.select("measure", "model", r6(F.col("m")).alias("mean_score"),
                      F.col("n").cast("long").alias("n_songs"))


@register("side_by_side", """
SELECT d.doc_id AS id, d.source AS artist, length(d.text)::BIGINT AS original_chars,
       c.turn, md5(c.text) AS answer_md5
FROM documents d JOIN conversations c ON d.doc_id = c.conv_id
WHERE d.source = 'src1' AND c.role = 'assistant'
""")
def q_side_by_side(spark, sf):
    """One artist's originals next to the model answers for the same id."""
    d = table(spark, sf, "documents").filter(F.col("source") == "src1").select(
        F.col("doc_id").alias("id"), F.col("source").alias("artist"),
        F.length("text").cast("long").alias("original_chars"))
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("id"), "turn", F.md5("text").alias("answer_md5"))
    return R.join_narrowed(d, c, "id", ["turn", "answer_md5"])
