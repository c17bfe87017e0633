"""Relational queries (P, J, D, W, O, U, R, A) over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophekit.functions.text import title_key
from strophekit.operators import relational as R
from strophekit.plans.catalog import r6, register, table

# Fixed values used by the stand-in queries.
CATEGORIES = ("Writing", "Roleplay", "Reasoning", "Math", "Coding", "Extraction", "STEM", "Humanities")
ANNOTATION_NOISE = ("inside scoop", "bio is unreviewed")
EVENT_RENAMES = {"click": "Click", "view": "View"}
EVENT_ORDER = ("view", "click", "signup", "purchase", "error")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
SOURCES = tuple(f"src{i}" for i in range(20))


def _sql_title_key(x: str) -> str:
    return (f"replace(lower(regexp_replace(split_part({x}, '(', 1), '^\\s+|\\s+$', '', 'g')), "
            f"chr(8203), '')")


def _py_index_case(expr: str, names) -> str:
    arr = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    n = len(names)
    return (f"CASE WHEN ({expr}) BETWEEN 0 AND {n - 1} THEN {arr}[({expr}) + 1] "
            f"WHEN ({expr}) BETWEEN -{n} AND -1 THEN {arr}[({expr}) + {n + 1}] END")


@register("select_rename", """
SELECT doc_id AS id, source AS artist, lang, n_chars FROM documents
""")
def q_select_rename(spark, sf):
    return R.select_rename(table(spark, sf, "documents"),
                           {"doc_id": "id", "source": "artist", "lang": "lang", "n_chars": "n_chars"})


@register("constant_and_corrections", """
WITH fx AS (SELECT doc_id, min('withheld') AS fix FROM labels WHERE toxic = 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(fx.fix, d.source) AS source, 'target' AS model
FROM documents d LEFT JOIN fx ON d.doc_id = fx.doc_id
""")
def q_constant_and_corrections(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    fixes = table(spark, sf, "labels").filter("toxic = 1").select(
        "doc_id", F.lit("withheld").alias("source"))
    out = R.apply_corrections(docs, fixes, "doc_id", "source")
    return R.with_constant(out, "model", "target").select("doc_id", "source", "model")


@register("equality_filter", """
SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'
""")
def q_equality_filter(spark, sf):
    return table(spark, sf, "documents").filter(F.col("source") == "src3").select("doc_id", "lang", "n_chars")


@register("membership_filter", """
SELECT doc_id, source, lang FROM documents
WHERE lang IN ('en', 'fr') AND doc_id IN (SELECT doc_id FROM labels)
""")
def q_membership_filter(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    d = R.filter_members(d, "lang", ["en", "fr"])
    return R.filter_members(d, "doc_id", table(spark, sf, "labels").select("doc_id"))


@register("refusal_filter", """
SELECT conv_id, turn FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations
                      WHERE contains(text, 'I apologize, but I cannot fulfill your request'))
""")
def q_refusal_filter(spark, sf):
    from strophekit.plans.scoring import REFUSAL_SENTENCES
    conv = table(spark, sf, "conversations")
    refused = conv.filter(F.col("text").contains(REFUSAL_SENTENCES[0])).select("conv_id")
    return conv.join(refused, "conv_id", "left_anti").select("conv_id", "turn")


@register("annotation_filter", f"""
SELECT doc_id, source FROM documents
WHERE NOT contains(text, '{ANNOTATION_NOISE[0]}') AND NOT contains(text, '{ANNOTATION_NOISE[1]}')
  AND doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL
  AND n_chars IS NOT NULL
""")
def q_annotation_filter(spark, sf):
    d = R.drop_substrings(table(spark, sf, "documents"), "text", ANNOTATION_NOISE)
    return d.select("doc_id", "source")


@register("numeric_filters", """
SELECT event_id, event_type, value FROM events WHERE value >= 0 AND user_id > 0
""")
def q_numeric_filters(spark, sf):
    e = table(spark, sf, "events")
    return e.filter((F.col("value") >= 0) & (F.col("user_id") > 0)).select("event_id", "event_type", "value")


@register("value_replace", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View'
                  ELSE event_type END AS event_type
FROM events
""")
def q_value_replace(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return R.replace_values(e, "event_type", EVENT_RENAMES)


_CAT_SQL = _py_index_case("floor((event_id - 81) / 10)::BIGINT", CATEGORIES)


@register("question_category", f"""
SELECT event_id, {_CAT_SQL} AS category FROM events
""")
def q_question_category(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", R.list_bucket(F.col("event_id"), 81, 10, CATEGORIES).alias("category"))


@register("judge_mean_by_category", f"""
WITH j AS (SELECT user_id AS model, {_CAT_SQL} AS category, value AS score FROM events)
SELECT model, category, round(avg(score), 6) AS score
FROM j WHERE score >= 0 AND category IS NOT NULL GROUP BY model, category
""")
def q_judge_mean(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("model"),
        R.list_bucket(F.col("event_id"), 81, 10, CATEGORIES).alias("category"),
        F.col("value").alias("score"))
    out = R.mean_by_group(e, ["model", "category"], "score",
                          (F.col("score") >= 0) & F.col("category").isNotNull())
    return out.select("model", "category", r6(F.col("score")).alias("score"))


@register("distinct_values", "SELECT DISTINCT event_type FROM events")
def q_distinct(spark, sf):
    return table(spark, sf, "events").select("event_type").distinct()


@register("joined_labels", """
SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def q_joined_labels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return R.join_narrowed(d, table(spark, sf, "labels"), "doc_id", ["quality"])


@register("left_join_keys", """
SELECT l.doc_id, l.quality, d.source FROM labels l
LEFT JOIN (SELECT doc_id AS song_id, source FROM documents) d ON l.doc_id = d.song_id
""")
def q_left_join_keys(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", "quality")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("song_id"), "source")
    return R.left_join_keys(l, d, "doc_id", "song_id").select("doc_id", "quality", "source")


@register("common_ids", """
WITH k AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id)
SELECT user_id, n AS n_members FROM k WHERE n = (SELECT count(DISTINCT event_type) FROM events)
""")
def q_common_ids(spark, sf):
    return R.common_keys(table(spark, sf, "events"), "user_id", "event_type")


@register("common_id_rows", """
WITH k AS (SELECT user_id FROM events GROUP BY user_id
           HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events))
SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM k)
""")
def q_common_id_rows(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return R.prune_to_common(e, "user_id", "event_type").select("event_id", "user_id")


@register("leak_guard", f"""
SELECT doc_id FROM documents
WHERE {_sql_title_key('text')} NOT IN (SELECT {_sql_title_key('text')} FROM benchmark)
""")
def q_leak_guard(spark, sf):
    d = table(spark, sf, "documents", spread=True).select("doc_id", "text")
    b = table(spark, sf, "benchmark")
    return R.leak_guard(d, b, title_key(F.col("text")), title_key(F.col("text"))).select("doc_id")


@register("dedup_first", f"""
SELECT doc_id, source FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY {_sql_title_key('text')} ORDER BY doc_id) AS rn
  FROM documents) WHERE rn = 1
""")
def q_dedup_first(spark, sf):
    d = table(spark, sf, "documents", spread=True).select("doc_id", "source", title_key(F.col("text")).alias("k"))
    return R.dedup_first(d, ["k"], ["doc_id"]).select("doc_id", "source")


@register("row_slice", """
SELECT doc_id, row_no FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_no FROM documents)
WHERE row_no >= 10 AND row_no < 60
""")
def q_row_slice(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return R.row_slice(d, "doc_id", 10, 50).select("doc_id", "row_no")


@register("round_robin_shard", """
SELECT doc_id, (row_number() OVER (ORDER BY doc_id) % 8)::INT AS shard FROM documents
""")
def q_round_robin(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return R.round_robin_shard(d, "doc_id", 8)


@register("multikey_sort", """
SELECT doc_id, source, n_chars FROM documents ORDER BY source DESC, n_chars DESC, doc_id
""")
def q_multikey_sort(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return d.orderBy(F.col("source").desc(), F.col("n_chars").desc(), "doc_id")


@register("custom_order", f"""
SELECT event_type, list_position({list(EVENT_ORDER)}, event_type)::INT AS order_key
FROM (SELECT DISTINCT event_type FROM events) ORDER BY order_key DESC
""")
def q_custom_order(spark, sf):
    e = table(spark, sf, "events").select("event_type").distinct()
    key = R.list_position_desc(F.col("event_type"), EVENT_ORDER).cast("int")
    return e.select("event_type", key.alias("order_key")).orderBy(F.col("order_key").desc())


@register("union_texts", """
SELECT 'documents' AS origin, doc_id AS item_id, length(text)::BIGINT AS n_chars FROM documents
UNION ALL
SELECT 'benchmark' AS origin, item_id, length(text)::BIGINT AS n_chars FROM benchmark
""")
def q_union(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("documents").alias("origin"),
                                             F.col("doc_id").alias("item_id"), "text")
    b = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("origin"), "item_id", "text")
    u = d.unionByName(b)
    return u.select("origin", "item_id", F.length("text").cast("long").alias("n_chars"))


@register("unpivot_labels", """
SELECT doc_id, 'quality' AS measure, quality AS value FROM labels
UNION ALL SELECT doc_id, 'toxic' AS measure, toxic AS value FROM labels
""")
def q_unpivot(spark, sf):
    return R.unpivot(table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"], "measure", "value")


@register("pivot_events", "SELECT user_id, " + ", ".join(
    f"round(avg(CASE WHEN event_type = '{t}' THEN value END), 6) AS {t}" for t in EVENT_TYPES)
    + " FROM events GROUP BY user_id")
def q_pivot(spark, sf):
    e = table(spark, sf, "events")
    out = R.pivot_agg(e, ["user_id"], "event_type", EVENT_TYPES, F.avg("value"))
    return out.select("user_id", *[r6(F.col(t)).alias(t) for t in EVENT_TYPES])


def _a1_sql():
    cols = []
    for m in SOURCES:
        cols.append(f"round_even(median(CASE WHEN source = '{m}' THEN n_chars END)::DOUBLE, 2) "
                    f"AS \"{m} median score\"")
        cols.append(f"round_even(avg(CASE WHEN source = '{m}' THEN n_chars END)::DOUBLE, 2) "
                    f"AS \"{m} mean score\"")
    return ("SELECT lang AS \"Measure\", " + ", ".join(cols) + " FROM documents GROUP BY lang "
            "ORDER BY \"src0 median score\" DESC, \"src0 mean score\" DESC")


@register("mean_median_table", _a1_sql())
def q_mean_median(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", F.col("n_chars").cast("double").alias("v"))
    return R.mean_median_table(d, "lang", "source", "v", SOURCES, "src0")


def _votes(spark, sf):
    l = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, "tuned").otherwise("base").alias("chosen_model"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("artist"))
    return l, d


@register("vote_counts", """
SELECT d.source AS artist,
       count(*) FILTER (WHERE l.quality <> 1)::BIGINT AS base,
       count(*) FILTER (WHERE l.quality = 1)::BIGINT AS tuned
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.source
""")
def q_vote_counts(spark, sf):
    l, d = _votes(spark, sf)
    j = R.join_narrowed(l, d, "id", ["artist"])
    return R.count_pivot(j, "artist", "chosen_model", ["base", "tuned"])


@register("vote_win_rates", """
WITH c AS (
  SELECT d.source AS artist,
         count(*) FILTER (WHERE l.quality <> 1)::BIGINT AS base,
         count(*) FILTER (WHERE l.quality = 1)::BIGINT AS tuned
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.source)
SELECT artist, base, tuned, (base + tuned)::BIGINT AS num_votes,
       round(tuned::DOUBLE / (base + tuned), 6) AS win_rate
FROM c WHERE base + tuned >= 12
""")
def q_vote_win_rates(spark, sf):
    l, d = _votes(spark, sf)
    c = R.count_pivot(R.join_narrowed(l, d, "id", ["artist"]), "artist", "chosen_model", ["base", "tuned"])
    w = R.win_rates(c, "tuned", "base", 12)
    return w.select("artist", "base", "tuned", "num_votes", r6(F.col("win_rate")).alias("win_rate"))


@register("overall_win_rate", """
SELECT round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS win_rate FROM labels
""")
def q_overall(spark, sf):
    l, _ = _votes(spark, sf)
    return R.overall_rate(l, "chosen_model", "tuned", "base").select(r6(F.col("win_rate")).alias("win_rate"))


@register("box_summary", """
WITH q AS (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3, count(value) AS n
  FROM events GROUP BY event_type),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       n::BIGINT AS n, round(iqr, 6) AS iqr,
       round(min(CASE WHEN e.value BETWEEN lo AND hi THEN e.value END), 6) AS lo_whisker,
       round(max(CASE WHEN e.value BETWEEN lo AND hi THEN e.value END), 6) AS hi_whisker,
       sum(CASE WHEN e.value BETWEEN lo AND hi THEN 0 ELSE 1 END)::BIGINT AS n_outliers
FROM f JOIN events e ON e.event_type = f.event_type
GROUP BY f.event_type, q1, median, q3, n, iqr
""")
def q_box_summary(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    b = R.box_summary(e, ["event_type"], "value")
    return b.select("event_type", *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3")],
                    F.col("n").cast("long").alias("n"), r6(F.col("iqr")).alias("iqr"),
                    r6(F.col("lo_whisker")).alias("lo_whisker"), r6(F.col("hi_whisker")).alias("hi_whisker"),
                    "n_outliers")
