"""Registered queries for readers of given file forms (S1, S4, S5, S6), score
records (K1) and checkpoint tables (P8, P11, A11).  Spark derives each file
from a given table, writes it to a fresh folder under the shared checkpoint
directory, and the reader under test reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophekit.operators import relational as R
from strophekit.plans import prep as P
from strophekit.plans.catalog import QUERIES, r6, register, table
from strophekit.plans.q_io import _streamed_sql
from strophekit.plans.q_relational import EVENT_TYPES
from strophekit.session import scratch_path
from strophekit.sources import io as IO

ARRAY_IDS = 500  # ids per file that holds one JSON array


def _arrays(df, key: str, record, path: str) -> None:
    """One JSON array per block of ids, each in a file of its own."""
    blocks = df.groupBy(F.floor(F.col(key) / ARRAY_IDS).alias("block")).agg(F.to_json(F.collect_list(record)).alias("value"))
    blocks.write.partitionBy("block").text(path)


@register("json_array_records", """
SELECT doc_id AS id, source AS artist, length(text)::BIGINT AS n_chars, md5(text) AS response_md5 FROM documents
""")
def q_json_arrays(spark, sf):
    """Files that hold one JSON array of song records each."""
    path = scratch_path(spark, "json-arrays")
    _arrays(table(spark, sf, "documents"), "doc_id", F.struct(
        F.col("doc_id").alias("id"), F.col("source").alias("artist"), F.col("text").alias("model_response")), path)
    back = IO.read_json_array(spark, path)
    return back.select("id", "artist", F.length("model_response").cast("long").alias("n_chars"), F.md5("model_response").alias("response_md5"))


@register("syllable_lexicon_lines", """
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)
SELECT word, ((length(word) + 2) // 3)::INT AS num_syllables,
       rtrim(regexp_replace(word, '(.{3})', '\\1-', 'g'), '-') AS split FROM w
""")
def q_syllable_lexicon(spark, sf):
    """``word=syl-la-ble`` lines, a word as often as it occurs, cut after every third letter."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w"))
    path = scratch_path(spark, "lexicon")
    words.select(F.concat("w", F.lit("="), F.regexp_replace("w", "(.{3})(?=.)", "$1-")).alias("value")).write.text(path)
    back = IO.read_syllable_lexicon(spark, path)
    return back.select("word", "num_syllables", F.array_join("syllables", "-").alias("split"))


@register("padded_word_list", """
WITH w AS (SELECT unnest(string_split_regex(text, '\\s+')) AS word FROM benchmark)
SELECT ' ' || word || ' ' AS word, count(*) AS n FROM (
  SELECT word FROM w UNION ALL SELECT 'one more'
) WHERE word <> '' GROUP BY ALL
""")
def q_word_list(spark, sf):
    """A word per line, blank lines between texts, one word appended, padded."""
    path = scratch_path(spark, "words")
    table(spark, sf, "benchmark").select(F.concat(F.array_join(F.split("text", r"\s+"), "\n"), F.lit("\n")).alias("value")).write.text(path)
    return IO.read_word_list(spark, path, pad=True, extra=("one more",)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@register("votes_from_files", """
SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'tuned' ELSE 'base' END AS chosen_model FROM labels WHERE doc_id IS NOT NULL
""")
def q_votes(spark, sf):
    """Files that hold one JSON array of ``{song id: chosen model}`` maps each."""
    path = scratch_path(spark, "votes")
    chosen = F.when(F.col("quality") == 1, "tuned").otherwise("base")
    _arrays(table(spark, sf, "labels").filter("doc_id is not null"), "doc_id", F.create_map(F.col("doc_id").cast("string"), chosen), path)
    return IO.read_votes(spark, path)


@register("scored_records", f"""
SELECT id, side, measure, score FROM ({_streamed_sql()})
""")
def q_scored_records(spark, sf):
    """K1: song records with a map of scores per side, written as JSON lines and read back."""
    scores = QUERIES["scored_songs"](spark, sf)
    songs = table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct()
    path = scratch_path(spark, "records")
    IO.write_json(P.scored_records(songs, scores, ["id"]), path)
    sides = "pred_scores map<string,double>, target_scores map<string,double>"
    back = IO.read_jsonl(spark, path, f"id long, {sides}")
    both = [back.select("id", F.lit(side).alias("side"), F.explode(f"{side}_scores").alias("measure", "score")) for side in ("pred", "target")]
    return both[0].unionByName(both[1]).withColumn("score", r6(F.col("score")))


@register("outputs_by_checkpoint", """
SELECT CASE WHEN lang = 'en' THEN 'tuned-chat-temp-1' WHEN doc_id % 3 = 1 THEN 'tuned' ELSE 'tuned-chat' END AS model,
       CASE WHEN doc_id % 3 = 2 THEN 0 WHEN source = 'src0' THEN 50 WHEN source = 'src1' THEN 100
            WHEN source = 'src2' THEN 150 END::INT AS checkpoint,
       count(*) AS count
FROM documents GROUP BY 1, 2
""")
def q_by_checkpoint(spark, sf):
    """Answers counted per output file, then by the family and checkpoint in its name."""
    third = F.pmod("doc_id", F.lit(3))
    base = F.when(third == 0, "tuned-chat").when(third == 1, "tuned").otherwise("llama-2-7b-chat")
    step = F.when(F.col("source") == "src0", "-50").when(F.col("source") == "src1", "-100").when(F.col("source") == "src2", "-150").otherwise("-last")
    heat = F.when(F.col("lang") == "en", "-temp-1").otherwise("")
    path = F.concat(base, F.lit("-checkpoint"), step, heat, F.lit("-test-outputs.json"))
    per_file = table(spark, sf, "documents").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return P.counts_by_checkpoint(per_file)


@register("training_curves", f"""
SELECT user_id AS step, event_type AS run, round(avg(value), 6) AS loss
FROM events WHERE event_type IN {EVENT_TYPES!r} GROUP BY ALL HAVING avg(value) IS NOT NULL
""")
def q_curves(spark, sf):
    """A wide table with a loss column and a helper column per run, made long without blanks."""
    events = table(spark, sf, "events")
    wide = R.pivot_agg(events, ["user_id"], "event_type", EVENT_TYPES, F.avg("value"))
    wide = wide.select(F.col("user_id").alias("Step"), *[F.col(t).alias(f"{t} - train/loss") for t in EVENT_TYPES],
                       *[F.lit(-1.0).alias(f"{t} - train/loss__MIN") for t in EVENT_TYPES])
    return P.curves_long(wide).withColumn("loss", r6(F.col("loss")))
