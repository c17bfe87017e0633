"""Source/sink round trips (S2, S3, S8, K1-K3): a query writes part of a
given table to a fresh folder under the shared checkpoint directory and
reads it back with an explicit schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophekit.plans.catalog import register, table
from strophekit.session import scratch_path
from strophekit.sources import io as IO


@register("jsonl_roundtrip", """
SELECT doc_id AS id, source AS artist, length(text)::BIGINT AS n_chars, md5(text) AS lyrics_md5
FROM documents
""")
def q_jsonl(spark, sf):
    d = table(spark, sf, "documents", spread=True).select(
        F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("song"),
        F.col("source").alias("artist"), F.col("text").alias("lyrics"), F.lit(None).cast("string").alias("prompt"))
    path = scratch_path(spark, "jsonl")
    IO.write_json(d, path)
    back = IO.read_jsonl(spark, path, IO.PROMPTS_SCHEMA)
    return back.select("id", "artist", F.length("lyrics").cast("long").alias("n_chars"),
                       F.md5("lyrics").alias("lyrics_md5"))


@register("csv_roundtrip", """
SELECT doc_id AS id, md5(text) AS lyrics_md5, lang AS annotation FROM documents
""")
def q_csv(spark, sf):
    d = table(spark, sf, "documents", spread=True).select(F.col("doc_id").alias("id"), F.col("text").alias("lyrics"),
                                             F.col("lang").alias("annotation"))
    path = scratch_path(spark, "csv")
    IO.write_csv(d, path, ["id", "lyrics", "annotation"])
    back = IO.read_csv(spark, path, IO.LYRICS_SCHEMA)
    return back.select("id", F.md5("lyrics").alias("lyrics_md5"), "annotation")


@register("model_outputs_tagged", """
SELECT source AS model, doc_id AS id, length(text)::BIGINT AS n_chars FROM documents
""")
def q_model_outputs(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    base = scratch_path(spark, "outputs")
    d.select(F.col("doc_id").alias("id"), F.col("text").alias("model_response"), "source") \
     .write.partitionBy("source").json(base)
    models = d.select(F.col("source").alias("file"), F.col("source").alias("model")).distinct()
    folder = F.regexp_extract("_metadata.file_path", "source=([^/]+)/", 1)
    back, _ = IO.read_model_folder(spark, base, models, multiline=False, file_key=folder)
    return back.select("model", "id", F.length("model_response").cast("long").alias("n_chars"))


def _streamed_sql() -> str:
    from strophekit.plans.q_songs import _x1_sql
    return f"SELECT id, side, measure, score, n_pairs FROM ({_x1_sql()})"


@register("streamed_song_scores", _streamed_sql())
def q_streamed(spark, sf):
    """The streaming scorer end to end: every conversation, rebuilt as a
    song text, lands as JSON files in a fresh folder; the file stream
    scores them (availableNow) into a parquet sink, which is read back."""
    from strophekit.plans.q_songs import rebuilt_songs
    from strophekit.streaming.incremental import score_stream
    src, sink, ckpt = (scratch_path(spark, x) for x in ("stream-in", "stream-out", "stream-ckpt"))
    rebuilt_songs(spark, sf).select("id", F.col("text").alias("model_response")).write.json(src)
    q = score_stream(spark, src, sink, ckpt, sides={"pred": "model_response"}, once=True)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return out.select("id", "side", "measure", F.round("score", 6).alias("score"), "n_pairs")
