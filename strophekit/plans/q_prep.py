"""Registered queries for the preparation plans (C8, C9, X3) over the test
tables: documents and conversations stand in for the scraped parts, pages
for the song metadata, labels for the chosen test ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophekit.plans import prep as P
from strophekit.plans.catalog import register, table

SQL_KEY = "replace(lower(regexp_replace(split_part({x}, '(', 1), '^\\s+|\\s+$', '', 'g')), chr(8203), '')"
SQL_TRIM = """CASE
  WHEN contains({a}, 'Expand +') AND contains({a}, ' contributors')
    THEN split_part(split_part({a}, 'Expand +', 1), ' contributors', 2)
  WHEN contains({a}, 'Expand +') AND contains({a}, ' contributor')
    THEN split_part(split_part({a}, 'Expand +', 1), ' contributor', 2)
  WHEN contains({a}, 'Expand +') THEN split_part({a}, 'Expand +', 1)
  WHEN contains({a}, ' contributors') THEN split_part({a}, ' contributors', 2)
  WHEN contains({a}, ' contributor') THEN split_part({a}, ' contributor', 2)
  ELSE {a} END"""


def _parts(spark, sf):
    d = table(spark, sf, "documents", spread=True).select(F.col("doc_id").alias("id"), F.col("text").alias("lyrics"),
                                             F.col("lang").alias("annotation"), F.lit(0).cast("long").alias("ord"))
    c = table(spark, sf, "conversations", spread=True).select(F.col("conv_id").alias("id"), F.col("text").alias("lyrics"),
                                                 F.col("role").alias("annotation"), (F.col("turn") + 1).alias("ord"))
    meta = table(spark, sf, "pages", spread=True).select(F.lit("site").alias("artist"), F.col("page_id").alias("artist_id"),
                                            F.col("url").alias("song"), F.col("page_id").alias("song_id"))
    return d, c, meta


@register("catalogue_build", f"""
WITH u AS (
  SELECT doc_id AS id, text AS lyrics, lang AS annotation, 0 AS ord FROM documents
  UNION ALL SELECT conv_id, text, role, turn + 1 FROM conversations),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM u) WHERE rn = 1),
g AS (SELECT id, lyrics, {SQL_TRIM.format(a='annotation')} AS annotation FROM f
      WHERE NOT contains(annotation, 'inside scoop') AND NOT contains(annotation, 'bio is unreviewed')
        AND id IS NOT NULL AND lyrics IS NOT NULL AND annotation IS NOT NULL)
SELECT g.id, md5(g.lyrics) AS lyrics_md5, g.annotation, p.artist, p.artist_id, p.song
FROM g LEFT JOIN (SELECT 'site' AS artist, page_id AS artist_id, url AS song, page_id AS song_id FROM pages) p
  ON g.id = p.song_id
""")
def q_catalogue(spark, sf):
    d, c, meta = _parts(spark, sf)
    cat = P.build_catalogue([d, c], meta, order_col="ord")
    return cat.select("id", F.md5("lyrics").alias("lyrics_md5"), "annotation", "artist", "artist_id", "song")


def _songs(spark, sf):
    return table(spark, sf, "documents", spread=True).select(
        F.col("doc_id").alias("id"), F.split_part("text", F.lit("."), F.lit(1)).alias("song"),
        F.col("source").alias("artist"))


@register("train_test_split", f"""
WITH s AS (SELECT doc_id AS id, split_part(text, '.', 1) AS song, source AS artist FROM documents),
a AS (SELECT *, {SQL_KEY.format(x='song')} AS k FROM s WHERE artist = 'src1'),
allowed AS (SELECT DISTINCT {SQL_KEY.format(x="split_part(d.text, '.', 1)")} AS k
            FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1),
cand AS (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.k ORDER BY a.id) AS rn
                        FROM a WHERE a.k IN (SELECT k FROM allowed)) WHERE rn = 1),
test AS (SELECT * FROM a WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT id, 'train' AS part FROM cand WHERE k NOT IN (SELECT k FROM test)
UNION ALL SELECT id, 'test' AS part FROM test
""")
def q_split(spark, sf):
    songs = _songs(spark, sf)
    lab = table(spark, sf, "labels")
    allowed = songs.join(lab.filter("quality = 1").select(F.col("doc_id").alias("id")), "id", "left_semi") \
        .select("song")
    test_ids = lab.filter("toxic = 1").select(F.col("doc_id").alias("id"))
    train, test = P.split_train_test(songs, "src1", allowed, [], test_ids)
    return train.select("id", F.lit("train").alias("part")).unionByName(
        test.select("id", F.lit("test").alias("part")))


@register("input_rejects", """
WITH c AS (SELECT conv_id AS id, turn, text FROM conversations),
bad AS (SELECT id, 'missing:text' AS reason FROM c WHERE text IS NULL
        UNION ALL SELECT id, 'refused' FROM c
        WHERE contains(text, 'I apologize, but I cannot fulfill your request')),
good AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn) AS rn FROM c
         WHERE text IS NOT NULL AND NOT contains(text, 'I apologize, but I cannot fulfill your request'))
SELECT id, reason FROM bad UNION ALL SELECT id, 'duplicate' AS reason FROM good WHERE rn > 1
""")
def q_rejects(spark, sf):
    c = table(spark, sf, "conversations", spread=True).select(F.col("conv_id").alias("id"), "turn", "text")
    _, rejects = P.check_songs(c, ["id"], ["text"], ["turn"], refusal_col="text")
    return rejects
