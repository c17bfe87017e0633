"""Embedding queries (A7, M13, M14, M17-M19) over ``embeddings``: label =
model, label 0 = target, position = order of vec_id inside a label."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophekit.operators import embeddings as EM
from strophekit.plans.catalog import r6, register, table

SQL_POS = """
pos AS (SELECT label, vec_id, embedding,
               row_number() OVER (PARTITION BY label ORDER BY vec_id) AS position FROM embeddings)
"""
SQL_CENTROID = """
ex AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x
       FROM embeddings),
cen AS (SELECT label, i, avg(x) AS m FROM ex GROUP BY label, i)
"""


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


def _positioned(spark, sf):
    from strophekit.operators.relational import position_index
    return position_index(_emb(spark, sf), ["label"], "vec_id", "position")


@register("centroid_by_label", f"""
WITH {SQL_CENTROID}
SELECT label, list(round(m, 6) ORDER BY i) AS centroid FROM cen GROUP BY label
""")
def q_centroid(spark, sf):
    c = EM.centroid(_emb(spark, sf), ["label"], "embedding")
    return c.select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@register("internal_semantics", f"""
WITH {SQL_CENTROID},
c AS (SELECT label, list(m ORDER BY i) AS cv FROM cen GROUP BY label),
d AS (SELECT e.label, sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1),
              lambda k: pow(e.embedding[k]::DOUBLE - c.cv[k], 2)))) AS dist
      FROM embeddings e JOIN c ON e.label = c.label)
SELECT label, round(avg(dist), 6) AS semantics_internal FROM d GROUP BY label
""")
def q_internal_semantics(spark, sf):
    s = EM.internal_semantics(_emb(spark, sf), ["label"], "embedding")
    return s.select("label", r6(F.col("semantics_internal")).alias("semantics_internal"))


@register("compared_semantics", f"""
WITH {SQL_CENTROID},
c AS (SELECT label, list(m ORDER BY i) AS cv FROM cen GROUP BY label)
SELECT a.label AS label_1, 0 AS label_2,
       round(sqrt(list_sum(list_transform(range(1, len(a.cv) + 1), lambda k: pow(a.cv[k] - b.cv[k], 2)))), 6)
         AS semantics
FROM c a JOIN c b ON b.label = 0 WHERE a.label <> 0
""")
def q_compared_semantics(spark, sf):
    e = _emb(spark, sf)
    pairs = e.select(F.col("label").alias("label_1")).distinct().filter("label_1 <> 0") \
        .withColumn("label_2", F.lit(0))
    s = EM.compared_semantics(e, ["label"], "embedding", pairs)
    return s.select("label_1", "label_2", r6(F.col("semantics")).alias("semantics"))


@register("aligned_similarity", f"""
WITH {SQL_POS},
j AS (SELECT m.label, m.embedding AS a, t.embedding AS b FROM pos m JOIN pos t
      ON m.position = t.position AND t.label = 0 WHERE m.label <> 0),
s AS (SELECT label,
             list_sum(list_transform(range(1, len(a) + 1), lambda k: a[k]::DOUBLE * b[k]::DOUBLE)) AS ab,
             sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda k: a[k]::DOUBLE * a[k]::DOUBLE))) AS na,
             sqrt(list_sum(list_transform(range(1, len(b) + 1), lambda k: b[k]::DOUBLE * b[k]::DOUBLE))) AS nb,
             sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda k: pow(a[k]::DOUBLE - b[k]::DOUBLE, 2))))
               AS dist
      FROM j)
SELECT label, round(avg(ab / (na * nb)), 6) AS cosine, round(avg(dist), 6) AS l2 FROM s GROUP BY label
""")
def q_aligned(spark, sf):
    p = _positioned(spark, sf)
    models = p.filter("label <> 0")
    target = p.filter("label = 0")
    s = EM.aligned_similarity(models, target, "label", "position", "embedding")
    return s.select("label", r6(F.col("cosine")).alias("cosine"), r6(F.col("l2")).alias("l2"))


@register("pca_similarity")
def q_pca_similarity(spark, sf):
    p = _positioned(spark, sf)
    s = EM.pca_similarity(p.filter("label <> 0"), p.filter("label = 0"), "label", "position", "embedding", 5)
    return s.select("label", r6(F.col("cosine")).alias("cosine"), r6(F.col("l2")).alias("l2"))


@register("pc_window_centroids")
def q_pc_window(spark, sf):
    e = _emb(spark, sf)
    c = EM.pc_window_centroids(e, e.filter("label = 0"), ["label"], "embedding", 10, 3, 3)
    return c.select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@register("pca_similarity_full_rank", f"""
WITH {SQL_POS},
mean AS (SELECT i, avg(x) AS m FROM (
  SELECT unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label = 0) GROUP BY i),
j AS (SELECT a.label, a.vec_id, unnest(range(1, len(a.embedding) + 1)) AS i, unnest(a.embedding)::DOUBLE AS x,
             unnest(t.embedding)::DOUBLE AS y
      FROM pos a JOIN pos t ON a.position = t.position AND t.label = 0 WHERE a.label <> 0),
s AS (SELECT label, vec_id, sqrt(sum((x - y) ** 2)) AS dist,
             sum((x - m) * (y - m)) / (sqrt(sum((x - m) ** 2)) * sqrt(sum((y - m) ** 2))) AS cos
      FROM j JOIN mean USING (i) GROUP BY label, vec_id)
SELECT label, round(avg(cos), 6) AS cosine, round(avg(dist), 6) AS l2 FROM s GROUP BY label
""")
def q_pca_full_rank(spark, sf):
    """M18 with as many components as the vectors are wide: a turn about the
    target's mean, which leaves distances as they are and cosines those of centred vectors."""
    p = _positioned(spark, sf)
    width = p.select(F.max(F.size("embedding"))).first()[0]
    s = EM.pca_similarity(p.filter("label <> 0"), p.filter("label = 0"), "label", "position", "embedding", width)
    return s.select("label", r6(F.col("cosine")).alias("cosine"), r6(F.col("l2")).alias("l2"))
