"""Embedding measures.

Vectors are ``ARRAY<FLOAT|DOUBLE>`` columns.  Element-wise means go through
``posexplode`` + a partial (map-side) aggregation keyed by (group, index),
so a group never has to be held in one task; only the final centroid (one
vector of the embedding width) is assembled per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centroid(df: DataFrame, group: Sequence[str], vec: str, out: str = "centroid") -> DataFrame:
    """Element-wise mean vector per group."""
    group = list(group)
    ex = df.select(*group, F.posexplode(vec).alias("_i", "_x"))
    means = ex.groupBy(*group, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    g = means.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return g.select(*group, F.transform("_v", lambda s: s["_m"]).alias(out))


def sq_dist(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(sq_dist(a, b))


def dot(a: Column, b: Column) -> Column:
    p = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def internal_semantics(df: DataFrame, group: Sequence[str], vec: str) -> DataFrame:
    """Mean Euclidean distance of the vectors of a group to its
    centroid (centroids joined back by the group key)."""
    group = list(group)
    c = centroid(df, group, vec, "_c")
    j = df.select(*group, vec).join(c, on=group)
    return j.groupBy(*group).agg(F.avg(l2(F.col(vec), F.col("_c"))).alias("semantics_internal"))


def compared_semantics(df: DataFrame, group: Sequence[str], vec: str, pairs: DataFrame) -> DataFrame:
    """Euclidean distance between the centroids of two groups for every
    row of ``pairs`` (columns ``<g>_1``, ``<g>_2`` for each group column)."""
    group = list(group)
    c = centroid(df, group, vec, "_c")
    c1 = c.select(*[F.col(g).alias(f"{g}_1") for g in group], F.col("_c").alias("_c1"))
    c2 = c.select(*[F.col(g).alias(f"{g}_2") for g in group], F.col("_c").alias("_c2"))
    j = pairs.join(c1, on=[f"{g}_1" for g in group]).join(c2, on=[f"{g}_2" for g in group])
    return j.withColumn("semantics", l2(F.col("_c1"), F.col("_c2"))).drop("_c1", "_c2")


def aligned_similarity(models: DataFrame, target: DataFrame, model_col: str, key: str,
                       vec: str) -> DataFrame:
    """Rows of each model aligned with the target on ``key``; mean
    cosine similarity and mean Euclidean distance per model."""
    t = target.select(key, F.col(vec).alias("_t"))
    j = models.select(model_col, key, vec).join(t, on=key)
    return j.groupBy(model_col).agg(
        F.avg(cosine(F.col(vec), F.col("_t"))).alias("cosine"),
        F.avg(l2(F.col(vec), F.col("_t"))).alias("l2"))


def fit_pca_on_target(target: DataFrame, vec: str, k: int):
    """Centre on the target mean and fit ``k`` components on the target
    only (covariance is a d x d matrix; d is the embedding width)."""
    v = target.select(array_to_vector(F.col(vec)).alias("_v"))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_cv").fit(v)
    pca = PCA(k=k, inputCol="_cv", outputCol="_pc").fit(scaler.transform(v))
    return scaler, pca


def pca_project(df: DataFrame, vec: str, scaler, pca, out: str = "pc") -> DataFrame:
    v = df.withColumn("_v", array_to_vector(F.col(vec)))
    p = pca.transform(scaler.transform(v))
    return p.withColumn(out, vector_to_array("_pc")).drop("_v", "_cv", "_pc")


def pca_similarity(models: DataFrame, target: DataFrame, model_col: str, key: str, vec: str,
                   k: int = 5) -> DataFrame:
    """M17 after projecting everything on k components of the target."""
    scaler, pca = fit_pca_on_target(target, vec, k)
    pm = pca_project(models, vec, scaler, pca)
    pt = pca_project(target, vec, scaler, pca)
    return aligned_similarity(pm.drop(vec).withColumnRenamed("pc", vec), pt.drop(vec).withColumnRenamed("pc", vec),
                              model_col, key, vec)


def pc_window_centroids(df: DataFrame, target: DataFrame, group: Sequence[str], vec: str,
                        k: int = 10, offset: int = 3, width: int = 3) -> DataFrame:
    """K components fitted on the target, components [offset,
    offset+width) kept, centroid per group."""
    scaler, pca = fit_pca_on_target(target, vec, k)
    p = pca_project(df, vec, scaler, pca)
    p = p.withColumn("_w", F.slice("pc", offset + 1, width))
    return centroid(p, group, "_w", "centroid")


def attach_line_embeddings(arrays: DataFrame, keys: Sequence[str], line_vectors: DataFrame,
                           vec: str = "embedding") -> DataFrame:
    """Add ``vecs`` (one vector per line) to every stanza of a song-array
    table from a line-embedding table ``(keys, pos, line_no, vec)``.  One
    aggregation keyed by the song gathers a song's vectors."""
    keys = list(keys)
    g = line_vectors.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("pos", "line_no", F.col(vec).alias("v")))).alias("_lv"))
    j = arrays.join(g, on=keys, how="left")
    merged = F.transform("stanzas", lambda s: s.withField(
        "vecs", F.transform(F.filter(F.coalesce("_lv", F.array()), lambda x: x["pos"] == s["pos"]),
                            lambda x: x["v"])))
    return j.select(*keys, merged.alias("stanzas"))
