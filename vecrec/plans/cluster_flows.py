"""Composite clustering flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecrec.functions import vec
from vecrec.operators import cluster, graph, pairs
from vecrec.session import cut_lineage


def feature_entities(
    entities: DataFrame,
    secondary: DataFrame | None,
    aliases: DataFrame,
    mode: str = "primary",
    weight: float = 1.0,
    min_image_count: int = 5,
    min_confidence: float = 0.35,
) -> DataFrame:
    """Entities fit for clustering: quality filters, one row per alias, one unit feature vector."""
    rows = entities.where((F.col("image_count") >= min_image_count) & (F.col("confidence") >= min_confidence))
    if mode != "primary":
        rows = rows.join(secondary.select("entity_id", F.col("vector").alias("__second")), "entity_id")
    rows = cluster.collapse_aliases(rows, aliases)
    rows = rows.withColumn("__f", F.expr(vec.concat_spaces("vector", "__second", mode, weight)))
    return vec.with_unit(rows, "__f", "feature", policy="pass").drop("__f", "__second")


def cluster_samples_then_vote(
    samples: DataFrame, vector: str, dim: int, pca_dim: int, eps: list[float], min_sizes: list[int], k: int, target_k: float
) -> DataFrame:
    """Samples -> PCA -> best density setting -> majority cluster per entity."""
    units = vec.with_unit(samples, vector, "__u", dim).drop(vector)
    reduced, _ = cluster.pca(cut_lineage(units), "__u", dim, pca_dim)
    width = min(pca_dim, dim)
    rows = cut_lineage(reduced.drop("__u"))
    nodes, members = pairs.distinct_vectors(rows, "sample_id", "reduced")
    nodes = cut_lineage(nodes)
    found = cut_lineage(graph.density_clusters(graph.density_labels(nodes, "reduced", width, eps, k), members, min_sizes))
    scores = cluster.density_scan_scores(found, rows, "sample_id", "reduced", target_k)
    best = scores.orderBy(F.col("score").desc(), "eps", "min_size").limit(1).select("eps", "min_size")
    chosen = found.join(best, ["eps", "min_size"], "left_semi").select(F.col("id").alias("sample_id"), F.col("label").alias("cluster_id"))
    return cluster.vote_entities(rows.join(chosen, "sample_id"))
