"""Recommend entities near the liked ones, for a whole batch of requests in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecrec.operators import rerank
from vecrec.operators.score import request_profiles, score_candidates


def join_spaces(primary: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Primary entity table plus one vector column per further space (null where missing)."""
    out = primary
    for i, other in enumerate(others):
        out = out.join(other.select("entity_id", F.col("vector").alias(f"vector_{i + 1}")), "entity_id", "left")
    return out


def recommend(
    entities: DataFrame,
    requests: DataFrame,
    dims: list[int],
    top_k: int = 10,
    secondary: DataFrame | None = None,
    tertiary: DataFrame | None = None,
    weights: list[float] | None = None,
    use_confidence: bool = True,
    mmr_lambda: float = 1.0,
    max_per_group: int = 0,
    pool_size: int = 50,
    segment_mode: str = "auto",
    min_image_count: int = 0,
    min_confidence: float = 0.0,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """``requests(request_id, entity_id)`` -> ranked rows per request.

    ``entities(entity_id, group_name, ord, image_count, confidence, segment, vector)``; further spaces give
    ``(entity_id, vector)``; ``aliases(entity_id, alias_id)``. Liked entities are exempt from the quality
    filters and part of the background population.
    """
    others = [s for s in (secondary, tertiary) if s is not None]
    spaces = [("vector", dims[0])] + [(f"vector_{i + 1}", dims[i + 1]) for i in range(len(others))]
    wide = join_spaces(entities, others)
    if aliases is not None:
        wide = wide.join(aliases.select("entity_id", "alias_id"), "entity_id", "left")
        wide = wide.withColumn("alias_id", F.coalesce("alias_id", "entity_id"))
    else:
        wide = wide.withColumn("alias_id", F.col("entity_id"))
    profiles, bans = request_profiles(requests, wide.drop("alias_id"), spaces, aliases, segment_mode)
    wide = wide.withColumn(
        "candidate", (F.col("image_count") >= min_image_count) & (F.col("confidence") >= min_confidence)
    )
    pool_n = max(top_k, pool_size)
    scored = score_candidates(wide, profiles, spaces, list(weights or [1.0]), use_confidence, pool_n, aliases is not None)
    scored = rerank.drop_liked_aliases(scored, bans)
    if aliases is not None:
        scored = rerank.dedupe_aliases(scored)
    pool = rerank.top_k(scored, pool_n).drop("rank")
    labels = wide.select("entity_id", "group_name", "image_count", "confidence", "segment")
    pool = pool.join(labels, "entity_id")
    if mmr_lambda >= 1.0:
        return rerank.top_k(rerank.cap_groups(pool, max_per_group), top_k).drop("alias_id")
    vectors = wide.select("entity_id", *[c for c, _ in spaces])
    order = rerank.diversify(pool.join(vectors, "entity_id"), spaces, mmr_lambda, top_k, max_per_group)
    return pool.join(order, ["request_id", "entity_id"]).drop("alias_id")
