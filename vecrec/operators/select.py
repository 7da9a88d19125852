"""Row selection helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidate_filter(entities: DataFrame, liked: DataFrame, min_count: int = 0, min_confidence: float = 0.0, allowed: str | None = None) -> DataFrame:
    """Entities that may be recommended: not liked, enough samples, consistent, right or unknown segment."""
    rows = entities.join(liked.select("entity_id").distinct(), "entity_id", "left_anti")
    rows = rows.where((F.col("image_count") >= min_count) & (F.col("confidence") >= min_confidence))
    return rows.where((F.col("segment") == "") | (F.col("segment") == allowed)) if allowed else rows


def without_prefixes(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    for p in prefixes:
        df = df.where(~F.startswith(F.col(column), F.lit(p)))
    return df
