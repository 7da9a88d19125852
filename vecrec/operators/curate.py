"""Curation: threshold marks against references, bounded removal, dry-run reports, detection choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecrec.functions import vec
from vecrec.operators.aggregate import mean_direction
from vecrec.operators.rank import HOT_GROUP_ROWS, exact_median, first_per_key, ranked


def mark_below_reference(samples: DataFrame, references: DataFrame, vector: str, dim: int, threshold: float) -> DataFrame:
    """Samples whose unit vector has cosine < threshold to their entity's reference vector, which is used
    as given. Entities without a reference are untouched (absent)."""
    units = vec.with_unit(samples, vector, "__u", dim)
    return (
        units.join(references.select("entity_id", F.col("vector").alias("__ref")), "entity_id")
        .withColumn("cos", vec.dot("__u", "__ref", dim))
        .where(F.col("cos") < threshold)
        .drop("__u", "__ref")
    )


def curate(
    samples: DataFrame,
    vector: str,
    dim: int,
    remove_invalid: bool = True,
    min_quality: float = 0.0,
    min_centroid: float | None = None,
    min_keep: int = 3,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Add ``removal_reason`` (null = keep) and ``centroid_similarity``.

    Invalid, then low quality, then farthest from the centroid of the survivors: worst first by
    (similarity, quality), never leaving fewer than ``min_keep`` rows of an entity.
    """
    usable = F.col("is_valid") & F.col(vector).isNotNull()
    first = F.when(~F.col("is_valid") & F.lit(remove_invalid), F.lit("invalid_result")).when(
        usable & (F.col("quality") < min_quality), F.lit(f"quality_score<{min_quality:.2f}")
    )
    rows = samples.withColumn("removal_reason", first)
    if min_centroid is None or min_centroid <= 0:
        return rows.withColumn("centroid_similarity", F.lit(None).cast("double"))
    alive = rows.where(F.col("removal_reason").isNull() & usable)
    centre = mean_direction(alive, ["entity_id"], vector, dim, "__c", normalise_rows=False).withColumnRenamed("n", "__n")
    scored = (
        vec.with_unit(alive, vector, "__u", dim)
        .join(centre, "entity_id")
        .select("entity_id", "sample_id", "ord", "quality", "__n", vec.dot("__u", "__c", dim).alias("cos"))
    )
    flagged = scored.where((F.col("cos") < min_centroid) & (F.col("__n") > min_keep))
    removed = (
        ranked(flagged, ["entity_id"], [F.col("cos"), F.col("quality"), F.col("ord")], "__r", hot_rows)
        .where(F.col("__r") <= F.col("__n") - min_keep)
        .select("sample_id", F.lit(f"centroid_similarity<{min_centroid:.2f}").alias("__far"))
    )
    return (
        rows.join(scored.select("sample_id", F.col("cos").alias("centroid_similarity")), "sample_id", "left")
        .join(removed, "sample_id", "left")
        .withColumn("removal_reason", F.coalesce("removal_reason", "__far"))
        .drop("__far")
    )


def removal_log(curated: DataFrame) -> DataFrame:
    keep = ["entity_id", "group_name", "sample_id", "is_valid", "face_count", "quality", "centroid_similarity", "removal_reason"]
    return curated.where(F.col("removal_reason").isNotNull()).select(*keep)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def valid_counts(samples: DataFrame) -> DataFrame:
    return count_by(samples.where("is_valid"), "entity_id")


def deficit_report(registry: DataFrame, samples: DataFrame, minimum: int) -> DataFrame:
    """Registry entities with fewer than ``minimum`` valid samples, zero included."""
    counts = valid_counts(samples)
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return registry.select("entity_id").distinct().join(counts, "entity_id", "left").select(
        "entity_id", n.alias("n_valid")
    ).where(F.col("n_valid") < minimum)


def dry_run(marked: DataFrame, top: int) -> DataFrame:
    """Removed count and worst cosine per entity, most removed first."""
    per = marked.groupBy("entity_id").agg(F.count(F.lit(1)).alias("removed"), F.min("cos").alias("worst"))
    return per.orderBy(F.col("removed").desc(), "entity_id").limit(top)


def dry_run_totals(marked: DataFrame) -> DataFrame:
    stats = marked.agg(F.count(F.lit(1)).alias("removed"), F.min("cos").alias("min_cos"), F.max("cos").alias("max_cos"))
    median = exact_median(marked, [], "cos", "median_cos")
    return stats.withColumn("__k", F.lit(1)).join(median.withColumn("__k", F.lit(1)), "__k", "left").drop("__k")


def choose_detection(detections: DataFrame, strategy: str, box: str = "bbox", size: tuple[str, str] = ("width", "height")) -> DataFrame:
    """One detection per sample: ``largest`` area, closest to the ``center``, or ``reject`` samples with several."""
    x0, y0, x1, y1 = (F.get(box, F.lit(i)) for i in range(4))
    area = F.greatest(F.lit(0.0), (x1 - x0) * (y1 - y0))
    dx, dy = (x0 + x1) / 2 - F.col(size[0]) / 2, (y0 + y1) / 2 - F.col(size[1]) / 2
    if strategy == "largest":
        return first_per_key(detections, ["sample_id"], [-area, F.col("det_no")])
    if strategy == "center":
        return first_per_key(detections, ["sample_id"], [F.sqrt(dx * dx + dy * dy), F.col("det_no")])
    if strategy == "reject":
        single = detections.groupBy("sample_id").agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select("sample_id")
        return detections.join(single, "sample_id", "left_semi")
    raise ValueError(f"unknown strategy: {strategy}")


def low_quality(count: Column, confidence: Column, min_count: int, min_confidence: float) -> Column:
    return (count < min_count) | (confidence < min_confidence)
