"""Entity aggregation: mean direction, trim, consistency, attribute votes, entity-vector build.

The iterative spherical mean has the normalised arithmetic mean as its fixed point, and the mean
pairwise cosine is ``(|S|^2 - sum|u|^2) / (n(n-1))`` with S the sum of the unit rows. Both follow from
``(n, S, sum|u|^2)``, which adds up over rows, tasks and micro-batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecrec.functions import vec
from vecrec.operators.rank import HOT_GROUP_ROWS, ranked

MIN_WEIGHT = 1e-6


def moments(df: DataFrame, keys: list[str], vector: str, dim: int, extra: list[Column] | None = None) -> DataFrame:
    """``(n, sum_vec, sum_sq)`` per key."""
    base = [
        F.count(F.lit(1)).alias("n"),
        F.sum(vec.dot(vector, vector, dim)).alias("sum_sq"),
        *(extra or []),
    ]
    return vec.vector_sums(df, keys, vector, dim, "sum_vec", extra=base)


def merge_moments(df: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Add partial moments per key (the same state for batch parts and micro-batches)."""
    return vec.vector_sums(
        df, keys, "sum_vec", dim, "sum_vec", extra=[F.sum("n").alias("n"), F.sum("sum_sq").alias("sum_sq")]
    )


def consistency(n: str = "n", sum_vec: str = "sum_vec", sum_sq: str = "sum_sq") -> Column:
    """Mean pairwise cosine clipped to [0, 1]; 0.5 for fewer than two rows."""
    total = vec.dot_sql(sum_vec, sum_vec)
    return F.expr(
        f"case when {n} < 2 then 0.5D else greatest(0D, least(1D, ({total} - {sum_sq}) / (double({n}) * ({n} - 1)))) end"
    )


def mean_direction(
    df: DataFrame,
    keys: list[str],
    vector: str,
    dim: int,
    out: str = "vector",
    normalise_rows: bool = True,
    weight: str | None = None,
    extra: list[Column] | None = None,
    policy: str = "clip",
) -> DataFrame:
    """Unit mean vector per key; ``weight`` gives the quality-weighted mean (weights at least 1e-6)."""
    source = "__unit" if normalise_rows else vector
    if normalise_rows:
        df = vec.with_unit(df, vector, "__unit", dim, policy)
    factor = f"greatest(double({weight}), {MIN_WEIGHT}D)" if weight else None
    sums = vec.vector_sums(df, keys, source, dim, "__sum", weight=factor, extra=[F.count(F.lit(1)).alias("n"), *(extra or [])])
    # the scale of the sum does not matter for its direction, but the clip at 1e-12 is on the mean
    if factor is None:
        sums = sums.withColumn("__sum", F.expr(vec.divide_sql("__sum", "n")))
    return vec.with_unit(sums, "__sum", out, policy="clip").drop("__sum")


def plain_mean(df: DataFrame, keys: list[str], vector: str, dim: int, min_rows: int = 1, unit: bool = True, out: str = "vector") -> DataFrame:
    sums = vec.vector_sums(df, keys, vector, dim, "__sum", extra=[F.count(F.lit(1)).alias("n")]).where(F.col("n") >= min_rows)
    mean = sums.withColumn(out, F.expr(vec.divide_sql("__sum", "n"))).drop("__sum")
    return vec.with_unit(mean.withColumnRenamed(out, "__mean"), "__mean", out, policy="clip").drop("__mean") if unit else mean


def trim_outliers(
    samples: DataFrame, key: str, unit: str, dim: int, fraction: float, min_keep: int, order: str = "ord", hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Keep the ``max(min_keep, half-even round(n*(1-fraction)))`` rows most central to their key."""
    if fraction <= 0:
        return samples
    centre = mean_direction(samples, [key], unit, dim, "__centre", normalise_rows=False).withColumnRenamed("n", "__n")
    scored = samples.join(centre, key).withColumn("__cos", vec.dot(unit, "__centre", dim)).drop("__centre")
    keep = F.expr(
        f"case when __n <= {int(min_keep)} then __n else greatest({int(min_keep)}L, bigint(bround(__n * (1D - {float(fraction)}D)))) end"
    )
    scored = scored.withColumn("__keep", keep)
    by_rank = ranked(scored, [key], [F.col("__cos").desc(), F.col(order)], "__rank", hot_rows)
    return by_rank.where(F.col("__rank") <= F.col("__keep")).drop("__n", "__cos", "__keep", "__rank")


def dominant_value(df: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    """Most frequent non-empty value per key, first seen wins ties. Keys without a value are absent."""
    votes = (
        df.where(F.col(value) != "")
        .groupBy(key, value)
        .agg(F.count(F.lit(1)).alias("__c"), F.min(order).alias("__first"))
    )
    return votes.groupBy(key).agg(F.max_by(value, F.struct("__c", -F.col("__first"))).alias(out))


def group_votes(entities: DataFrame, group_map: DataFrame, mixed: str = "COED", order: str = "ord") -> DataFrame:
    """Per group: the segment every member takes. A mixed group gets none from votes; a majority of at
    least half wins otherwise; an external non-mixed value overrides the votes."""
    votes = (
        entities.where((F.col("segment") != "") & (F.col("group_name") != ""))
        .groupBy("group_name", "segment")
        .agg(F.count(F.lit(1)).alias("__c"), F.min(order).alias("__first"))
        .groupBy("group_name")
        .agg(
            F.max_by("segment", F.struct("__c", -F.col("__first"))).alias("__top"),
            F.max("__c").alias("__max"),
            F.sum("__c").alias("__all"),
        )
    )
    both = votes.join(group_map.select("group_name", F.col("segment").alias("__given")), "group_name", "full_outer")
    chosen = F.when(F.col("__given") == mixed, F.lit(None).cast("string")).when(
        F.col("__given").isNotNull(), F.col("__given")
    ).when(F.col("__max") / F.col("__all") >= 0.5, F.col("__top"))
    return both.select("group_name", chosen.alias("group_segment")).where(F.col("group_segment").isNotNull())


def apply_segment_overrides(entities: DataFrame, group_segment: DataFrame, entity_map: DataFrame) -> DataFrame:
    """Entity map beats the group value, which beats the entity's own value."""
    own = entity_map.select("entity_id", F.col("segment").alias("__own"))
    return (
        entities.join(group_segment, "group_name", "left")
        .join(own, "entity_id", "left")
        .withColumn("segment", F.coalesce("__own", "group_segment", "segment"))
        .drop("__own", "group_segment")
        .select(*entities.columns)
    )


def eligible_samples(samples: DataFrame, min_quality: float = 0.0, max_detections: int = 1) -> DataFrame:
    """Valid, single-detection (unknown count is 1), good enough, with a non-blank entity id."""
    return samples.where(
        F.col("is_valid")
        & (F.coalesce(F.col("face_count"), F.lit(1)) <= max_detections)
        & (F.coalesce(F.col("quality"), F.lit(0.0)) >= min_quality)
        & (F.trim(F.coalesce(F.col("entity_id"), F.lit(""))) != "")
    )


def build_entity_vectors(
    samples: DataFrame,
    vector: str,
    dim: int,
    min_quality: float = 0.0,
    min_samples: int = 1,
    trim_fraction: float = 0.0,
    min_keep: int = 3,
    aggregator: str = "spherical",
    group_map: DataFrame | None = None,
    entity_map: DataFrame | None = None,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Samples -> one unit vector, consistency score and segment per entity."""
    unit = vec.with_unit(eligible_samples(samples, min_quality).where(F.size(vector) > 0), vector, "__unit", dim)
    head = (
        unit.groupBy("entity_id")
        .agg(
            F.count(F.lit(1)).alias("image_count"),
            F.max_by("group_name", "ord").alias("group_name"),
            F.min("ord").alias("ord"),
        )
        .where(F.col("image_count") >= min_samples)
    )
    kept = trim_outliers(unit, "entity_id", "__unit", dim, trim_fraction, min_keep, hot_rows=hot_rows)
    state = moments(kept, ["entity_id"], "__unit", dim)
    if aggregator == "mean":
        weight = f"greatest(double(quality), {MIN_WEIGHT}D)"
        state = state.join(
            vec.vector_sums(kept, ["entity_id"], "__unit", dim, "__mean", weight=weight), "entity_id"
        )
    else:
        state = state.withColumn("__mean", F.expr(vec.divide_sql("sum_vec", "n")))
    state = state.withColumn("confidence", consistency())
    state = vec.with_unit(state, "__mean", "vector").select(
        "entity_id", F.col("n").alias("kept_count"), "confidence", "vector"
    )
    segments = dominant_value(unit, "entity_id", "segment", "ord", "segment")
    built = (
        head.join(state, "entity_id")
        .join(segments, "entity_id", "left")
        .withColumn("segment", F.coalesce("segment", F.lit("")))
        .select("entity_id", "group_name", "ord", "image_count", "kept_count", "confidence", "segment", "vector")
    )
    if group_map is not None:
        built = apply_segment_overrides(
            built,
            group_votes(built, group_map),
            entity_map if entity_map is not None else built.sparkSession.createDataFrame([], "entity_id string, segment string"),
        )
    return built


def build_second_space_vectors(
    secondary: DataFrame, primary: DataFrame, vector: str, dim: int, min_samples: int = 5, trim_fraction: float = 0.15, min_keep: int = 3, single_detection: bool = True, **options
) -> DataFrame:
    """Entity vectors of a second space, led by the first: ``secondary(entity_id, sample_id, ord, <vector>)``
    rows count only where ``primary(entity_id, sample_id, is_valid, face_count, quality, group_name, segment)``
    holds the sample as valid (and, unless told otherwise, with one detection). Quality, group and segment
    are the primary's; trim, consistency and segment votes run on the second space's rows.

    Of several primary rows of a sample any valid one admits it, with the last one's values (by ``ord``).
    """
    known = primary.where(F.col("is_valid") & (F.trim(F.coalesce("entity_id", F.lit(""))) != ""))
    if single_detection:
        known = known.where(F.coalesce(F.col("face_count"), F.lit(1)) == 1)
    last = F.max_by(F.struct("group_name", "quality", "segment"), "ord").alias("__p")
    known = known.groupBy("entity_id", "sample_id").agg(last).select("entity_id", "sample_id", "__p.*")
    rows = secondary.select("entity_id", "sample_id", "ord", vector).join(known, ["entity_id", "sample_id"])
    rows = rows.withColumn("is_valid", F.lit(True)).withColumn("face_count", F.lit(1)).withColumn("quality", F.coalesce("quality", F.lit(0.0)))
    return build_entity_vectors(rows, vector, dim, float("-inf"), min_samples, trim_fraction, min_keep, **options)
