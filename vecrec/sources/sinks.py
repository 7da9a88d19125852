"""Table writers and maintenance: export, append, scoped overwrite, keyed updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_entity_vectors(entities: DataFrame) -> DataFrame:
    """Text form of the vector table: compact JSON vectors, confidence to four decimals."""
    return entities.select(
        "entity_id", "group_name", "image_count", "kept_count", F.format_string("%.4f", "confidence").alias("confidence"), "segment",
        F.to_json("vector").alias("vector_json"),
    )


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def evolve(df: DataFrame, columns: list[str], fill: str = "") -> DataFrame:
    """Rows in the current column order, columns the old rows lack filled with ``fill``, others dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def append_evolving(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    return evolve(old, columns).unionByName(evolve(new, columns))


def append_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Only rows of ``new`` whose key is not there yet.

    The old table is reduced to the keys the new rows ask for; with few new rows it is scanned, not shuffled.
    """
    known = old.select(key).join(new.select(key).distinct(), key, "left_semi").distinct()
    return new.join(known, key, "left_anti").select(*new.columns)


def drop_entities(df: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti").select(*df.columns)


def overwrite_entities(old: DataFrame, new: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """Old rows of the chosen ids replaced by the new rows, all others kept."""
    return drop_entities(old, ids, key).unionByName(new)


def write_entity_partitions(df: DataFrame, path: str, bucket: str) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def update_keyed(df: DataFrame, keys: DataFrame, on: list[str], changes: dict[str, Column]) -> DataFrame:
    """Apply column changes to rows whose key is listed (merge: matched -> update)."""
    hit = keys.select(*on).distinct().withColumn("__hit", F.lit(True))
    out = df.join(hit, on, "left")
    for name, value in changes.items():
        out = out.withColumn(name, F.when(F.col("__hit"), value).otherwise(F.col(name)))
    return out.select(*df.columns)


def delete_keyed(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti").select(*df.columns)
