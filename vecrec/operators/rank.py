"""Exact ranks, quantiles and first-row picks per key that stay parallel when one key is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecrec.session import cut_lineage

HOT_GROUP_ROWS = 2_000_000


def has_hot_group(df: DataFrame, keys: list[str], hot_rows: int = HOT_GROUP_ROWS) -> bool:
    """True when some key holds more than ``hot_rows`` rows (one map-side combined count)."""
    return not df.groupBy(*keys).count().where(F.col("count") > hot_rows).isEmpty()


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank", hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Add the exact 1-based row number per key.

    Groups up to ``hot_rows`` use one window. If a larger group exists, rows are range-partitioned on
    (key, order), which cuts a big group over many partitions; the number inside each cut plus the
    rows of earlier cuts gives the same rank. ``order`` must be total (end with a unique column).
    """
    if not has_hot_group(df, keys, hot_rows):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    # A tie-free order and a stored copy keep the cuts the same in both uses below.
    placed = cut_lineage(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__cut", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "__cut")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    local = placed.withColumn("__local", F.row_number().over(Window.partitionBy(*keys, "__cut").orderBy(*order)))
    return (
        local.join(offsets, [*keys, "__cut"])
        .withColumn(out, (F.col("__local") + F.col("__before")).cast("bigint"))
        .drop("__local", "__before", "__cut")
    )


def exact_median(df: DataFrame, keys: list[str], value: str, out: str, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Exact median per key (over all rows for ``keys=[]``)."""
    df = df.where(F.col(value).isNotNull())
    if not has_hot_group(df, keys, hot_rows):
        return df.groupBy(*keys).agg(F.median(value).alias(out))
    # equal values may swap places without changing the value at a rank
    spread = df.select(*keys, value).withColumn("__tie", F.monotonically_increasing_id())
    if not keys:
        spread = spread.withColumn("__all", F.lit(1))
    names = keys or ["__all"]
    by_rank = ranked(spread, names, [F.col(value), F.col("__tie")], "__r", hot_rows)
    sizes = by_rank.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    middle = (
        by_rank.join(sizes, names)
        .where((F.col("__r") == F.floor((F.col("__n") + 1) / 2)) | (F.col("__r") == F.floor((F.col("__n") + 2) / 2)))
        .groupBy(*names)
        .agg(F.avg(value).alias(out))
    )
    return middle.drop("__all")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per key (order-preserving distinct).

    Written as a struct minimum, so map tasks reduce to one row per key before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])
    agg = df.groupBy(*keys).agg(F.min(packed).alias("__first"))
    return agg.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(*df.columns)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """Top-n rows per key with a display rank. The constant bound lets Spark cut each map task's
    rows to n per key before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n).withColumn(out, F.col(out).cast("bigint"))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Reproducible sample without replacement: the n smallest keyed digests."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.withColumn("__digest", digest).orderBy("__digest", id_col).limit(n).drop("__digest")


def zero_padded(number: Column, width: int) -> Column:
    """``lpad`` that never cuts longer numbers."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
