"""Incremental forms on Structured Streaming.

All three write one partition per micro-batch (``epoch=N``, overwritten on a replay), so a batch that is
run again after a failure leaves the same files. Readers fold the partitions; nothing is kept in memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vecrec.functions import vec
from vecrec.operators.aggregate import consistency, merge_moments, moments
from vecrec.operators.rank import first_per_key
from vecrec.operators.registry import round_progress

#: Parts by key hash that a table of processed rows is written in.
KEY_BUCKETS = 64
#: Stands for all epochs written so far.
LAST_EPOCH = 2**31 - 1


def file_stream(spark: SparkSession, path: str, schema: StructType, glob: str | None = None, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, batch by batch, then stop."""
    q = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def epoch_path(path: str, epoch: int) -> str:
    return f"{path}/epoch={epoch}"


def written(spark: SparkSession, path: str) -> bool:
    """Whether files match ``path``."""
    try:
        spark.read.option("recursiveFileLookup", "true").text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_epochs(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All batch partitions with their ``epoch`` number."""
    reader = spark.read.option("basePath", path)
    if schema is not None:
        reader = reader.schema(StructType([*schema.fields, StructField("epoch", IntegerType())]))
    return reader.parquet(f"{path}/epoch=*")


def within_watermark(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Bounded-state de-duplication for repeats that arrive within ``delay``."""
    stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def skip_processed(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str) -> None:
    """Append only rows whose key was never written; the first row in ``order`` of a key wins in its batch.

    The written table itself is the memory, so repeats are skipped however late they come. It is written in
    ``KEY_BUCKETS`` parts by the hash of the key (column ``bucket``), and a batch reads the keys of its own
    parts only. A table goes with one checkpoint: epochs of a new one would replace those that are there, so
    that is an error.
    """
    schema = StructType([*stream.schema.fields, StructField("bucket", IntegerType())])
    spark = stream.sparkSession
    if written(spark, f"{path}/epoch=*") and not written(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{path} was written under another checkpoint")

    def handle(batch: DataFrame, epoch: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int").alias("bucket")
        fresh = first_per_key(batch, keys, [F.col(order)]).select("*", bucket)
        if epoch > 0:
            parts = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most KEY_BUCKETS
            done = read_epochs(batch.sparkSession, path, schema)
            # the batch is the small side: its parts of the written table are only scanned for keys, not shuffled
            known = done.where((F.col("epoch") < epoch) & F.col("bucket").isin(parts)).select(*keys).join(fresh.select(*keys), keys, "left_semi").distinct()
            fresh = fresh.join(known, keys, "left_anti")
        fresh.select(*batch.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(epoch_path(path, epoch))

    run_available(stream, handle, checkpoint)


def accumulate_moments(stream: DataFrame, key: str, vector: str, dim: int, path: str, checkpoint: str) -> None:
    """Write each batch's ``(n, sum_vec, sum_sq)`` of unit rows per key as a delta."""

    def handle(batch: DataFrame, epoch: int) -> None:
        unit = vec.with_unit(batch, vector, "__u", dim)
        moments(unit, [key], "__u", dim).write.mode("overwrite").parquet(epoch_path(path, epoch))

    run_available(stream, handle, checkpoint)


def current_vectors(spark: SparkSession, path: str, key: str, dim: int) -> DataFrame:
    """Unit vector and consistency per key from all deltas: equal to the batch aggregate without trim."""
    state = merge_moments(read_epochs(spark, path), [key], dim)
    state = state.withColumn("confidence", consistency())
    return vec.with_unit(state.withColumn("__m", F.expr(vec.divide_sql("sum_vec", "n"))), "__m", "vector").select(key, "n", "confidence", "vector")


def compact_moments(spark: SparkSession, path: str, key: str, dim: int, out: str) -> None:
    """Fold all deltas into one (written elsewhere; the caller swaps the folders between runs)."""
    merge_moments(read_epochs(spark, path), [key], dim).write.mode("overwrite").parquet(epoch_path(out, 0))


def count_progress(stream: DataFrame, key: str, path: str, checkpoint: str) -> None:
    """Running count per key in update mode: each batch writes the keys it changed with their new count."""
    counts = stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(epoch_path(path, epoch))

    run_available(counts, handle, checkpoint, mode="update")


def counts_upto(spark: SparkSession, path: str, key: str, epoch: int) -> DataFrame:
    rows = read_epochs(spark, path).where(F.col("epoch") <= epoch)
    return rows.groupBy(key).agg(F.max_by("n", "epoch").alias("n"))


def progress_between(spark: SparkSession, path: str, registry: DataFrame, minimum: int, before: int, after: int) -> DataFrame:
    """Round report between two epochs for registry entities that were short before."""
    b, a = (counts_upto(spark, path, "entity_id", e) for e in (before, after))
    lacking = registry.select("entity_id").join(b.where(F.col("n") >= minimum), "entity_id", "left_anti")
    return round_progress(lacking, b, a, minimum)
