"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a written file, at most some hundred bytes each.
FILE_ROWS = 50_000
#: Removes the shuffle files of a job when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "vecrec", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators rely on; cluster settings given outside win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("VECREC_DRIVER_MEMORY", "8g"))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and hand-over tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder: on a cluster a machine-local folder is lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vecrec-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy survives lost executors, later plans start from a short scan with known size (so joins can
    be chosen well) and column pruning, and no constraints of the old plan are carried along. Shuffle files
    of the job go with its end; else those of many rounds stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if was is None else spark.conf.set(SHUFFLE_CLEANUP, was)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.cut_path = path
    return stored


def forget(*stored: DataFrame) -> None:
    """Remove tables of :func:`cut_lineage` that no later plan reads, such as those of a round that is over."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fewer_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as ``rows``, the most it can have, ask for, or one for each core if that is more.

    For small tables written again and again, which otherwise have a file for each shuffle partition.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def cut_and_count(df: DataFrame, changed: Column) -> tuple[DataFrame, int]:
    """``cut_lineage`` that also counts rows where ``changed`` holds, in the same job."""
    stored, (n,) = cut_and_sum(df, [changed])
    return stored, n


def cut_and_sum(df: DataFrame, sums: list[Column]) -> tuple[DataFrame, list[int]]:
    """``cut_lineage`` that also sums integer (or boolean) columns, in the same job."""
    seen = Observation()
    counted = df.observe(seen, *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"n{i}") for i, c in enumerate(sums)])
    stored = cut_lineage(counted)
    return stored, [int(seen.get[f"n{i}"]) for i in range(len(sums))]
