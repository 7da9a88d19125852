"""Role views over the shared tables, as Spark frames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

D1 = 32  # primary space: first half of the embedding
D2 = 32  # secondary space: second half

SAMPLES_SQL = """samples AS (
  SELECT vec_id AS sample_id, vec_id AS ord, label*5 + vec_id % 5 AS entity_no,
         concat('e', lpad(CAST(label*5 + vec_id % 5 AS VARCHAR), 3, '0')) AS entity_id,
         concat('g', label) AS group_name,
         CAST(embedding[1:32] AS DOUBLE[]) AS v1, CAST(embedding[33:64] AS DOUBLE[]) AS v2,
         vec_id % 17 <> 0 AS is_valid,
         CASE WHEN vec_id % 13 = 0 THEN 2 ELSE 1 END AS face_count,
         CAST((vec_id*37) % 100 AS DOUBLE) / 100 AS quality,
         CASE WHEN vec_id % 10 = 0 THEN ''
              WHEN (label + CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 0 END) % 2 = 0 THEN 'A' ELSE 'B' END AS segment
  FROM embeddings)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    entity_no = "label*5 + vec_id % 5"
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS sample_id",
        "vec_id AS ord",
        f"{entity_no} AS entity_no",
        f"concat('e', lpad(cast({entity_no} AS string), 3, '0')) AS entity_id",
        "concat('g', label) AS group_name",
        "cast(slice(embedding, 1, 32) AS array<double>) AS v1",
        "cast(slice(embedding, 33, 32) AS array<double>) AS v2",
        "vec_id % 17 <> 0 AS is_valid",
        "CASE WHEN vec_id % 13 = 0 THEN 2 ELSE 1 END AS face_count",
        "cast((vec_id*37) % 100 AS double) / 100 AS quality",
        "CASE WHEN vec_id % 10 = 0 THEN '' "
        "WHEN (label + CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 0 END) % 2 = 0 THEN 'A' ELSE 'B' END AS segment",
    )


# Small role maps, all keyed by ids found in the data.
MAPS_SQL = """aliases AS (
  SELECT DISTINCT entity_id, CASE WHEN entity_no IN (3, 8) THEN 'p1' ELSE 'p2' END AS alias_id
  FROM samples WHERE entity_no IN (3, 8, 12, 22)),
group_map AS (
  SELECT DISTINCT group_name, CASE WHEN group_name = 'g0' THEN 'A' ELSE 'COED' END AS segment
  FROM samples WHERE group_name IN ('g0', 'g1')),
entity_map AS (SELECT DISTINCT entity_id, 'B' AS segment FROM samples WHERE entity_no = 7),
requests AS (
  SELECT DISTINCT concat('r', label) AS request_id,
         concat('e', lpad(CAST(CASE WHEN k = 0 THEN label*5 ELSE (label*5 + 7) % 50 END AS VARCHAR), 3, '0')) AS entity_id
  FROM embeddings CROSS JOIN (VALUES (0), (1)) AS t(k))"""


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    return (
        samples(spark, sf)
        .where("entity_no IN (3, 8, 12, 22)")
        .selectExpr("entity_id", "CASE WHEN entity_no IN (3, 8) THEN 'p1' ELSE 'p2' END AS alias_id")
        .distinct()
    )


def group_map(spark: SparkSession, sf: str) -> DataFrame:
    return (
        samples(spark, sf)
        .where("group_name IN ('g0', 'g1')")
        .selectExpr("group_name", "CASE WHEN group_name = 'g0' THEN 'A' ELSE 'COED' END AS segment")
        .distinct()
    )


def entity_map(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).where("entity_no = 7").selectExpr("entity_id", "'B' AS segment").distinct()


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "embeddings")
        .select("label")
        .distinct()
        .selectExpr("concat('r', label) AS request_id", "explode(array(label*5, (label*5 + 7) % 50)) AS entity_no")
        .selectExpr("request_id", "concat('e', lpad(cast(entity_no AS string), 3, '0')) AS entity_id")
    )
