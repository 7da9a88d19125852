"""Table readers: raw text columns -> typed, trimmed, defaulted columns.

The ``read_*`` helpers open files; the ``typed_*`` functions take any frame with the raw columns, so Parquet,
CSV and streams share them. CSV is read permissively with every cell as text (unknown columns are
ignored, extra cells dropped, a byte-order mark stripped by Spark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecrec.functions import text, vec
from vecrec.operators.rank import first_per_key

# fixed values: names of registry columns, file suffixes and statuses
REGISTRY_COLUMNS = ["member_id", "group_name", "member_name", "search_hint", "include_terms", "exclude_terms"]
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "gif")
SEEN_STATUSES = ("downloaded", "duplicate_phash")


def read_text_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, all cells text, quotes doubled the usual way."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
    if columns is None:
        return df
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def column_or_blank(df: DataFrame, name: str) -> Column:
    return text.clean(F.col(name)) if name in df.columns else F.lit("")


def typed_registry(raw: DataFrame) -> DataFrame:
    """Registry rows: blank ids dropped, hint defaults to ``group name``, term lists split."""
    c = {name: column_or_blank(raw, name) for name in REGISTRY_COLUMNS}
    default = F.trim(F.concat_ws(" ", F.nullif(c["group_name"], F.lit("")), F.nullif(c["member_name"], F.lit(""))))
    return raw.select(
        c["member_id"].alias("entity_id"),
        c["group_name"].alias("group_name"),
        c["member_name"].alias("entity_name"),
        F.when(c["search_hint"] != "", c["search_hint"]).otherwise(default).alias("search_hint"),
        text.term_list(c["include_terms"]).alias("include_terms"),
        text.term_list(c["exclude_terms"]).alias("exclude_terms"),
    ).where(F.col("entity_id") != "")


def typed_entity_vectors(raw: DataFrame, mode: str = "null") -> DataFrame:
    """Entity vectors: blank ids and missing vectors dropped, counts default 0, confidence default 0.5."""
    return raw.where((column_or_blank(raw, "member_id") != "") & (column_or_blank(raw, "vector_json") != "")).select(
        column_or_blank(raw, "member_id").alias("entity_id"),
        column_or_blank(raw, "group_name").alias("group_name"),
        column_or_blank(raw, "member_name").alias("entity_name"),
        text.number_or(F.col("image_count"), 0, "bigint").alias("image_count"),
        text.number_or(F.col("confidence"), 0.5).alias("confidence"),
        column_or_blank(raw, "gender").alias("segment"),
        vec.parse_vector(F.col("vector_json"), mode).alias("vector"),
    ).where(F.col("vector").isNotNull())


def typed_samples(raw: DataFrame, valid_only: bool = True, default_count: int = 1) -> DataFrame:
    """Sample embeddings. The validity test comes before the vector is parsed."""
    valid = text.lenient_bool(F.col("is_valid_face"))
    rows = raw.where(valid & (column_or_blank(raw, "member_id") != "")) if valid_only else raw
    return rows.select(
        column_or_blank(raw, "member_id").alias("entity_id"),
        column_or_blank(raw, "group_name").alias("group_name"),
        column_or_blank(raw, "member_name").alias("entity_name"),
        column_or_blank(raw, "image_path").alias("sample_path"),
        valid.alias("is_valid"),
        text.number_or(F.col("face_count"), default_count, "int").alias("face_count"),
        text.number_or(F.col("quality_score"), 0.0).alias("quality"),
        column_or_blank(raw, "gender").alias("segment"),
        vec.parse_vector(F.col("vector_json")).alias("vector"),
    )


def typed_secondary(raw: DataFrame, vector_column: str = "farl_vector_json") -> DataFrame:
    """Second-space samples; rows without key or vector are dropped."""
    return raw.select(
        column_or_blank(raw, "member_id").alias("entity_id"),
        column_or_blank(raw, "image_path").alias("sample_path"),
        vec.parse_vector(F.col(vector_column)).alias("vector"),
    ).where((F.col("entity_id") != "") & (F.col("sample_path") != "") & F.col("vector").isNotNull())


def typed_references(raw: DataFrame, order: str = "ord") -> DataFrame:
    """One reference vector per entity; the last row of an id wins."""
    rows = raw.select(column_or_blank(raw, "member_id").alias("entity_id"), F.col(order), vec.parse_vector(F.col("vector_json")).alias("vector"))
    rows = rows.where((F.col("entity_id") != "") & F.col("vector").isNotNull())
    return first_per_key(rows, ["entity_id"], [-F.col(order)]).drop(order)


def typed_features(raw: DataFrame, id_columns: list[str], features: list[str] | None = None) -> DataFrame:
    """Wide numeric features as one array; names come from the header, unparsable rows are dropped."""
    names = features or [c for c in raw.columns if c not in id_columns]
    array = F.array(*[F.col(c).try_cast("double") for c in names])
    return raw.select(*id_columns, array.alias("features")).where(~F.exists("features", lambda x: x.isNull()))


def typed_aliases(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Alias map; the alias column may be named ``alias_id``, ``person_id`` or ``canonical_id``."""
    choices = [F.nullif(column_or_blank(raw, c), F.lit("")) for c in ("alias_id", "person_id", "canonical_id") if c in raw.columns]
    rows = raw.select(column_or_blank(raw, "member_id").alias("entity_id"), F.coalesce(*choices).alias("alias_id"), *([order] if order else []))
    rows = rows.where((F.col("entity_id") != "") & F.col("alias_id").isNotNull())
    return first_per_key(rows, ["entity_id"], [-F.col(order)]).drop(order) if order else rows


def typed_segment_map(raw: DataFrame, key: str, out_key: str, allowed: tuple[str, ...], value: str = "gender") -> DataFrame:
    segment = F.upper(column_or_blank(raw, value))
    return raw.select(column_or_blank(raw, key).alias(out_key), segment.alias("segment")).where((F.col(out_key) != "") & F.col("segment").isin(*allowed))


def typed_labels(raw: DataFrame, key: str, label: str) -> DataFrame:
    return raw.select(column_or_blank(raw, key).alias(key), text.clean_label(F.col(label)).alias("label")).where((F.col(key) != "") & (F.col("label") != ""))


def file_listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """Files below ``root/<entity>/<file>``: entity, path and size. Only metadata is read, never content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(suffix.isin(*suffixes)).select(
        F.element_at(F.split("path", "/"), -2).alias("entity_id"), text.file_name(F.col("path")).alias("file_name"), "path", F.col("length").alias("bytes")
    )


def first_file_per_entity(files: DataFrame) -> DataFrame:
    return files.groupBy("entity_id").agg(F.min("path").alias("path"))


def unreferenced_files(files: DataFrame, used: DataFrame) -> DataFrame:
    """Files no valid row refers to."""
    return files.join(used.select("path").distinct(), "path", "left_anti")


def prune_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))


def preferred_path(rows: DataFrame, files: DataFrame, first: str, fallback: str) -> DataFrame:
    """The first path if that file exists, else the fallback if it exists, else the row is skipped."""
    have = files.select("path").distinct()
    a, b = have.select(F.col("path").alias(first), F.lit(True).alias("__a")), have.select(F.col("path").alias(fallback), F.lit(True).alias("__b"))
    out = rows.join(a, first, "left").join(b, fallback, "left")
    chosen = F.when(F.col("__a"), F.col(first)).when(F.col("__b"), F.col(fallback))
    return out.withColumn("chosen_path", chosen).where(F.col("chosen_path").isNotNull()).drop("__a", "__b")


def seen_urls(manifest: DataFrame) -> DataFrame:
    return manifest.select(text.clean(F.col("source_url")).alias("url")).where(F.col("url") != "").distinct()


def seen_fingerprints(manifest: DataFrame) -> DataFrame:
    rows = manifest.where(text.clean(F.col("status")).isin(*SEEN_STATUSES))
    return rows.select(text.clean(F.col("phash")).alias("phash")).where(F.col("phash").rlike("^[0-9A-Fa-f]+$")).distinct()


def seen_digests(files: DataFrame, path: str = "path") -> DataFrame:
    return files.select("entity_id", text.stem_digest(F.col(path)).alias("digest")).where(F.col("digest") != "").distinct()


def distinct_values(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.select(text.clean(F.col(column)).alias(out)).where(F.col(out) != "").distinct()
