"""Vector expressions on ``array`` columns (parse, normalise, dot, concat, z-score).

Every helper takes SQL text (a column name or expression) and returns SQL text or a Column. When
the dimension is known and small the arithmetic is unrolled (``a[0]*b[0]+...``): unlike
higher-order functions that stays inside whole-stage codegen. Larger dimensions fall back to
``aggregate``/``zip_with``. After an aggregation (one row per key) the short higher-order form is used on
purpose: unrolling there inlines every sum into one oversized generated method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNROLL_LIMIT = 128
TINY = 1e-12
FLAT_SIGMA = 1e-6


def _tree(terms: list[str]) -> str:
    # balanced, so a 128-term sum is 7 levels deep instead of 128
    while len(terms) > 1:
        terms = [
            f"({terms[i]} + {terms[i + 1]})" if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)
        ]
    return terms[0]


def dot_sql(a: str, b: str, dim: int | None = None) -> str:
    if dim and dim <= UNROLL_LIMIT:
        return _tree([f"double({a}[{i}]) * double({b}[{i}])" for i in range(dim)])
    return f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"


def dot(a: str, b: str, dim: int | None = None) -> Column:
    return F.expr(dot_sql(a, b, dim))


def norm_sql(v: str, dim: int | None = None) -> str:
    return f"sqrt({dot_sql(v, v, dim)})"


def scale_sql(v: str, factor: str, dim: int | None = None) -> str:
    if dim and dim <= UNROLL_LIMIT:
        return "array(" + ", ".join(f"double({v}[{i}]) * {factor}" for i in range(dim)) + ")"
    return f"transform({v}, x -> double(x) * {factor})"


def divide_sql(v: str, divisor: str, dim: int | None = None) -> str:
    if dim and dim <= UNROLL_LIMIT:
        return "array(" + ", ".join(f"double({v}[{i}]) / {divisor}" for i in range(dim)) + ")"
    return f"transform({v}, x -> double(x) / {divisor})"


def with_unit(df: DataFrame, vec: str, out: str, dim: int | None = None, policy: str = "clip") -> DataFrame:
    """Add ``out`` = ``vec`` scaled to unit length.

    ``policy`` for a zero vector: ``raise`` an error, ``clip`` the norm at 1e-12, or ``pass`` it through.
    """
    norm = f"__norm_{out}"
    df = df.withColumn(norm, F.expr(norm_sql(vec, dim)))
    if policy == "raise":
        safe = f"if({norm} <= {TINY}D, double(raise_error('zero vector cannot be normalised')), {norm})"
    elif policy == "clip":
        safe = f"greatest({norm}, {TINY}D)"
    elif policy == "pass":
        safe = f"if({norm} <= {TINY}D, 1D, {norm})"
    else:
        raise ValueError(f"unknown zero-vector policy: {policy}")
    df = df.withColumn(norm, F.expr(safe))
    return df.withColumn(out, F.expr(f"if({vec} is null, null, {divide_sql(vec, norm, dim)})")).drop(norm)


def parse_vector(text: Column, mode: str = "null") -> Column:
    """JSON text -> non-empty ``array<double>``. ``mode``: ``null`` on bad text, or ``raise``."""
    parsed = F.from_json(text, "array<double>")
    ok = (F.size(parsed) > 0) & ~F.exists(parsed, lambda x: x.isNull())
    if mode == "raise":
        return F.when(ok, parsed).otherwise(F.raise_error(F.lit("vector text must be a non-empty number list")))
    return F.when(ok, parsed)


def concat_spaces(a: str, b: str, mode: str = "both", weight: float = 1.0) -> str:
    """SQL of the fused feature before renormalising: ``primary``, ``secondary`` or ``both``."""
    if mode == "primary":
        return a
    if mode == "secondary":
        return b
    if mode == "both":
        return f"concat({a}, transform({b}, x -> double(x) * {float(weight)}D))"
    raise ValueError(f"unknown feature mode: {mode}")


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std < FLAT_SIGMA, x - mean).otherwise((x - mean) / std)


def confidence_scaled(score: Column, confidence: Column) -> Column:
    return score * (F.lit(0.5) + F.lit(0.5) * confidence)


def dimension_report(df: DataFrame, vec: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(
        F.min(F.size(vec)).cast("bigint").alias("min_dim"),
        F.max(F.size(vec)).cast("bigint").alias("max_dim"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def require_dimension(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Fail the job on the first row whose vector has another length (no extra pass)."""
    checked = F.when(F.size(vec) == dim, F.col(vec)).otherwise(
        F.raise_error(F.concat(F.lit(f"vector length is not {dim}: "), F.size(vec).cast("string")))
    )
    return df.withColumn(vec, checked)


def vector_sums(
    df: DataFrame, keys: list[str], vec: str, dim: int, out: str = "sum_vec", weight: str | None = None, extra: list[Column] | None = None
) -> DataFrame:
    """Per key: per-dimension sums as one array plus ``extra`` aggregates, one shuffle, map-side combined.

    A key that holds a large share of all rows is summed inside the map tasks first, so it costs no
    more than any other. Up to 128 dimensions the sums are fixed columns of one hash aggregate;
    beyond that, slices of 64 dimensions are aggregated per (key, slice).
    """
    extra = list(extra or [])
    w = f"{weight} * " if weight else ""
    if dim <= UNROLL_LIMIT:
        sums = [F.expr(f"sum({w}double({vec}[{i}]))").alias(f"__s{i}") for i in range(dim)]
        agg = df.groupBy(*keys).agg(*sums, *extra)
        kept = [c for c in agg.columns if not c.startswith("__s") and c not in keys]
        return agg.select(*keys, F.array(*[F.col(f"__s{i}") for i in range(dim)]).alias(out), *kept)
    width = 64
    n_slices = -(-dim // width)
    sliced = df.select(
        *keys,
        F.expr(weight or "1D").alias("__w"),
        F.posexplode(F.expr(f"transform(sequence(0, {n_slices - 1}), c -> slice({vec}, c * {width} + 1, {width}))")).alias("__c", "__v"),
    )
    sums = [F.expr(f"sum(__w * double(get(__v, {i})))").alias(f"__s{i}") for i in range(width)]
    parts = sliced.groupBy(*keys, "__c").agg(*sums)
    part = F.expr("filter(array(" + ",".join(f"__s{i}" for i in range(width)) + "), x -> x is not null)")
    joined = parts.groupBy(*keys).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__c", part.alias("__p")))), lambda s: s["__p"])).alias(out)
    )
    if not extra:
        return joined
    if not keys:
        raise ValueError("extra aggregates beyond 128 dimensions need a key")
    return joined.join(df.groupBy(*keys).agg(*extra), keys)
