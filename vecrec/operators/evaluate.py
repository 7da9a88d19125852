"""Evaluation of vectors: similarity summaries, leave-one-out identification, fusion-weight grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecrec.functions import vec
from vecrec.operators.aggregate import mean_direction, moments
from vecrec.operators.blocks import RIGHT_ROWS, block_apply, matrix, self_block_apply
from vecrec.operators.rank import exact_median, has_hot_group
from vecrec.session import cut_lineage

KEY_BITS, PASS_BITS = 52, 13


def _pair_keys(a: np.ndarray, b: np.ndarray, ordered: bool, ids_a, ids_b) -> np.ndarray:
    s = np.clip(a @ b.T, -1.0, 1.0)
    s = s[np.asarray(ids_a)[:, None] < np.asarray(ids_b)[None, :]] if ordered else s.ravel()
    return np.minimum(((s + 1.0) * 2.0 ** (KEY_BITS - 1)).astype(np.int64), 2**KEY_BITS - 1)


def pair_order_stats(units: DataFrame, key: str, id_col: str, block_rows: int = RIGHT_ROWS) -> DataFrame:
    """Exact median, min and max of all pairwise cosines within each key.

    Keys of up to ``block_rows`` rows are one bounded group each. Larger keys are cut into block pairs; the
    median is found by radix selection on the 52-bit fixed-point cosine: every pass counts 8192 bins
    per key, so neither pairs nor whole keys ever meet in one place.
    """

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        u = matrix(pdf["u"])
        s = (u @ u.T)[np.triu_indices(len(u), k=1)]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "med": [np.median(s)], "low": [s.min()], "high": [s.max()]})

    sizes = units.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2")
    schema = f"{key} string, med double, low double, high double"
    rows = units.select(key, F.col(id_col).alias("id"), "u").join(sizes, key)
    small = rows.where(F.col("__n") <= block_rows).groupBy(key).applyInPandas(whole, schema)
    if not has_hot_group(units, [key], block_rows):
        return small

    big = cut_lineage(rows.where(F.col("__n") > block_rows))

    def extremes(a: pd.DataFrame, b: pd.DataFrame, ordered: bool) -> pd.DataFrame:
        s = matrix(a["u"]) @ matrix(b["u"]).T
        s = s[a["id"].to_numpy()[:, None] < b["id"].to_numpy()[None, :]] if ordered else s.ravel()
        if not len(s):
            return pd.DataFrame({key: [], "low": [], "high": []})
        return pd.DataFrame({key: [a[key].iloc[0]], "low": [s.min()], "high": [s.max()]})

    bounds = (
        self_block_apply(big, extremes, f"{key} string, low double, high double", "id", 0, block_rows=block_rows, within=key)
        .groupBy(key).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    pairs = sizes.where(F.col("__n") > block_rows).select(key, F.expr("__n * (__n - 1) div 2").alias("m"))
    state = cut_lineage(
        pairs.select(key, F.explode(F.array(F.struct(F.lit(1).alias("which"), F.expr("(m + 1) div 2").alias("r")),
                                            F.struct(F.lit(2).alias("which"), F.expr("(m + 2) div 2").alias("r")))).alias("x"))
        .select(key, "x.which", "x.r", F.lit(0).cast("bigint").alias("prefix"))
    )
    shift = KEY_BITS
    while shift > 0:
        shift -= PASS_BITS
        current = shift

        def counts(a: pd.DataFrame, b: pd.DataFrame, ordered: bool) -> pd.DataFrame:
            q = _pair_keys(matrix(a["u"]), matrix(b["u"]), ordered, a["id"], b["id"])
            outs = []
            for which, column in ((1, "p1"), (2, "p2")):
                prefix = int(a[column].iloc[0])
                hit = q[(q >> (current + PASS_BITS)) == prefix]
                bins, n = np.unique(hit >> current, return_counts=True)
                outs.append(pd.DataFrame({key: a[key].iloc[0], "which": which, "bin": bins, "c": n}))
            return pd.concat(outs, ignore_index=True)

        prefixes = state.groupBy(key).agg(
            F.max(F.when(F.col("which") == 1, F.col("prefix"))).alias("p1"), F.max(F.when(F.col("which") == 2, F.col("prefix"))).alias("p2")
        )
        hist = (
            self_block_apply(big.join(prefixes, key), counts, f"{key} string, which int, bin long, c long", "id", 0, block_rows=block_rows, within=key)
            .groupBy(key, "which", "bin").agg(F.sum("c").alias("c"))
        )
        upto = F.sum("c").over(Window.partitionBy(key, "which").orderBy("bin"))
        state = cut_lineage(
            hist.withColumn("upto", upto).join(state.drop("prefix"), [key, "which"])
            .where((F.col("upto") >= F.col("r")) & (F.col("upto") - F.col("c") < F.col("r")))
            .select(key, "which", (F.col("r") - (F.col("upto") - F.col("c"))).alias("r"), F.col("bin").alias("prefix"))
        )
    value = F.col("prefix") / F.lit(float(2 ** (KEY_BITS - 1))) - 1.0
    medians = state.groupBy(key).agg(F.avg(value).alias("med"))
    return small.unionByName(medians.join(bounds, key).select(key, "med", "low", "high"))


def similarity_summary(samples: DataFrame, vector: str, dim: int, min_samples: int = 2, block_rows: int = RIGHT_ROWS) -> DataFrame:
    """Per entity: pair statistics of unit rows and cosines to the (raw-mean) centroid."""
    units = vec.with_unit(samples, vector, "u", dim).select("entity_id", "group_name", "sample_id", "ord", "u", vector)
    sizes = units.groupBy("entity_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_samples)
    units = units.join(sizes, "entity_id").drop("__n")
    centre = mean_direction(units, ["entity_id"], vector, dim, "c", normalise_rows=False).drop("n")
    cosines = (
        units.join(centre, "entity_id")
        .withColumn("cos", vec.dot("u", "c", dim))
        .groupBy("entity_id")
        .agg(
            F.max_by("group_name", "ord").alias("group_name"),
            F.avg("cos").alias("mean_centroid_cosine"),
            F.min("cos").alias("min_centroid_cosine"),
            F.max("cos").alias("max_centroid_cosine"),
            F.min_by("sample_id", F.struct("cos", "ord")).alias("worst_sample"),
        )
    )
    total = vec.dot_sql("sum_vec", "sum_vec")
    mean_pair = moments(units, ["entity_id"], "u", dim).select(
        "entity_id",
        F.col("n").alias("image_count"),
        F.expr("n * (n - 1) div 2").alias("pair_count"),
        F.expr(f"({total} - sum_sq) / (double(n) * (n - 1))").alias("mean_pairwise_cosine"),
    )
    order = pair_order_stats(units, "entity_id", "sample_id", block_rows).select(
        "entity_id",
        F.col("med").alias("median_pairwise_cosine"),
        F.col("low").alias("min_pairwise_cosine"),
        F.col("high").alias("max_pairwise_cosine"),
    )
    return cosines.join(mean_pair, "entity_id").join(order, "entity_id")


def overall_report(summary: DataFrame) -> DataFrame:
    """Means and medians over entities, as (metric, mean, median) rows."""
    out = None
    for metric in ("mean_pairwise_cosine", "mean_centroid_cosine", "min_centroid_cosine"):
        mean = summary.agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("n_entities"))
        both = mean.withColumn("metric", F.lit(metric)).join(
            exact_median(summary, [], metric, "median").withColumn("metric", F.lit(metric)), "metric"
        )
        out = both if out is None else out.unionByName(both)
    return out


def _loo_cosine(unit: str, total: str, dim: int) -> str:
    """Cosine of a unit row to the unit mean of the *other* rows of its entity: u.(S-u)/|S-u|."""
    us, ss, uu = vec.dot_sql(unit, total, dim), vec.dot_sql(total, total, dim), vec.dot_sql(unit, unit, dim)
    return f"(({us}) - ({uu})) / greatest(sqrt(greatest(0D, ({ss}) - 2 * ({us}) + ({uu}))), {vec.TINY}D)"


def leave_one_out(samples: DataFrame, vector: str, dim: int) -> DataFrame:
    """Per sample: cosine to its own entity without it, and the best other entity's centroid."""
    units = vec.with_unit(samples, vector, "u", dim).select("entity_id", "sample_id", "u", vector)
    sums = vec.vector_sums(units, ["entity_id"], "u", dim, "total", extra=[F.count(F.lit(1)).alias("n")]).where("n >= 2")
    own = units.join(sums, "entity_id").withColumn("own", F.expr(_loo_cosine("u", "total", dim)))
    others = mean_direction(units, ["entity_id"], vector, dim, "c", normalise_rows=False).where("n >= 2").select("entity_id", "c")

    def best_other(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        s = matrix(left["u"]) @ matrix(right["c"]).T
        s[left["entity_id"].to_numpy()[:, None] == right["entity_id"].to_numpy()[None, :]] = -np.inf
        top = s.max(axis=1)
        ok = np.isfinite(top)
        return pd.DataFrame({"sample_id": left["sample_id"].to_numpy()[ok], "b": top[ok]})

    best = block_apply(
        own.select("sample_id", "entity_id", "u"), others, best_other, "sample_id long, b double", "sample_id", "entity_id", 8 * dim + 64
    ).groupBy("sample_id").agg(F.max("b").alias("best_other"))
    return own.select("sample_id", "entity_id", "own").join(best, "sample_id", "left")


def leave_one_out_accuracy(samples: DataFrame, vector: str, dim: int) -> DataFrame:
    """One row; a tie goes to the own entity; with one eligible entity the comparison columns are null."""
    rows = leave_one_out(samples, vector, dim)
    hit = F.when(F.col("best_other").isNotNull(), (F.col("own") >= F.col("best_other")).cast("double"))
    per_entity = rows.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("h"), F.sum("own").alias("o"), F.sum("best_other").alias("b")
    )
    n = F.sum("n")
    return per_entity.agg(
        F.count(F.lit(1)).alias("eligible_entities"),
        n.alias("eligible_samples"),
        (F.sum("h") / n).alias("top1_accuracy"),
        (F.sum("o") / n).alias("mean_own_similarity"),
        (F.sum("b") / n).alias("mean_best_other_similarity"),
        ((F.sum("o") - F.sum("b")) / n).alias("mean_margin"),
    )


def fusion_grid(
    pairs: DataFrame, vectors: tuple[str, str], dims: tuple[int, int], grid: list[tuple[float, float]], min_samples: int = 2
) -> DataFrame:
    """Leave-one-out accuracy and margin for every weight pair, all cells in one plan.

    ``pairs`` holds one row per sample with both vectors. Per probe both spaces are z-scored over all
    entities (own entity without the probe); the shift cancels in the margin, so only 1/sigma is used.
    """
    (va, vb), (da, db) = vectors, dims
    cells = [(a, b) for a, b in grid if not (a == 0 and b == 0)]
    sized = pairs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, min_samples))
    units = vec.with_unit(vec.with_unit(pairs.join(sized, "entity_id"), va, "a", da), vb, "b", db)
    units = units.select("entity_id", "sample_id", "a", "b")
    sums = vec.vector_sums(units, ["entity_id"], "a", da, "ta").join(vec.vector_sums(units, ["entity_id"], "b", db, "tb"), "entity_id")
    centres = vec.with_unit(vec.with_unit(sums, "ta", "ca"), "tb", "cb").select("entity_id", "ca", "cb")
    probes = (
        units.join(sums, "entity_id")
        .withColumn("own_a", F.expr(_loo_cosine("a", "ta", da)))
        .withColumn("own_b", F.expr(_loo_cosine("b", "tb", db)))
        .drop("ta", "tb")
    )
    probes = cut_lineage(probes)

    def cosines(left, right):
        same = left["entity_id"].to_numpy()[:, None] == right["entity_id"].to_numpy()[None, :]
        return matrix(left["a"]) @ matrix(right["ca"]).T, matrix(left["b"]) @ matrix(right["cb"]).T, same

    def spread(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sa, sb, same = cosines(left, right)
        sa[same] = 0.0
        sb[same] = 0.0
        return pd.DataFrame({
            "sample_id": left["sample_id"], "n": (~same).sum(axis=1),
            "xa": sa.sum(axis=1), "qa": (sa * sa).sum(axis=1), "xb": sb.sum(axis=1), "qb": (sb * sb).sum(axis=1),
        })

    row_bytes = 8 * (da + db) + 64
    stats = block_apply(
        probes, centres, spread, "sample_id long, n long, xa double, qa double, xb double, qb double", "sample_id", "entity_id", row_bytes
    ).groupBy("sample_id").agg(*[F.sum(c).alias(c) for c in ("n", "xa", "qa", "xb", "qb")])

    def inverse(x: str, q: str, own: str):
        n, total, squares = F.col("n") + 1, F.col(x) + F.col(own), F.col(q) + F.col(own) * F.col(own)
        sigma = F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n)))
        return F.when(sigma < vec.FLAT_SIGMA, F.lit(1.0)).otherwise(1.0 / sigma)

    scaled = cut_lineage(
        probes.join(stats, "sample_id")
        .withColumn("ia", inverse("xa", "qa", "own_a"))
        .withColumn("ib", inverse("xb", "qb", "own_b"))
        .select("sample_id", "entity_id", "a", "b", "own_a", "own_b", "ia", "ib")
    )

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sa, sb, same = cosines(left, right)
        sa *= left["ia"].to_numpy()[:, None]
        sb *= left["ib"].to_numpy()[:, None]
        sa[same] = np.nan
        top = np.stack([np.nanmax(np.where(same, -np.inf, wa * sa + wb * sb), axis=1) for wa, wb in cells], axis=1)
        return pd.DataFrame({"sample_id": left["sample_id"], "best": list(top)})

    found = block_apply(scaled, centres, best, "sample_id long, best array<double>", "sample_id", "entity_id", row_bytes)
    maxima = found.groupBy("sample_id").agg(F.array(*[F.max(F.get("best", F.lit(i))) for i in range(len(cells))]).alias("best"))
    per_cell = scaled.join(maxima, "sample_id").select(
        *[
            F.expr(f"{wa}D * own_a * ia + {wb}D * own_b * ib - best[{i}]").alias(f"m{i}")
            for i, (wa, wb) in enumerate(cells)
        ]
    )
    totals = per_cell.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg((F.col(f"m{i}") > 0).cast("double")).alias(f"acc{i}") for i in range(len(cells))],
        *[F.avg(f"m{i}").alias(f"mar{i}") for i in range(len(cells))],
    )
    entries = [
        F.struct(F.lit(float(wa)).alias("w1"), F.lit(float(wb)).alias("w2"), F.col(f"acc{i}").alias("accuracy"), F.col(f"mar{i}").alias("margin"))
        for i, (wa, wb) in enumerate(cells)
    ]
    return totals.select(F.explode(F.array(*entries)).alias("e"), "n").select("e.*", F.col("n").alias("n_probes"))
