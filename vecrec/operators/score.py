"""Query vectors, background statistics and fused scores for a batch of requests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecrec.functions import vec
from vecrec.operators.aggregate import mean_direction
from vecrec.operators.blocks import block_apply, matrix
from vecrec.operators.rerank import SCORE_DIGITS
from vecrec.session import cut_lineage

#: Entities and requests that are scored together: a few matrices of that many squared numbers.
REQUEST_BLOCK = 2048


def query_vectors(requests: DataFrame, entities: DataFrame, vector: str, dim: int, out: str = "query", strict: bool = False) -> DataFrame:
    """Unit mean of the liked entities per request. ``requests(request_id, entity_id)`` is long form.

    A request that matches no entity is absent, or an error with ``strict``.
    """
    unit = entities.where(F.col(vector).isNotNull()).select("entity_id", vector)
    liked = requests.select("request_id", "entity_id").distinct().join(unit, "entity_id")
    found = mean_direction(liked, ["request_id"], vector, dim, out, policy="raise" if strict else "clip").drop("n")
    if not strict:
        return found
    return (
        requests.select("request_id").distinct().join(found, "request_id", "left")
        .withColumn(out, F.coalesce(F.col(out), F.raise_error(F.lit("no liked entity was found")).cast("array<double>")))
    )


def background_stats(entities: DataFrame, queries: DataFrame, spaces: list[tuple[str, int]]) -> DataFrame:
    """Per request: entity count, mean ``m<i>`` and population sigma ``s<i>`` of the cosine to every entity.

    ``queries(request_id, q0, q1, ..)`` may lack a space (null). All spaces share one pass over the entities,
    and a map task hands on one row per request.
    """
    n = len(spaces)
    sums = [f"{k}{i}" for i in range(n) for k in ("n", "x", "xx")]

    def cosines(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"request_id": right["request_id"], **{c: 0.0 for c in sums}})
        for i in range(n):
            rows, asked = left[f"u{i}"].dropna(), right[f"q{i}"].dropna()
            if len(rows) and len(asked):
                c = matrix(rows) @ matrix(asked).T
                out.loc[asked.index, f"n{i}"] = float(len(rows))
                out.loc[asked.index, f"x{i}"] = c.sum(axis=0)
                out.loc[asked.index, f"xx{i}"] = (c * c).sum(axis=0)
        return out

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.groupby("request_id", as_index=False, sort=False)[sums].sum()

    units = entities
    for i, (column, dim) in enumerate(spaces):
        units = vec.with_unit(units, column, f"u{i}", dim)
    part = block_apply(
        units.select("entity_id", *[f"u{i}" for i in range(n)]),
        queries.select("request_id", *[f"q{i}" for i in range(n)]),
        cosines,
        "request_id string, " + ", ".join(f"{c} double" for c in sums),
        "entity_id",
        "request_id",
        row_bytes=8 * sum(d for _, d in spaces),
        combine=fold,
    )
    total = part.groupBy("request_id").agg(*[F.sum(c).alias(c) for c in sums])
    out = [F.col("request_id"), F.col("n0").cast("bigint").alias("n_background")]
    for i in range(n):
        mean = F.try_divide(f"x{i}", f"n{i}")
        spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(f"xx{i}", f"n{i}") - mean * mean))
        out += [F.when(F.col(f"n{i}") > 0, mean).alias(f"m{i}"), F.when(F.col(f"n{i}") > 0, spread).alias(f"s{i}")]
    return total.select(*out)


def _scores(entities: DataFrame, queries: DataFrame, vector: str, dim: int, keep: int | None) -> DataFrame:
    def cosines(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        s = matrix(right["q"]) @ matrix(left["u"]).T
        ids = left["entity_id"].to_numpy()
        if keep is None or len(ids) <= keep:
            return pd.DataFrame({"request_id": np.repeat(right["request_id"].to_numpy(), len(ids)), "entity_id": np.tile(ids, len(right)), "s": s.ravel()})
        order = np.argsort(ids, kind="stable")
        s, ids = s[:, order], ids[order]
        top = np.argsort(-np.round(s, SCORE_DIGITS), axis=1, kind="stable")[:, :keep]
        return pd.DataFrame({"request_id": np.repeat(right["request_id"].to_numpy(), keep), "entity_id": ids[top].ravel(), "s": np.take_along_axis(s, top, axis=1).ravel()})

    units = vec.with_unit(entities.where(F.col(vector).isNotNull()), vector, "u", dim).select("entity_id", "u")
    right = queries.select("request_id", F.col("query").alias("q"))
    return block_apply(units, right, cosines, "request_id string, entity_id string, s double", "entity_id", "request_id", row_bytes=8 * dim)


def best_cosines(entities: DataFrame, queries: DataFrame, vector: str, dim: int, k: int) -> DataFrame:
    """The k entities closest to each query vector; each block pair hands on at most k rows per request."""
    found = _scores(entities, queries, vector, dim, k)
    w = Window.partitionBy("request_id").orderBy(F.round("s", SCORE_DIGITS).desc(), "entity_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def space_zscores(entities: DataFrame, requests: DataFrame, vector: str, dim: int) -> DataFrame:
    """``(request_id, entity_id, z)`` for every entity of one space: the full score list of a few requests."""
    queries = cut_lineage(query_vectors(requests, entities, vector, dim))
    stats = background_stats(entities, queries.withColumnRenamed("query", "q0"), [(vector, dim)])
    rows = _scores(entities, queries, vector, dim, None).join(stats, "request_id")
    return rows.select("request_id", "entity_id", vec.zscore(F.col("s"), F.col("m0"), F.col("s0")).alias("z"))


def fuse_scores(primary: DataFrame, spaces: list[DataFrame], weights: list[float], id_col: str | list[str] = "entity_id") -> DataFrame:
    """Left-join per-space ``(entity_id, z)`` tables (``id_col`` may add the request) to the primary; a missing space adds 0 while the
    denominator stays the sum of all absolute weights."""
    out = primary
    total: Column = F.lit(0.0)
    for i, space in enumerate(spaces):
        out = out.join(space.select(*([id_col] if isinstance(id_col, str) else id_col), F.col("z").alias(f"score_{i}")), id_col, "left")
        total = total + F.lit(float(weights[i] if i < len(weights) else 1.0)) * F.coalesce(F.col(f"score_{i}"), F.lit(0.0))
    denominator = sum(abs(weights[i] if i < len(weights) else 1.0) for i in range(len(spaces))) or 1.0
    return out.withColumn("score", total / F.lit(float(denominator)))


NO_SEGMENT = ""


def request_profiles(
    requests: DataFrame, entities: DataFrame, spaces: list[tuple[str, int]], aliases: DataFrame | None, segment_mode: str
) -> tuple[DataFrame, DataFrame]:
    """``(profiles, bans)``: one row per request with its query vector, background mean and sigma per space, the
    allowed segment (``auto`` = majority among the liked, ``off``, or a value) and the number of aliases it
    may not return; and those aliases as rows ``(request_id, alias_id)``.

    Without aliases an entity is its own alias.
    """
    liked = requests.select("request_id", "entity_id").distinct()
    if aliases is not None:
        liked = liked.join(aliases, "entity_id", "left").withColumn("alias_id", F.coalesce("alias_id", "entity_id"))
    else:
        liked = liked.withColumn("alias_id", F.col("entity_id"))
    # only the liked rows: read once, then everything about the requests comes from this small copy
    liked = cut_lineage(liked.join(entities.select("entity_id", "ord", "segment", *[c for c, _ in spaces]), "entity_id", "left"))
    bans = liked.select("request_id", "alias_id").distinct()
    profile = bans.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_banned"))
    if segment_mode == "auto":
        votes = (
            liked.where(F.col("segment") != NO_SEGMENT)
            .groupBy("request_id", "segment")
            .agg(F.count(F.lit(1)).alias("c"), F.min("ord").alias("o"))
            .groupBy("request_id")
            .agg(F.max_by("segment", F.struct("c", -F.col("o"))).alias("allowed"))
        )
        profile = profile.join(votes, "request_id", "left")
    else:
        profile = profile.withColumn("allowed", F.lit(None if segment_mode == "off" else segment_mode).cast("string"))
    for i, (column, dim) in enumerate(spaces):
        rows = liked.where(F.col(column).isNotNull())
        profile = profile.join(mean_direction(rows, ["request_id"], column, dim, f"q{i}").drop("n"), "request_id", "left")
    profile = cut_lineage(profile.where(F.coalesce(*[F.col(f"q{i}") for i in range(len(spaces))]).isNotNull()))
    return cut_lineage(profile.join(background_stats(entities, profile, spaces).drop("n_background"), "request_id")), bans


def fused_zscores(left: pd.DataFrame, right: pd.DataFrame, weights: list[float], use_confidence: bool) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(requests x entities fused scores, z-scores per space, which spaces each request has).

    A space in which a request likes nothing is left out of its sum and its denominator; an entity without
    a vector in a space adds 0.
    """
    total, denominator, shown, asked = np.zeros((len(right), len(left))), np.zeros(len(right)), [], []
    for i, weight in enumerate(weights):
        have, wanted = left[f"u{i}"].notna().to_numpy(), right[f"q{i}"].notna().to_numpy()
        z = np.full(total.shape, np.nan)
        if have.any() and wanted.any():
            mean, sigma = (right.loc[wanted, f"{c}{i}"].to_numpy(dtype=float)[:, None] for c in ("m", "s"))
            x = matrix(right.loc[wanted, f"q{i}"]) @ matrix(left.loc[have, f"u{i}"]).T - mean
            z[np.ix_(wanted, have)] = x / np.where(sigma < vec.FLAT_SIGMA, 1.0, sigma)
        total += weight * np.nan_to_num(z)
        denominator += abs(weight) * wanted
        shown.append(z)
        asked.append(wanted)
    total /= np.where(denominator == 0, 1.0, denominator)[:, None]
    if use_confidence:
        total *= 0.5 + 0.5 * left["confidence"].to_numpy(dtype=float)
    return total, shown, np.stack(asked)


def best_per_alias(score: np.ndarray, alias: np.ndarray) -> None:
    """Per request all but the best entity of an alias become -inf; of equal ones the first column stays."""
    _, code, many = np.unique(alias, return_inverse=True, return_counts=True)
    for c in np.flatnonzero(many > 1).tolist():
        columns = np.flatnonzero(code == c)
        part = score[:, columns]
        keep = part.argmax(axis=1)
        lost = np.ones(part.shape, bool)
        lost[np.arange(len(part)), keep] = False
        part[lost] = -np.inf
        score[:, columns] = part


def score_candidates(
    entities: DataFrame,
    profiles: DataFrame,
    spaces: list[tuple[str, int]],
    weights: list[float],
    use_confidence: bool,
    pool: int,
    by_alias: bool,
) -> DataFrame:
    """The best candidates per request and map task: fused z-scores, quality and segment filters.

    All requests of a block are scored by one matrix product per space. Bans are not looked at here: a task
    hands on ``pool`` candidates more than the request has banned aliases, so that the rest of the pool is
    whole once the bans are out. That cut is exact: a row of the overall pool is in the pool of its
    own task, because each alias keeps its best row before the cut. Equal scores at the cut all stay.
    """
    n = len(spaces)
    weight = [float(weights[i]) if i < len(weights) else 1.0 for i in range(n)]
    shown_names = [f"score_{i}" for i in range(n)]

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.assign(__s=pdf["score"].round(SCORE_DIGITS)).sort_values(["request_id", "__s", "ord"], ascending=[True, False, True])
        best = best.drop(columns="__s")
        if by_alias:
            best = best.drop_duplicates(["request_id", "alias_id"])
        return best[best.groupby("request_id", sort=False).cumcount() < best["wide"]]

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left[left["candidate"].to_numpy(dtype=bool)].sort_values("ord")
        fused, shown, asked = fused_zscores(left, right, weight, use_confidence)
        segment = left["segment"].to_numpy()
        by_segment = right["allowed"].fillna("").to_numpy()
        fit = (by_segment[:, None] == "") | (segment == NO_SEGMENT)[None, :] | (by_segment[:, None] == segment[None, :])
        order = np.where(fit, np.round(fused, SCORE_DIGITS), -np.inf)
        if by_alias:
            best_per_alias(order, left["alias_id"].to_numpy())
        wide = pool + right["n_banned"].to_numpy()
        # everything not below a request's last place
        ends = np.full(len(right), -np.inf)
        for w in np.unique(wide[wide < len(left)]).tolist():
            mine = wide == w
            ends[mine] = -np.partition(-order[mine], w - 1, axis=1)[:, w - 1]
        r, c = np.nonzero((order >= ends[:, None]) & np.isfinite(order))
        z = np.stack([x[r, c] for x in shown])
        known = asked[:, r]
        if not known.all():  # spaces in which a request likes nothing are passed over, later ones move up
            first = np.argsort(~known, axis=0, kind="stable")
            z = np.where(np.take_along_axis(known, first, axis=0), np.take_along_axis(z, first, axis=0), np.nan)
        out = {"request_id": right["request_id"].to_numpy()[r], **{k: left[k].to_numpy()[c] for k in ("entity_id", "alias_id", "ord")}, "score": fused[r, c], "wide": wide[r]}
        return pd.DataFrame(out | dict(zip(shown_names, z, strict=True)))

    rows, keep = entities, ["entity_id", "alias_id", "ord", "segment", "confidence", "candidate"]
    for i, (column, dim) in enumerate(spaces):
        rows = vec.with_unit(rows, column, f"u{i}", dim)
        keep.append(f"u{i}")
    found = block_apply(
        rows.select(*keep),
        profiles,
        score,
        f"request_id string, entity_id string, alias_id string, ord long, score double, wide long, {', '.join(f'{c} double' for c in shown_names)}",
        "entity_id",
        "request_id",
        row_bytes=8 * sum(d for _, d in spaces) + 512,
        combine=cut,
        left_rows=REQUEST_BLOCK,
        right_rows=REQUEST_BLOCK,
    )
    return found.drop("wide")
