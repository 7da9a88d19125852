"""Top-k, alias de-duplication, group caps and diversity re-ranking per request."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecrec.functions import vec
from vecrec.operators.blocks import matrix
from vecrec.operators.rank import top_n


SCORE_DIGITS = 9  # sums differ in their last bits from run to run; equal scores must stay ties


def best_first() -> list[Column]:
    return [F.round("score", SCORE_DIGITS).desc(), F.col("ord")]


def dedupe_aliases(rows: DataFrame) -> DataFrame:
    """Best-scored row per (request, alias)."""
    return top_n(rows, ["request_id", "alias_id"], best_first(), 1, "__r").drop("__r")


def drop_liked_aliases(rows: DataFrame, liked_aliases: DataFrame) -> DataFrame:
    return rows.join(liked_aliases, ["request_id", "alias_id"], "left_anti")


def cap_groups(rows: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` rows per (request, group), best first; with pure relevance this equals the greedy walk."""
    if cap <= 0:
        return rows
    return top_n(rows, ["request_id", "group_name"], best_first(), cap, "__g").drop("__g")


def diversify(pool: DataFrame, vectors: list[tuple[str, int]], lam: float, k: int, cap: int) -> DataFrame:
    """Greedy re-rank per request: ``lam*score - (1-lam)*max cosine to the chosen`` with a group cap.

    Each group is one request's pool, already cut to the pool size. The fused vector is the
    concatenation of the unit vectors of all spaces (zeros where one is missing), renormalised.
    """
    parts = []
    for i, (column, dim) in enumerate(vectors):
        pool = vec.with_unit(pool, column, f"__u{i}", dim)
        parts.append(f"coalesce(__u{i}, transform(sequence(1, {dim}), x -> 0D))")
    pool = pool.withColumn("__f", F.expr("concat(" + ", ".join(parts) + ")"))
    width = sum(d for _, d in vectors)
    pool = vec.with_unit(pool, "__f", "__fused", width).select("request_id", "entity_id", "group_name", "ord", "score", "__fused")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(__s=pdf["score"].round(SCORE_DIGITS)).sort_values(["__s", "ord"], ascending=[False, True]).reset_index(drop=True)
        m, score = matrix(pdf["__fused"]), pdf["score"].to_numpy()
        redundancy = np.zeros(len(pdf))
        open_, used, picks = np.ones(len(pdf), bool), {}, []
        while len(picks) < k:
            allowed = open_.copy()
            if cap > 0:
                allowed &= np.array([used.get(g, 0) < cap for g in pdf["group_name"]])
            if not allowed.any():
                break
            value = np.where(allowed, np.round(lam * score - (1.0 - lam) * redundancy, SCORE_DIGITS), -np.inf)
            best = int(np.argmax(value))
            sims = m @ m[best]
            redundancy = sims if not picks else np.maximum(redundancy, sims)
            open_[best] = False
            group = pdf["group_name"][best]
            used[group] = used.get(group, 0) + 1
            picks.append(best)
        out = pdf.loc[picks, ["request_id", "entity_id"]].copy()
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    return pool.groupBy("request_id").applyInPandas(walk, "request_id string, entity_id string, rank long")


def top_k(rows: DataFrame, k: int) -> DataFrame:
    return top_n(rows, ["request_id"], best_first(), k)
