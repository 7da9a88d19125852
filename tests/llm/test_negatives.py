"""Cover trees and hard negatives against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from vecrec.llm import negatives

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("id", "v", "a", "centre", "rank"))])


def clustered(n, dim, seed, centres=12, spread=0.15):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return np.floor(256 * (c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))))


@pytest.mark.parametrize("kind", ["clustered", "random", "equal", "zero", "one"])
def test_tree_covers_and_search_is_exact(kind):
    x = {"clustered": clustered(700, 6, 1), "random": clustered(500, 40, 2, 500, 1.0), "equal": np.repeat(clustered(9, 5, 3), 40, axis=0), "zero": np.zeros((30, 4)), "one": clustered(1, 3, 4)}[kind]
    norm = float(np.sqrt((x**2).sum(axis=1)).max())
    tree = negatives.CoverTree(x, norm)
    assert sorted(p for p, again in zip(tree.point, tree.again, strict=True) if not again) == list(range(len(x)))

    def below(k):
        return [tree.point[k], *(p for c in tree.children[k] for p in below(c))]

    for k in range(0, len(tree.point), 7):
        chord = np.sqrt(((tree.points[below(k)] - tree.points[tree.point[k]]) ** 2).sum(axis=1)).max()
        assert chord <= 2 * norm * np.sin(min(np.pi, tree.reach[k]) / 2) + 1e-5 * max(norm, 1)
        assert all(tree.reach[c] <= tree.reach[k] + 1e-9 for c in tree.children[k])
    rng = np.random.default_rng(5)
    ids, labels = rng.permutation(len(x)) * 10, rng.integers(0, 3, len(x))
    asked = np.arange(0, len(x), 5)
    q, scores = x[asked], x[asked] @ x.T
    for same, spread in ((True, None), (False, (0.3, 0.9))):
        who = np.repeat(np.arange(len(asked)), 1 if same else 3)
        top = np.sort(scores, axis=1)[:, ::-1][:, :3]
        low = np.full(len(who), -np.inf) if same else np.ceil(top[:, : top.shape[1]][who, np.arange(len(who)) % top.shape[1]] * spread[0])
        high = np.full(len(who), np.inf) if same else np.floor(top[who, np.arange(len(who)) % top.shape[1]] * spread[1])
        windows = negatives.Windows(who, low, high, 4, ids[asked], labels[asked], ids, labels, same)
        tree.search(q, windows)
        windows.settle()
        got = [list(zip(windows.found[1][windows.found[0] == w], ids[windows.found[2][windows.found[0] == w]], strict=True)) for w in range(len(who))]
        for w, a in enumerate(who.tolist()):
            fits = ((labels == labels[asked[a]]) == same) & (ids != ids[asked[a]]) & (scores[a] >= low[w]) & (scores[a] <= high[w])
            assert got[w] == sorted(zip(scores[a][fits], ids[fits], strict=True), key=lambda r: (-r[0], r[1]))[:4]


def test_tight_clusters_are_left_unopened():
    x = clustered(4000, 8, 7, 40, 0.01)
    tree = negatives.CoverTree(x, float(np.sqrt((x**2).sum(axis=1)).max()))
    ids = np.arange(len(x))
    windows = negatives.Windows(np.arange(1), np.array([-np.inf]), np.array([np.inf]), 5, ids[:1], ids[:1] * 0, ids, ids * 0, True)
    met = []
    offer = windows.offer
    windows.offer = lambda who, c, s: (met.append(len(c)), offer(who, c, s))
    tree.search(x[:1], windows)
    windows.settle()
    assert sum(met) < len(x) / 2 and len(windows.found[0]) == 5


def brute(spark, df):
    from vecrec.llm.queries import OP12_SQL

    embeddings = df.select("vec_id", "embedding", "label").toArrow()  # noqa: F841
    return sorted(duckdb.sql(OP12_SQL).fetchall())


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def relabelled(df):
    from pyspark.sql import functions as F

    return df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


@pytest.mark.parametrize("part_rows, block_rows", [(4096, 1024), (60, 3)])
def test_equal_to_brute_force_with_hot_labels_copies_and_nulls(spark, part_rows, block_rows):
    rng = random.Random(9)
    x = clustered(900, 6, 8, 5, 0.4) / 256
    rows = [(k if k < 450 else 50 * k, x[k].tolist(), 3 if k % 3 else rng.randrange(10)) for k in range(900)]
    rows += [(100_000 + 25 * k, x[5].tolist(), k % 2) for k in range(120)]  # copies in two labels
    rows += [(200_000 + k, (x[6] + 1e-4 * k).tolist(), 4) for k in range(300)]  # a dense ball
    rows += [(200, x[7].tolist(), None), (None, x[7].tolist(), 1), (300, None, 2), (400, [1.0, None] + [0.0] * 4, 2), (500_000, [float("nan")] * 6, 1), (500_100, [float("inf")] * 6, 1), (500_200, [0.0] * 6, 2)]
    rows += [rows[3], rows[3], (600_000, (-x[9]).tolist(), 8)]
    df = spark.createDataFrame([(*r, *"iacvr") for r in rows], ROWS).repartition(7)
    got = negatives.hard_negatives(relabelled(df), part_rows=part_rows, block_rows=block_rows).select(*NAMES)
    assert sorted(tuple(r) for r in got.collect()) == brute(spark, df)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], ROWS)
    assert negatives.hard_negatives(empty).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0], 1, *"iacvr"), (101, [1.0], 1, *"iacvr"), (102, [0.5, 1.0], 2, *"iacvr")], ROWS)
    got = [tuple(r) for r in negatives.hard_negatives(one).select(*NAMES).collect()]
    assert got == [] or got == brute(spark, one)
    got = [tuple(r) for r in negatives.hard_negatives(one, low=0, high=1000).select(*NAMES).collect()]
    assert got == [(100, 101, 1, 102, 65536, 256 * 128 + 512 * 256)]  # the short vector is filled up with zeros
