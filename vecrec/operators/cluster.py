"""Feature transforms and clustering: PCA, standardising, k-means, average linkage, auto-k, profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecrec.functions import vec
from vecrec.operators import blocks
from vecrec.operators.rank import top_n, zero_padded
from vecrec.session import cut_lineage

#: Groups of average linkage that one task merges to the end; more merge in distributed rounds.
MICRO_CLUSTERS = 512
#: Bytes of groups in a block of average linkage, pairs of groups that a task compares (or one block pair), and rows and columns of a tile of products.
LINK_BYTES, LINK_PAIRS, TILE = 8 << 20, 1 << 28, (512, 2048)
#: Rows that k-means seeds are drawn from.
SEED_ROWS = 5_000


def column_stats(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """One row: per-dimension mean and population sigma."""
    return df.agg(
        F.array(*[F.avg(F.get(vector, F.lit(i))) for i in range(dim)]).alias("mean"),
        F.array(*[F.stddev_pop(F.get(vector, F.lit(i))) for i in range(dim)]).alias("std"),
    )


def _with_stats(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Attach the one-row statistics as array literals (2*dim numbers through the driver)."""
    row = column_stats(df, vector, dim).first()
    lit = lambda xs: F.array(*[F.lit(float(x or 0.0)) for x in xs])
    return df.withColumn("__mean", lit(row["mean"])).withColumn("__std", lit(row["std"]))


def standardise(df: DataFrame, vector: str, dim: int, out: str = "scaled") -> DataFrame:
    """Zero mean, unit population sigma; a constant column is only centred."""
    scaled = F.expr(
        f"transform({vector}, (x, i) -> (x - __mean[i]) / if(__std[i] <= 1e-12, 1D, __std[i]))"
    )
    return _with_stats(df, vector, dim).withColumn(out, scaled).drop("__mean", "__std")


def pca(df: DataFrame, vector: str, dim: int, k: int, out: str = "reduced", unit: bool = True) -> tuple[DataFrame, list[float]]:
    """Centred PCA to ``min(k, dim, rows)`` dimensions, optionally renormalised; also the explained variance."""
    k = max(1, min(k, dim, df.limit(k).count()))
    centred = _with_stats(df, vector, dim).withColumn("__x", array_to_vector(F.expr(f"transform({vector}, (x, i) -> x - __mean[i])")))
    model = PCA(k=k, inputCol="__x", outputCol="__y").fit(centred)
    done = model.transform(centred).withColumn("__r", vector_to_array("__y")).drop("__x", "__y", "__mean", "__std")
    if unit:
        done = vec.with_unit(done, "__r", out, k, "clip").drop("__r")
    else:
        done = done.withColumnRenamed("__r", out)
    return done, [float(x) for x in model.explainedVariance]


def kmeans(df: DataFrame, vector: str, k: int, restarts: int = 10, seed: int = 42, out: str = "cluster_id") -> DataFrame:
    """k-means|| with several seeds; the model with the least training cost labels the rows."""
    rows = df.withColumn("__x", array_to_vector(vector))
    best = None
    for i in range(restarts):
        model = KMeans(k=k, seed=seed + i, featuresCol="__x", predictionCol=out, maxIter=50).fit(rows)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(rows).drop("__x").withColumn(out, F.col(out).cast("bigint"))


def seeded_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeds among the rows of ``x``."""
    chosen = [x[rng.integers(len(x))]]
    d = ((x - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
        d = np.minimum(d, ((x - chosen[-1]) ** 2).sum(axis=1))
    return np.stack(chosen)


def kmeans_many(df: DataFrame, vector: str, ks: list[int], restarts: int = 30, seed: int = 42, out: str = "labels", max_iter: int = 50, tol: float = 1e-4, seed_rows: int = SEED_ROWS) -> DataFrame:
    """k-means for several k and restarts side by side: adds ``labels``, for each k those of its cheapest restart.

    Seeds come from k-means++ on a sample of ``seed_rows`` rows by hash; each step then reads all rows once for
    all models. Centres and their sums (ks x restarts x dim numbers, whatever the input) go through the driver.
    """
    rows, spark = cut_lineage(df), df.sparkSession
    total = rows.count()
    if not total:
        return rows.withColumn(out, F.array(*[F.lit(0).cast("bigint") for _ in ks]))
    share = int(min(1.0, 2 * seed_rows / total) * (1 << 30))
    near = rows.select(F.xxhash64(vector).alias("h"), vector).where(F.pmod("h", F.lit(1 << 30)) < share).orderBy("h").limit(seed_rows).toPandas()
    x = blocks.matrix(near[vector] if len(near) else rows.select(vector).limit(1).toPandas()[vector])
    models = [k for k in ks for _ in range(restarts)]
    centres = np.concatenate([seeded_centres(x, k, np.random.default_rng(seed + i)) for i, k in enumerate(models)])
    cut = np.concatenate([[0], np.cumsum(models)])
    owner, live = np.repeat(np.arange(len(models)), models), np.ones(len(models), bool)
    costs = np.full(len(models), np.inf)

    def nearest(x: np.ndarray, c: np.ndarray, which: np.ndarray):
        d = (c * c).sum(axis=1)[None, :] - 2 * x @ c.T
        for m in which:
            part = d[:, cut[m] : cut[m + 1]]
            label = part.argmin(axis=1)
            yield m, label, part[np.arange(len(x)), label]

    for _ in range(max_iter):
        shared = spark.sparkContext.broadcast((centres, np.flatnonzero(live)))

        def step(batches, shared=shared):
            c, which = shared.value
            n, sums, cost = np.zeros(len(c)), np.zeros(c.shape), np.zeros(len(c))
            for batch in batches:
                x = blocks.matrix(batch[vector])
                for part in np.array_split(x, -(-len(x) // 1024)) if len(x) else ():
                    sq = (part * part).sum(axis=1)
                    for m, label, d in nearest(part, c, which):
                        one = np.eye(cut[m + 1] - cut[m])[label]
                        n[cut[m] : cut[m + 1]] += one.sum(axis=0)
                        sums[cut[m] : cut[m + 1]] += one.T @ part
                        cost[cut[m]] += (sq + d).sum()
            yield pd.DataFrame({"centre": np.arange(len(c)), "n": n, "cost": cost, "s": list(sums)})

        done = vec.vector_sums(rows.select(vector).mapInPandas(step, "centre int, n double, cost double, s array<double>"), ["centre"], "s", x.shape[1], "t", extra=[F.sum("n").alias("n"), F.sum("cost").alias("cost")])
        state = done.orderBy("centre").toPandas()
        n, sums = state["n"].to_numpy(), blocks.matrix(state["t"])
        costs[live] = np.add.reduceat(state["cost"].to_numpy(), cut[:-1])[live]
        new = np.where((n > 0)[:, None], sums / np.maximum(n, 1)[:, None], centres)
        moved = np.maximum.reduceat(((new - centres) ** 2).sum(axis=1), cut[:-1]) > tol * tol
        live &= moved
        centres = np.where(live[owner][:, None], new, centres)
        if not live.any():
            break
    best = np.array([i * restarts + costs[i * restarts : (i + 1) * restarts].argmin() for i in range(len(ks))])
    shared = spark.sparkContext.broadcast((centres, best))

    def name(batches):
        c, which = shared.value
        for batch in batches:
            found = np.stack([label for _, label, _ in nearest(blocks.matrix(batch[vector]), c, which)], axis=1) if len(batch) else np.zeros((0, len(ks)))
            yield batch.assign(**{out: list(found.astype(np.int64))})

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(name, f"{shape}, `{out}` array<bigint>")


def average_linkage(counts: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    """Exact average linkage under cosine distance on (n, sum of unit rows) of a bounded set of groups.

    The mean distance of two groups is 1 - Sa.Sb/(na*nb), so merging is adding counts and sums.
    """
    n, s = counts.astype(float).copy(), sums.astype(float).copy()
    label = np.arange(len(n))
    alive = list(range(len(n)))
    d = 1.0 - (s @ s.T) / np.outer(n, n)
    np.fill_diagonal(d, np.inf)
    while len(alive) > k:
        sub = d[np.ix_(alive, alive)]
        i, j = np.unravel_index(np.argmin(sub), sub.shape)
        a, b = alive[min(i, j)], alive[max(i, j)]
        n[a] += n[b]
        s[a] += s[b]
        label[label == b] = a
        alive.remove(b)
        row = 1.0 - (s @ s[a]) / (n * n[a])
        d[a, :], d[:, a] = row, row
        d[a, a] = np.inf
    names = {old: new for new, old in enumerate(sorted(set(label.tolist())))}
    return np.array([names[x] for x in label])


def nearest_groups(asked: DataFrame, groups: DataFrame, dim: int, **sizes: int) -> DataFrame:
    """(seg, lo, hi, d, id): for each group (seg, id, n, s) of ``asked`` the pair it forms with its nearest other one of its segment.

    Equal distances (12 decimals) go to the smaller pair of ids, so the closest pair of all is mutual. Products
    are taken tile by tile in single precision; what they leave open within their error is decided in double precision.
    """
    slack = np.float32(2 * (dim + 4) * 2.0**-23)  # twice the error of a product of two vectors no longer than 1
    some = max(1, (1 << 21) // dim)
    block = max(blocks.RIGHT_ROWS, LINK_BYTES // (8 * dim + 24))
    sizes = {"left_rows": block, "right_rows": block, "task_pairs": LINK_PAIRS} | sizes

    def within(seg: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        x, y, n, m = blocks.matrix(left["s"]), blocks.matrix(right["s"]), left["n"].to_numpy(), right["n"].to_numpy()
        cx, cy = (x / n[:, None]).astype(np.float32), (y / m[:, None]).astype(np.float32)
        at = {v: k for k, v in enumerate(b.tolist())}
        own = np.array([at.get(v, -1) for v in a.tolist()], np.int64)
        least, other = np.full(len(a), np.inf), np.full(len(a), np.iinfo(np.int64).max)
        top = np.full(len(a), -np.inf, np.float32)
        for i in range(0, len(a), TILE[0]):
            rows = slice(i, i + TILE[0])
            for j in range(0, len(b), TILE[1]):
                cos = cx[rows] @ cy[j : j + TILE[1]].T
                here = np.flatnonzero((own[rows] >= j) & (own[rows] < j + cos.shape[1]))
                cos[here, own[rows][here] - j] = -np.inf
                top[rows] = np.maximum(top[rows], cos.max(axis=1))
                p, q = np.nonzero((cos >= (top[rows] - slack)[:, None]) & (cos > -np.inf))
                d = np.empty(len(p))
                for k in range(0, len(p), some):
                    u, v = p[k : k + some] + i, q[k : k + some] + j
                    d[k : k + some] = np.round(1.0 - np.einsum("ij,ij->i", x[u], y[v]) / (n[u] * m[v]), 12)
                low, who = np.full(len(cos), np.inf), np.full(len(cos), np.iinfo(np.int64).max)
                np.minimum.at(low, p, d)
                # for one group the order of its pairs is that of the partners
                tied = d == low[p]
                np.minimum.at(who, p[tied], b[j + q[tied]])
                better = (low < least[rows]) | ((low == least[rows]) & (who < other[rows]))
                least[rows], other[rows] = np.where(better, low, least[rows]), np.where(better, who, other[rows])
        found = pd.DataFrame({"seg": seg, "id": a, "d": least, "lo": np.minimum(a, other), "hi": np.maximum(a, other)})
        return found[np.isfinite(least)]

    def closest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        others = dict(list(right.groupby("seg")))
        met = [within(seg, part, others[seg]) for seg, part in left.groupby("seg") if seg in others]
        return pd.concat(met) if met else pd.DataFrame({c: [] for c in ("seg", "id", "d", "lo", "hi")})

    met = blocks.block_apply(asked, groups, closest, "seg long, id long, d double, lo long, hi long", "id", "id", 8 * dim + 24, **sizes)
    best = met.groupBy("seg", "id").agg(F.min(F.struct("d", "lo", "hi")).alias("b"))
    return best.select("seg", "id", "b.d", "b.lo", "b.hi")


def merged_groups(groups: DataFrame, dim: int, most_k: int, micro: int, compared: list[int] | None = None, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """Average linkage of (seg, id, n, s) within each segment, by rounds of mutual nearest groups, until no
    segment has more than ``micro`` groups -> (groups, (id, group) moves). Ids are unique over all segments.

    Average linkage is reducible: mutual nearest groups merge at some time in any order. A group whose
    nearest one is at distance h stays alone below h, so at a height that ``most_k`` groups reach there are
    ``most_k`` clusters or more, and merges below it belong to every cut asked for. The result is the same
    as merging the closest pair each time.

    By the same property a merged group is no nearer to any other than its two parts were, so a group
    whose nearest one did not merge keeps it: after the first round only merged groups, and those whose
    nearest one merged, are compared with all. ``compared`` takes the numbers of groups compared per round.
    A round takes all segments that still have too many groups.
    """
    most = max(micro, most_k)
    moves = cut_lineage(groups.select("id", F.col("id").alias("group")))
    kept = None
    while True:
        sizes_of = groups.groupBy("seg").count().where(F.col("count") > most).select("seg")
        open_ = cut_lineage(groups.join(sizes_of, "seg", "left_semi"))
        if open_.isEmpty():
            return groups, moves
        asked = open_ if kept is None else open_.join(kept.select("id"), "id", "left_anti")
        if compared is not None:
            compared.append(asked.count())
        best = nearest_groups(asked, open_, dim, **sizes)
        if kept is not None:
            best = best.unionByName(kept.join(open_.select("id"), "id", "left_semi"))
        best = cut_lineage(best)
        place = Window.partitionBy("seg").orderBy(F.desc("d"), "id")
        height = best.select("seg", "d", F.row_number().over(place).alias("r")).where(F.col("r") <= most_k).groupBy("seg").agg(F.min("d").alias("height"))
        least = best.groupBy("seg").agg(F.min(F.struct("d", "lo", "hi")).alias("b")).select("seg", F.col("b.lo").alias("first_lo"), F.col("b.hi").alias("first_hi"))
        mutual = best.groupBy("seg", "lo", "hi").agg(F.count(F.lit(1)).alias("c"), F.min("d").alias("d")).where("c = 2")
        first = (F.col("lo") == F.col("first_lo")) & (F.col("hi") == F.col("first_hi"))
        pairs = cut_lineage(mutual.join(height, "seg").join(least, "seg").where((F.col("d") < F.col("height")) | first).select("lo", "hi"))
        touched = pairs.select(F.explode(F.array("lo", "hi")).alias("id"))
        # both of a pair: the group itself and its nearest one are as they were
        still = best.join(touched, "id", "left_anti").withColumn("other", F.when(F.col("lo") == F.col("id"), F.col("hi")).otherwise(F.col("lo")))
        kept = cut_lineage(still.join(touched.withColumnRenamed("id", "other"), "other", "left_anti").select("seg", "id", "d", "lo", "hi"))
        placed = groups.join(pairs, groups["id"] == pairs["hi"], "left").withColumn("id", F.coalesce("lo", "id")).drop("lo", "hi")
        groups = cut_lineage(vec.vector_sums(placed, ["seg", "id"], "s", dim, "t", extra=[F.sum("n").alias("m")]).select("seg", "id", F.col("m").alias("n"), F.col("t").alias("s")))
        moves = cut_lineage(moves.join(pairs, moves["group"] == pairs["hi"], "left").select("id", F.coalesce("lo", "group").alias("group")))


def agglomerate(df: DataFrame, vector: str, dim: int, ks: list[int], micro: int = MICRO_CLUSTERS, within: str | None = None, **sizes: int) -> DataFrame:
    """Average linkage under cosine distance, cut at several k: adds ``labels`` (one cluster id per k).

    Exact at every size: groups merge in distributed rounds until ``micro`` are left, whose (n, sum) state
    one task merges to the end. Clusters are numbered by their least vector. ``within`` names a column
    whose values are clustered apart, all in the same rounds; rows where it is null are left out.
    """
    segment = F.col(within).cast("string") if within else F.lit("")
    rows = df.withColumn("__seg", segment).where(F.col("__seg").isNotNull())
    distinct = rows.groupBy("__seg", vector).agg(F.count(F.lit(1)).cast("double").alias("n")).orderBy("__seg", vector).withColumn("id", F.monotonically_increasing_id())
    distinct = cut_lineage(vec.with_unit(distinct, vector, "__u", dim))
    numbers = distinct.groupBy("__seg").agg(F.min("id").alias("seg"))  # one row per segment
    groups = cut_lineage(distinct.join(numbers, "__seg").select("seg", "id", "n", F.transform("__u", lambda x: x * F.col("n")).alias("s")))
    groups, moves = merged_groups(groups, dim, max(ks), micro, **sizes)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        sums, counts = blocks.matrix(pdf["s"]), pdf["n"].to_numpy()
        cuts = np.stack([average_linkage(counts, sums, k) for k in ks], axis=1)
        return pd.DataFrame({"group": pdf["id"], "labels": list(cuts.astype(np.int64))})

    table = groups.groupBy("seg").applyInPandas(finish, "group long, labels array<bigint>")  # at most ``micro`` groups each
    named = distinct.select("__seg", F.col(vector).alias("__of"), "id").join(moves, "id").join(table, "group")
    named = named.select(F.col("__seg").alias("__in"), "__of", "labels")
    return rows.join(named, (rows["__seg"] == named["__in"]) & (rows[vector] == named["__of"])).drop("__of", "__in", "__seg")

def silhouettes(df: DataFrame, id_col: str, vector: str, labels: str, **sizes: int) -> DataFrame:
    """Exact euclidean silhouette over all rows, for several labellings at once -> (setting, silhouette).

    ``labels`` holds one label per labelling, -1 for rows it leaves out. Distances are summed per (row, label)
    inside blocks, once for all labellings; pairs never become rows. A labelling with one label has none (NaN).
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(labels).alias("labels"))

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, y = blocks.matrix(left["v"]), blocks.matrix(right["v"])
        d = np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T))
        d[left["id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :]] = 0.0
        own, other = (np.stack(f["labels"].to_numpy()) for f in (left, right))
        parts = []
        for k in range(own.shape[1]):
            here, there = np.flatnonzero(own[:, k] >= 0), np.flatnonzero(other[:, k] >= 0)
            names, codes = np.unique(other[there, k], return_inverse=True)
            total = d[np.ix_(here, there)] @ np.eye(len(names))[codes]
            ids = left["id"].to_numpy()[here]
            parts.append(pd.DataFrame({"id": np.repeat(ids, len(names)), "setting": np.int32(k), "own": np.repeat(own[here, k], len(names)), "label": np.tile(names, len(here)), "total": total.ravel()}))
        return pd.concat(parts, ignore_index=True)

    kind = df.schema[id_col].dataType.simpleString()
    row_bytes = rows.agg(F.max(8 * F.size("v") + 8 * F.size("labels"))).first()[0] or 0
    met = blocks.block_apply(rows, rows, sums, f"id {kind}, setting int, own long, label long, total double", "id", "id", row_bytes + 64, left_rows=512, **sizes)
    counted = rows.select(F.posexplode("labels").alias("setting", "label")).where("label >= 0").groupBy("setting", "label").count()
    mean = met.groupBy("id", "setting", "own", "label").agg(F.sum("total").alias("total")).join(counted, ["setting", "label"])
    same = F.col("own") == F.col("label")
    each = mean.groupBy("id", "setting").agg(
        F.max(F.when(same, F.col("total") / F.greatest(F.col("count") - 1, F.lit(1)))).alias("a"),
        F.max(F.when(same, F.col("count"))).alias("n"),
        F.min(F.when(~same, F.col("total") / F.col("count"))).alias("b"),
    )
    one = F.when(F.col("b").isNull(), F.lit(float("nan"))).when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(vec.TINY)))
    return each.groupBy("setting").agg(F.avg(one).alias("silhouette"))


def silhouette(x: np.ndarray, labels: np.ndarray, metric: str = "euclidean") -> float:
    if metric == "cosine":
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vec.TINY)
        d = 1.0 - u @ u.T
    else:
        sq = (x * x).sum(axis=1)
        d = np.sqrt(np.maximum(0.0, sq[:, None] + sq[None, :] - 2 * x @ x.T))
    np.fill_diagonal(d, 0.0)
    names, codes = np.unique(labels, return_inverse=True)
    if len(names) < 2:
        return float("nan")
    onehot = np.eye(len(names))[codes]
    size, total = onehot.sum(axis=0), d @ onehot
    own = size[codes]
    a = np.where(own > 1, total[np.arange(len(x)), codes] / np.maximum(own - 1, 1), 0.0)
    mean = total / size
    mean[np.arange(len(x)), codes] = np.inf
    b = mean.min(axis=1)
    s = np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), vec.TINY), 0.0)
    return float(s.mean())


def cosine_silhouette(df: DataFrame, vector: str, label: str) -> float:
    """Exact cosine silhouette over all rows in two aggregate passes (no pairs)."""
    rows = df.withColumn("__x", array_to_vector(vector))
    return ClusteringEvaluator(featuresCol="__x", predictionCol=label, distanceMeasure="cosine").evaluate(rows)


def auto_k(df: DataFrame, id_col: str, vector: str, dim: int, method: str = "auto", ks: range = range(2, 21), restarts: int = 10) -> tuple[DataFrame, DataFrame]:
    """Best k by silhouette over all rows: ``auto`` = k-means + euclidean, ``auto-cosine`` = average linkage + cosine."""
    fits = cut_lineage(df)
    if method == "auto-cosine":
        fits = cut_lineage(agglomerate(fits, vector, dim, list(ks)))
        last = fits.agg(*[F.max(F.get("labels", F.lit(i))) for i in range(len(ks))]).first()  # 0: one cluster, which has no silhouette
        scored = [(k, cosine_silhouette(fits.withColumn("__k", F.get("labels", F.lit(i))), vector, "__k") if last[i] else float("nan")) for i, k in enumerate(ks)]
    else:
        fits = cut_lineage(kmeans_many(fits, vector, list(ks), restarts))
        found = {r["setting"]: r["silhouette"] for r in silhouettes(fits, id_col, vector, "labels").collect()}  # one row per k
        scored = [(k, found[i]) for i, k in enumerate(ks)]
    best = max(range(len(scored)), key=lambda i: (scored[i][1] if scored[i][1] == scored[i][1] else -2.0, -i))
    kept = fits.withColumn("cluster_id", F.get("labels", F.lit(best))).drop("labels")
    return kept, df.sparkSession.createDataFrame(scored, "k int, silhouette double")


def choose_k(df: DataFrame, vector: str, dim: int, min_k: int, max_k: int, target_k: int, method: str = "kmeans", restarts: int = 30) -> tuple[DataFrame, DataFrame]:
    """Best k by ``max(0, silhouette) * balance * gaussian prior`` -> (labelled rows, scores)."""
    df = cut_lineage(df)
    n = df.count()
    max_k = min(max_k, max(2, n - 1))
    min_k = min(min_k, max_k)
    sigma = max(2.0, target_k / 3)
    ks = list(range(min_k, max_k + 1))
    fits = cut_lineage(kmeans_many(df, vector, ks, restarts) if method == "kmeans" else agglomerate(df, vector, dim, ks))
    scores, kept, top = [], None, -1.0
    for i, k in enumerate(ks):
        labelled = fits.withColumn("cluster_id", F.get("labels", F.lit(i))).drop("labels")
        sil = cosine_silhouette(labelled, vector, "cluster_id")
        largest = labelled.groupBy("cluster_id").count().agg(F.max("count")).first()[0]
        balance = min(1.0, 2.5 * (n / k) / largest)
        score = max(0.0, sil) * balance * float(np.exp(-((k - target_k) ** 2) / (2 * sigma * sigma)))
        scores.append((k, float(sil), int(largest), float(score)))
        if score > top:
            top, kept = score, labelled
    return kept, df.sparkSession.createDataFrame(scores, "k int, silhouette double, max_size long, score double")


def collapse_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Best entity per alias by (confidence, sample count, id), all descending."""
    named = entities.join(aliases, "entity_id", "left").withColumn("alias_id", F.coalesce("alias_id", "entity_id"))
    best = named.groupBy("alias_id").agg(F.max_by("entity_id", F.struct("confidence", "image_count", "entity_id")).alias("entity_id"))
    return named.join(best, ["alias_id", "entity_id"], "left_semi")


def vote_entities(samples: DataFrame, cluster: str = "cluster_id", order: str = "ord") -> DataFrame:
    """Majority cluster per entity without noise (-1); consensus = majority count / all samples."""
    counts = samples.groupBy("entity_id", cluster).agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("o"))
    real = F.col(cluster) >= 0
    return counts.groupBy("entity_id").agg(
        F.coalesce(F.max_by(F.when(real, F.col(cluster)), F.when(real, F.struct("c", -F.col("o")))), F.lit(-1)).alias("cluster_id"),
        F.coalesce(F.max(F.when(real, F.col("c"))), F.lit(0)).alias("majority_count"),
        F.sum("c").alias("total_samples"),
    ).withColumn("consensus", F.col("majority_count") / F.col("total_samples"))


def consensus_report(votes: DataFrame) -> DataFrame:
    """One row: least, mean and greatest consensus of the entities with a cluster, and how many have none."""
    real = F.col("cluster_id") >= 0
    share = F.when(real, F.col("consensus"))
    return votes.agg(
        F.min(share).alias("min_consensus"), F.avg(share).alias("mean_consensus"), F.max(share).alias("max_consensus"), F.count(F.lit(1)).alias("n_entities"), F.count_if(~real).alias("n_noise")
    )


def cluster_profile(rows: DataFrame, keys: list[str], top_groups: int = 5) -> DataFrame:
    """Per cluster: size, average sample count and confidence, and the largest groups as ``name:n`` text."""
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.avg("image_count").alias("avg_image_count"), F.avg("confidence").alias("avg_confidence")
    )
    groups = rows.groupBy(*keys, "group_name").agg(F.count(F.lit(1)).alias("n"))
    best = top_n(groups, keys, [F.col("n").desc(), F.col("group_name")], top_groups)
    listed = best.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "group_name", F.col("n").cast("string")).alias("t")))), lambda s: s["t"]), ", "
        ).alias("top_groups")
    )
    return base.join(listed, keys)


def name_clusters(rows: DataFrame, segment: str, cluster: str = "cluster_id", width: int = 2) -> DataFrame:
    """Cluster code by falling size within its segment: segment letter + zero-padded number."""
    sizes = rows.groupBy(segment, cluster).agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy(segment).orderBy(F.col("size").desc(), cluster)
    return sizes.withColumn("rank", F.row_number().over(w)).select(
        segment, cluster, "size", F.concat(F.col(segment), zero_padded(F.col("rank"), width)).alias("type_id")
    )


def density_scan_scores(clusters: DataFrame, rows: DataFrame, id_col: str, vector: str, target_k: float, mode: str = "samples") -> DataFrame:
    """Score every (eps, min_size) setting: silhouette * sqrt(1-noise) * k prior * balance.

    ``mode`` samples: sigma = max(5, K/2), size bound max(50, 2N/K). ``mode`` entities: bound max(20, 1.5N/K).
    """
    keys = ["eps", "min_size"]
    n = rows.count()
    bound = max(50, int(n / target_k * 2)) if mode == "samples" else max(20, int(n / target_k * 1.5))
    sigma = max(5.0, target_k / 2)
    sizes = clusters.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("c"))
    real = F.col("label") >= 0
    stats = sizes.groupBy(*keys).agg(
        F.count(F.when(real, 1)).alias("k"), F.sum(F.when(real, F.col("c")).otherwise(0)).alias("n_kept"), F.max(F.when(real, F.col("c"))).alias("max_size")
    )
    grid = [(r["eps"], r["min_size"]) for r in clusters.select(*keys).distinct().orderBy(*keys).collect()]  # the settings asked for
    label_of = [F.coalesce(F.max(F.when((F.col("eps") == e) & (F.col("min_size") == m), F.col("label"))), F.lit(-1)).cast("bigint") for e, m in grid]
    labelled = clusters.groupBy("id").agg(F.array(*label_of).alias("labels")).join(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), "id")
    at = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.col("setting"))
    found = silhouettes(cut_lineage(labelled), "id", "v", "labels")
    sils = found.select(at([e for e, _ in grid]).alias("eps"), at([m for _, m in grid]).alias("min_size"), "silhouette")
    enough = 20 if mode == "samples" else 10
    prior = F.exp(-((F.col("k") - float(target_k)) ** 2) / (2 * sigma * sigma))
    return (
        stats.join(sils, keys)
        .where((F.col("k") >= 2) & (F.col("n_kept") >= enough))
        .withColumn("noise", 1.0 - F.col("n_kept") / F.lit(float(n)))
        .withColumn("score", F.col("silhouette") * F.sqrt(1.0 - F.col("noise")) * prior * F.least(F.lit(1.0), F.lit(float(bound)) / F.col("max_size")))
    )


def first_members(rows: DataFrame, keys: list[str], label: str, order: str, n: int = 8) -> DataFrame:
    """The first n labels per cluster as one text."""
    best = top_n(rows, keys, [F.col(order)], n)
    return best.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(label).alias("t")))), lambda s: s["t"]), ", ").alias("members")
    )
