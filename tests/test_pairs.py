"""Pair joins, greedy suppression, admission and graph clustering against brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vecrec import session
from vecrec.operators import blocks, cells, cluster, dedupe, graph, pairs
from vecrec.operators.cells import CellIndex

GRID = dict(broadcast_bytes=1, block_rows=17)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, 5))
    x[60:75] = x[3]  # a group of copies
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in u[i]]) for i in range(90)], "id long, v array<double>")
    nodes, members = pairs.distinct_vectors(df, "id", "v")
    return u, nodes, members


def test_copies_collapse(cloud):
    _, nodes, members = cloud
    assert {r.id: r.copies for r in nodes.collect()}[3] == 16
    assert {r.id: r.rep for r in members.collect()}[70] == 3 and nodes.count() == 75


def test_similar_pairs_broadcast_and_grid(cloud):
    u, nodes, _ = cloud
    ids = sorted(r.id for r in nodes.collect())
    want = {(a, b) for a in ids for b in ids if a < b and u[a] @ u[b] >= 0.6}
    assert {(r.src, r.dst) for r in pairs.similar_pairs(nodes, "v", 5, 0.6).collect()} == want
    for rows in (17, 20, 40):
        found = [(r.src, r.dst) for r in pairs.similar_pairs(nodes, "v", 5, 0.6, broadcast_bytes=1, block_rows=rows).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_far_cells_never_meet(spark):
    """Tight, far-apart bunches: the pruned grid finds the same pairs and leaves most block pairs out."""
    rng = np.random.default_rng(8)
    centres = np.eye(6)
    x = np.repeat(centres, 25, axis=0) + rng.normal(scale=0.02, size=(150, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, [float(v) for v in u[i]]) for i in range(150)], "id long, v array<double>")
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if u[a] @ u[b] >= 0.9985}
    assert {(r.src, r.dst) for r in pairs.similar_pairs(nodes, "v", 6, 0.9985, broadcast_bytes=1, block_rows=8).collect()} == want
    index = CellIndex(nodes, 6, 8)
    met = index.send(index.rows.withColumn("reach", F.lit(np.arccos(0.9985))), onward=True).groupBy("id").count()
    assert met.agg(F.avg("count")).first()[0] < 0.3 * index.blocks.sum()


def test_nearest_sends_few_rows_on_clustered_data(spark):
    """Exact neighbours of clustered rows with a dense ball, of which most cells are ruled out."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(24, 6))
    x = centres[np.arange(900) % 24] + rng.normal(scale=0.12, size=(900, 6))
    x[600:] = x[1] + rng.normal(scale=1e-4, size=(300, 6))  # a third of the rows, nearly one vector
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, [float(v) for v in u[i]]) for i in range(900)], "id long, v array<double>")
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    got = {}
    for r in pairs.nearest(nodes, "v", 6, 5, broadcast_bytes=1, right_rows=30, left_rows=100).collect():
        got.setdefault(r.src, []).append((r["rank"], r.weight))
    for i in range(900):
        np.testing.assert_allclose([w for _, w in sorted(got[i])], np.sort(s[i])[::-1][:5], atol=1e-12)
    index = CellIndex(nodes, 6, 30)
    fifth = spark.createDataFrame([(i, float(np.sort(s[i])[-5])) for i in range(900)], "id long, bound double")
    sent = index.send(index.rows.join(fifth, "id").withColumn("reach", F.acos(F.least(F.lit(1.0), "bound"))).drop("bound"), onward=False)
    assert sent.count() < 0.2 * 900 * index.blocks.sum()
    held = index.rows.groupBy("block").count().agg(F.max("count")).first()[0]
    assert held <= 4 * 30


def test_a_dense_block_gives_its_pairs_in_slices(spark, monkeypatch):
    """Every pair of a block is near: no frame holds more than a slice of them, on either path."""
    x = np.array([1.0, 0.0, 0.0]) + np.random.default_rng(2).normal(scale=0.05, size=(600, 3))
    frame = pd.DataFrame({"id": np.arange(600), "v": list(x / np.linalg.norm(x, axis=1, keepdims=True)), "home": 0, "block": 0})
    nodes = spark.createDataFrame([(i, [float(v) for v in frame["v"][i]]) for i in range(30)], "id long, v array<double>")
    seen = []
    index = CellIndex(nodes, 3, 8)
    monkeypatch.setattr(pairs, "SLICE", 10_000)
    monkeypatch.setattr(pairs, "self_block_apply", lambda rows, fn, *_, **__: seen.append(lambda a, b: fn(a, b, True)))
    monkeypatch.setattr(CellIndex, "meet", lambda self, sent, fn, *_, **__: seen.append(fn))
    pairs.similar_pairs(nodes, "v", 3, 0.5)
    pairs.similar_pairs(nodes, "v", 3, 0.5, index=index)
    for fn in seen:
        sizes = [len(f) for f in fn(frame, frame)]
        assert sum(sizes) == 600 * 599 // 2 and max(sizes) <= 10_000
    assert len(seen) == 2


def test_index_of_nothing_and_of_one_row(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert pairs.nearest(empty, "v", 3, 2, index=CellIndex(empty, 3)).count() == 0
    one = spark.createDataFrame([(7, [1.0, 0.0, 0.0])], "id long, v array<double>")
    assert pairs.nearest(one, "v", 3, 2, index=CellIndex(one, 3)).count() == 0
    assert pairs.similar_pairs(one, "v", 3, 0.5, index=CellIndex(one, 3)).count() == 0


def test_nearest_broadcast_and_grid(cloud):
    u, nodes, _ = cloud
    small = {(r.src, r.dst, r["rank"]) for r in pairs.nearest(nodes, "v", 5, 4).collect()}
    grid = {(r.src, r.dst, r["rank"]) for r in pairs.nearest(nodes, "v", 5, 4, broadcast_bytes=1, left_rows=20, right_rows=11).collect()}
    assert small == grid and len(small) == 75 * 4
    either, both = pairs.knn_edges(nodes, "v", 5, 4, 0.0).count(), pairs.knn_edges(nodes, "v", 5, 4, 0.0, mutual=True).count()
    assert both < either


def prints(seed, n, keys=3, bits=63, noise=4):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**62, size=6)
    out = []
    for i in range(n):
        fp = int(centres[rng.integers(6)])
        for b in rng.integers(0, bits, size=rng.integers(0, noise + 1)):
            fp ^= 1 << int(b)
        out.append((f"k{rng.integers(keys)}", i, i, fp))
    return out


def dist(a, b):
    return bin(a ^ b).count("1")


@pytest.mark.parametrize("t", [3, 6, 12, 20])
def test_hamming_pairs_with_hot_buckets(spark, t):
    rows = prints(1, 150)
    df = spark.createDataFrame(rows, "k string, id long, ord long, fp long")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and dist(a[3], b[3]) <= t}
    for hot in (10_000, 3):
        found = [(r.src, r.dst) for r in pairs.hamming_pairs(df, ["k"], t, hot_bucket=hot).collect()]
        assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("t", [4, 20])
def test_groups_of_a_hot_entity_stay_bounded(spark, monkeypatch, t):
    """One entity holds nearly all rows, a ball of near fingerprints among them: no co-group exceeds the bound."""
    rng = np.random.default_rng(31)
    rows = [("hot", i, i, int(x)) for i, x in enumerate(rng.integers(0, 2**62, size=250))]
    rows += [("hot", 300 + i, 300 + i, rows[5][3] ^ (1 << int(rng.integers(62)))) for i in range(150)] + [("cold", 900, 900, rows[5][3]), (None, 901, 901, 0), (None, 902, 902, 0)]
    df = spark.createDataFrame(rows, "k string, id long, ord long, fp long")
    largest = spark.sparkContext.accumulator(0)
    original = pairs.self_block_apply

    def watched(named, fn, schema, key, row_bytes, **sizes):
        def counted(a, b, ordered):
            if max(len(a), len(b)) > 40:
                largest.add(1)
            return fn(a, b, ordered)

        return original(named, counted, schema, key, row_bytes, **sizes)

    monkeypatch.setattr(pairs, "self_block_apply", watched)
    found = [(r.src, r.dst, r.distance) for r in pairs.hamming_pairs(df, ["k"], t, hot_bucket=20).collect()]
    want = {(a[1], b[1], dist(a[3], b[3])) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[2] < b[2] and dist(a[3], b[3]) <= t}
    assert len(found) == len(set(found)) and set(found) == want
    assert largest.value == 0


def greedy(rows, t, across):
    taken, out = [], {}
    for k, i, _, fp in rows:
        same = [f for q, f in taken if q == k]
        if fp in same:
            out[i] = "duplicate_sha"
        elif any(dist(fp, f) <= t for f in same):
            out[i] = "duplicate_phash"
        elif across and any(f == fp for _, f in taken):
            out[i] = "duplicate_crossmember"
        else:
            out[i] = "downloaded"
            taken.append((k, fp))
    return out


@pytest.mark.parametrize("across", [False, True])
def test_greedy_suppression(spark, across):
    rows = prints(2, 120, noise=3)
    df = spark.createDataFrame(rows, "k string, id long, ord long, fp long")
    want = greedy(rows, 3, across)
    got = {r.id: r.accepted for r in dedupe.suppress_near_duplicates(df, "k", 3, across).collect()}
    assert got == {i: s == "downloaded" for i, s in want.items()}


@pytest.mark.parametrize("across", [False, True])
def test_covering_rounds_decide_like_the_walk(spark, across):
    rows = prints(12, 260, noise=3)
    df = spark.createDataFrame(rows, "k string, id long, ord long, fp long").repartition(5)
    want = {i for i, s in greedy(rows, 3, across).items() if s == "downloaded"}
    for head, crowd in ((1, 3), (7, 20), (50, 60)):
        got = dedupe.suppress_near_duplicates(df, "k", 3, across, head_rows=head, crowd=crowd)
        assert {r.id for r in got.where("accepted").collect()} == want


def test_a_dense_ball_makes_no_pairs(spark, monkeypatch):
    """20,000 near fingerprints of one entity: rows handed on stay in proportion to them."""
    rng = np.random.default_rng(41)
    centre = int(rng.integers(2**62))
    bits = rng.integers(0, 62, size=(20_000, 3))
    fps = np.unique(np.bitwise_xor.reduce(np.int64(1) << bits, axis=1) ^ centre)
    rng.shuffle(fps)
    rows = [("hot", int(i), int(i), int(f)) for i, f in enumerate(fps)] + [("cold", 10**6 + i, 10**6 + i, int(x)) for i, x in enumerate(rng.integers(0, 2**62, size=50))]
    df = spark.createDataFrame(rows, "k string, id long, ord long, fp long")
    seen = []
    original = dedupe.hamming_pairs
    monkeypatch.setattr(dedupe, "hamming_pairs", lambda *a, **k: (seen.append(original(*a, **k)), seen[-1])[1])
    got = [r for r in dedupe.suppress_near_duplicates(df, "k", 6).where("accepted").collect()]
    assert {r.id for r in got if r.k == "hot"} == {0} and sum(r.k == "cold" for r in got) == 50
    assert sum(e.count() for e in seen) < 100


def test_admission_statuses_and_quota(spark):
    rows = prints(4, 140, noise=3)
    df = spark.createDataFrame(rows, "entity_id string, id long, ord long, fp long").selectExpr(
        "*", "concat('u', id % 120) AS url", "cast(fp AS string) AS digest", "if(id % 13 = 5, 'too small', cast(null AS string)) AS error"
    )
    seen = spark.createDataFrame([("u7",), ("u9",)], "url string")
    firsts, live = set(), []
    for k, i, o, fp in rows:
        url = f"u{i % 120}"
        if url in ("u7", "u9") or (k, url) in firsts:
            continue
        firsts.add((k, url))
        live.append((k, i, o, fp))
    want = greedy([r for r in live if r[1] % 13 != 5], 3, True)
    want.update({r[1]: "failed" for r in live if r[1] % 13 == 5})
    got = {r.id: r.status for r in dedupe.admit(df, seen, None, 3, True).collect()}
    assert got == want
    have = spark.createDataFrame([("k0", 1), ("k1", 50)], "entity_id string, n long")
    limited = dedupe.admit(df, seen, have, 3, True, limit=4).where("status = 'downloaded'").groupBy("entity_id").count().collect()
    full = {}
    for k, i, *_ in live:
        if want[i] == "downloaded":
            full[k] = full.get(k, 0) + 1
    assert {r.entity_id: r["count"] for r in limited} == {k: min(n, 3 if k == "k0" else 4) for k, n in full.items() if k != "k1"}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "src long, dst long")
    nodes = spark.range(45).toDF("id")
    labels = {r.id: r.label for r in graph.components(nodes, edges).collect()}
    assert labels == {i: 0 if i <= 20 else 21 if i <= 40 else i for i in range(45)}


def test_label_propagation(spark):
    left = [(a, b, 1.0) for a in range(5) for b in range(a + 1, 5)]
    right = [(a, b, 1.0) for a in range(5, 10) for b in range(a + 1, 10)]
    edges = spark.createDataFrame(left + right + [(4, 5, 0.1)], "src long, dst long, weight double")
    labels = {r.id: r.label for r in graph.propagate_labels(spark.range(11).toDF("id"), edges).collect()}
    assert len({labels[i] for i in range(5)}) == 1 and len({labels[i] for i in range(5, 10)}) == 1
    assert labels[0] != labels[9] and labels[10] == 10
    ids = {r.id: r.cluster_id for r in graph.relabel(graph.propagate_labels(spark.range(11).toDF("id"), edges)).collect()}
    assert sorted(set(ids.values())) == [0, 1, 2]


def walked_labels(nodes, edges, rounds):
    """Label propagation by hand: every node of a half reads all its neighbours in every round."""
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    label = {i: i for i, _ in nodes}
    copies = dict(nodes)
    for step in range(2 * rounds):
        new = dict(label)
        for i in label:
            if ord(hashlib.md5(f"{i}:{step // 2}".encode()).hexdigest()[0]) % 2 != step % 2:
                continue
            votes = {}
            for j, w in near.get(i, []):
                votes[label[j]] = votes.get(label[j], 0.0) + w * copies[j]
            if copies[i] > 1:
                votes[label[i]] = votes.get(label[i], 0.0) + copies[i] - 1.0
            if votes:
                new[i] = min(votes, key=lambda v: (-round(votes[v], 9), v))
        label = new
    return label


@pytest.mark.parametrize("sizes", [{}, {"frontier_links": 0}, {"frontier_links": 0, "broadcast_nodes": 60}])
def test_label_propagation_by_frontier(spark, sizes):
    rng = np.random.default_rng(5)
    nodes = [(i, 3 if i % 11 == 0 else 1) for i in range(150)]
    pairs_of = {tuple(sorted(p)) for p in rng.integers(0, 140, (420, 2)).tolist() if p[0] != p[1]}
    edges = [(a, b, float(rng.integers(1, 4)) / 4) for a, b in sorted(pairs_of)]
    cuts = [0.25, 0.5]
    table = spark.createDataFrame([(c, *n) for c in cuts for n in nodes], "cut double, id long, copies long")
    links = spark.createDataFrame([(c, *e) for c in cuts for e in edges if e[2] >= c], "cut double, src long, dst long, weight double")
    got = {(r.cut, r.id): r.label for r in graph.propagate_labels(table, links, ["cut"], 4, **sizes).collect()}
    want = {(c, i): v for c in cuts for i, v in walked_labels(nodes, [e for e in edges if e[2] >= c], 4).items()}
    assert got == want


def test_density_clusters_with_copies(cloud):
    u, nodes, members = cloud
    eps, k = 0.12, 3
    got, grid = (
        {r.id: r.label for r in graph.density_clusters(graph.density_labels(nodes, "v", 5, [eps], k, **sizes), members, [4]).collect()} for sizes in ({}, GRID)
    )
    assert got == grid
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    core = np.sort(np.maximum(d, 0), axis=1)[:, k - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), d) <= eps
    label = list(range(90))
    for _ in range(90):
        label = [min([label[i]] + [label[j] for j in np.nonzero(reach[i])[0]]) for i in range(90)]
    # equal vectors always belong together
    for i in range(60, 75):
        label[i] = label[3]
    size = {x: label.count(x) for x in label}
    assert got == {i: (label[i] if size[label[i]] >= 4 else -1) for i in range(90)}


def test_average_linkage_brute_force():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(18, 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = cluster.average_linkage(np.ones(18), u, 4)
    groups = [[i] for i in range(18)]
    while len(groups) > 4:
        pairs_ = [(np.mean([1 - u[a] @ u[b] for a in g for b in h]), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j]
        _, i, j = min(pairs_)
        groups[i] += groups.pop(j)
    assert {frozenset(g) for g in groups} == {frozenset(np.nonzero(got == c)[0].tolist()) for c in set(got.tolist())}


def test_linkage_rounds_equal_exact_linkage(spark):
    """Distributed rounds down to a few groups cut the same clusters as merging the closest pair each time."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(40, 3)), rng.normal(size=(3, 3)) * 9])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = sorted(range(43), key=lambda i: list(u[i]))
    copies = [*range(43), 4, 4]  # equal rows weigh as often as they occur
    df = spark.createDataFrame([(n, [float(v) for v in u[i]]) for n, i in enumerate(copies)], "id long, v array<double>")
    count = np.array([copies.count(i) for i in order], float)
    want = [cluster.average_linkage(count, u[order] * count[:, None], k) for k in (2, 5)]
    for micro in (6, 512):
        got = {r.id: r.labels for r in cluster.agglomerate(df, "v", 3, [2, 5], micro).collect()}
        for k in range(2):
            label = dict(zip(order, want[k].tolist()))
            assert {n: x[k] for n, x in got.items()} == {n: label[i] for n, i in enumerate(copies)}


def test_linkage_compares_only_groups_whose_nearest_merged(spark):
    rng = np.random.default_rng(18)
    x = rng.normal(size=(12, 4))[np.arange(120) % 12] + rng.normal(size=(120, 4)) * 0.2
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = sorted(range(120), key=lambda i: list(u[i]))
    df = spark.createDataFrame([(n, [float(v) for v in u[i]]) for n, i in enumerate(order)], "id long, v array<double>")
    want = cluster.average_linkage(np.ones(120), u[order], 5)
    got = {r.id: r.labels[0] for r in cluster.agglomerate(df, "v", 4, [5], 8, broadcast_bytes=1, left_rows=40, right_rows=30).collect()}
    assert got == dict(enumerate(want.tolist()))
    groups = df.select(F.lit(0).cast("long").alias("seg"), "id", F.lit(1.0).alias("n"), F.col("v").alias("s"))
    compared = []
    left, _ = cluster.merged_groups(groups, 4, 5, 8, compared)
    assert left.count() <= 8 and compared[0] == 120
    assert all(n < 120 * 0.7 for n in compared[1:]) and sum(compared) < 120 * (1 + 0.45 * (len(compared) - 1))


def test_linkage_of_many_segments_at_once(spark):
    """Each segment is cut as if it were alone; there may be hundreds, some smaller than the number of clusters."""
    rng = np.random.default_rng(28)
    sizes = [30, 17, 2, 1] + [3] * 230
    rows, want, n = [], {}, 0
    for k, size in enumerate(sizes):
        x = rng.normal(size=(size, 3))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        order = sorted(range(size), key=lambda i: list(u[i]))
        labels = cluster.average_linkage(np.ones(size), u[order], 2)
        for at, i in enumerate(order):
            rows.append((n, f"s{k}", [float(v) for v in u[i]]))
            want[n] = int(labels[at])
            n += 1
    df = spark.createDataFrame(rows + [(-1, None, [1.0, 0.0, 0.0])], "id long, part string, v array<double>")
    got = {r.id: r.labels[0] for r in cluster.agglomerate(df, "v", 3, [2], 6, within="part").collect()}
    assert got == want


def test_nearest_groups_within_single_precision(spark):
    """Products of near copies differ by less than single precision holds; several tiles, and few pairs to a task."""
    rng = np.random.default_rng(38)
    x = rng.normal(size=(130, 4))[np.arange(2600) % 130] + rng.normal(size=(2600, 4)) * 1e-4
    x[7] = x[2599]
    n = 1.0 + np.arange(2600) % 3
    s = x / np.linalg.norm(x, axis=1, keepdims=True) * n[:, None]
    groups = spark.createDataFrame([(0, i, float(n[i]), [float(v) for v in s[i]]) for i in range(2600)], "seg long, id long, n double, s array<double>").coalesce(1)
    d = np.round(1.0 - (s @ s.T) / np.outer(n, n), 12)
    np.fill_diagonal(d, np.inf)
    for sizes in ({"task_pairs": 1_000_000}, {"broadcast_bytes": 1, "left_rows": 1300, "right_rows": 1300}):
        got = {r.id: r for r in cluster.nearest_groups(groups, groups, 4, **sizes).collect()}
        for i in range(2600):
            near = {min(i, j) + max(i, j) - i for j in np.flatnonzero(d[i] <= d[i].min() + 2e-12)}
            r = got[i]
            assert abs(r.d - d[i].min()) <= 2e-12 and i in (r.lo, r.hi) and r.lo + r.hi - i in near
        assert (got[7].lo, got[7].hi) == (got[2599].lo, got[2599].hi) == (7, 2599)


def test_block_pairs_are_dealt_out(spark):
    """One file of rows, or few shuffle partitions, do not make one long task of all pairs."""
    df = spark.range(2000).coalesce(1)
    count = lambda a, b: pd.DataFrame({"n": [len(a) * len(b)]})
    for sizes, tasks in (({}, 40), ({"broadcast_bytes": 1, "left_rows": 400, "right_rows": 500}, 20)):
        met = blocks.block_apply(df, df, count, "n long", "id", "id", 8, task_pairs=100_000, **sizes)
        assert met.rdd.getNumPartitions() == tasks and met.agg(F.sum("n")).first()[0] == 2000 * 2000


def test_silhouettes(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3)) + np.repeat([[4, 0, 0], [0, 4, 0]], 20, axis=0)
    labels = np.repeat([0, 1], 20)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(labels[i])) for i in range(40)], "id long, v array<double>, cluster_id long")
    assert cluster.cosine_silhouette(df, "v", "cluster_id") == pytest.approx(cluster.silhouette(x, labels, "cosine"), abs=1e-9)
    other = np.where(np.arange(40) % 5 == 0, -1, np.arange(40) % 3)
    both = df.withColumn("labels", F.array("cluster_id", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("id") % 3)))
    want = {0: cluster.silhouette(x, labels), 1: cluster.silhouette(x[other >= 0], other[other >= 0])}
    for sizes in ({}, {"broadcast_bytes": 1, "right_rows": 7}):
        got = {r.setting: r.silhouette for r in cluster.silhouettes(both, "id", "v", "labels", **sizes).collect()}
        assert got == pytest.approx(want, abs=1e-9)
    done = {r.id: r.cluster_id for r in cluster.kmeans(df.drop("cluster_id"), "v", 2, restarts=2).collect()}
    assert len({done[i] for i in range(20)}) == 1 and done[0] != done[39]


def test_kmeans_for_several_k_at_once(spark):
    """Each row has its nearest centre, each centre is the mean of its rows, and clear clusters are found."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 3)) * 0.2 + np.repeat(np.eye(3) * 5, 20, axis=0)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "id long, v array<double>").repartition(3)
    got = {r.id: r.labels for r in cluster.kmeans_many(df, "v", [2, 3, 5], 4).collect()}
    for k, size in enumerate((2, 3, 5)):
        label = np.array([got[i][k] for i in range(60)])
        centres = np.stack([x[label == c].mean(axis=0) for c in range(size)])
        assert (((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) == label).all()
    assert len({(got[i][1], i // 20) for i in range(60)}) == 3
    labelled, scores = cluster.auto_k(df, "id", "v", 3, "auto", range(2, 6), 4)
    assert max(scores.collect(), key=lambda r: r.silhouette).k == 3 and labelled.select("cluster_id").distinct().count() == 3
    assert cluster.kmeans_many(df.limit(0), "v", [2], 2).count() == 0


def test_block_grid_covers_every_pair_once(spark):
    df = spark.range(53).toDF("id")
    import pandas as pd

    def pair(a, b, ordered):
        out = [(x, y) for x in a["id"] for y in b["id"] if not ordered or x < y]
        return pd.DataFrame({"x": [min(p) for p in out], "y": [max(p) for p in out]}, dtype="int64")

    for rows in (60, 30, 20, 9):
        got = [(r.x, r.y) for r in blocks.self_block_apply(df, pair, "x long, y long", "id", 8, broadcast_bytes=1, block_rows=rows).collect()]
        assert len(got) == len(set(got)) == 53 * 52 // 2
    assert F is not None


@pytest.mark.parametrize("grid_rows", [7, 20, 100])
def test_scattered_vectors_meet_in_whole_blocks(cloud, monkeypatch, grid_rows):
    """Where cells rule out too little nothing is sent to them: rows go once to each large block, and all is found."""
    u, nodes, _ = cloud
    monkeypatch.setattr(cells, "SEND_BYTES", 0)
    monkeypatch.setattr(cells, "SPARED", 0.0)
    monkeypatch.setattr(CellIndex, "send", lambda *_, **__: pytest.fail("sent to cells"))
    ids = sorted(r.id for r in nodes.collect())
    want = {(a, b) for a in ids for b in ids if a < b and u[a] @ u[b] >= 0.6}
    found = pairs.similar_pairs(nodes, "v", 5, 0.6, **GRID, grid_rows=grid_rows)
    got = [(r.src, r.dst) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    small = {(r.src, r.dst, r["rank"]) for r in pairs.nearest(nodes, "v", 5, 4).collect()}
    grid = {(r.src, r.dst, r["rank"]) for r in pairs.nearest(nodes, "v", 5, 4, broadcast_bytes=1, right_rows=11, grid_rows=grid_rows).collect()}
    assert small == grid


def test_block_best_of_near_copies():
    """Weights that single precision cannot tell apart, more of them than are asked for."""
    rng = np.random.default_rng(3)
    x = np.array([1.0, 0, 0, 0]) + rng.normal(scale=1e-6, size=(6000, 4))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    frame = pd.DataFrame({"id": rng.permutation(6000), "v": list(u)})
    got = pairs.closest_in_block(frame.iloc[:40], frame, 3, np.full(40, -2.0))
    s = np.einsum("ij,kj->ik", u[:40], u)
    s[np.arange(40), np.arange(40)] = -np.inf
    best = got.groupby("src")["weight"].apply(lambda w: np.sort(w)[::-1])
    for i in range(40):
        np.testing.assert_allclose(best[frame["id"][i]], np.sort(s[i])[::-1][:3], atol=1e-15)
    assert not (got["src"] == got["dst"]).any() and len(got) == 120


def test_links_are_made_once(spark):
    """Both directions come from one run of the plan of the edges."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25)], "src long, dst long, weight double").mapInPandas(count, "src long, dst long, weight double")
    assert sorted(map(tuple, graph.both_ways(edges, []).collect())) == [(1, 2, 0.5), (2, 1, 0.5), (2, 3, 0.25), (3, 2, 0.25)]
    assert seen.value == 2


def test_shuffle_files_go_with_their_round(spark):
    """A stored round leaves no shuffle behind, and keeps the setting as it was."""
    was = spark.conf.get(session.SHUFFLE_CLEANUP, None)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = tracker.size()
    stored = session.cut_lineage(spark.range(1000).repartition(4, "id"))
    assert tracker.size() <= before and spark.conf.get(session.SHUFFLE_CLEANUP, None) == was
    assert stored.count() == 1000


def test_density_stores_only_pairs_that_join_components(spark, monkeypatch):
    """A ball whose rows are all near to each other gives fewer pairs than rows and bounds, with the same components."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 4))
    x[100:] = np.array([2.0, 0, 0, 0]) + rng.normal(scale=0.05, size=(200, 4))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, 1, [float(v) for v in u[i]]) for i in range(300)], "id long, copies long, v array<double>")
    made, eps = [], [0.01, 0.05, 0.1]
    search = graph.similar_pairs
    monkeypatch.setattr(graph, "similar_pairs", lambda *a, **b: made.append(search(*a, **b)) or made[-1])
    monkeypatch.setattr(cells, "SEND_BYTES", 0)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    core = np.sort(np.maximum(d, 0), axis=1)[:, 1]
    for spared, sizes in ((1.0, {}), (1.0, {"broadcast_bytes": 1, "block_rows": 40}), (0.0, {"broadcast_bytes": 1, "block_rows": 40, "grid_rows": 160})):
        monkeypatch.setattr(cells, "SPARED", spared)
        got = {(r.eps, r.id): r.label for r in graph.density_labels(nodes, "v", 4, eps, 2, **sizes).collect()}
        if "block_rows" not in sizes or "grid_rows" in sizes:
            assert made[-1].count() < 6 * 300 * len(eps)
        for e in eps:
            near = np.maximum(np.maximum(core[:, None], core[None, :]), d) <= e
            assert near.sum() > 2 * 6 * 300 * len(eps)
            label = np.arange(300)
            for _ in range(300):
                new = np.where(near, label[None, :], 300).min(axis=1)
                new = np.minimum(label, new)
                if (new == label).all():
                    break
                label = new
            assert [got[e, i] for i in range(300)] == label.tolist()
