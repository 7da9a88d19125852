"""Recommendation on generated vectors against a brute-force scorer, and the greedy re-rank against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecrec.operators import rerank, score
from vecrec.plans.recommend import recommend

SCHEMA = "entity_id string, group_name string, ord long, image_count long, confidence double, segment string, vector array<double>"


def entities(spark, rows):
    full = [(e, g, i, o.get("count", 5), o.get("conf", 0.8), o.get("seg", ""), [float(x) for x in v]) for i, (e, g, v, o) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def population(seed, n=36, dim=5, groups=6):
    """Generated entities whose quality and segment vary independently of their vectors."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    options = [{"count": int(rng.integers(1, 9)), "conf": float(rng.uniform(0.05, 1)), "seg": "FM"[int(rng.integers(2))]} for _ in range(n)]
    return [(f"p{i:02d}", f"team{int(rng.integers(groups))}", v[i].tolist(), options[i]) for i in range(n)]


def brute(rows, liked, top_k, segment="off", min_count=0, min_conf=0.0, cap=0, alias=None):
    """Order by cosine to the liked direction (one liked entity: z-scores keep that order), then aliases and cap."""
    alias = alias or {}
    at = {r[0]: r for r in rows}
    unit = {e: np.array(v) / np.linalg.norm(v) for e, _, v, _ in rows}
    if segment == "auto":
        segment = at[liked][3]["seg"]
    banned = {alias.get(liked, liked)}
    fit = [e for e, _, _, o in rows if alias.get(e, e) not in banned and e != liked and (segment == "off" or o["seg"] == segment) and o["count"] >= min_count and o["conf"] >= min_conf]
    out, used, seen = [], {}, set()
    for e in sorted(fit, key=lambda e: -(unit[e] @ unit[liked])):
        group = at[e][1]
        if alias.get(e, e) in seen or cap and used.get(group, 0) >= cap:
            continue
        seen.add(alias.get(e, e))
        used[group] = used.get(group, 0) + 1
        out.append(e)
    return out[:top_k]


def ask(spark, rows, liked, **options):
    req = spark.createDataFrame([("r", liked)], "request_id string, entity_id string")
    out = recommend(entities(spark, rows), req, [len(rows[0][2])], use_confidence=False, pool_size=len(rows), **options).orderBy("rank").collect()
    return [r.entity_id for r in out]


@pytest.mark.parametrize("seed", [11, 12])
def test_filters_against_brute_force(spark, seed):
    rows = population(seed)
    weak = min(rows, key=lambda r: r[3]["conf"])[0]  # a liked row that fails the filters itself still counts
    assert ask(spark, rows, weak, top_k=9, segment_mode="off", min_image_count=4, min_confidence=0.3) == brute(rows, weak, 9, min_count=4, min_conf=0.3)
    for mode in ("auto", "off", "F", "M"):
        assert ask(spark, rows, "p07", top_k=12, segment_mode=mode) == brute(rows, "p07", 12, mode)


def test_group_cap_against_brute_force(spark):
    rows = population(21, groups=4)
    for cap in (1, 2, 3):
        assert ask(spark, rows, "p03", top_k=8, segment_mode="off", max_per_group=cap) == brute(rows, "p03", 8, cap=cap)


@pytest.mark.parametrize("block", [2048, 7])
def test_aliases_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(score, "REQUEST_BLOCK", block)
    rows = population(31)
    alias = {f"p{i:02d}": f"person{i // 3}" for i in range(0, 30, 1) if i % 3 < 2}
    frame = spark.createDataFrame(list(alias.items()), "entity_id string, alias_id string")
    for liked in ("p04", "p35"):
        assert ask(spark, rows, liked, top_k=15, segment_mode="off", aliases=frame) == brute(rows, liked, 15, alias=alias)


def test_unknown_request_is_empty_and_missing_space_counts_zero(spark):
    rows = [("a", "A", [1.0, 0], {}), ("b", "B", [0.9, 0.1], {}), ("c", "C", [0.2, 0.9], {})]
    assert ask(spark, rows, ["nobody"]) == []
    second = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "entity_id string, vector array<double>")
    req = spark.createDataFrame([("r", "a")], "request_id string, entity_id string")
    out = {r.entity_id: r for r in recommend(entities(spark, rows), req, [2, 2], secondary=second, weights=[1.0, 1.0], use_confidence=False).collect()}
    assert out["b"].score_1 is None or np.isnan(out["b"].score_1)
    assert out["b"].score == pytest.approx(out["b"].score_0 / 2)
    assert out["c"].score == pytest.approx((out["c"].score_0 + out["c"].score_1) / 2)
    # no liked entity in the second space: it drops out of the denominator
    req = spark.createDataFrame([("r", "b")], "request_id string, entity_id string")
    out = recommend(entities(spark, rows), req, [2, 2], secondary=second, weights=[1.0, 1.0], use_confidence=False).collect()
    assert all(r.score == pytest.approx(r.score_0) for r in out)


def test_many_requests_take_the_block_grid(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"e{i}", f"g{i % 5}", [float(x) for x in rng.normal(size=4)], {}) for i in range(60)]
    req = spark.createDataFrame([(f"r{i}", f"e{i}") for i in range(12)], "request_id string, entity_id string")
    args = dict(top_k=5, max_per_group=1, pool_size=20)
    want = recommend(entities(spark, rows), req, [4], **args).orderBy("request_id", "rank").select("request_id", "entity_id").collect()
    from vecrec.operators import blocks

    original = blocks.block_apply
    monkeypatch.setattr(score, "block_apply", lambda *a, **k: original(*a, **{**k, "broadcast_bytes": 1, "left_rows": 16, "right_rows": 5}))
    got = recommend(entities(spark, rows), req, [4], **args).orderBy("request_id", "rank").select("request_id", "entity_id").collect()
    assert got == want and len(got) == 60


def test_ten_thousand_requests_with_long_ban_lists(spark):
    """All requests in one run, one of them liking half of all entities, against the scoring formula."""
    rng = np.random.default_rng(17)
    n, d, asked = 120, 6, 10_000
    rows = [(f"e{i:03d}", f"g{i % 9}", rng.normal(size=d).tolist(), {"conf": float(rng.uniform(0.2, 1)), "seg": "FM"[i % 2]}) for i in range(n)]
    likes = {f"r{k:05d}": sorted({int(x) for x in rng.integers(0, n, size=1 + k % 3)}) for k in range(asked)}
    likes["r00000"] = list(range(0, n, 2))
    req = spark.createDataFrame([(r, f"e{i:03d}") for r, ids in likes.items() for i in ids], "request_id string, entity_id string")
    got = {}
    for r in recommend(entities(spark, rows), req, [d], top_k=4, segment_mode="off", pool_size=4).collect():
        got.setdefault(r.request_id, []).append((r["rank"], r.entity_id, r.score))
    assert len(got) == asked
    v = np.array([r[2] for r in rows])
    u, conf = v / np.linalg.norm(v, axis=1, keepdims=True), np.array([r[3]["conf"] for r in rows])
    for name in [f"r{k:05d}" for k in range(0, asked, 97)]:
        q = u[likes[name]].mean(axis=0)
        s = u @ (q / np.linalg.norm(q))
        z = (s - s.mean()) / s.std() * (0.5 + 0.5 * conf)
        best = sorted((i for i in range(n) if i not in likes[name]), key=lambda i: (-round(z[i], 9), i))[:4]
        assert [e for _, e, _ in sorted(got[name])] == [f"e{i:03d}" for i in best]
        np.testing.assert_allclose([x for *_, x in sorted(got[name])], z[best], atol=1e-9)


def test_greedy_rerank_against_brute_force(spark):
    rng = np.random.default_rng(7)
    n, d, k, cap, lam = 40, 6, 12, 3, 0.4
    v = rng.normal(size=(n, d))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = rng.normal(size=n)
    groups = [f"g{i % 6}" for i in range(n)]
    pool = spark.createDataFrame(
        [("r", f"e{i}", groups[i], i, float(s[i]), [float(x) for x in v[i]]) for i in range(n)],
        "request_id string, entity_id string, group_name string, ord long, score double, vector array<double>",
    )
    got = [r.entity_id for r in rerank.diversify(pool, [("vector", d)], lam, k, cap).orderBy("rank").collect()]
    order, chosen = sorted(range(n), key=lambda i: -s[i]), []
    while len(chosen) < k:
        best, top = None, -1e9
        for i in order:
            if i in chosen or sum(groups[c] == groups[i] for c in chosen) >= cap:
                continue
            red = max((u[i] @ u[c] for c in chosen), default=0.0)
            if lam * s[i] - (1 - lam) * red > top:
                best, top = i, lam * s[i] - (1 - lam) * red
        if best is None:
            break
        chosen.append(best)
    assert got == [f"e{i}" for i in chosen]


def test_strict_query_raises(spark):
    ev = entities(spark, [("a", "A", [1.0, 0.0], {})])
    req = spark.createDataFrame([("r", "zz")], "request_id string, entity_id string")
    with pytest.raises(Exception, match="no liked entity"):
        score.query_vectors(req, ev, "vector", 2, strict=True).collect()
    assert score.query_vectors(req, ev, "vector", 2).where(F.lit(True)).count() == 0
