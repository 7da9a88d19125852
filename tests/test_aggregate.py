"""Aggregation, override precedence, exact ranks and medians on huge keys, wide vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecrec.functions import vec
from vecrec.operators import aggregate, evaluate, rank

EV = "entity_id string, group_name string, segment string, ord long"


def resolve(spark, rows, group_map, entity_map=()):
    ev = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EV)
    gm = spark.createDataFrame(list(group_map), "group_name string, segment string")
    em = spark.createDataFrame(list(entity_map), "entity_id string, segment string")
    out = aggregate.apply_segment_overrides(ev, aggregate.group_votes(ev, gm), em)
    return {r.entity_id: r.segment for r in out.collect()}


def test_mixed_group_is_not_forced(spark):
    assert resolve(spark, [("a", "G", "F"), ("b", "G", "M")], [("G", "COED")]) == {"a": "F", "b": "M"}


def test_external_value_beats_votes(spark):
    assert resolve(spark, [("a", "G", "M"), ("b", "G", "M")], [("G", "F")]) == {"a": "F", "b": "F"}


def test_entity_value_beats_group(spark):
    assert resolve(spark, [("a", "G", "M"), ("b", "G", "M")], [("G", "F")], [("a", "M")]) == {"a": "M", "b": "F"}


def test_tie_goes_to_first_seen_and_blank_stays(spark):
    assert resolve(spark, [("a", "G", "M"), ("b", "G", "F"), ("c", "H", "")], []) == {"a": "M", "b": "M", "c": ""}


def test_wide_vectors_use_slices(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 150))
    df = spark.createDataFrame([(f"k{i % 3}", [float(v) for v in x[i]]) for i in range(30)], "k string, v array<double>")
    out = vec.vector_sums(df, ["k"], "v", 150, extra=[F.count(F.lit(1)).alias("n")])
    for r in out.collect():
        assert r.n == 10
        assert np.allclose(r.sum_vec, x[int(r.k[1:])::3].sum(axis=0))
    mean = {r.k: np.array(r.vector) for r in aggregate.mean_direction(df, ["k"], "v", 150).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = u[0::3].mean(axis=0)
    assert np.allclose(mean["k0"], m / np.linalg.norm(m))


def test_zero_vector_policies(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r.u for r in vec.with_unit(df, "v", "u", 2, "pass").collect()] == [[0.0, 0.0], [0.6, 0.8]]
    with pytest.raises(Exception, match="zero vector"):
        vec.with_unit(df, "v", "u", 2, "raise").collect()
    with pytest.raises(Exception, match="number list"):
        spark.createDataFrame([("[]",)], "t string").select(vec.parse_vector(F.col("t"), "raise")).collect()
    with pytest.raises(Exception, match="length is not 3"):
        vec.require_dimension(df, "v", 3).collect()


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", float(np.round(rng.normal(), 1)), i) for i in range(900)]
    return spark.createDataFrame(rows, "k string, x double, ord long").repartition(6)


def test_rank_of_a_huge_key_is_exact(spark, skewed):
    order = [F.col("x").desc(), F.col("ord")]
    want = {(r.k, r.ord): r["rank"] for r in rank.ranked(skewed, ["k"], order).collect()}
    got = {(r.k, r.ord): r["rank"] for r in rank.ranked(skewed, ["k"], order, hot_rows=50).collect()}
    assert got == want and len(got) == 900


def test_median_of_a_huge_key_is_exact(spark, skewed):
    for keys in (["k"], []):
        want = sorted(map(tuple, rank.exact_median(skewed, keys, "x", "m").collect()))
        got = {tuple(r)[:-1]: tuple(r)[-1] for r in rank.exact_median(skewed, keys, "x", "m", hot_rows=50).collect()}
        assert got == {w[:-1]: pytest.approx(w[-1]) for w in want}


def test_trim_is_the_same_with_a_huge_key(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 3 else "cold", i, [float(v) for v in rng.normal(size=4)]) for i in range(120)]
    df = vec.with_unit(spark.createDataFrame(rows, "entity_id string, ord long, v array<double>"), "v", "u", 4)
    want = {r.ord for r in aggregate.trim_outliers(df, "entity_id", "u", 4, 0.15, 3).collect()}
    got = {r.ord for r in aggregate.trim_outliers(df, "entity_id", "u", 4, 0.15, 3, hot_rows=10).collect()}
    assert got == want and len(want) == 34 + 68


def test_pair_statistics_of_large_keys_match_small_path(spark):
    rng = np.random.default_rng(9)
    for sizes in ((45, 12), (30, 31)):
        rows = [(f"k{j}", 1000 * j + i, [float(v) for v in rng.normal(size=5)]) for j, n in enumerate(sizes) for i in range(n)]
        df = vec.with_unit(spark.createDataFrame(rows, "entity_id string, sample_id long, v array<double>"), "v", "u", 5)
        want = {r.entity_id: (r.med, r.low, r.high) for r in evaluate.pair_order_stats(df, "entity_id", "sample_id").collect()}
        got = {r.entity_id: (r.med, r.low, r.high) for r in evaluate.pair_order_stats(df, "entity_id", "sample_id", block_rows=13).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_moments_merge(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{i % 4}", i, [float(v) for v in rng.normal(size=3)]) for i in range(40)]
    df = vec.with_unit(spark.createDataFrame(rows, "k string, i long, v array<double>"), "v", "u", 3)
    parts = aggregate.moments(df.where("i < 13"), ["k"], "u", 3).unionByName(aggregate.moments(df.where("i >= 13"), ["k"], "u", 3))
    merged = {r.k: r for r in aggregate.merge_moments(parts, ["k"], 3).withColumn("c", aggregate.consistency()).collect()}
    for r in aggregate.moments(df, ["k"], "u", 3).withColumn("c", aggregate.consistency()).collect():
        assert merged[r.k].n == r.n and merged[r.k].c == pytest.approx(r.c)


def test_single_sample_confidence(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0])], "k string, v array<double>")
    assert aggregate.moments(df, ["k"], "v", 2).select(aggregate.consistency().alias("c")).first().c == 0.5


def test_second_space_follows_the_first(spark):
    """Validity, detections, quality, group and segment come from the first table, vectors and trim from the second."""
    rng = np.random.default_rng(23)
    n, d = 40, 4
    v = rng.normal(size=(n, d)) + 2
    first = [(f"e{i % 3}", i, i, f"g{i % 2}", i % 7 != 3, None if i % 5 == 0 else 2 if i % 11 == 4 else 1, float(i % 10) / 10, "F" if i % 4 else "") for i in range(n)]
    primary = spark.createDataFrame(first, "entity_id string, sample_id long, ord long, group_name string, is_valid boolean, face_count int, quality double, segment string")
    second = spark.createDataFrame([(f"e{i % 3}", i, i, [float(x) for x in v[i]]) for i in range(0, n) if i % 6 != 5] + [("e9", 1, 1, [1.0] * d)], "entity_id string, sample_id long, ord long, w array<double>")
    for how in ("spherical", "mean"):
        got = {r.entity_id: r for r in aggregate.build_second_space_vectors(second, primary, "w", d, 3, 0.3, 2, aggregator=how).collect()}
        assert set(got) == {"e0", "e1", "e2"}
        for e in range(3):
            ids = [i for i in range(e, n, 3) if i % 6 != 5 and i % 7 != 3 and not (i % 5 and i % 11 == 4)]
            u = v[ids] / np.linalg.norm(v[ids], axis=1, keepdims=True)
            centre = u.mean(axis=0) / np.linalg.norm(u.mean(axis=0))
            keep = np.argsort(-(u @ centre), kind="stable")[: max(2, round(len(ids) * 0.7))]
            w = np.maximum([ids[k] % 10 / 10 for k in keep], 1e-6) if how == "mean" else np.ones(len(keep))
            mean = (u[keep] * w[:, None]).sum(axis=0)
            np.testing.assert_allclose(got[f"e{e}"].vector, mean / np.linalg.norm(mean), atol=1e-9)
            s = u[keep] @ u[keep].T
            assert got[f"e{e}"].confidence == pytest.approx(s[np.triu_indices(len(keep), 1)].mean(), abs=1e-9)
            assert (got[f"e{e}"].image_count, got[f"e{e}"].kept_count, got[f"e{e}"].group_name) == (len(ids), len(keep), f"g{ids[-1] % 2}")
    loose = aggregate.build_second_space_vectors(second, primary, "w", d, 3, single_detection=False).where("entity_id = 'e0'").first()
    assert loose.image_count == len([i for i in range(0, n, 3) if i % 6 != 5 and i % 7 != 3])
