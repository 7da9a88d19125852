"""Queries: entity aggregation and recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecrec.catalog import views
from vecrec.catalog.base import mean_cte, query, unit
from vecrec.catalog.views import D1, D2, MAPS_SQL, SAMPLES_SQL
from vecrec.functions import vec
from vecrec.operators import aggregate, rerank, score
from vecrec.plans.recommend import recommend
from vecrec.session import cut_lineage

TRIM, MIN_KEEP, MIN_SAMPLES = 0.15, 3, 2

ELIGIBLE_SQL = f"""{SAMPLES_SQL},
elig AS (SELECT * FROM samples WHERE is_valid AND face_count <= 1 AND quality >= 0.05),
units AS (SELECT *, {unit('v1')} AS u FROM elig)"""

BUILT_SQL = f"""{ELIGIBLE_SQL}, {MAPS_SQL},
{mean_cte('c0', 'units', 'entity_id', 'u')},
trimmed AS (
  SELECT units.* FROM units JOIN c0 USING (entity_id)
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY list_dot_product(u, vector) DESC, ord)
    <= CASE WHEN n <= {MIN_KEEP} THEN n ELSE greatest({MIN_KEEP}, round_even(n * (1 - {TRIM}), 0)) END),
{mean_cte('c1', 'trimmed', 'entity_id', 'u')},
conf AS (
  SELECT a.entity_id, avg(list_dot_product(a.u, b.u)) AS c FROM trimmed a JOIN trimmed b
  ON a.entity_id = b.entity_id AND a.sample_id < b.sample_id GROUP BY 1),
segs AS (
  SELECT entity_id, segment FROM (SELECT entity_id, segment, count(*) AS c, min(ord) AS o FROM elig WHERE segment <> '' GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY c DESC, o) = 1),
raw_ev AS (
  SELECT h.*, c1.n AS kept_count, coalesce(greatest(0, least(1, conf.c)), 0.5) AS confidence,
         coalesce(segs.segment, '') AS own_segment, c1.vector
  FROM (SELECT entity_id, count(*) AS image_count, max_by(group_name, ord) AS group_name, min(ord) AS ord
        FROM elig GROUP BY 1 HAVING count(*) >= {MIN_SAMPLES}) h
  JOIN c1 USING (entity_id) LEFT JOIN conf USING (entity_id) LEFT JOIN segs USING (entity_id)),
votes AS (
  SELECT group_name, own_segment AS segment, count(*) AS c, min(ord) AS o FROM raw_ev WHERE own_segment <> '' GROUP BY 1, 2),
majority AS (
  SELECT group_name, segment FROM (SELECT *, sum(c) OVER (PARTITION BY group_name) AS t FROM votes)
  QUALIFY row_number() OVER (PARTITION BY group_name ORDER BY c DESC, o) = 1 AND c / t >= 0.5),
group_segment AS (
  SELECT coalesce(m.group_name, g.group_name) AS group_name, coalesce(g.segment, m.segment) AS segment
  FROM majority m FULL JOIN group_map g ON m.group_name = g.group_name WHERE coalesce(g.segment, '') <> 'COED'),
ev AS (
  SELECT e.entity_id, e.group_name, e.ord, e.image_count, e.kept_count, e.confidence,
         coalesce(em.segment, gs.segment, e.own_segment) AS segment, e.vector
  FROM raw_ev e LEFT JOIN group_segment gs ON e.group_name = gs.group_name LEFT JOIN entity_map em ON e.entity_id = em.entity_id),
second_in AS (SELECT entity_id, {unit('v2')} AS u FROM samples WHERE is_valid AND entity_no % 11 <> 5),
{mean_cte('second', 'second_in', 'entity_id', 'u')}"""


def unit_samples(spark: SparkSession, sf: str) -> DataFrame:
    eligible = aggregate.eligible_samples(views.samples(spark, sf), 0.05)
    return vec.with_unit(eligible, "v1", "u", D1)


def stored_entity_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Entity vectors as the written table that searches read (built once, not per use)."""
    return cut_lineage(entity_vectors(spark, sf))


def entity_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.build_entity_vectors(
        views.samples(spark, sf), "v1", D1, min_quality=0.05, min_samples=MIN_SAMPLES, trim_fraction=TRIM, min_keep=MIN_KEEP,
        group_map=views.group_map(spark, sf), entity_map=views.entity_map(spark, sf),
    )


def second_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.samples(spark, sf).where("is_valid AND entity_no % 11 <> 5")
    return aggregate.mean_direction(rows, ["entity_id"], "v2", D2)


def long_vector(df: DataFrame, *keys: str, vector: str = "vector") -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("dim", "x")).select(
        *keys, (F.col("dim") + 1).cast("bigint").alias("dim"), F.round("x", 6).alias("x")
    )


def long_sql(source: str, *keys: str, vector: str = "vector") -> str:
    k = ", ".join(keys)
    return f"SELECT {k}, i AS dim, round(x, 6) AS x FROM (SELECT {k}, unnest(range(1, len({vector}) + 1)) AS i, unnest({vector}) AS x FROM {source})"


@query("a01_mean_direction", f"WITH {ELIGIBLE_SQL}, {mean_cte('c', 'units', 'entity_id', 'u')} {long_sql('c', 'entity_id', 'n')}")
def _(spark, sf):
    return long_vector(aggregate.mean_direction(unit_samples(spark, sf), ["entity_id"], "u", D1, normalise_rows=False), "entity_id", "n")


@query(
    "a02_weighted_mean",
    f"""WITH {ELIGIBLE_SQL},
d AS (SELECT entity_id, i, sum(w * x) / sum(w) AS m FROM (
  SELECT entity_id, greatest(quality, 1e-6) AS w, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS x FROM units) GROUP BY 1, 2),
m AS (SELECT entity_id, list(m ORDER BY i) AS mean FROM d GROUP BY 1),
c AS (SELECT entity_id, {unit('mean')} AS vector FROM m) {long_sql('c', 'entity_id')}""",
)
def _(spark, sf):
    out = aggregate.mean_direction(unit_samples(spark, sf), ["entity_id"], "u", D1, normalise_rows=False, weight="quality")
    return long_vector(out, "entity_id")


@query("a03_outlier_trim", f"WITH {BUILT_SQL} SELECT entity_id, sample_id FROM trimmed")
def _(spark, sf):
    kept = aggregate.trim_outliers(unit_samples(spark, sf), "entity_id", "u", D1, TRIM, MIN_KEEP)
    return kept.select("entity_id", "sample_id")


@query(
    "a04_consistency",
    f"""WITH {ELIGIBLE_SQL},
p AS (SELECT a.entity_id, avg(list_dot_product(a.u, b.u)) AS c FROM units a JOIN units b
  ON a.entity_id = b.entity_id AND a.sample_id < b.sample_id GROUP BY 1)
SELECT entity_id, count(*) AS n, round(coalesce(greatest(0, least(1, max(c))), 0.5), 6) AS confidence
FROM units LEFT JOIN p USING (entity_id) GROUP BY 1""",
)
def _(spark, sf):
    state = aggregate.moments(unit_samples(spark, sf), ["entity_id"], "u", D1)
    return state.select("entity_id", "n", F.round(aggregate.consistency(), 6).alias("confidence"))


@query(
    "a05_dominant_segment",
    f"""WITH {SAMPLES_SQL}
SELECT entity_id, coalesce(segment, '') AS segment FROM (SELECT DISTINCT entity_id FROM samples) LEFT JOIN (
  SELECT entity_id, segment FROM (SELECT entity_id, segment, count(*) AS c, min(ord) AS o FROM samples WHERE segment <> '' GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY c DESC, o) = 1) USING (entity_id)""",
)
def _(spark, sf):
    rows = views.samples(spark, sf)
    voted = aggregate.dominant_value(rows, "entity_id", "segment", "ord", "segment")
    return rows.select("entity_id").distinct().join(voted, "entity_id", "left").select(
        "entity_id", F.coalesce("segment", F.lit("")).alias("segment")
    )


@query("a06_group_segments", f"WITH {BUILT_SQL} SELECT entity_id, group_name, segment FROM ev")
def _(spark, sf):
    return entity_vectors(spark, sf).select("entity_id", "group_name", "segment")


@query(
    "a07_entity_vectors",
    f"WITH {BUILT_SQL} {long_sql('ev', 'entity_id', 'group_name', 'image_count', 'kept_count', 'segment', 'round(confidence, 4) AS confidence')}".replace(
        "SELECT entity_id, group_name, image_count, kept_count, segment, round(confidence, 4) AS confidence, i AS dim",
        "SELECT entity_id, group_name, image_count, kept_count, segment, confidence, i AS dim",
    ),
)
def _(spark, sf):
    ev = entity_vectors(spark, sf).withColumn("confidence", F.round("confidence", 4))
    return long_vector(ev, "entity_id", "group_name", "image_count", "kept_count", "segment", "confidence")


@query("a01_secondary_mean", f"WITH {BUILT_SQL} {long_sql('second', 'entity_id', 'n')}")
def _(spark, sf):
    return long_vector(second_vectors(spark, sf), "entity_id", "n")


# the second space holds fewer samples, and only the first one knows which are valid
SECOND_ELIGIBLE_SQL = f"""{SAMPLES_SQL},
elig AS (SELECT s.entity_id, s.sample_id, s.ord, s.v2, p.group_name, p.quality, p.segment
  FROM (SELECT entity_id, sample_id, ord, v2 FROM samples WHERE sample_id % 11 <> 5) s
  JOIN samples p USING (entity_id, sample_id) WHERE p.is_valid AND coalesce(p.face_count, 1) = 1),
units AS (SELECT *, {unit('v2')} AS u FROM elig)"""
SECOND_BUILT_SQL = BUILT_SQL.replace(ELIGIBLE_SQL, SECOND_ELIGIBLE_SQL)


@query(
    "a07_secondary_vectors",
    f"""WITH {SECOND_BUILT_SQL}, rounded AS (SELECT * REPLACE (round(confidence, 4) AS confidence) FROM ev)
{long_sql('rounded', 'entity_id', 'group_name', 'image_count', 'kept_count', 'segment', 'confidence')}""",
)
def _(spark, sf):
    samples = views.samples(spark, sf)
    secondary = samples.where("sample_id % 11 <> 5").select("entity_id", "sample_id", "ord", "v2")
    built = aggregate.build_second_space_vectors(
        secondary, samples, "v2", D2, MIN_SAMPLES, TRIM, MIN_KEEP, group_map=views.group_map(spark, sf), entity_map=views.entity_map(spark, sf)
    )
    return long_vector(built.withColumn("confidence", F.round("confidence", 4)), "entity_id", "group_name", "image_count", "kept_count", "segment", "confidence")


@query(
    "a15_plain_mean",
    f"""WITH {SAMPLES_SQL}, {mean_cte('c', '(SELECT * FROM samples WHERE is_valid)', 'entity_id', 'v2')}
{long_sql('(SELECT * FROM c WHERE n >= 8)', 'entity_id', 'n')}""",
)
def _(spark, sf):
    out = aggregate.plain_mean(views.samples(spark, sf).where("is_valid"), ["entity_id"], "v2", D2, min_rows=8)
    return long_vector(out, "entity_id", "n")


QUERY_SQL = f"""{BUILT_SQL},
liked AS (SELECT request_id, ev.* FROM requests JOIN ev USING (entity_id)),
{mean_cte('q1', 'liked', 'request_id', 'vector')},
liked2 AS (SELECT request_id, second.vector FROM requests JOIN second USING (entity_id)),
{mean_cte('q2', 'liked2', 'request_id', 'vector')}"""


@query("a10_query_vectors", f"WITH {QUERY_SQL} {long_sql('q1', 'request_id')}")
def _(spark, sf):
    return long_vector(
        score.query_vectors(views.requests(spark, sf), entity_vectors(spark, sf), "vector", D1, "vector"), "request_id"
    )


@query(
    "a09_background_stats",
    f"""WITH {QUERY_SQL}
SELECT request_id, count(*) AS n_background, round(avg(list_dot_product(q1.vector, ev.vector)), 6) AS bg_mean,
       round(stddev_pop(list_dot_product(q1.vector, ev.vector)), 6) AS bg_std
FROM q1, ev GROUP BY 1""",
)
def _(spark, sf):
    ev = stored_entity_vectors(spark, sf)
    queries = score.query_vectors(views.requests(spark, sf), ev, "vector", D1, "q0")
    out = score.background_stats(ev, queries, [("vector", D1)])
    return out.select("request_id", "n_background", F.round("m0", 6).alias("bg_mean"), F.round("s0", 6).alias("bg_std"))


SCORED_SQL = f"""{QUERY_SQL},
s1 AS (SELECT request_id, entity_id, list_dot_product(q1.vector, ev.vector) AS s FROM q1, ev),
z1 AS (SELECT request_id, entity_id, (s - avg(s) OVER w) / stddev_pop(s) OVER w AS z FROM s1 WINDOW w AS (PARTITION BY request_id)),
s2 AS (SELECT request_id, second.entity_id, list_dot_product(q2.vector, second.vector) AS s
       FROM q2, second WHERE second.entity_id IN (SELECT entity_id FROM ev)),
z2 AS (SELECT request_id, entity_id, (s - avg(s) OVER w) / stddev_pop(s) OVER w AS z FROM s2 WINDOW w AS (PARTITION BY request_id)),
allowed AS (
  SELECT request_id, segment FROM (SELECT request_id, segment, count(*) AS c, min(ord) AS o FROM liked WHERE segment <> '' GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY c DESC, o) = 1)"""

RECOMMEND_SQL = f"""{SCORED_SQL},
fused AS (
  SELECT request_id, ev.*, coalesce(a.alias_id, ev.entity_id) AS alias_id, z1.z AS za, z2.z AS zb,
         (z1.z + coalesce(0.5 * z2.z, 0)) / (1.0 + CASE WHEN request_id IN (SELECT request_id FROM q2) THEN 0.5 ELSE 0 END)
           * (0.5 + 0.5 * confidence) AS score
  FROM z1 JOIN ev USING (entity_id) LEFT JOIN z2 USING (request_id, entity_id) LEFT JOIN aliases a USING (entity_id)),
open AS (
  SELECT f.* FROM fused f LEFT JOIN allowed USING (request_id)
  WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.request_id = f.request_id AND r.entity_id = f.entity_id)
    AND f.alias_id NOT IN (SELECT coalesce(a.alias_id, r.entity_id) FROM requests r LEFT JOIN aliases a USING (entity_id)
                           WHERE r.request_id = f.request_id)
    AND image_count >= 5 AND confidence >= 0.02
    AND (allowed.segment IS NULL OR f.segment = '' OR f.segment = allowed.segment)),
deduped AS (SELECT * FROM open QUALIFY row_number() OVER (PARTITION BY request_id, alias_id ORDER BY round(score, 9) DESC, ord) = 1),
pool AS (SELECT * FROM deduped QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, ord) <= 50),
capped AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY request_id, group_name ORDER BY round(score, 9) DESC, ord) <= 2)
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, ord) AS rank, entity_id, group_name, segment,
       image_count, round(score, 6) AS score, round(za, 6) AS score_0, round(zb, 6) AS score_1
FROM capped QUALIFY rank <= 10"""


def walk_sql(lam: float, k: int, cap: int) -> str:
    """Greedy re-rank as a recursion over list state; ``cand(request_id, entity_id, group_name, ord, score, f)``."""
    return f"""pools AS (SELECT request_id, list({{'e': entity_id, 'g': group_name, 'o': ord, 's': score, 'f': f}}) AS pool FROM cand GROUP BY 1),
walk AS (
  SELECT request_id, 0 AS n, [] :: STRUCT(v DOUBLE, o BIGINT, e VARCHAR, g VARCHAR, f DOUBLE[])[] AS chosen FROM pools
  UNION ALL
  SELECT w.request_id, w.n + 1, list_append(w.chosen, list_sort(list_transform(
      list_filter(p.pool, lambda x: NOT list_contains(list_transform(w.chosen, lambda c: c.e), x.e) AND len(list_filter(w.chosen, lambda c: c.g = x.g)) < {cap}),
      lambda x: {{'v': round({lam} * x.s - {1 - lam} * coalesce(list_max(list_transform(w.chosen, lambda c: list_dot_product(c.f, x.f))), 0), 9), 'o': -x.o, 'e': x.e, 'g': x.g, 'f': x.f}}), 'DESC')[1])
  FROM walk w JOIN pools p USING (request_id) WHERE w.n < {k} AND len(list_filter(p.pool,
      lambda x: NOT list_contains(list_transform(w.chosen, lambda c: c.e), x.e) AND len(list_filter(w.chosen, lambda c: c.g = x.g)) < {cap})) > 0),
picked AS (SELECT request_id, unnest(list_transform(chosen, lambda c: c.e)) AS entity_id, unnest(range(1, len(chosen) + 1)) AS rank
  FROM walk QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY n DESC) = 1)"""


ZERO2 = "list_transform(range(0, 32), lambda i: 0.0)"
DIVERSE_SQL = f"""{RECOMMEND_SQL[: RECOMMEND_SQL.index('capped AS')]}
fv AS (SELECT ev.entity_id, list_concat(ev.vector, coalesce(second.vector, {ZERO2})) AS f FROM ev LEFT JOIN second USING (entity_id)),
cand AS (SELECT request_id, pool.entity_id, group_name, ord, score, {unit('fv.f')} AS f FROM pool JOIN fv USING (entity_id)),
{walk_sql(0.6, 10, 2)}
SELECT request_id, picked.rank, entity_id, pool.group_name, pool.segment, pool.image_count, round(pool.score, 6) AS score, round(za, 6) AS score_0, round(zb, 6) AS score_1
FROM picked JOIN pool USING (request_id, entity_id)"""


def shown(df: DataFrame) -> DataFrame:
    return df.select(
        "request_id", "rank", "entity_id", "group_name", "segment", "image_count",
        *[F.round(c, 6).alias(c) for c in df.columns if c.startswith("score")],
    )


def recommend_two_spaces(spark: SparkSession, sf: str, **options) -> DataFrame:
    ev = stored_entity_vectors(spark, sf)
    second = second_vectors(spark, sf).join(ev.select("entity_id"), "entity_id", "left_semi")
    args = dict(
        top_k=10, secondary=second, weights=[1.0, 0.5], max_per_group=2, pool_size=50, min_image_count=5, min_confidence=0.02,
        aliases=views.aliases(spark, sf),
    )
    args.update(options)
    return shown(recommend(ev, views.requests(spark, sf), [D1, D2], **args))


@query("l1_recommend", f"WITH {RECOMMEND_SQL}")
def _(spark, sf):
    return recommend_two_spaces(spark, sf)


@query("l1_recommend_diverse", f"WITH RECURSIVE {DIVERSE_SQL}")
def _(spark, sf):
    return recommend_two_spaces(spark, sf, mmr_lambda=0.6)
