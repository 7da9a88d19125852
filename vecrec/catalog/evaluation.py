"""Queries: evaluation reports and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecrec.catalog import views
from vecrec.catalog.base import mean_cte, query, unit
from vecrec.catalog.vectors import ELIGIBLE_SQL, unit_samples
from vecrec.catalog.views import D1, D2, SAMPLES_SQL
from vecrec.functions import vec
from vecrec.operators import aggregate, curate, evaluate
from vecrec.operators.rank import top_n

# rows scaled by quality so that raw means and unit means differ
SCALED_SQL = f"""{SAMPLES_SQL},
scaled AS (SELECT * REPLACE (list_transform(v1, lambda x: x * (0.5 + quality)) AS v1) FROM samples WHERE is_valid),
su AS (SELECT *, {unit('v1')} AS u FROM scaled),
{mean_cte('sc', 'su', 'entity_id', 'v1')}"""


def scaled_samples(spark, sf):
    rows = views.samples(spark, sf).where("is_valid")
    return rows.withColumn("v1", F.expr(vec.scale_sql("v1", "(0.5D + quality)", D1)))


SUMMARY_SQL = f"""{SCALED_SQL},
pc AS (SELECT a.entity_id, list_dot_product(a.u, b.u) AS c FROM su a JOIN su b ON a.entity_id = b.entity_id AND a.sample_id < b.sample_id),
pairs AS (SELECT entity_id, count(*) AS pair_count, avg(c) AS mean_pairwise_cosine, median(c) AS median_pairwise_cosine,
  min(c) AS min_pairwise_cosine, max(c) AS max_pairwise_cosine FROM pc GROUP BY 1),
cc AS (SELECT su.*, list_dot_product(u, vector) AS c FROM su JOIN sc USING (entity_id)),
cen AS (SELECT entity_id, count(*) AS image_count, max_by(group_name, ord) AS group_name, avg(c) AS mean_centroid_cosine,
  min(c) AS min_centroid_cosine, max(c) AS max_centroid_cosine, arg_min(sample_id, c) AS worst_sample FROM cc GROUP BY 1 HAVING count(*) >= 2),
summary AS (SELECT * FROM cen JOIN pairs USING (entity_id))"""
METRICS = [f"{s}_{k}_cosine" for k in ("pairwise", "centroid") for s in ("mean", "median", "min", "max") if (s, k) != ("median", "centroid")]


@query(
    "a08_similarity_summary",
    f"WITH {SUMMARY_SQL} SELECT entity_id, group_name, image_count, pair_count, worst_sample, "
    + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM summary",
)
def _(spark, sf):
    out = evaluate.similarity_summary(scaled_samples(spark, sf), "v1", D1)
    return out.select("entity_id", "group_name", "image_count", "pair_count", "worst_sample", *[F.round(m, 6).alias(m) for m in METRICS])


@query(
    "a16_overall_report",
    f"WITH {SUMMARY_SQL} " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count(*) AS n_entities, round(avg({m}), 6) AS mean, round(median({m}), 6) AS median FROM summary"
        for m in ("mean_pairwise_cosine", "mean_centroid_cosine", "min_centroid_cosine")
    ),
)
def _(spark, sf):
    out = evaluate.overall_report(evaluate.similarity_summary(scaled_samples(spark, sf), "v1", D1))
    return out.select("metric", "n_entities", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query(
    "w13_lowest_consistency",
    f"WITH {SUMMARY_SQL} SELECT entity_id, round(mean_pairwise_cosine, 6) AS mean_pairwise_cosine FROM summary ORDER BY 2, 1 LIMIT 10",
)
def _(spark, sf):
    units = vec.with_unit(scaled_samples(spark, sf), "v1", "u", D1)
    state = aggregate.moments(units, ["entity_id"], "u", D1).where("n >= 2")
    total = vec.dot_sql("sum_vec", "sum_vec")
    out = state.select("entity_id", F.round(F.expr(f"({total} - sum_sq) / (double(n) * (n - 1))"), 6).alias("mean_pairwise_cosine"))
    return out.orderBy("mean_pairwise_cosine", "entity_id").limit(10)


LOO_SQL = f"""{SCALED_SQL},
el AS (SELECT entity_id FROM su GROUP BY 1 HAVING count(*) >= 2),
pr AS (SELECT su.* FROM su JOIN el USING (entity_id)),
own_d AS (
  SELECT a.sample_id, i, avg(x) AS m FROM pr a JOIN (
    SELECT entity_id, sample_id AS other, unnest(range(1, 33)) AS i, unnest(u) AS x FROM pr) b
  ON a.entity_id = b.entity_id AND a.sample_id <> b.other GROUP BY 1, 2),
own_m AS (SELECT sample_id, list(m ORDER BY i) AS m FROM own_d GROUP BY 1),
own AS (SELECT sample_id, list_dot_product(u, {unit('m')}) AS own FROM own_m JOIN pr USING (sample_id)),
oth AS (SELECT sample_id, max(list_dot_product(u, sc.vector)) AS best_other FROM pr JOIN (SELECT sc.* FROM sc JOIN el USING (entity_id)) sc
  ON pr.entity_id <> sc.entity_id GROUP BY 1),
loo AS (SELECT pr.entity_id, sample_id, own, best_other FROM pr JOIN own USING (sample_id) JOIN oth USING (sample_id))"""


@query(
    "a11_leave_one_out",
    f"WITH {LOO_SQL} SELECT entity_id, sample_id, round(own, 6) AS own, round(best_other, 6) AS best_other FROM loo",
)
def _(spark, sf):
    out = evaluate.leave_one_out(scaled_samples(spark, sf), "v1", D1)
    return out.select("entity_id", "sample_id", F.round("own", 6).alias("own"), F.round("best_other", 6).alias("best_other"))


@query(
    "a11_identification_accuracy",
    f"""WITH {LOO_SQL} SELECT count(DISTINCT entity_id) AS eligible_entities, count(*) AS eligible_samples,
round(avg(CASE WHEN own >= best_other THEN 1.0 ELSE 0.0 END), 6) AS top1_accuracy, round(avg(own), 6) AS mean_own_similarity,
round(avg(best_other), 6) AS mean_best_other_similarity, round(avg(own - best_other), 6) AS mean_margin FROM loo""",
)
def _(spark, sf):
    out = evaluate.leave_one_out_accuracy(scaled_samples(spark, sf), "v1", D1)
    return out.select("eligible_entities", F.col("eligible_samples").cast("bigint").alias("eligible_samples"), *[
        F.round(c, 6).alias(c) for c in ("top1_accuracy", "mean_own_similarity", "mean_best_other_similarity", "mean_margin")
    ])


STEPS = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0)
GRID = [(a, b) for a in STEPS for b in STEPS]
GRID_SQL = f"""{SAMPLES_SQL},
el AS (SELECT entity_id FROM samples WHERE is_valid GROUP BY 1 HAVING count(*) >= 3),
pr AS (SELECT entity_id, sample_id, {unit('v1')} AS a, {unit('v2')} AS b FROM samples JOIN el USING (entity_id) WHERE is_valid),
{mean_cte('ca', 'pr', 'entity_id', 'a')}, {mean_cte('cb', 'pr', 'entity_id', 'b')},
ex AS (SELECT entity_id, sample_id AS other, unnest(range(1, 33)) AS i, unnest(a) AS x, unnest(b) AS y FROM pr),
od AS (SELECT p.sample_id, i, avg(x) AS ma, avg(y) AS mb FROM pr p JOIN ex ON p.entity_id = ex.entity_id AND p.sample_id <> ex.other GROUP BY 1, 2),
om AS (SELECT sample_id, list(ma ORDER BY i) AS ma, list(mb ORDER BY i) AS mb FROM od GROUP BY 1),
own AS (SELECT sample_id, {unit('ma')} AS oa, {unit('mb')} AS ob FROM om),
sims AS (
  SELECT pr.sample_id, pr.entity_id = ca.entity_id AS mine,
         list_dot_product(pr.a, CASE WHEN pr.entity_id = ca.entity_id THEN own.oa ELSE ca.vector END) AS sa,
         list_dot_product(pr.b, CASE WHEN pr.entity_id = ca.entity_id THEN own.ob ELSE cb.vector END) AS sb
  FROM pr JOIN own USING (sample_id) CROSS JOIN ca JOIN cb ON ca.entity_id = cb.entity_id),
z AS (SELECT sample_id, mine, (sa - avg(sa) OVER w) / stddev_pop(sa) OVER w AS za, (sb - avg(sb) OVER w) / stddev_pop(sb) OVER w AS zb
  FROM sims WINDOW w AS (PARTITION BY sample_id)),
steps AS (SELECT unnest({list(STEPS)}) AS w),
cells AS (SELECT a.w::DOUBLE AS w1, b.w::DOUBLE AS w2 FROM steps a CROSS JOIN steps b WHERE NOT (a.w = 0 AND b.w = 0)),
m AS (SELECT sample_id, w1, w2, max(CASE WHEN mine THEN w1*za + w2*zb END) - max(CASE WHEN NOT mine THEN w1*za + w2*zb END) AS margin
  FROM z CROSS JOIN cells GROUP BY 1, 2, 3),
graded AS (SELECT w1, w2, count(*) AS n_probes, round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(margin), 6) AS margin FROM m GROUP BY 1, 2)"""


def graded(spark, sf):
    out = evaluate.fusion_grid(views.samples(spark, sf).where("is_valid"), ("v1", "v2"), (D1, D2), GRID, min_samples=3)
    return out.select("w1", "w2", "n_probes", F.round("accuracy", 6).alias("accuracy"), F.round("margin", 6).alias("margin"))


@query("a12_fusion_grid", f"WITH {GRID_SQL} SELECT * FROM graded")
def _(spark, sf):
    return graded(spark, sf)


@query("w13_best_weights", f"WITH {GRID_SQL} SELECT * FROM graded ORDER BY accuracy DESC, margin DESC, w1, w2 LIMIT 5")
def _(spark, sf):
    return graded(spark, sf).orderBy(F.col("accuracy").desc(), F.col("margin").desc(), "w1", "w2").limit(5)


# ---- curation -------------------------------------------------------------------------------
REFERENCE_SQL = f"""{ELIGIBLE_SQL}, {mean_cte('c', 'units', 'entity_id', 'u')},
refs AS (SELECT entity_id, vector FROM c WHERE entity_id NOT IN (SELECT entity_id FROM samples WHERE entity_no % 9 = 4)),
below AS (SELECT s.*, list_dot_product({unit('v1')}, refs.vector) AS cos FROM samples s JOIN refs USING (entity_id) WHERE is_valid),
marked AS (SELECT * FROM below WHERE cos < 0.3)"""


def marked(spark, sf):
    refs = aggregate.mean_direction(unit_samples(spark, sf), ["entity_id"], "u", D1, normalise_rows=False)
    skip = views.samples(spark, sf).where("entity_no % 9 = 4").select("entity_id").distinct()
    return curate.mark_below_reference(views.samples(spark, sf).where("is_valid"), refs.join(skip, "entity_id", "left_anti"), "v1", D1, 0.3)


@query("f09_below_reference", f"WITH {REFERENCE_SQL} SELECT entity_id, sample_id, round(cos, 6) AS cos FROM marked")
def _(spark, sf):
    return marked(spark, sf).select("entity_id", "sample_id", F.round("cos", 6).alias("cos"))


@query("j03_sample_to_reference", f"WITH {REFERENCE_SQL} SELECT entity_id, sample_id, round(cos, 6) AS cos FROM below")
def _(spark, sf):
    refs = aggregate.mean_direction(unit_samples(spark, sf), ["entity_id"], "u", D1, normalise_rows=False)
    skip = views.samples(spark, sf).where("entity_no % 9 = 4").select("entity_id").distinct()
    out = curate.mark_below_reference(views.samples(spark, sf).where("is_valid"), refs.join(skip, "entity_id", "left_anti"), "v1", D1, 2.0)
    return out.select("entity_id", "sample_id", F.round("cos", 6).alias("cos"))


@query(
    "a18_dry_run",
    f"WITH {REFERENCE_SQL} SELECT entity_id, count(*) AS removed, round(min(cos), 6) AS worst FROM marked GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
)
def _(spark, sf):
    return curate.dry_run(marked(spark, sf), 15).select("entity_id", "removed", F.round("worst", 6).alias("worst"))


@query(
    "a18_dry_run_totals",
    f"""WITH {REFERENCE_SQL} SELECT count(*) AS removed, round(min(cos), 6) AS min_cos, round(max(cos), 6) AS max_cos,
round(median(cos), 6) AS median_cos FROM marked""",
)
def _(spark, sf):
    out = curate.dry_run_totals(marked(spark, sf))
    return out.select("removed", *[F.round(c, 6).alias(c) for c in ("min_cos", "max_cos", "median_cos")])


CURATE_SQL = f"""{SAMPLES_SQL},
ph AS (SELECT *, CASE WHEN NOT is_valid THEN 'invalid_result' WHEN quality < 0.1 THEN 'quality_score<0.10' END AS why FROM samples),
alive AS (SELECT *, {unit('v1')} AS u FROM ph WHERE why IS NULL),
{mean_cte('cen', 'alive', 'entity_id', 'v1')},
sc AS (SELECT alive.*, list_dot_product(u, vector) AS cos, n FROM alive JOIN cen USING (entity_id)),
cut AS (SELECT sample_id FROM sc WHERE cos < 0.35 AND n > 3
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY cos, quality, ord) <= n - 3),
curated AS (SELECT ph.*, sc.cos AS centroid_similarity,
  coalesce(ph.why, CASE WHEN ph.sample_id IN (SELECT sample_id FROM cut) THEN 'centroid_similarity<0.35' END) AS removal_reason
  FROM ph LEFT JOIN sc USING (sample_id))"""


def curated(spark, sf):
    return curate.curate(views.samples(spark, sf), "v1", D1, True, 0.1, 0.35, 3)


@query(
    "l2_curation",
    f"WITH {CURATE_SQL} SELECT sample_id, entity_id, round(centroid_similarity, 6) AS centroid_similarity, removal_reason FROM curated",
)
def _(spark, sf):
    return curated(spark, sf).select("sample_id", "entity_id", F.round("centroid_similarity", 6).alias("centroid_similarity"), "removal_reason")


@query("w07_bounded_removal", f"WITH {CURATE_SQL} SELECT sample_id, entity_id FROM curated WHERE removal_reason LIKE 'centroid%'")
def _(spark, sf):
    return curated(spark, sf).where("removal_reason LIKE 'centroid%'").select("sample_id", "entity_id")


@query(
    "k07_removal_log",
    f"""WITH {CURATE_SQL} SELECT entity_id, group_name, sample_id, is_valid, face_count, quality, round(centroid_similarity, 6) AS centroid_similarity,
removal_reason FROM curated WHERE removal_reason IS NOT NULL""",
)
def _(spark, sf):
    return curate.removal_log(curated(spark, sf)).withColumn("centroid_similarity", F.round("centroid_similarity", 6))


@query("a17_removals_by_reason", f"WITH {CURATE_SQL} SELECT removal_reason, count(*) AS n FROM curated WHERE removal_reason IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return curate.count_by(curate.removal_log(curated(spark, sf)), "removal_reason")


@query("a17_valid_counts", f"WITH {SAMPLES_SQL} SELECT entity_id, count(*) AS n FROM samples WHERE is_valid GROUP BY 1")
def _(spark, sf):
    return curate.valid_counts(views.samples(spark, sf))


REGISTRY_SQL = "reg AS (SELECT DISTINCT concat('e', lpad(CAST(c_custkey % 60 AS VARCHAR), 3, '0')) AS entity_id FROM customer)"


@query(
    "a19_deficit_report",
    f"""WITH {SAMPLES_SQL}, {REGISTRY_SQL}, c AS (SELECT entity_id, count(*) AS n FROM samples WHERE is_valid GROUP BY 1)
SELECT entity_id, coalesce(n, 0) AS n_valid FROM reg LEFT JOIN c USING (entity_id) WHERE coalesce(n, 0) < 9""",
)
def _(spark, sf):
    reg = views.table(spark, sf, "customer").selectExpr("concat('e', lpad(cast(c_custkey % 60 AS string), 3, '0')) AS entity_id").distinct()
    return curate.deficit_report(reg, views.samples(spark, sf), 9)


@query(
    "f03_min_samples",
    f"WITH {SAMPLES_SQL} SELECT entity_id, count(*) AS n FROM samples WHERE is_valid GROUP BY 1 HAVING count(*) >= 10",
)
def _(spark, sf):
    return curate.valid_counts(views.samples(spark, sf)).where("n >= 10")


@query("f01_sample_eligibility", f"WITH {ELIGIBLE_SQL} SELECT sample_id, entity_id FROM elig")
def _(spark, sf):
    return aggregate.eligible_samples(views.samples(spark, sf), 0.05).select("sample_id", "entity_id")


@query(
    "w06_representatives",
    f"""WITH {SAMPLES_SQL}, su AS (SELECT *, {unit('v1')} AS u FROM samples), {mean_cte('c', 'su', 'group_name', 'u')}
SELECT group_name, sample_id, round(list_dot_product(u, vector), 6) AS cos,
       row_number() OVER (PARTITION BY group_name ORDER BY list_dot_product(u, vector) DESC, sample_id) AS rank
FROM su JOIN c USING (group_name) QUALIFY rank <= 5""",
)
def _(spark, sf):
    units = vec.with_unit(views.samples(spark, sf), "v1", "u", D1)
    centre = aggregate.mean_direction(units, ["group_name"], "u", D1, "c", normalise_rows=False)
    scored = units.join(centre.select("group_name", "c"), "group_name").withColumn("cos", vec.dot("u", "c", D1))
    best = top_n(scored, ["group_name"], [F.col("cos").desc(), F.col("sample_id")], 5)
    return best.select("group_name", "sample_id", F.round("cos", 6).alias("cos"), "rank")
