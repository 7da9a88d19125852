"""Queries: pair joins, near-duplicates, admission, graphs and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecrec.catalog import views
from vecrec.catalog.base import query, unit
from vecrec.catalog.vectors import BUILT_SQL, entity_vectors, second_vectors, stored_entity_vectors
from vecrec.catalog.views import D1, MAPS_SQL, SAMPLES_SQL
from vecrec.functions import vec
from vecrec.operators import cluster, dedupe, graph, pairs
from vecrec.plans.cluster_flows import cluster_samples_then_vote, feature_entities
from vecrec.session import cut_lineage

D = 64
PAIR_COS, KNN, NEAR_BITS = 0.3, 5, 24
NODES_SQL = f"""base AS (SELECT vec_id, {unit('CAST(embedding AS DOUBLE[])')} AS v FROM embeddings),
nodes AS (SELECT min(vec_id) AS id, count(*) AS copies, v FROM base GROUP BY v)"""
EDGES_SQL = f"""{NODES_SQL},
sims AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) AS w FROM nodes a JOIN nodes b ON a.id <> b.id),
edges AS (SELECT src, dst, w AS weight FROM sims WHERE src < dst AND w >= {PAIR_COS}),
knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM sims)"""


def nodes(spark, sf):
    rows = views.table(spark, sf, "embeddings").selectExpr("vec_id", "cast(embedding AS array<double>) AS e")
    return pairs.distinct_vectors(vec.with_unit(rows, "e", "v", D).select("vec_id", "v"), "vec_id", "v")


@query("j05_similar_pairs", f"WITH {EDGES_SQL} SELECT src, dst, round(weight, 6) AS weight FROM edges")
def _(spark, sf):
    found = pairs.similar_pairs(nodes(spark, sf)[0], "v", D, PAIR_COS)
    return found.select("src", "dst", F.round("weight", 6).alias("weight"))


@query(
    "j06_knn_graph",
    f"""WITH {EDGES_SQL} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(w), 6) AS weight
FROM knn WHERE r <= {KNN} AND w >= {PAIR_COS} GROUP BY 1, 2""",
)
def _(spark, sf):
    found = pairs.knn_edges(nodes(spark, sf)[0], "v", D, KNN, PAIR_COS)
    return found.select("src", "dst", F.round("weight", 6).alias("weight"))


@query(
    "c09_similarity_graph",
    f"""WITH {EDGES_SQL}, both_ways AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)
SELECT nodes.id, count(dst) AS degree, round(coalesce(sum(weight), 0), 6) AS strength FROM nodes LEFT JOIN both_ways ON id = src GROUP BY 1""",
)
def _(spark, sf):
    table, _ = nodes(spark, sf)
    edges = pairs.similar_pairs(table, "v", D, PAIR_COS)
    links = graph.both_ways(edges, []).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("s"))
    return table.select("id").join(links, "id", "left").select(
        "id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("strength")
    )


# ---- fingerprints ----------------------------------------------------------------------------
FP_SQL = """CAST(list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT)"""
ITEMS_SQL = f"""items AS (
  SELECT concat('g', label) AS entity_id, 2 * vec_id AS id, 2 * vec_id AS ord, {FP_SQL} AS fp FROM embeddings
  UNION ALL
  SELECT concat('g', CASE WHEN vec_id % 10 = 0 THEN (label + 1) % 10 ELSE label END), 2 * (vec_id + 50) + 1, 2 * (vec_id + 50) + 1, {FP_SQL}
  FROM embeddings WHERE vec_id % 5 = 0)"""


def items(spark, sf):
    """Samples plus re-posts of every fifth one (half of them under the next entity), a little later: samples have even ids, re-posts odd ones."""
    e = views.table(spark, sf, "embeddings").withColumn("fp", pairs.sign_fingerprint("embedding", 63))
    first = e.selectExpr("concat('g', label) AS entity_id", "2 * vec_id AS id", "2 * vec_id AS ord", "fp")
    again = e.where("vec_id % 5 = 0").selectExpr(
        "concat('g', CASE WHEN vec_id % 10 = 0 THEN (label + 1) % 10 ELSE label END) AS entity_id", "2 * (vec_id + 50) + 1 AS id", "2 * (vec_id + 50) + 1 AS ord", "fp"
    )
    return first.unionByName(again)


@query(
    "j07_hamming_pairs",
    f"""WITH {ITEMS_SQL} SELECT a.entity_id, a.id AS src, b.id AS dst, bit_count(xor(a.fp, b.fp)) AS distance
FROM items a JOIN items b ON a.entity_id = b.entity_id AND a.ord < b.ord AND bit_count(xor(a.fp, b.fp)) <= 20""".replace(
        "bit_count(xor(a.fp, b.fp)) AS distance", "CAST(bit_count(xor(a.fp, b.fp)) AS INTEGER) AS distance"
    ),
)
def _(spark, sf):
    return pairs.hamming_pairs(items(spark, sf), ["entity_id"], 20)


GREEDY_SQL = f"""{ITEMS_SQL},
numbered AS (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM items),
walk(i, acc, verdict) AS (
  SELECT 0::BIGINT, CAST([] AS STRUCT(e VARCHAR, fp BIGINT)[]), CAST('' AS VARCHAR)
  UNION ALL
  SELECT n.i,
    CASE WHEN v.verdict = 'downloaded' THEN list_append(w.acc, {{'e': n.entity_id, 'fp': n.fp}}) ELSE w.acc END, v.verdict
  FROM walk w JOIN numbered n ON n.i = w.i + 1,
  LATERAL (SELECT CASE
    WHEN len(list_filter(w.acc, lambda x: x.e = n.entity_id AND x.fp = n.fp)) > 0 THEN 'duplicate_sha'
    WHEN len(list_filter(w.acc, lambda x: x.e = n.entity_id AND bit_count(xor(x.fp, n.fp)) <= {NEAR_BITS})) > 0 THEN 'duplicate_phash'
    WHEN len(list_filter(w.acc, lambda x: x.fp = n.fp)) > 0 THEN 'duplicate_crossmember'
    ELSE 'downloaded' END AS verdict) v)"""


@query(
    "l3_admission",
    f"WITH RECURSIVE {GREEDY_SQL} SELECT n.id, n.entity_id, w.verdict AS status FROM walk w JOIN numbered n ON n.i = w.i",
)
def _(spark, sf):
    rows = items(spark, sf).selectExpr(
        "entity_id", "id", "ord", "fp", "concat('u', id) AS url", "md5(cast(fp AS string)) AS digest", "cast(null AS string) AS error"
    )
    return dedupe.admit(rows, rows.select("url").limit(0), None, NEAR_BITS, True).select("id", "entity_id", "status")


QUOTA = 30
CLIPS_SQL = f"""{ITEMS_SQL},
told AS (SELECT *, concat('u', id % 700) AS url, concat('clip ', id % 10) AS title, id % 13 = 5 AS bad FROM items),
fits AS (SELECT * FROM told WHERE NOT (entity_id IN ('g3', 'g5') AND title = 'clip 7') AND (entity_id NOT IN ('g4', 'g5') OR title IN ('clip 1', 'clip 2', 'clip 7', 'clip 8'))),
fresh AS (SELECT * FROM (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY entity_id, url ORDER BY ord) = 1) WHERE CAST(substr(url, 2) AS BIGINT) % 37 <> 0),
good AS (SELECT * FROM fresh WHERE NOT bad)"""


@query(
    "l3_admission_branches",
    "WITH RECURSIVE " + GREEDY_SQL.replace(ITEMS_SQL, CLIPS_SQL).replace("AS i FROM items)", "AS i FROM good)") + f""",
judged AS (SELECT n.id, n.ord, n.entity_id, w.verdict AS status, 3 * CAST(substr(n.entity_id, 2) AS BIGINT) AS have FROM walk w JOIN numbered n ON n.i = w.i),
placed AS (SELECT entity_id, max(ord) AS last, max(seq) AS seq FROM (
  SELECT entity_id, ord, have + row_number() OVER (PARTITION BY entity_id ORDER BY ord) AS seq FROM judged WHERE status = 'downloaded') WHERE seq <= {QUOTA} GROUP BY 1)
SELECT id, entity_id, status FROM judged LEFT JOIN placed USING (entity_id) WHERE have < {QUOTA} AND (coalesce(seq, 0) < {QUOTA} OR ord <= last)
UNION ALL SELECT id, entity_id, 'failed' FROM fresh WHERE bad""",
)
def _(spark, sf):
    """All branches: terms, repeated and seen addresses, failed candidates, entities near and over their quota."""
    rows = items(spark, sf).selectExpr(
        "entity_id", "id", "ord", "fp", "concat('u', id % 700) AS url", "md5(cast(fp AS string)) AS digest", "concat('clip ', id % 10) AS title",
        "if(id % 13 = 5, 'too small', cast(null AS string)) AS error",
    )
    include = F.when(F.col("entity_id").isin("g4", "g5"), F.array(*map(F.lit, ("Clip 1", "clip 2", "clip 7", "clip 8")))).otherwise(F.array().cast("array<string>"))
    exclude = F.when(F.col("entity_id").isin("g3", "g5"), F.array(F.lit("clip 7"))).otherwise(F.array().cast("array<string>"))
    fits = rows.where(dedupe.term_match(F.col("title"), include, exclude)).drop("title")
    seen = rows.select("url").distinct().where("cast(substr(url, 2) as bigint) % 37 = 0")
    have = rows.select("entity_id").distinct().withColumn("n", 3 * F.substring("entity_id", 2, 20).cast("bigint"))
    return dedupe.admit(fits, seen, have, NEAR_BITS, True, QUOTA).select("id", "entity_id", "status")


@query(
    "w12_near_duplicates",
    f"""WITH RECURSIVE {ITEMS_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ord) AS i FROM items),
walk(entity_id, i, acc, ok) AS (
  SELECT DISTINCT entity_id, 0::BIGINT, CAST([] AS BIGINT[]), false FROM items
  UNION ALL
  SELECT n.entity_id, n.i, CASE WHEN v.ok THEN list_append(w.acc, n.fp) ELSE w.acc END, v.ok
  FROM walk w JOIN numbered n ON n.entity_id = w.entity_id AND n.i = w.i + 1,
  LATERAL (SELECT len(list_filter(w.acc, lambda x: bit_count(xor(x, n.fp)) <= {NEAR_BITS})) = 0 AS ok) v)
SELECT n.id, n.entity_id, w.ok AS accepted FROM walk w JOIN numbered n ON n.entity_id = w.entity_id AND n.i = w.i""",
)
def _(spark, sf):
    return dedupe.suppress_near_duplicates(items(spark, sf), "entity_id", NEAR_BITS).select("id", "entity_id", "accepted")


# ---- graph clustering ------------------------------------------------------------------------
# one half-round per step; a settled labelling no longer changes, so all 60 steps can be taken
def propagation_sql(key: str, rounds: int = 30) -> str:
    k = f"{key}, " if key else ""
    on = f"w.{key} = e.{key} AND " if key else ""
    back = f"l.{key} = b.{key} AND " if key else ""
    return f"""twice AS (SELECT {k}src, dst, weight FROM cut UNION ALL SELECT {k}dst, src, weight FROM cut),
spread(step, {k}id, label) AS (
  SELECT 0, {k}id, id FROM start
  UNION ALL
  SELECT l.step + 1, {'l.' + key + ', ' if key else ''}l.id,
    CASE WHEN b.label IS NOT NULL AND ascii(md5(concat(l.id, ':', l.step // 2))) % 2 = l.step % 2 THEN b.label ELSE l.label END
  FROM spread l LEFT JOIN (
    SELECT {k}id, arg_max(label, {{'w': w, 'l': -label}}) AS label FROM (
      SELECT {'e.' + key + ', ' if key else ''}e.src AS id, w.label, round(sum(e.weight), 9) AS w FROM twice e JOIN spread w ON {on}w.id = e.dst GROUP BY ALL)
    GROUP BY ALL) b ON {back}l.id = b.id
  WHERE l.step < {2 * rounds})"""


@query(
    "c10_label_propagation",
    f"""WITH RECURSIVE {EDGES_SQL}, cut AS (SELECT * FROM edges), start AS (SELECT id FROM nodes), {propagation_sql('')}
SELECT id, label, dense_rank() OVER (ORDER BY label) - 1 AS cluster_id FROM spread WHERE step = 60""",
)
def _(spark, sf):
    table, members = nodes(spark, sf)
    labels = graph.propagate_labels(table.select("id", "copies"), pairs.similar_pairs(table, "v", D, PAIR_COS))
    return graph.relabel(members.join(labels.withColumnRenamed("id", "rep"), "rep").select("id", "label")).select("id", "label", "cluster_id")


SCAN = (0.30, 0.32, 0.34, 0.36, 0.38, 0.40)


@query(
    "c11_threshold_scan",
    f"""WITH RECURSIVE {EDGES_SQL}, kept AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(w) AS weight FROM knn WHERE r <= 10 AND w >= {min(SCAN)} GROUP BY 1, 2),
cuts AS (SELECT unnest({list(SCAN)})::DOUBLE AS threshold), cut AS (SELECT threshold, src, dst, weight FROM kept, cuts WHERE weight >= threshold),
start AS (SELECT threshold, id FROM nodes, cuts), {propagation_sql('threshold')},
sizes AS (SELECT threshold, label, count(*) AS n FROM spread WHERE step = 60 GROUP BY 1, 2), total AS (SELECT count(*) AS n, greatest(8, round(sqrt(count(*)))) AS t FROM base),
s AS (SELECT threshold, count(*) AS k, max(sizes.n) AS max_size FROM sizes GROUP BY 1), e AS (SELECT threshold, count(*) AS edges FROM cut GROUP BY 1)
SELECT threshold, edges, k, max_size, round(exp(-((k - t) ** 2) / (2 * (t / 2) ** 2)) * least(1, greatest(20, floor(n / t * 1.5)) / max_size), 6) AS score
FROM s JOIN e USING (threshold), total""",
)
def _(spark, sf):
    table, members = nodes(spark, sf)
    table = cut_lineage(table)
    edges = cut_lineage(pairs.knn_edges(table, "v", D, 10, min(SCAN)))
    scores, _ = graph.threshold_scan(table, members, edges, list(SCAN))
    return scores.select("threshold", "edges", "k", "max_size", F.round("score", 6).alias("score"))


EPS, CORE_K, MIN_SIZE = 0.62, 2, 5
DENSITY_SQL = f"""{EDGES_SQL},
core AS (SELECT src AS id, 1 - w AS core FROM knn WHERE r = {CORE_K}),
reached AS (SELECT src, dst FROM sims JOIN core a ON a.id = src JOIN core b ON b.id = dst
  WHERE greatest(a.core, b.core, 1 - w) <= {EPS}),
closure(src, dst) AS (SELECT id, id FROM nodes UNION SELECT c.src, r.dst FROM closure c JOIN reached r ON c.dst = r.src),
comp AS (SELECT src AS id, min(dst) AS label FROM closure GROUP BY 1),
sized AS (SELECT *, count(*) OVER (PARTITION BY label) AS size FROM comp)"""


def density(spark, sf, eps, sizes):
    table, members = nodes(spark, sf)
    table = cut_lineage(table)
    labels = graph.density_labels(table, "v", D, eps, CORE_K)
    return graph.density_clusters(labels, members, sizes)


@query(
    "c07_density_clusters",
    f"WITH RECURSIVE {DENSITY_SQL} SELECT id, CASE WHEN size >= {MIN_SIZE} THEN label ELSE -1 END AS label FROM sized",
)
def _(spark, sf):
    return density(spark, sf, [EPS], [MIN_SIZE]).select("id", "label")


SCAN_EPS, SCAN_SIZES = [0.58, 0.60, 0.62, 0.64], [2, 3, 5]
DENSITY_SCAN_SQL = f"""{EDGES_SQL},
core AS (SELECT src AS id, 1 - w AS core FROM knn WHERE r = {CORE_K}), lv AS (SELECT unnest({SCAN_EPS})::DOUBLE AS eps),
reached AS (SELECT eps, src, dst FROM sims JOIN core a ON a.id = src JOIN core b ON b.id = dst JOIN lv ON greatest(a.core, b.core, 1 - w) <= eps),
closure(eps, src, dst) AS (SELECT eps, id, id FROM nodes, lv UNION SELECT c.eps, c.src, r.dst FROM closure c JOIN reached r ON c.dst = r.src AND c.eps = r.eps),
comp AS (SELECT eps, src AS id, min(dst) AS label FROM closure GROUP BY 1, 2), sized AS (SELECT *, count(*) OVER (PARTITION BY eps, label) AS size FROM comp),
kept AS (SELECT eps, min_size, id, label, size FROM sized JOIN (SELECT unnest({SCAN_SIZES}) AS min_size) ON size >= min_size),
st AS (SELECT eps, min_size, count(DISTINCT label) AS k, count(*) AS n_kept, max(size) AS max_size FROM kept GROUP BY 1, 2),
to_label AS (SELECT a.eps, a.min_size, a.id, a.label, b.label AS other, avg(sqrt(greatest(0, 2 - 2 * w))) AS d FROM kept a
  JOIN sims ON sims.src = a.id JOIN kept b ON b.eps = a.eps AND b.min_size = a.min_size AND b.id = sims.dst GROUP BY ALL),
sil AS (SELECT eps, min_size, avg((b - a) / greatest(a, b)) AS silhouette FROM (SELECT eps, min_size, id, max(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b
  FROM to_label GROUP BY ALL) GROUP BY 1, 2), total AS (SELECT count(*) AS n FROM base)"""


@query(
    "c08_density_scan",
    f"""WITH RECURSIVE {DENSITY_SCAN_SQL} SELECT eps, min_size, k, max_size, round(1 - n_kept / n, 6) AS noise, round(silhouette, 6) AS silhouette,
round(silhouette * sqrt(n_kept / n) * exp(-((k - 25) ** 2) / (2 * 12.5 ** 2)) * least(1, greatest(50, n * 2 // 25) / max_size), 6) AS score
FROM st JOIN sil USING (eps, min_size), total WHERE k >= 2 AND n_kept >= 20""",
)
def _(spark, sf):
    found = cut_lineage(density(spark, sf, SCAN_EPS, SCAN_SIZES))
    rows = views.table(spark, sf, "embeddings").selectExpr("vec_id", "cast(embedding AS array<double>) AS e")
    scores = cluster.density_scan_scores(found, vec.with_unit(rows, "e", "v", D), "vec_id", "v", 25, "samples")
    return scores.select("eps", "min_size", "k", "max_size", F.round("noise", 6).alias("noise"), F.round("silhouette", 6).alias("silhouette"), F.round("score", 6).alias("score"))


# ---- feature transforms and clustering ---------------------------------------------------------
@query("c01_pca")
def _(spark, sf):
    rows = views.samples(spark, sf).where("is_valid").select("sample_id", "v1")
    out, _ = cluster.pca(rows, "v1", D1, 8)
    return out.select("sample_id", F.posexplode("reduced").alias("dim", "x")).select("sample_id", "dim", F.round("x", 6).alias("x"))


@query(
    "c02_standardise",
    f"""WITH {SAMPLES_SQL},
ex AS (SELECT sample_id, unnest(range(1, 33)) AS i, unnest(v1) AS x FROM samples),
st AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM ex GROUP BY 1)
SELECT sample_id, i AS dim, round((x - m) / CASE WHEN s <= 1e-12 THEN 1 ELSE s END, 6) AS x FROM ex JOIN st USING (i)""",
)
def _(spark, sf):
    out = cluster.standardise(views.samples(spark, sf), "v1", D1)
    return out.select("sample_id", F.posexplode("scaled").alias("dim", "x")).select("sample_id", (F.col("dim") + 1).cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


@query("c03_kmeans")
def _(spark, sf):
    return cluster.kmeans(stored_entity_vectors(spark, sf), "vector", 8).select("entity_id", "cluster_id")


@query(
    "c04_auto_k",
    f"""WITH RECURSIVE {BUILT_SQL}, pts AS (SELECT row_number() OVER (ORDER BY vector) AS i, {unit('vector')} AS u FROM ev),
dd AS (SELECT a.i, b.i AS j, 1 - list_dot_product(a.u, b.u) AS d FROM pts a JOIN pts b ON a.i <> b.i),
link(step, i, g) AS (
  SELECT 0, i, i FROM pts
  UNION ALL
  SELECT l.step + 1, l.i, CASE WHEN l.g = p.m.b THEN p.m.a ELSE l.g END
  FROM link l CROSS JOIN (
    SELECT min({{'d': round(d, 12), 'a': ga, 'b': gb}}) AS m FROM (
      SELECT x.g AS ga, y.g AS gb, avg(dd.d) AS d FROM link x JOIN link y ON x.g < y.g JOIN dd ON dd.i = x.i AND dd.j = y.i GROUP BY ALL) HAVING count(*) > 1) p),
ks AS (SELECT step, count(DISTINCT g) AS k FROM link GROUP BY 1 HAVING count(DISTINCT g) BETWEEN 2 AND 20),
far AS (SELECT a.step, a.i, a.g, b.g AS other, avg(d) AS d FROM link a JOIN ks USING (step) JOIN link b ON a.step = b.step JOIN dd ON dd.i = a.i AND dd.j = b.i GROUP BY ALL),
s AS (SELECT step, i, max(d) FILTER (other = g) AS a, min(d) FILTER (other <> g) AS b FROM far GROUP BY 1, 2)
SELECT k::INT AS k, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s JOIN ks USING (step) GROUP BY 1""",
)
def _(spark, sf):
    rows = stored_entity_vectors(spark, sf).select("entity_id", "vector")
    return cluster.auto_k(rows, "entity_id", "vector", D1, "auto-cosine")[1].withColumn("silhouette", F.round("silhouette", 6))


@query("c05_chosen_k")
def _(spark, sf):
    rows = stored_entity_vectors(spark, sf).select("entity_id", "vector")
    return cluster.choose_k(rows, "vector", D1, 7, 14, 10, "kmeans")[1].withColumn("score", F.round("score", 6))


@query("c06_average_linkage")
def _(spark, sf):
    rows = vec.with_unit(views.samples(spark, sf).where("is_valid"), "v1", "u", D1).select("sample_id", "u")
    return cluster.agglomerate(rows, "u", D1, [8]).select("sample_id", F.get("labels", F.lit(0)).alias("cluster_id"))


LINKAGE_SQL = f"""{BUILT_SQL},
pts AS (SELECT segment, entity_id, row_number() OVER (PARTITION BY segment ORDER BY vector) AS i, {unit('vector')} AS u FROM ev WHERE segment <> ''),
dd AS (SELECT a.segment, a.i, b.i AS j, 1 - list_dot_product(a.u, b.u) AS d FROM pts a JOIN pts b ON a.segment = b.segment),
link(step, segment, i, g) AS (
  SELECT 0, segment, i, i FROM pts
  UNION ALL
  SELECT l.step + 1, l.segment, l.i, CASE WHEN l.g = p.m.b THEN p.m.a ELSE l.g END
  FROM link l JOIN (
    SELECT segment, min({{'d': round(d, 12), 'a': ga, 'b': gb}}) AS m FROM (
      SELECT x.segment, x.g AS ga, y.g AS gb, avg(dd.d) AS d FROM link x JOIN link y ON x.segment = y.segment AND x.g < y.g
      JOIN dd ON dd.segment = x.segment AND dd.i = x.i AND dd.j = y.i GROUP BY ALL) GROUP BY 1 HAVING count(*) > 6) p ON l.segment = p.segment),
cut AS (SELECT * FROM link QUALIFY step = max(step) OVER (PARTITION BY segment))"""


@query(
    "c12_per_segment",
    f"""WITH RECURSIVE {LINKAGE_SQL} SELECT entity_id, segment, dense_rank() OVER (PARTITION BY segment ORDER BY g) - 1 AS cluster_id FROM cut JOIN pts USING (segment, i)""",
)
def _(spark, sf):
    rows = stored_entity_vectors(spark, sf).select("entity_id", "segment", "vector")
    done = cluster.agglomerate(rows.where("segment <> ''"), "vector", D1, [4], within="segment")
    return done.select("entity_id", "segment", F.get("labels", F.lit(0)).alias("cluster_id"))


@query("c13_coordinates")
def _(spark, sf):
    out, _ = cluster.pca(entity_vectors(spark, sf).select("entity_id", "vector"), "vector", D1, 2, unit=False)
    return out.select("entity_id", F.round(F.get("reduced", F.lit(0)), 6).alias("x"), F.round(F.get("reduced", F.lit(1)), 6).alias("y"))


@query("c14_samples_then_vote")
def _(spark, sf):
    rows = views.samples(spark, sf).where("is_valid").select("sample_id", "entity_id", "ord", "v1")
    return cluster_samples_then_vote(rows, "v1", D1, pca_dim=16, eps=[0.35, 0.4, 0.45], min_sizes=[3, 5], k=2, target_k=25).withColumn(
        "consensus", F.round("consensus", 6)
    )


CLUSTERED_SQL = f"{SAMPLES_SQL}, clustered AS (SELECT *, CASE WHEN sample_id % 11 = 0 THEN -1 ELSE (sample_id * 7) % 4 END AS cluster_id FROM samples)"


@query(
    "a13_vote_entities",
    f"""WITH {CLUSTERED_SQL}, c AS (SELECT entity_id, cluster_id, count(*) AS c, min(ord) AS o FROM clustered WHERE cluster_id >= 0 GROUP BY 1, 2),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY c DESC, o) = 1),
t AS (SELECT entity_id, count(*) AS n FROM clustered GROUP BY 1)
SELECT t.entity_id, coalesce(cluster_id, -1) AS cluster_id, coalesce(c, 0) AS majority_count, n AS total_samples,
       round(coalesce(c, 0) / n, 6) AS consensus FROM t LEFT JOIN best USING (entity_id)""",
)
def _(spark, sf):
    rows = views.samples(spark, sf).withColumn("cluster_id", F.expr("CASE WHEN sample_id % 11 = 0 THEN -1 ELSE (sample_id * 7) % 4 END"))
    return cluster.vote_entities(rows).withColumn("consensus", F.round("consensus", 6))


@query(
    "a17_consensus",
    f"""WITH {CLUSTERED_SQL}, c AS (SELECT entity_id, count(*) AS n, max(k) AS k FROM (SELECT entity_id, count(*) FILTER (cluster_id >= 0) OVER (PARTITION BY entity_id, cluster_id) AS k FROM clustered) GROUP BY 1)
SELECT round(min(k / n) FILTER (k > 0), 6) AS min_consensus, round(avg(k / n) FILTER (k > 0), 6) AS mean_consensus, round(max(k / n) FILTER (k > 0), 6) AS max_consensus,
       count(*) AS n_entities, count(*) FILTER (k = 0) AS n_noise FROM c""",
)
def _(spark, sf):
    rows = views.samples(spark, sf).withColumn("cluster_id", F.expr("CASE WHEN sample_id % 11 = 0 THEN -1 ELSE (sample_id * 7) % 4 END"))
    found = cluster.consensus_report(cluster.vote_entities(rows))
    return found.select(*[F.round(c, 6).alias(c) if c.endswith("consensus") else c for c in found.columns])


TYPED_SQL = f"{BUILT_SQL}, typed AS (SELECT *, CAST(substr(entity_id, 2) AS BIGINT) % 4 AS cluster_id FROM ev WHERE segment <> '')"


def typed(spark, sf):
    return entity_vectors(spark, sf).where("segment <> ''").withColumn("cluster_id", F.expr("cast(substr(entity_id, 2) AS bigint) % 4"))


@query(
    "a14_cluster_profile",
    f"""WITH {TYPED_SQL},
g AS (SELECT segment, cluster_id, group_name, count(*) AS n FROM typed GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY segment, cluster_id ORDER BY n DESC, group_name) <= 5),
l AS (SELECT segment, cluster_id, string_agg(concat(group_name, ':', n), ', ' ORDER BY n DESC, group_name) AS top_groups FROM g GROUP BY 1, 2)
SELECT segment, cluster_id, count(*) AS size, round(avg(image_count), 6) AS avg_image_count, round(avg(confidence), 6) AS avg_confidence,
       any_value(top_groups) AS top_groups FROM typed JOIN l USING (segment, cluster_id) GROUP BY 1, 2""",
)
def _(spark, sf):
    out = cluster.cluster_profile(typed(spark, sf), ["segment", "cluster_id"])
    return out.withColumn("avg_image_count", F.round("avg_image_count", 6)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    "a14_first_members",
    f"""WITH {TYPED_SQL} SELECT cluster_id, string_agg(entity_id, ', ' ORDER BY entity_id) AS members FROM (
SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY entity_id) <= 8) GROUP BY 1""",
)
def _(spark, sf):
    return cluster.first_members(typed(spark, sf), ["cluster_id"], "entity_id", "entity_id")


@query(
    "w09_cluster_names",
    f"""WITH {TYPED_SQL}, s AS (SELECT segment, cluster_id, count(*) AS size FROM typed GROUP BY 1, 2)
SELECT segment, cluster_id, size, concat(segment, lpad(CAST(row_number() OVER (PARTITION BY segment ORDER BY size DESC, cluster_id) AS VARCHAR), 2, '0')) AS type_id FROM s""",
)
def _(spark, sf):
    return cluster.name_clusters(typed(spark, sf), "segment")


@query(
    "w03_alias_collapse",
    f"""WITH {BUILT_SQL} SELECT coalesce(alias_id, entity_id) AS alias_id, entity_id FROM ev LEFT JOIN aliases USING (entity_id)
QUALIFY row_number() OVER (PARTITION BY coalesce(alias_id, entity_id) ORDER BY confidence DESC, image_count DESC, entity_id DESC) = 1""",
)
def _(spark, sf):
    return cluster.collapse_aliases(entity_vectors(spark, sf), views.aliases(spark, sf)).select("alias_id", "entity_id")


@query(
    "l8_feature_entities",
    f"""WITH {BUILT_SQL},
f AS (SELECT coalesce(alias_id, ev.entity_id) AS alias_id, ev.entity_id, ev.confidence, image_count,
        list_concat(ev.vector, list_transform(second.vector, lambda x: x * 0.5)) AS f
      FROM ev JOIN second USING (entity_id) LEFT JOIN aliases USING (entity_id) WHERE image_count >= 5 AND confidence >= 0.02
      QUALIFY row_number() OVER (PARTITION BY coalesce(alias_id, ev.entity_id) ORDER BY ev.confidence DESC, image_count DESC, ev.entity_id DESC) = 1)
SELECT alias_id, entity_id, i AS dim, round(x, 6) AS x FROM (
  SELECT alias_id, entity_id, unnest(range(1, 65)) AS i, unnest({unit('f')}) AS x FROM f)""",
)
def _(spark, sf):
    out = feature_entities(
        entity_vectors(spark, sf), second_vectors(spark, sf), views.aliases(spark, sf), mode="both", weight=0.5, min_image_count=5, min_confidence=0.02
    )
    return out.select("alias_id", "entity_id", F.posexplode("feature").alias("dim", "x")).select(
        "alias_id", "entity_id", (F.col("dim") + 1).cast("bigint").alias("dim"), F.round("x", 6).alias("x")
    )
