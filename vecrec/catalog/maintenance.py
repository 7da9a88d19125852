"""Queries: scans, table maintenance, joins, set operations, registry flows, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vecrec.catalog import views
from vecrec.catalog.base import mean_cte, query, unit
from vecrec.catalog.texts import HEADING, LINK, REG_SQL, REGISTRY_SQL, raw_registry, registry
from vecrec.catalog.vectors import (
    BUILT_SQL, RECOMMEND_SQL, SCORED_SQL, entity_vectors, long_sql, long_vector, recommend_two_spaces, second_vectors, stored_entity_vectors, walk_sql,
)
from vecrec.catalog.views import D1, D2, MAPS_SQL, SAMPLES_SQL
from vecrec.functions import text, vec
from vecrec.operators import curate, dedupe, registry as reg, rerank, score
from vecrec.operators.rank import first_per_key, seeded_sample
from vecrec.plans.registry_flows import anchor_log
from vecrec.session import cut_lineage, shared_dir
from vecrec.sources import sinks, tables
from vecrec.streaming import streams


def t(spark, sf, name):
    return views.table(spark, sf, name)


# ---- scans -------------------------------------------------------------------------------------
@query(
    "s01_registry",
    f"WITH {REGISTRY_SQL} SELECT entity_id, group_name, entity_name, search_hint, array_to_string(include_terms, '|') AS include_terms, array_to_string(exclude_terms, '|') AS exclude_terms FROM reg",
)
def _(spark, sf):
    out = registry(spark, sf)
    return out.withColumn("include_terms", F.array_join("include_terms", "|")).withColumn("exclude_terms", F.array_join("exclude_terms", "|"))


RAW_EV_SQL = """raw AS (SELECT vec_id, CASE WHEN vec_id % 19 = 0 THEN ' ' ELSE concat(' m', vec_id) END AS member_id, concat('g', label, ' ') AS group_name, concat('n', vec_id) AS member_name,
  CASE vec_id % 5 WHEN 0 THEN 'many' WHEN 1 THEN NULL ELSE CAST(vec_id % 30 AS VARCHAR) END AS image_count,
  CASE vec_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE CAST(vec_id % 7 / 8.0 AS VARCHAR) END AS confidence, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 'a ' END AS gender,
  CASE vec_id % 6 WHEN 0 THEN '' WHEN 1 THEN '[]' ELSE CAST(to_json(embedding) AS VARCHAR) END AS vector_json,
  CASE vec_id % 9 WHEN 0 THEN 'False' WHEN 1 THEN NULL WHEN 2 THEN ' YES' ELSE 'true' END AS is_valid_face,
  CASE WHEN vec_id % 8 = 0 THEN '?' ELSE CAST(1 + vec_id % 2 AS VARCHAR) END AS face_count, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE CAST((vec_id % 4) / 4.0 AS VARCHAR) END AS quality_score,
  CASE WHEN vec_id % 10 = 3 THEN '' ELSE concat('p/', vec_id, '.jpg') END AS image_path FROM embeddings)"""
_raw_cols = RAW_EV_SQL[len("raw AS (SELECT "):-len(" FROM embeddings)")]


def raw_vectors(spark, sf):
    t(spark, sf, "embeddings").createOrReplaceTempView("__embeddings_raw")
    # decimal text differs between engines ('0.25' and '0.250000'), the parsed numbers do not
    return spark.sql(f"SELECT {_raw_cols.replace('AS VARCHAR', 'AS STRING')} FROM __embeddings_raw")


VEC_SQL = "TRY_CAST(vector_json AS DOUBLE[]) AS v"


@query(
    "s02_entity_vectors",
    f"""WITH {RAW_EV_SQL}, p AS (SELECT *, {VEC_SQL} FROM raw WHERE trim(member_id) <> '' AND vector_json <> '')
SELECT trim(member_id) AS entity_id, trim(group_name) AS group_name, member_name AS entity_name, coalesce(TRY_CAST(image_count AS BIGINT), 0) AS image_count,
round(coalesce(TRY_CAST(confidence AS DOUBLE), 0.5), 6) AS confidence, trim(coalesce(gender, '')) AS segment, round(list_sum(v), 5) AS total FROM p WHERE len(v) > 0""",
)
def _(spark, sf):
    out = tables.typed_entity_vectors(raw_vectors(spark, sf))
    return out.withColumn("total", F.round(F.expr("aggregate(vector, 0D, (s, x) -> s + x)"), 5)).withColumn("confidence", F.round("confidence", 6)).drop("vector")


@query(
    "s03_sample_embeddings",
    f"""WITH {RAW_EV_SQL}, p AS (SELECT *, {VEC_SQL} FROM raw WHERE lower(trim(is_valid_face)) IN ('1', 'true', 'yes', 'y') AND trim(member_id) <> '')
SELECT trim(member_id) AS entity_id, image_path AS sample_path, coalesce(TRY_CAST(face_count AS INTEGER), 1) AS face_count,
round(coalesce(TRY_CAST(quality_score AS DOUBLE), 0), 6) AS quality, len(v) > 0 AND v IS NOT NULL AS has_vector FROM p""",
)
def _(spark, sf):
    out = tables.typed_samples(raw_vectors(spark, sf))
    return out.select("entity_id", "sample_path", "face_count", F.round("quality", 6).alias("quality"), F.col("vector").isNotNull().alias("has_vector"))


@query(
    "s04_secondary_samples",
    f"WITH {RAW_EV_SQL}, p AS (SELECT *, {VEC_SQL} FROM raw) SELECT trim(member_id) AS entity_id, image_path AS sample_path FROM p WHERE trim(member_id) <> '' AND image_path <> '' AND len(v) > 0",
)
def _(spark, sf):
    return tables.typed_secondary(raw_vectors(spark, sf), "vector_json").select("entity_id", "sample_path")


@query(
    "s05_reference_vectors",
    f"""WITH {RAW_EV_SQL}, p AS (SELECT *, {VEC_SQL} FROM (SELECT * REPLACE (trim(group_name) AS group_name) FROM raw) WHERE trim(member_id) <> '')
SELECT group_name AS entity_id, round(list_sum(v), 5) AS total FROM p WHERE len(v) > 0 QUALIFY row_number() OVER (PARTITION BY group_name ORDER BY vec_id DESC) = 1""",
)
def _(spark, sf):
    raw = raw_vectors(spark, sf).where("trim(member_id) <> ''").withColumn("member_id", F.col("group_name"))
    out = tables.typed_references(raw, "vec_id")
    return out.select("entity_id", F.round(F.expr("aggregate(vector, 0D, (s, x) -> s + x)"), 5).alias("total"))


@query(
    "s06_wide_features",
    """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN 'bad' ELSE CAST(l_quantity AS VARCHAR) END AS f1, CAST(l_tax AS VARCHAR) AS f2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round(f1::DOUBLE, 6) AS x1, round(f2::DOUBLE, 6) AS x2 FROM r WHERE TRY_CAST(f1 AS DOUBLE) IS NOT NULL AND TRY_CAST(f2 AS DOUBLE) IS NOT NULL""",
)
def _(spark, sf):
    raw = t(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_linenumber % 5 = 0 THEN 'bad' ELSE cast(l_quantity AS string) END AS f1", "cast(l_tax AS string) AS f2"
    )
    out = tables.typed_features(raw, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *[F.round(F.get("features", F.lit(i)), 6).alias(f"x{i + 1}") for i in range(2)])


@query(
    "s07_aliases",
    """SELECT concat('c', c_custkey) AS entity_id, CASE WHEN c_custkey % 4 = 0 THEN concat('p', c_nationkey) ELSE concat('q', c_nationkey) END AS alias_id FROM customer
WHERE c_custkey % 4 < 2""",
)
def _(spark, sf):
    raw = t(spark, sf, "customer").selectExpr(
        "concat(' c', c_custkey) AS member_id", "CASE WHEN c_custkey % 4 = 0 THEN concat('p', c_nationkey) ELSE ' ' END AS person_id",
        "CASE WHEN c_custkey % 4 < 2 THEN concat('q', c_nationkey) END AS canonical_id",
    )
    return tables.typed_aliases(raw)


SEG_RAW = "CASE n_nationkey % 5 WHEN 0 THEN 'f' WHEN 1 THEN ' M ' WHEN 2 THEN 'coed' WHEN 3 THEN 'x' ELSE '' END"


@query(
    "s08_segment_maps",
    f"""WITH r AS (SELECT n_name, upper(trim({SEG_RAW})) AS s FROM nation) SELECT 'group' AS kind, n_name AS key, s AS segment FROM r WHERE s IN ('F', 'M', 'COED')
UNION ALL SELECT 'entity', n_name, s FROM r WHERE s IN ('F', 'M')""",
)
def _(spark, sf):
    raw = t(spark, sf, "nation").selectExpr("n_name AS k", f"{SEG_RAW} AS gender")
    groups = tables.typed_segment_map(raw, "k", "key", ("F", "M", "COED")).withColumn("kind", F.lit("group"))
    return groups.unionByName(tables.typed_segment_map(raw, "k", "key", ("F", "M")).withColumn("kind", F.lit("entity")))


@query(
    "s09_labels",
    """SELECT concat('c', c_custkey) AS entity_id, concat(c_name, ' x') AS label FROM customer WHERE c_custkey % 6 <> 0""",
)
def _(spark, sf):
    raw = t(spark, sf, "customer").selectExpr("concat('c', c_custkey) AS entity_id", "CASE WHEN c_custkey % 6 = 0 THEN ' \"\" ' ELSE concat('“', c_name, '”   x') END AS ko")
    return tables.typed_labels(raw, "entity_id", "ko")


@query("s10_file_listing")
def _(spark, sf):
    return tables.file_listing(spark, sf, ("parquet",)).select("entity_id", "file_name", "bytes")


MANIFEST_SQL = """manifest AS (SELECT doc_id, concat('http://d/', doc_id % 700) AS source_url, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 17 = 0 THEN 'zz' ELSE substr(sha256(text), 1, 16) END AS phash,
  CASE doc_id % 4 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'duplicate_phash' WHEN 2 THEN 'failed' ELSE 'duplicate_sha' END AS status, source, concat(source, '/', lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0'), '_', substr(sha256(text), 1, 12), '.jpg') AS path FROM documents)"""


def manifest(spark, sf):
    d = t(spark, sf, "documents").withColumn("sha", F.sha2("text", 256))
    return d.selectExpr(
        "doc_id", "concat('http://d/', doc_id % 700) AS source_url", "CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 17 = 0 THEN 'zz' ELSE substr(sha, 1, 16) END AS phash",
        "CASE doc_id % 4 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'duplicate_phash' WHEN 2 THEN 'failed' ELSE 'duplicate_sha' END AS status", "source AS entity_id",
        "concat(source, '/', lpad(cast(doc_id % 1000 AS string), 3, '0'), '_', substr(sha, 1, 12), '.jpg') AS path",
    )


@query(
    "s11_manifest_sets",
    f"""WITH {MANIFEST_SQL} SELECT DISTINCT 'url' AS kind, source_url AS value FROM manifest
UNION ALL SELECT DISTINCT 'fingerprint', phash FROM manifest WHERE status IN ('downloaded', 'duplicate_phash') AND regexp_matches(phash, '^[0-9A-Fa-f]+$')
UNION ALL SELECT DISTINCT 'digest', concat(source, ' ', substr(path, strpos(path, '_') + 1, 12)) FROM manifest""",
)
def _(spark, sf):
    m = manifest(spark, sf)
    urls = tables.seen_urls(m).select(F.lit("url").alias("kind"), F.col("url").alias("value"))
    prints = tables.seen_fingerprints(m).select(F.lit("fingerprint").alias("kind"), F.col("phash").alias("value"))
    digests = tables.seen_digests(m).select(F.lit("digest").alias("kind"), F.concat_ws(" ", "entity_id", "digest").alias("value"))
    return urls.unionByName(prints).unionByName(digests)


@query("s12_group_list", f"WITH {REG_SQL} SELECT DISTINCT trim(group_name) AS group_name FROM regraw")
def _(spark, sf):
    return tables.distinct_values(raw_registry(spark, sf), "group_name", "group_name")


@query("s13_pages", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


# ---- sinks and table maintenance -----------------------------------------------------------------
def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "k01_vector_export",
    f"WITH {BUILT_SQL} SELECT entity_id, image_count, printf('%.4f', confidence) AS confidence, round(list_sum(vector), 6) AS total FROM ev",
)
def _(spark, sf):
    path = scratch(spark, "export")
    sinks.write_report(sinks.export_entity_vectors(entity_vectors(spark, sf)), path, "csv")
    back = tables.read_text_table(spark, path)
    v = vec.parse_vector(F.col("vector_json"))
    return back.select("entity_id", F.col("image_count").cast("bigint").alias("image_count"), "confidence", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("k02_report", f"WITH {SAMPLES_SQL} SELECT entity_id, count(*) AS n FROM samples GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "report")
    sinks.write_report(views.samples(spark, sf).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.parquet(path)


@query(
    "k03_append_evolving",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, '' AS note FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 'new' FROM supplier",
)
def _(spark, sf):
    old = t(spark, sf, "customer").selectExpr("cast(c_custkey AS string) AS id", "c_name AS name", "c_mktsegment AS gone")
    new = t(spark, sf, "supplier").selectExpr("cast(s_suppkey AS string) AS id", "s_name AS name", "'new' AS note")
    return sinks.append_evolving(old, new, ["id", "name", "note"])


OLD, NEW = "o_orderkey % 3 <> 0", "o_orderkey % 2 = 0"


@query("k04_append_missing", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {NEW} AND NOT ({OLD})")
def _(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sinks.append_missing(o.where(OLD), o.where(NEW), "o_orderkey")


@query(
    "k05_overwrite_entities",
    """SELECT o_custkey AS entity_id, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 4 <> 1
UNION ALL SELECT o_custkey, o_orderkey, 0.0 FROM orders WHERE o_custkey % 4 = 1 AND o_orderkey % 2 = 0""",
)
def _(spark, sf):
    o = t(spark, sf, "orders").selectExpr("o_custkey AS entity_id", "o_orderkey", "o_totalprice")
    new = o.where("entity_id % 4 = 1 AND o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0))
    return sinks.overwrite_entities(o, new, o.where("entity_id % 4 = 1").select("entity_id"))


@query(
    "k06_keyed_update",
    f"""WITH {SAMPLES_SQL} SELECT sample_id, entity_id, is_valid AND quality >= 0.3 AS is_valid, CASE WHEN quality >= 0.3 THEN 32 ELSE 0 END AS dim,
CASE WHEN quality < 0.3 THEN 'curated' ELSE 'kept' END AS status FROM samples""",
)
def _(spark, sf):
    s = views.samples(spark, sf).withColumn("status", F.lit("kept"))
    changes = {"is_valid": F.lit(False), "v1": F.lit(None), "status": F.lit("curated")}
    out = sinks.update_keyed(s, s.where("quality < 0.3"), ["entity_id", "sample_id"], changes)
    return out.select("sample_id", "entity_id", "is_valid", F.coalesce(F.size("v1"), F.lit(0)).alias("dim"), "status").withColumn("dim", F.greatest("dim", F.lit(0)))


@query("k06_keyed_delete", f"WITH {SAMPLES_SQL} SELECT sample_id FROM samples WHERE quality >= 0.3")
def _(spark, sf):
    s = views.samples(spark, sf)
    return sinks.delete_keyed(s, s.where("quality < 0.3"), ["entity_id", "sample_id"]).select("sample_id")


# ---- joins -----------------------------------------------------------------------------------------
@query(
    "j01_paired_spaces",
    f"WITH {SAMPLES_SQL} SELECT a.entity_id, a.sample_id, round(a.v1[1], 6) AS x, round(b.v2[1], 6) AS y FROM samples a JOIN samples b ON a.entity_id = b.entity_id AND a.sample_id = b.sample_id WHERE a.is_valid AND b.sample_id % 4 > 0",
)
def _(spark, sf):
    s = views.samples(spark, sf)
    a, b = s.where("is_valid").select("entity_id", "sample_id", "v1"), s.where("sample_id % 4 > 0").select("entity_id", "sample_id", "v2")
    return a.join(b, ["entity_id", "sample_id"]).select("entity_id", "sample_id", F.round(F.get("v1", F.lit(0)), 6).alias("x"), F.round(F.get("v2", F.lit(0)), 6).alias("y"))


@query(
    "j02_lookup_fallback",
    f"WITH {SAMPLES_SQL}, {MAPS_SQL} SELECT sample_id, coalesce(alias_id, s.entity_id) AS alias_id, coalesce(g.segment, s.segment) AS segment FROM samples s LEFT JOIN aliases a ON s.entity_id = a.entity_id LEFT JOIN group_map g ON s.group_name = g.group_name",
)
def _(spark, sf):
    s = views.samples(spark, sf)
    s = s.join(views.aliases(spark, sf), "entity_id", "left").join(views.group_map(spark, sf).withColumnRenamed("segment", "given"), "group_name", "left")
    return s.select("sample_id", F.coalesce("alias_id", "entity_id").alias("alias_id"), F.coalesce("given", "segment").alias("segment"))


@query(
    "j04_query_to_entities",
    f"""WITH {SCORED_SQL} SELECT request_id, entity_id, round(s, 6) AS s, row_number() OVER (PARTITION BY request_id ORDER BY round(s, 9) DESC, entity_id) AS rank FROM s1 QUALIFY rank <= 20""",
)
def _(spark, sf):
    ev = stored_entity_vectors(spark, sf)
    queries = score.query_vectors(views.requests(spark, sf), ev, "vector", D1)
    return score.best_cosines(ev, queries, "vector", D1, 20).withColumn("s", F.round("s", 6))


@query(
    "j08_anti_joins",
    f"WITH {SAMPLES_SQL}, {MAPS_SQL} SELECT DISTINCT entity_id FROM samples WHERE entity_id NOT IN (SELECT entity_id FROM requests)",
)
def _(spark, sf):
    return views.samples(spark, sf).select("entity_id").distinct().join(views.requests(spark, sf).select("entity_id"), "entity_id", "left_anti")


@query("j09_unreferenced_files")
def _(spark, sf):
    files = tables.file_listing(spark, sf, ("parquet",))
    used = files.join(t(spark, sf, "region").selectExpr("concat(lower(r_name), '.parquet') AS file_name"), "file_name", "left_semi")
    return tables.prune_totals(tables.unreferenced_files(files, used))


@query(
    "j10_preceding_link",
    f"""WITH tok AS (SELECT page_id, unnest(range(0, len(h))) AS i, unnest(h) AS item, unnest(l) AS url FROM (
  SELECT page_id, regexp_extract_all(html, '{HEADING}|href="([^"]*)"', 1) AS h, regexp_extract_all(html, '{HEADING}|href="([^"]*)"', 2) AS l FROM pages)),
r AS (SELECT *, last_value(CASE WHEN url <> '' AND NOT contains(lower(url), 'the') THEN url END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS prev FROM tok)
SELECT page_id, trim(item) AS item, prev AS url FROM r WHERE trim(item) <> '' AND prev IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, trim(item) ORDER BY i) = 1""",
)
def _(spark, sf):
    pairs = reg.preceding_links(F.col("html"), HEADING, 'href="([^"]*)"', ("the",))
    return t(spark, sf, "pages").select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.item", "p.url")


LISTED_SQL = f"""lst AS (SELECT concat('g', page_id) AS group_name, i AS pos, name, local FROM (SELECT page_id, unnest(range(0, len(n))) AS i, unnest(n) AS name, unnest(l) AS local FROM (
  SELECT page_id, regexp_extract_all(html, '{LINK}', 2) AS n, regexp_extract_all(html, '{LINK}', 1) AS l FROM pages)) WHERE trim(name) <> ''),
people AS (SELECT concat(group_name, '-', pos) AS entity_id, group_name, CASE pos % 4 WHEN 0 THEN concat(' ', name, '.') WHEN 1 THEN concat('Ahn ', name) WHEN 2 THEN substr(name, 1, length(name) - 1) ELSE concat(name, 'zz') END AS entity_name FROM lst),
forms AS (SELECT p.*, l.name, l.local, l.pos, lower(regexp_replace(l.name, '[\\s\\-.]', '', 'g')) AS f, lower(regexp_replace(list_last(regexp_split_to_array(trim(l.name), '\\s+')), '[\\s\\-.]', '', 'g')) AS fl,
  lower(regexp_replace(p.entity_name, '[\\s\\-.]', '', 'g')) AS tg, lower(regexp_replace(list_last(regexp_split_to_array(trim(p.entity_name), '\\s+')), '[\\s\\-.]', '', 'g')) AS tl FROM people p JOIN lst l USING (group_name)),
tiers AS (SELECT *, CASE WHEN f = tg AND f <> '' THEN 1 WHEN fl = tg AND fl <> '' THEN 2 WHEN f = tl AND f <> '' THEN 3 WHEN f <> '' AND tg <> '' AND (contains(f, tg) OR contains(tg, f)) THEN 4 END AS tier FROM forms),
matched AS (SELECT * FROM tiers WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY tier, pos) = 1)"""


def people(spark, sf):
    found = t(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("n"), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("l"))
    listed = found.select(F.concat(F.lit("g"), "page_id").alias("group_name"), F.posexplode(F.arrays_zip("n", "l")).alias("pos", "z"))
    listed = listed.select("group_name", "pos", F.col("z.n").alias("name"), F.col("z.l").alias("local")).where("trim(name) <> ''")
    rows = listed.selectExpr(
        "concat(group_name, '-', pos) AS entity_id", "group_name",
        "CASE pos % 4 WHEN 0 THEN concat(' ', name, '.') WHEN 1 THEN concat('Ahn ', name) WHEN 2 THEN substr(name, 1, length(name) - 1) ELSE concat(name, 'zz') END AS entity_name",
    )
    return rows, listed


@query("j11_name_match", f"WITH {LISTED_SQL} SELECT entity_id, tier, name AS new_name FROM matched")
def _(spark, sf):
    return reg.match_names(*people(spark, sf)).select("entity_id", "tier", "new_name")


HINT = "concat('G ', entity_name, ' 얼굴')"


@query(
    "j13_registry_diff",
    f"""WITH {LISTED_SQL}, h AS (SELECT *, {HINT} AS hint, list_last(regexp_split_to_array(trim(concat('G ', entity_name)), '\\s+')) AS old FROM matched),
n AS (SELECT *, CASE WHEN local <> '' AND old <> '' AND instr(hint, old) > 0 THEN concat(substr(hint, 1, instr(hint, old) - 1), local, substr(hint, instr(hint, old) + length(old))) ELSE hint END AS new_hint FROM h)
SELECT entity_id, entity_name AS old_entity_name, CASE WHEN f <> tg THEN name ELSE entity_name END AS new_entity_name, hint AS old_search_hint, new_hint AS new_search_hint FROM n WHERE f <> tg OR new_hint <> hint""",
)
def _(spark, sf):
    return reg.name_changes(reg.match_names(*people(spark, sf)).withColumn("search_hint", F.expr(HINT)))


GROUP_HINT = "concat(group_name, ' ', entity_name, ' 얼굴')"


@query(
    "j13_group_swap",
    f"""WITH {LISTED_SQL}, h AS (SELECT *, {GROUP_HINT} AS hint, list_last(regexp_split_to_array(trim(concat(group_name, ' ', entity_name)), '\\s+')) AS old,
  CASE CAST(substr(group_name, 2) AS BIGINT) % 3 WHEN 0 THEN '한글 팀' WHEN 1 THEN '가-나' ELSE '' END AS gl FROM matched),
n0 AS (SELECT *, CASE WHEN local <> '' AND old <> '' AND instr(hint, old) > 0 THEN concat(substr(hint, 1, instr(hint, old) - 1), local, substr(hint, instr(hint, old) + length(old))) ELSE hint END AS h0 FROM h),
n AS (SELECT *, CASE WHEN gl <> '' THEN replace(h0, group_name, gl) ELSE h0 END AS new_hint FROM n0)
SELECT entity_id, entity_name AS old_entity_name, CASE WHEN f <> tg THEN name ELSE entity_name END AS new_entity_name, hint AS old_search_hint, new_hint AS new_search_hint FROM n WHERE f <> tg OR new_hint <> hint""",
)
def _(spark, sf):
    from vecrec.catalog.texts import GROUP_INTRO

    groups = t(spark, sf, "pages").select(F.concat(F.lit("g"), "page_id").alias("group_name"), text.group_local(F.expr(GROUP_INTRO)).alias("group_local"))
    matched = reg.match_names(*people(spark, sf)).join(groups.hint("merge"), "group_name", "left")  # a row per page: not to be broadcast
    return reg.name_changes(matched.withColumn("search_hint", F.expr(GROUP_HINT)))


PAGE_KEY = "regexp_extract(url, '/([a-z]{2}/[0-9]+)', 1)"
INTAKE_HTML = """concat('<p>', CASE page_id % 9 WHEN 0 THEN 'now disbanded' WHEN 1 THEN 'a virtual idol group' WHEN 2 THEN 'a project group' WHEN 3 THEN 'sub-unit of y' ELSE '' END,
 CASE page_id % 4 WHEN 0 THEN ' Debut Date: 2030.1.2 ' WHEN 1 THEN ' Debut Date: May 3, 2019 ' ELSE '' END, '</p>', CASE WHEN page_id % 5 = 0 THEN replace(html, 'href', 'ref') ELSE html END)"""
GROUPS_SQL = f"""keyed AS (SELECT page_id, {PAGE_KEY} AS url_key, html FROM pages),
grp AS (SELECT c_custkey, concat('Grp ', c_custkey) AS group_name, 2015 + c_custkey % 15 AS debut_year FROM customer),
cand AS (SELECT group_name, unnest(range(0, 4)) AS pos, unnest([concat('fr/', c_custkey), concat('en/', c_custkey), concat('de/', c_custkey), concat('es/', c_custkey)]) AS url_key FROM grp),
page AS (SELECT group_name, pos, page_id, url_key FROM cand JOIN keyed USING (url_key) WHERE contains(html, 'article') QUALIFY row_number() OVER (PARTITION BY group_name ORDER BY pos, page_id) = 1)"""


def page_groups(spark, sf):
    groups = t(spark, sf, "customer").selectExpr(
        "c_custkey", "concat('Grp ', c_custkey) AS group_name", "2015 + c_custkey % 15 AS debut_year", "array(concat('fr/', c_custkey), concat('en/', c_custkey), concat('de/', c_custkey), concat('es/', c_custkey)) AS candidates"
    )
    return groups, t(spark, sf, "pages").withColumn("url_key", F.expr(PAGE_KEY))


@query("j14_first_page", f"WITH {GROUPS_SQL} SELECT group_name, pos::INT AS pos, page_id, url_key FROM page")
def _(spark, sf):
    groups, pages = page_groups(spark, sf)
    return reg.first_existing_page(groups, pages, "group_name", "url_key", "article")


INTAKE_SQL = f"""{GROUPS_SQL},
facts AS (SELECT grp.*, page.page_id, CASE page_id % 4 WHEN 0 THEN DATE '2030-01-02' WHEN 1 THEN DATE '2019-05-03' END AS debut FROM grp LEFT JOIN page USING (group_name)),
st AS (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN 'skip_existing' WHEN c_custkey % 13 = 0 THEN 'blacklisted' WHEN page_id IS NULL THEN 'not_found'
  WHEN page_id % 9 = 0 THEN 'disbanded' WHEN page_id % 9 = 1 THEN 'virtual' WHEN page_id % 9 = 2 THEN 'project' WHEN page_id % 9 = 3 THEN 'unit'
  WHEN debut > DATE '2026-04-23' THEN 'not_debuted' WHEN debut IS NULL AND debut_year > 2026 THEN 'not_debuted' WHEN page_id % 5 = 0 THEN 'no_members' ELSE 'added' END AS status FROM facts)"""


def intake(spark, sf):
    groups, pages = page_groups(spark, sf)
    pages = pages.withColumn("html", F.expr(INTAKE_HTML))
    members = text.field_pairs(F.col("html"), LINK, "<nothing>(x)", None, 2, 1)
    return reg.intake_status(
        groups, pages, groups.where("c_custkey % 10 = 0"), groups.where("c_custkey % 13 = 0"), "2026-04-23", members, "url_key", "article"
    )


@query("l4_intake_status", f"WITH {INTAKE_SQL} SELECT group_name, status, coalesce(page_id, -1) AS page_id, CAST(debut AS VARCHAR) AS debut FROM st")
def _(spark, sf):
    return intake(spark, sf).select("group_name", "status", F.coalesce("page_id", F.lit(-1)).cast("bigint").alias("page_id"), F.col("debut").cast("string").alias("debut"))


@query("a17_status_counts", f"WITH {INTAKE_SQL} SELECT status, count(*) AS n FROM st GROUP BY 1")
def _(spark, sf):
    return curate.count_by(intake(spark, sf), "status")


def _slug_sql(c):
    return f"coalesce(nullif(trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')"


@query(
    "l4_intake_rows",
    f"""WITH {INTAKE_SQL}, lst AS (SELECT page_id, unnest(range(0, len(n))) AS i, trim(unnest(n)) AS name, trim(unnest(l)) AS local FROM (
  SELECT page_id, regexp_extract_all(html, '{LINK}', 2) AS n, regexp_extract_all(html, '{LINK}', 1) AS l FROM pages)),
m AS (SELECT page_id, name, local FROM lst WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY page_id, name ORDER BY i) = 1),
r AS (SELECT concat({_slug_sql('group_name')}, '__', {_slug_sql('name')}) AS entity_id, group_name, name, concat('"', group_name, '" ', CASE WHEN local <> '' THEN local ELSE name END) AS search_hint FROM st JOIN m USING (page_id) WHERE status = 'added')
SELECT entity_id, group_name, name AS entity_name, search_hint FROM r QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY group_name, name, search_hint) = 1""",
)
def _(spark, sf):
    known = t(spark, sf, "supplier").selectExpr("concat('s', s_suppkey) AS entity_id")
    return reg.intake_rows(intake(spark, sf), known)


@query(
    "l5_precedence",
    """SELECT n_name AS group_name, CASE WHEN n_nationkey % 5 = 0 THEN 'A' WHEN n_nationkey % 7 = 1 THEN 'B' WHEN n_nationkey % 3 = 1 THEN 'A' ELSE '' END AS segment,
CASE WHEN n_nationkey % 5 = 0 THEN 'cached' WHEN n_nationkey % 7 = 1 THEN 'manual_override' WHEN n_nationkey % 3 = 1 THEN 'downloaded' WHEN n_nationkey % 3 = 0 THEN 'ambiguous' ELSE 'fetch_fail' END AS status FROM nation""",
)
def _(spark, sf):
    n = t(spark, sf, "nation").withColumnRenamed("n_name", "group_name")
    pick = lambda cond, value: n.where(cond).selectExpr("group_name", f"{value} AS segment")
    derived = pick("n_nationkey % 3 < 2", "CASE WHEN n_nationkey % 3 = 1 THEN 'A' ELSE '' END")
    return reg.resolve_precedence(n, pick("n_nationkey % 5 = 0", "'A'"), pick("n_nationkey % 7 = 1", "'B'"), derived)


ANCHOR_SQL = f"""heads AS (SELECT page_id, regexp_extract(html, '{HEADING}', 1) AS h, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links, strpos(html, '<h1>') AS h_at, html FROM pages),
prev AS (SELECT page_id, h, list_last(regexp_extract_all(substr(html, 1, h_at), 'href="([^"]*)"', 1)) AS url FROM heads),
who AS (SELECT page_id, url, concat('a', page_id) AS entity_id, trim(h) AS h, CASE page_id % 3 WHEN 0 THEN h WHEN 1 THEN substr(h, 1, 10) ELSE 'qqq' END AS nm FROM prev)"""


@query(
    "l6_anchor_mapping",
    f"""WITH {ANCHOR_SQL}, f AS (SELECT *, regexp_replace(lower(h), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(nm), '[^a-z0-9]', '', 'g') AS b FROM who),
s AS (SELECT *, CASE WHEN page_id % 6 = 5 THEN 'group_page_fail' WHEN page_id % 11 = 0 THEN 'cached' WHEN url IS NULL OR a = '' OR b = '' OR NOT (starts_with(a, b) OR starts_with(b, a)) THEN 'no_match' ELSE 'ok' END AS status FROM f)
SELECT entity_id, CASE WHEN status = 'ok' THEN url ELSE '' END AS source_url, status FROM s""",
)
def _(spark, sf):
    pages = t(spark, sf, "pages")
    h = F.regexp_extract("html", HEADING, 1)
    name = F.when(F.col("page_id") % 3 == 0, h).when(F.col("page_id") % 3 == 1, F.substring(h, 1, 10)).otherwise("qqq")
    who = pages.select(F.concat(F.lit("a"), "page_id").alias("entity_id"), F.concat(F.lit("g"), "page_id").alias("group_name"), name.alias("entity_name"))
    fetched = pages.where("page_id % 6 <> 5").select(F.concat(F.lit("g"), "page_id").alias("group_name"), "html")
    cached = pages.where("page_id % 11 = 0").select(F.concat(F.lit("a"), "page_id").alias("entity_id"))
    return anchor_log(who, fetched, cached, HEADING, 'href="([^"]*)"')


PROGRESS_SQL = """ids AS (SELECT concat('u', c_custkey) AS entity_id FROM customer),
b AS (SELECT concat('u', user_id) AS entity_id, count(*) AS n FROM events WHERE {before} GROUP BY 1),
a AS (SELECT concat('u', user_id) AS entity_id, count(*) AS n FROM events GROUP BY 1)
SELECT ids.entity_id, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(a.n, 0) < {m} AS still_short, coalesce(a.n, 0) <= coalesce(b.n, 0) AS given_up
FROM ids LEFT JOIN b USING (entity_id) LEFT JOIN a USING (entity_id) WHERE coalesce(b.n, 0) < {m}"""


@query("l7_round_progress", "WITH " + PROGRESS_SQL.format(before="ts < TIMESTAMP '2024-01-20'", m=60))
def _(spark, sf):
    ids = t(spark, sf, "customer").selectExpr("concat('u', c_custkey) AS entity_id")
    e = t(spark, sf, "events").withColumn("entity_id", F.concat(F.lit("u"), "user_id"))
    count = lambda df: df.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    before, after = count(e.where("ts < TIMESTAMP '2024-01-20'")), count(e)
    lacking = ids.join(before.where("n >= 60"), "entity_id", "left_anti")
    return reg.round_progress(lacking, before, after, 60)


@query(
    "j12_score_fusion",
    f"""WITH {SCORED_SQL} SELECT z1.request_id, ev.entity_id, round((z1.z + coalesce(0.5 * z2.z, 0)) / 1.5, 6) AS score, round(z1.z, 6) AS score_0, round(z2.z, 6) AS score_1
FROM ev JOIN z1 ON z1.entity_id = ev.entity_id LEFT JOIN z2 ON z2.entity_id = ev.entity_id AND z2.request_id = z1.request_id""",
)
def _(spark, sf):
    ev = stored_entity_vectors(spark, sf)
    second = cut_lineage(second_vectors(spark, sf).join(ev.select("entity_id"), "entity_id", "left_semi"))
    spaces = [score.space_zscores(df, views.requests(spark, sf), "vector", dim) for df, dim in ((ev, D1), (second, D2))]
    asked = spaces[0].select("request_id", "entity_id")
    out = score.fuse_scores(asked, spaces, [1.0, 0.5], ["request_id", "entity_id"])
    return out.select("request_id", "entity_id", *[F.round(c, 6).alias(c) for c in ("score", "score_0", "score_1")])


# ---- sets --------------------------------------------------------------------------------------------
@query(
    "u01_space_union",
    f"""WITH {BUILT_SQL} SELECT 'primary' AS space, count(*) AS n, round(sum(list_sum(vector)), 5) AS total FROM ev UNION ALL SELECT 'secondary', count(*), round(sum(list_sum(vector)), 5) FROM second""",
)
def _(spark, sf):
    a = entity_vectors(spark, sf).select(F.lit("primary").alias("space"), "vector")
    b = second_vectors(spark, sf).select(F.lit("secondary").alias("space"), "vector")
    total = F.sum(F.expr("aggregate(vector, 0D, (s, x) -> s + x)"))
    return a.unionByName(b).groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.round(total, 5).alias("total"))


@query("u02_append", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(spark, sf):
    return t(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name").unionByName(t(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name"))


@query("u03_distinct_ids", "SELECT DISTINCT source AS entity_id FROM documents")
def _(spark, sf):
    return tables.distinct_values(t(spark, sf, "documents"), "source", "entity_id")


@query("u04_difference", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)")
def _(spark, sf):
    gone = t(spark, sf, "customer").where("c_acctbal < 5000").select(F.col("c_custkey").alias("id"))
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct().join(gone, "id", "left_anti")


# ---- ranking -------------------------------------------------------------------------------------------
def plain_scores(spark, sf):
    """Per-request z-scores with the labels the ranking steps need."""
    ev = stored_entity_vectors(spark, sf)
    rows = score.space_zscores(ev, views.requests(spark, sf), "vector", D1).withColumnRenamed("z", "score")
    rows = rows.join(ev.select("entity_id", "group_name", "ord"), "entity_id").join(views.aliases(spark, sf), "entity_id", "left")
    return rows.withColumn("alias_id", F.coalesce("alias_id", "entity_id"))


PLAIN_SQL = f"{SCORED_SQL}, ps AS (SELECT request_id, ev.entity_id, group_name, ord, z AS score, coalesce(alias_id, ev.entity_id) AS alias_id FROM z1 JOIN ev USING (entity_id) LEFT JOIN aliases USING (entity_id))"


@query(
    "w01_top_k",
    f"WITH {PLAIN_SQL} SELECT request_id, entity_id, round(score, 6) AS score, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, ord) AS rank FROM ps QUALIFY rank <= 12",
)
def _(spark, sf):
    return rerank.top_k(plain_scores(spark, sf), 12).select("request_id", "entity_id", F.round("score", 6).alias("score"), "rank")


@query(
    "w02_alias_dedupe",
    f"""WITH {PLAIN_SQL}, la AS (SELECT DISTINCT request_id, coalesce(alias_id, entity_id) AS alias_id FROM requests LEFT JOIN aliases USING (entity_id))
SELECT request_id, entity_id, alias_id FROM ps WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.request_id = ps.request_id AND la.alias_id = ps.alias_id)
QUALIFY row_number() OVER (PARTITION BY request_id, alias_id ORDER BY round(score, 9) DESC, ord) = 1""",
)
def _(spark, sf):
    liked = views.requests(spark, sf).join(views.aliases(spark, sf), "entity_id", "left").select("request_id", F.coalesce("alias_id", "entity_id").alias("alias_id")).distinct()
    return rerank.dedupe_aliases(rerank.drop_liked_aliases(plain_scores(spark, sf), liked)).select("request_id", "entity_id", "alias_id")


@query(
    "w04_group_cap",
    f"""WITH {PLAIN_SQL}, c AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY request_id, group_name ORDER BY round(score, 9) DESC, ord) <= 1)
SELECT request_id, entity_id, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, ord) AS rank FROM c QUALIFY rank <= 6""",
)
def _(spark, sf):
    return rerank.top_k(rerank.cap_groups(plain_scores(spark, sf), 1), 6).select("request_id", "entity_id", "rank")


@query(
    "w05_diversity",
    f"""WITH RECURSIVE {PLAIN_SQL}, best AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, ord) <= 50),
cand AS (SELECT request_id, entity_id, best.group_name, best.ord, score, ev.vector AS f FROM best JOIN ev USING (entity_id)),
{walk_sql(0.5, 10, 2)} SELECT request_id, entity_id, rank FROM picked""",
)
def _(spark, sf):
    ev = stored_entity_vectors(spark, sf)
    pool = rerank.top_k(plain_scores(spark, sf), 50).drop("rank").join(ev.select("entity_id", "vector"), "entity_id")
    return rerank.diversify(pool, [("vector", D1)], 0.5, 10, 2)


@query(
    "w10_first_occurrence",
    """WITH l AS (SELECT page_id, unnest(range(0, len(u))) AS i, unnest(u) AS url FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS u FROM pages))
SELECT url, page_id, i::INT AS pos FROM l QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, i) = 1""",
)
def _(spark, sf):
    links = t(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "url"))
    return first_per_key(links, ["url"], [F.col("page_id"), F.col("pos")]).select("url", "page_id", "pos")


@query(
    "w11_quota_numbers",
    """WITH n AS (SELECT source AS entity_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) + CASE WHEN source IN ('src1', 'src2') THEN 7 ELSE 0 END AS seq FROM documents)
SELECT entity_id, doc_id, seq, lpad(CAST(seq AS VARCHAR), 3, '0') AS seq_text FROM n WHERE seq <= 40""",
)
def _(spark, sf):
    d = t(spark, sf, "documents").select(F.col("source").alias("entity_id"), "doc_id")
    existing = d.where("entity_id IN ('src1', 'src2')").select("entity_id").distinct().withColumn("n", F.lit(7))
    return dedupe.sequence_numbers(d, "entity_id", [F.col("doc_id")], existing, 40)


@query("w11_query_quota", "SELECT c_custkey, greatest(8, c_custkey // greatest(1, c_nationkey)) AS per_query FROM customer")
def _(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", dedupe.per_query_quota(F.col("c_custkey"), F.col("c_nationkey")).alias("per_query"))


@query(
    "w14_first_entities",
    f"""WITH {SAMPLES_SQL}, f AS (SELECT entity_id FROM samples GROUP BY 1 ORDER BY min(ord), entity_id LIMIT 7) SELECT sample_id, entity_id FROM samples WHERE entity_id IN (SELECT entity_id FROM f)""",
)
def _(spark, sf):
    s = views.samples(spark, sf)
    firsts = s.groupBy("entity_id").agg(F.min("ord").alias("o")).orderBy("o", "entity_id").limit(7)
    return s.join(firsts, "entity_id", "left_semi").select("sample_id", "entity_id")


@query("w15_seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 60")
def _(spark, sf):
    return seeded_sample(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 60)


@query("w16_first_file")
def _(spark, sf):
    return tables.first_file_per_entity(tables.file_listing(spark, sf, ("parquet",)))


@query(
    "p26_preferred_path",
    """WITH f AS (SELECT doc_id, quality = 1 AS has_crop FROM labels)
SELECT doc_id, CASE WHEN has_crop THEN concat('crops/', doc_id) ELSE concat('raw/', doc_id) END AS chosen_path FROM documents JOIN f USING (doc_id) WHERE has_crop OR doc_id % 3 > 0""",
)
def _(spark, sf):
    lab = t(spark, sf, "labels")
    files = lab.where("quality = 1").selectExpr("concat('crops/', doc_id) AS path").unionByName(lab.where("doc_id % 3 > 0").selectExpr("concat('raw/', doc_id) AS path"))
    rows = t(spark, sf, "documents").selectExpr("doc_id", "concat('crops/', doc_id) AS crop", "concat('raw/', doc_id) AS raw")
    return tables.preferred_path(rows, files, "crop", "raw").select("doc_id", "chosen_path")


# ---- streams ---------------------------------------------------------------------------------------------
SLICES = 4


def event_stream(spark, sf, path):
    """The events in slices that arrive one after the other, each in files of its own, read in about ``SLICES`` micro-batches."""
    events = t(spark, sf, "events")
    for k in range(SLICES):
        events.where(F.col("event_id") % SLICES == k).write.mode("append").parquet(f"{path}/in")
    files = len(spark.read.parquet(f"{path}/in").inputFiles())
    return streams.file_stream(spark, f"{path}/in", events.schema, files_per_batch=max(1, -(-files // SLICES)))


@query("t1_skip_processed", f"SELECT user_id, event_type, min(event_id % {SLICES}) AS slice FROM events GROUP BY 1, 2")
def _(spark, sf):
    path = scratch(spark, "stream")
    rows = event_stream(spark, sf, path).select((F.col("event_id") % SLICES).alias("slice"), "user_id", "event_type")
    streams.skip_processed(rows, ["user_id", "event_type"], "slice", f"{path}/rows", f"{path}/checkpoint")
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/epoch=*").select("user_id", "event_type", "slice")


#: Days of events that arrive together, and how late a repeat may be: it comes with the next days' events.
SLICE_DAYS, DELAY = 5, "12 days"


@query("t1_watermark_dedupe", "SELECT event_id, user_id, event_type FROM events")
def _(spark, sf):
    """Events in order of time; of every third one a repeat comes with the next days' events, while the watermark still keeps its key."""
    path = scratch(spark, "stream")
    events = t(spark, sf, "events").withColumn("__k", F.floor(F.datediff("ts", F.lit("2024-01-01")) / SLICE_DAYS))
    late = events.where("event_id % 3 = 0").withColumn("__k", F.col("__k") + 1)
    arriving = cut_lineage(events.unionByName(late))
    last = arriving.agg(F.max("__k")).first()[0]
    for k in range(int(last) + 1):  # a slice per few days
        arriving.where(F.col("__k") == k).drop("__k").write.mode("append").parquet(f"{path}/in")
    files = len(spark.read.parquet(f"{path}/in").inputFiles())
    rows = streams.file_stream(spark, f"{path}/in", events.drop("__k").schema, files_per_batch=max(1, -(-files // (int(last) + 1))))
    fresh = streams.within_watermark(rows, ["event_id"], "ts", DELAY).select("event_id", "user_id", "event_type")
    streams.run_available(fresh, lambda batch, epoch: batch.write.mode("overwrite").parquet(streams.epoch_path(f"{path}/rows", epoch)), f"{path}/checkpoint")
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/epoch=*").select("event_id", "user_id", "event_type")


EVENT_VEC = "array(value, double(get_json_object(props, '$.k')), double(event_id % 7), 1D)"


@query(
    "t2_incremental_vectors",
    f"""WITH e AS (SELECT user_id, [value, CAST(json_extract_string(props, '$.k') AS DOUBLE), (event_id % 7)::DOUBLE, 1.0::DOUBLE] AS v FROM events),
u AS (SELECT user_id, {unit('v')} AS u FROM e), {mean_cte('c', 'u', 'user_id', 'u')}, {long_sql('c', 'user_id', 'n').replace('SELECT user_id, n, i', 'o AS (SELECT user_id, n, i', 1)}) SELECT * FROM o""",
)
def _(spark, sf):
    path = scratch(spark, "stream")
    rows = event_stream(spark, sf, path).select("user_id", F.expr(EVENT_VEC).alias("v"))
    streams.accumulate_moments(rows, "user_id", "v", 4, f"{path}/state", f"{path}/checkpoint")
    return long_vector(streams.current_vectors(spark, f"{path}/state", "user_id", 4), "user_id", "n")


@query("t3_progress", "WITH " + PROGRESS_SQL.format(before=f"event_id % {SLICES} = 0", m=60))
def _(spark, sf):
    path = scratch(spark, "stream")
    rows = event_stream(spark, sf, path).select(F.concat(F.lit("u"), "user_id").alias("entity_id"))
    streams.count_progress(rows, "entity_id", f"{path}/counts", f"{path}/checkpoint")
    ids = t(spark, sf, "customer").selectExpr("concat('u', c_custkey) AS entity_id")
    return streams.progress_between(spark, f"{path}/counts", ids, 60, 0, streams.LAST_EPOCH)
