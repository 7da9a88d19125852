"""Queries: scalar functions over vectors, text, HTML, dates, URLs, boxes; row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecrec.catalog import views
from vecrec.catalog.base import query, unit
from vecrec.catalog.vectors import BUILT_SQL, entity_vectors
from vecrec.catalog.views import D1, D2, SAMPLES_SQL
from vecrec.functions import geometry, text, vec
from vecrec.operators import curate, dedupe
from vecrec.operators.select import candidate_filter, without_prefixes


def t(spark, sf, name):
    return views.table(spark, sf, name)


# ---- vectors ---------------------------------------------------------------------------------
@query(
    "p01_parse_vector",
    """WITH raw AS (SELECT vec_id, CASE vec_id % 10 WHEN 0 THEN '[]' WHEN 1 THEN 'oops' WHEN 2 THEN '[1,"a"]' WHEN 3 THEN ''
  ELSE CAST(to_json(embedding) AS VARCHAR) END AS js FROM embeddings),
p AS (SELECT vec_id, TRY_CAST(js AS DOUBLE[]) AS v FROM raw)
SELECT vec_id, len(v) AS dim, round(list_sum(v), 5) AS total FROM p WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL)) = 0""",
)
def _(spark, sf):
    raw = t(spark, sf, "embeddings").withColumn(
        "js", F.expr("CASE vec_id % 10 WHEN 0 THEN '[]' WHEN 1 THEN 'oops' WHEN 2 THEN '[1,\"a\"]' WHEN 3 THEN '' ELSE to_json(embedding) END")
    )
    p = raw.select("vec_id", vec.parse_vector(F.col("js")).alias("v")).where("v IS NOT NULL")
    return p.select("vec_id", F.size("v").cast("bigint").alias("dim"), F.round(F.expr("aggregate(v, 0D, (s, x) -> s + x)"), 5).alias("total"))


RAW_BOOL = "CASE event_id % 8 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN '1' WHEN 3 THEN 'False' WHEN 4 THEN 'Y' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE event_type END"


@query("p02_lenient_bool", f"SELECT event_id, coalesce(lower(trim({RAW_BOOL})) IN ('1', 'true', 'yes', 'y'), false) AS flag FROM events")
def _(spark, sf):
    return t(spark, sf, "events").select("event_id", text.lenient_bool(F.expr(RAW_BOOL)).alias("flag"))


ZEROED = "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 50 = 0 THEN 0::DOUBLE ELSE x::DOUBLE * (1 + vec_id % 3) END) AS v FROM embeddings"


@query(
    "p03_normalise",
    f"""WITH z AS ({ZEROED}), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM z)
SELECT vec_id, round(list_sum(v) / greatest(n, 1e-12), 6) AS clipped, round(list_sum(v) / CASE WHEN n <= 1e-12 THEN 1 ELSE n END, 6) AS passed,
round(CASE WHEN n <= 1e-12 THEN 0 ELSE 1 END, 6) AS length FROM n""".replace("round(CASE WHEN n <= 1e-12 THEN 0 ELSE 1 END, 6)", "CASE WHEN n <= 1e-12 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END"),
)
def _(spark, sf):
    v = F.expr("transform(embedding, x -> if(vec_id % 50 = 0, 0D, double(x) * (1 + vec_id % 3)))")
    rows = t(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    rows = vec.with_unit(vec.with_unit(rows, "v", "c", 64, "clip"), "v", "p", 64, "pass")
    total = lambda c: F.round(F.expr(f"aggregate({c}, 0D, (s, x) -> s + x)"), 6)
    return rows.select("vec_id", total("c").alias("clipped"), total("p").alias("passed"), F.round(F.expr(vec.norm_sql("c", 64)), 6).alias("length"))


@query(
    "p04_dot_and_cosine",
    f"WITH {SAMPLES_SQL} SELECT sample_id, round(list_dot_product(v1, v2), 6) AS dot, round(list_cosine_similarity(v1, v2), 6) AS cosine FROM samples",
)
def _(spark, sf):
    rows = views.samples(spark, sf)
    rows = vec.with_unit(vec.with_unit(rows, "v1", "a", D1), "v2", "b", D2)
    return rows.select("sample_id", F.round(vec.dot("v1", "v2", D1), 6).alias("dot"), F.round(vec.dot("a", "b", D1), 6).alias("cosine"))


@query(
    "p05_concat_spaces",
    f"""WITH {SAMPLES_SQL}, f AS (SELECT sample_id, 'primary' AS mode, v1 AS f FROM samples UNION ALL SELECT sample_id, 'secondary', v2 FROM samples
  UNION ALL SELECT sample_id, 'both', list_concat(v1, list_transform(v2, lambda x: x * 0.5)) FROM samples)
SELECT sample_id, mode, len(f) AS dim, round(list_sum({unit('f')}), 6) AS total FROM f""",
)
def _(spark, sf):
    rows, out = views.samples(spark, sf), None
    for mode in ("primary", "secondary", "both"):
        part = vec.with_unit(rows.withColumn("f", F.expr(vec.concat_spaces("v1", "v2", mode, 0.5))), "f", "u", 64 if mode == "both" else 32)
        part = part.select("sample_id", F.lit(mode).alias("mode"), F.size("u").cast("bigint").alias("dim"), F.round(F.expr("aggregate(u, 0D, (s, x) -> s + x)"), 6).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "p06_zscore",
    """WITH s AS (SELECT c_nationkey, avg(x) AS m, stddev_pop(x) AS sd FROM (
  SELECT c_nationkey, CASE WHEN c_nationkey = 3 THEN 5.0::DOUBLE ELSE c_acctbal END AS x FROM customer) GROUP BY 1)
SELECT c_custkey, round(CASE WHEN sd < 1e-6 THEN x - m ELSE (x - m) / sd END, 6) AS z FROM (
  SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 3 THEN 5.0::DOUBLE ELSE c_acctbal END AS x FROM customer) JOIN s USING (c_nationkey)""",
)
def _(spark, sf):
    rows = t(spark, sf, "customer").select("c_custkey", "c_nationkey", F.expr("CASE WHEN c_nationkey = 3 THEN 5.0D ELSE c_acctbal END").alias("x"))
    stats = rows.groupBy("c_nationkey").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return rows.join(stats, "c_nationkey").select("c_custkey", F.round(vec.zscore(F.col("x"), F.col("m"), F.col("sd")), 6).alias("z"))


@query(
    "p07_confidence_scaling",
    f"WITH {SAMPLES_SQL} SELECT sample_id, round(list_sum(v1) * (0.5 + 0.5 * quality), 6) AS scaled FROM samples",
)
def _(spark, sf):
    total = F.expr("aggregate(v1, 0D, (s, x) -> s + x)")
    return views.samples(spark, sf).select("sample_id", F.round(vec.confidence_scaled(total, F.col("quality")), 6).alias("scaled"))


@query(
    "p25_dimension_check",
    "SELECT label, CAST(min(len(embedding)) AS BIGINT) AS min_dim, CAST(max(len(embedding)) AS BIGINT) AS max_dim, count(*) AS n_rows FROM embeddings GROUP BY 1",
)
def _(spark, sf):
    checked = vec.require_dimension(t(spark, sf, "embeddings"), "embedding", 64)
    return vec.dimension_report(checked, "embedding", ["label"])


# ---- boxes and keypoints -----------------------------------------------------------------------
BOX_SQL = """boxes AS (SELECT vec_id AS sample_id, embedding, k AS det_no,
  [least(a, c), least(b, d), greatest(a, c), greatest(b, d)] AS bbox, 400.0::DOUBLE AS width, 300.0::DOUBLE AS height FROM (
  SELECT vec_id, embedding, k, 200 + 400 * embedding[1 + 4*k]::DOUBLE AS a, 150 + 300 * embedding[2 + 4*k]::DOUBLE AS b,
         200 + 400 * embedding[3 + 4*k]::DOUBLE AS c, 150 + 300 * embedding[4 + 4*k]::DOUBLE AS d
  FROM embeddings, (VALUES (0), (1)) AS v(k) WHERE k = 0 OR vec_id % 3 > 0))"""


def boxes(spark, sf):
    e = t(spark, sf, "embeddings").selectExpr("vec_id AS sample_id", "embedding", "explode(if(vec_id % 3 > 0, array(0, 1), array(0))) AS det_no")
    e = e.selectExpr("*", *[f"{base} + {scale} * double(embedding[{i} + 4 * det_no]) AS {n}" for i, (n, base, scale) in enumerate((("a", 200, 400), ("b", 150, 300), ("c", 200, 400), ("d", 150, 300)))])
    return e.selectExpr("sample_id", "embedding", "det_no", "array(least(a, c), least(b, d), greatest(a, c), greatest(b, d)) AS bbox", "400D AS width", "300D AS height")


@query(
    "p08_detection_metrics",
    f"""WITH {BOX_SQL}, m AS (SELECT sample_id, det_no, abs(embedding[9]::DOUBLE) AS score, greatest(0, bbox[3] - bbox[1]) AS w, greatest(0, bbox[4] - bbox[2]) AS h FROM boxes)
SELECT sample_id, CAST(det_no AS BIGINT) AS det_no, round(w, 6) AS box_width, round(h, 6) AS box_height, round(w * h / 120000, 6) AS area_ratio,
round(score * least(1, w * h / 120000 * 10), 4) AS quality FROM m""",
)
def _(spark, sf):
    m = geometry.box_metrics("bbox", "width", "height")
    rows = boxes(spark, sf).select("sample_id", F.col("det_no").cast("bigint").alias("det_no"), F.expr("abs(double(embedding[8]))").alias("score"), *[c.alias(n) for n, c in m.items()])
    return rows.select("sample_id", "det_no", F.round("box_width", 6).alias("box_width"), F.round("box_height", 6).alias("box_height"),
                       F.round("area_ratio", 6).alias("area_ratio"), geometry.detection_quality(F.col("score"), F.col("area_ratio")).alias("quality"))


_PT = [f"x{i}" for i in range(5)]
KEYPOINT_SQL = f"""WITH {BOX_SQL},
k AS (SELECT sample_id, bbox, {", ".join(f"200 + 300 * embedding[{11 + 2 * i}]::DOUBLE AS x{i}, 150 + 300 * embedding[{12 + 2 * i}]::DOUBLE AS y{i}" for i in range(5))} FROM boxes WHERE det_no = 0),
a AS (SELECT *, -atan2(y1 - y0, x1 - x0) AS a, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM k),
r AS (SELECT sample_id, {", ".join(f"cos(a) * (x{i} - mx) - sin(a) * (y{i} - my) AS px{i}, sin(a) * (x{i} - mx) + cos(a) * (y{i} - my) AS py{i}" for i in range(5))},
  list_transform([[bbox[1], bbox[2]], [bbox[3], bbox[2]], [bbox[3], bbox[4]], [bbox[1], bbox[4]]], lambda c: [cos(a) * (c[1] - mx) - sin(a) * (c[2] - my), sin(a) * (c[1] - mx) + cos(a) * (c[2] - my)]) AS cs FROM a),
b AS (SELECT *, list_min(list_transform(cs, lambda c: c[1])) AS bx0, list_max(list_transform(cs, lambda c: c[1])) AS bx1,
  list_min(list_transform(cs, lambda c: c[2])) AS by0, list_max(list_transform(cs, lambda c: c[2])) AS by1 FROM r),
m AS (SELECT sample_id, bx1 - bx0 AS w, by1 - by0 AS h, sqrt((px1-px0)**2 + (py1-py0)**2) AS eye, sqrt((px4-px3)**2 + (py4-py3)**2) AS mouth,
  ((py0+py1)/2 - by0) / (by1-by0) AS ey, (py2 - by0) / (by1-by0) AS ny, ((py3+py4)/2 - by0) / (by1-by0) AS my, px2 - (px0+px1)/2 AS off FROM b),
f AS (SELECT *, greatest(ny - ey, 1e-6) AS middle, greatest(1 - my, 1e-6) AS lower FROM m)
SELECT sample_id, round(w / h, 5) AS face_aspect, round(eye / w, 5) AS eye_spacing, round(ey, 5) AS eye_position_y, round(middle, 5) AS nose_length,
round(greatest(my - ny, 0), 5) AS philtrum, round(lower, 5) AS chin_length, round(mouth / w, 5) AS mouth_width, round(mouth / eye, 5) AS mouth_to_eye_ratio,
round(off / w, 5) AS nose_offset_x, round(log10(lower / middle), 5) AS log_lower_face_ratio FROM f"""


@query("p09_keypoint_features", KEYPOINT_SQL)
def _(spark, sf):
    points = ", ".join(f"array(200 + 300 * double(embedding[{10 + 2 * i}]), 150 + 300 * double(embedding[{11 + 2 * i}]))" for i in range(5))
    rows = boxes(spark, sf).where("det_no = 0").withColumn("pts", F.expr(f"array({points})"))
    out = geometry.keypoint_features(rows, "bbox", "pts").select("sample_id", "features.*")
    names = geometry.FEATURE_NAMES[:-1]
    return out.select("sample_id", *[F.round(n, 5).alias(n) for n in names], F.round(F.log10("lower_face_ratio"), 5).alias("log_lower_face_ratio"))


@query(
    "w08_largest_detection",
    f"""WITH {BOX_SQL} SELECT sample_id, CAST(det_no AS BIGINT) AS det_no FROM boxes QUALIFY row_number() OVER (
PARTITION BY sample_id ORDER BY (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) DESC, det_no) = 1""",
)
def _(spark, sf):
    return curate.choose_detection(boxes(spark, sf), "largest").select("sample_id", F.col("det_no").cast("bigint").alias("det_no"))


@query(
    "w08_central_detection",
    f"""WITH {BOX_SQL} SELECT sample_id, CAST(det_no AS BIGINT) AS det_no FROM boxes QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY
sqrt(((bbox[1] + bbox[3]) / 2 - width / 2) ** 2 + ((bbox[2] + bbox[4]) / 2 - height / 2) ** 2), det_no) = 1""",
)
def _(spark, sf):
    return curate.choose_detection(boxes(spark, sf), "center").select("sample_id", F.col("det_no").cast("bigint").alias("det_no"))


@query("w08_single_detection", f"WITH {BOX_SQL} SELECT sample_id FROM boxes GROUP BY 1 HAVING count(*) = 1")
def _(spark, sf):
    return curate.choose_detection(boxes(spark, sf), "reject").select("sample_id")


# ---- text --------------------------------------------------------------------------------------
@query(
    "p10_clean_label",
    """SELECT doc_id, trim(regexp_replace(regexp_replace(concat('“', text, '”  '), '["''“”‘’]', '', 'g'), '\\s+', ' ', 'g')) AS label FROM documents""",
)
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.clean_label(F.concat(F.lit("“"), "text", F.lit("”  "))).alias("label"))


PART_NAME = "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' & Co.' WHEN 1 THEN '''s' WHEN 2 THEN '!' ELSE '' END)"


@query(
    "p11_slugs",
    f"""WITH n AS (SELECT p_partkey, p_brand, {PART_NAME} AS name FROM part)
SELECT p_partkey, trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
trim(regexp_replace(regexp_replace(lower(trim(name)), '[''.’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS quiet_slug,
concat(trim(regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '_', 'g'), '_'), '__', trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '_')) AS entity_id FROM n""",
)
def _(spark, sf):
    name = F.expr(PART_NAME.replace("'''s'", "\"'s\""))
    return t(spark, sf, "part").select(
        "p_partkey", text.slug(name).alias("slug"), text.slug_without_quotes(name).alias("quiet_slug"), text.entity_id(F.col("p_brand"), name).alias("entity_id")
    )


SLUGS_SQL = f"""n AS (SELECT p_partkey, {PART_NAME} AS name FROM part),
b AS (SELECT *, trim(regexp_replace(replace(lower(name), '&', 'and'), '[^a-z0-9]+', '-', 'g'), '-') AS base, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS packed FROM n),
c AS (SELECT p_partkey, base || '-members-profile' AS s, 0 AS o FROM b UNION ALL SELECT p_partkey, base || '-profile', 1 FROM b UNION ALL SELECT p_partkey, base || '-members', 2 FROM b
  UNION ALL SELECT p_partkey, base, 3 FROM b
  UNION ALL SELECT p_partkey, regexp_replace(base, 's$', 'ss') || '-members-profile', 4 FROM b WHERE lower(name) LIKE '%s' AND length(name) > 4
  UNION ALL SELECT p_partkey, packed || '-members-profile', 5 FROM b WHERE packed <> base UNION ALL SELECT p_partkey, packed || '-profile', 6 FROM b WHERE packed <> base)"""


@query(
    "p11_slug_candidates",
    f"WITH {SLUGS_SQL} SELECT p_partkey, string_agg(s, '|' ORDER BY o) AS slugs FROM (SELECT p_partkey, s, min(o) AS o FROM c GROUP BY 1, 2) GROUP BY 1",
)
def _(spark, sf):
    name = F.expr(PART_NAME.replace("'''s'", "\"'s\""))
    return t(spark, sf, "part").select("p_partkey", F.array_join(text.slug_candidates(name), "|").alias("slugs"))


@query(
    "p11_page_paths",
    """WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '-', 'g'), '-') AS raw FROM part),
b AS (SELECT p_partkey, CASE raw WHEN 'brand-1' THEN 'brand-one' WHEN 'brand-12' THEN 'brand-twelve' ELSE raw END AS base FROM s)
SELECT p_partkey, CASE base WHEN 'brand-one' THEN 'brand-one-profile' WHEN 'brand-3' THEN 'brand-3-profile' ELSE base || '-members-profile' END AS path FROM b""",
)
def _(spark, sf):
    aliases, paths = {"brand-1": "brand-one", "brand-12": "brand-twelve"}, {"brand-one": "brand-one-profile", "brand-3": "brand-3-profile"}
    return t(spark, sf, "part").select("p_partkey", text.page_path(F.col("p_brand"), aliases, paths).alias("path"))


@query(
    "p12_name_forms",
    f"""WITH n AS (SELECT p_partkey, {PART_NAME} AS name FROM part) SELECT p_partkey, lower(regexp_replace(name, '[\\s\\-.]', '', 'g')) AS name_form,
regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS alnum_form, trim(regexp_replace(lower(concat(' ', name, '  X ')), '\\s+', ' ', 'g')) AS match_form FROM n""",
)
def _(spark, sf):
    name = F.expr(PART_NAME.replace("'''s'", "\"'s\""))
    return t(spark, sf, "part").select(
        "p_partkey", text.name_form(name).alias("name_form"), text.alnum_form(name).alias("alnum_form"),
        text.match_form(F.concat(F.lit(" "), name, F.lit("  X "))).alias("match_form"),
    )


DECODE_SQL = """concat(string_split(s, '&#')[1], list_aggregate(list_concat([''], list_transform(string_split(s, '&#')[2:], lambda p:
  CASE WHEN regexp_matches(p, '^\\d{1,7};') THEN concat(chr(CAST(regexp_extract(p, '^(\\d{1,7});', 1) AS INTEGER)), regexp_replace(p, '^\\d{1,7};', '')) ELSE concat('&#', p) END)), 'string_agg', ''))"""
MARKED_HTML = "concat(html, '&#', 65 + page_id % 50, ';&#54620;&nbsp;&#x;')"
STRIP_SQL = f"""pt AS (SELECT page_id, replace(replace(regexp_replace(regexp_replace(regexp_replace({MARKED_HTML}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
  '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&') AS s FROM pages),
stripped AS (SELECT page_id, trim(regexp_replace({DECODE_SQL}, '\\s+', ' ', 'g')) AS txt FROM pt)"""


@query("p13_strip_html", f"WITH {STRIP_SQL} SELECT page_id, txt FROM stripped")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", text.strip_html(F.expr(MARKED_HTML)).alias("txt"))


ENTITY_HTML = "concat(html, '&#x', hex(44032 + page_id % 900), ';&#38;lt;&eacute;&apos;&amp;gt;&bogus;&#xD800;&#;& ')"


@query(
    "p13_tags_to_text",
    f"""WITH s AS (SELECT page_id, string_split(regexp_replace({ENTITY_HTML}, '<[^>]+>', ' ', 'g'), '&') AS p FROM pages),
e AS (SELECT page_id, i, p[i] AS part, regexp_extract(p[i], '^(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]*);', 1) AS body FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM s)),
named AS (SELECT unnest({[n for n in text.NAMED_ENTITIES]}) AS body, unnest({[ord(c) for c in text.NAMED_ENTITIES.values()]}) AS code),
n AS (SELECT e.*, CASE WHEN lower(body[2]) = 'x' AND body[1] = '#' THEN TRY_CAST('0x' || substr(body, 3) AS INTEGER) WHEN body[1] = '#' THEN TRY_CAST(substr(body, 2) AS INTEGER) ELSE code END AS code FROM e LEFT JOIN named USING (body))
SELECT page_id, string_agg(CASE WHEN i = 1 THEN part WHEN code BETWEEN 1 AND 1114111 AND code NOT BETWEEN 55296 AND 57343 THEN concat(chr(code), substr(part, length(body) + 2)) ELSE '&' || part END, '' ORDER BY i) AS txt FROM n GROUP BY 1""",
)
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", text.tags_to_text(F.expr(ENTITY_HTML)).alias("txt"))


@query(
    "p13_head_text",
    "SELECT page_id, substr(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), 1, 4000) AS head FROM pages",
)
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", text.head_text(F.col("html")).alias("head"))


LINK = '<a href="([^"]*)">([^<]*)</a>'
HEADING = "<h1>([^<]*)</h1>"
PAIRS_SQL = f"""raw AS (SELECT page_id, unnest(range(0, len(n))) AS i, unnest(n) AS name, unnest(l) AS local FROM (
  SELECT page_id, regexp_extract_all(html, '{LINK}', 2) AS n, regexp_extract_all(html, '{LINK}', 1) AS l FROM src)),
fb AS (SELECT page_id, unnest(range(0, len(n))) AS i, unnest(n) AS name, '' AS local FROM (SELECT page_id, regexp_extract_all(html, '{HEADING}', 1) AS n FROM src)),
ok AS (SELECT page_id, i, trim(name) AS name, trim(local) AS local FROM raw WHERE trim(name) <> '' AND length(trim(name)) <= 40),
fbok AS (SELECT page_id, i, trim(name) AS name, local FROM fb WHERE trim(name) <> '' AND length(trim(name)) <= 40 AND page_id NOT IN (SELECT page_id FROM ok)),
u AS (SELECT * FROM ok UNION ALL SELECT * FROM fbok),
found AS (SELECT page_id, name, local FROM u QUALIFY row_number() OVER (PARTITION BY page_id, name ORDER BY i) = 1)"""
NO_LINKS = "CASE WHEN page_id % 7 = 0 THEN replace(html, 'href', 'ref') ELSE html END"


@query("p14_field_pairs", f"WITH src AS (SELECT page_id, {NO_LINKS} AS html FROM pages), {PAIRS_SQL} SELECT * FROM found")
def _(spark, sf):
    rows = t(spark, sf, "pages").select("page_id", F.explode(text.field_pairs(F.expr(NO_LINKS), LINK, HEADING, 40, 2, 1)).alias("p"))
    return rows.select("page_id", "p.name", "p.local")


@query(
    "p14b_section_stop",
    f"""WITH src AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<article') THEN regexp_extract(html, '(?is)^(.*?)<article', 1) ELSE html END AS html FROM (
  SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(html, '<article>', '') ELSE concat(html, '<a href="/late">late</a>') END AS html FROM pages)),
{PAIRS_SQL} SELECT * FROM found""",
)
def _(spark, sf):
    html = F.expr("CASE WHEN page_id % 5 = 0 THEN replace(html, '<article>', '') ELSE concat(html, '<a href=\"/late\">late</a>') END")
    rows = t(spark, sf, "pages").select("page_id", F.explode(text.field_pairs(text.before_stop(html, "(?i)<article"), LINK, HEADING, 40, 2, 1)).alias("p"))
    return rows.select("page_id", "p.name", "p.local")


PEOPLE_NAMES = f"transform(regexp_extract_all(html, '{LINK}', 2), x -> trim(regexp_replace(regexp_replace(x, '[^A-Za-z ]', ''), ' +', ' ')))"
PEOPLE_HTML = f"""array_join(transform({PEOPLE_NAMES}, (n, i) -> concat(
  CASE WHEN page_id % 3 = 0 AND i = page_id % 5 THEN '<h2>More</h2><p>Former Members</p>' WHEN page_id % 3 = 1 AND i = 0 THEN '<p>Stage Name rules: a hiatus of 2 years</p>' ELSE '' END,
  CASE (page_id + i) % 5 WHEN 0 THEN concat('<p><b>Stage Name:</b> ', n, ' (가나 다)</p><p>Korean Name: 라마</p>') WHEN 1 THEN concat('<p>Stage Name: ', n, '</p><p>Age: 20</p><p>Korean Name: 나다</p>')
    WHEN 2 THEN concat('<div>Stage / Birth Name: ', n, '</div><div>Birth Name: Kim 마바사 x</div>') WHEN 3 THEN concat('<p>Stage Name: ', n, '</p><p>Birth Name: Lee (아자)</p><p>Korean Name: 차카</p>')
    ELSE concat('<p>stage name : ', n, ' (x)</p>') END)), '')"""


@query(
    "p14b_current_people",
    f"""WITH n AS (SELECT page_id, list_transform(regexp_extract_all(html, '{LINK}', 2), lambda x: trim(regexp_replace(regexp_replace(x, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g'))) AS names FROM pages),
e AS (SELECT page_id, unnest(range(0, len(names))) AS i, unnest(names) AS name FROM n)
SELECT page_id, i - (SELECT count(*) FROM e b WHERE b.page_id = e.page_id AND b.i < e.i AND b.name = '') AS pos, name,
  CASE (page_id + i) % 5 WHEN 0 THEN '가나 다' WHEN 1 THEN '나다' WHEN 2 THEN '마바사' WHEN 3 THEN '아자' ELSE '' END AS local
FROM e WHERE name <> '' AND NOT (page_id % 3 = 0 AND i >= page_id % 5)""",
)
def _(spark, sf):
    found = t(spark, sf, "pages").select("page_id", F.posexplode(text.current_fields(F.expr(PEOPLE_HTML))).alias("pos", "p"))
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "p.name", "p.local")


GROUP_INTRO = "concat('<p>', CASE page_id % 3 WHEN 0 THEN concat('Team ', page_id, ' (한글 팀) is a group') WHEN 1 THEN concat('Team ', page_id, ' ( 가-나 ) is  an act') ELSE 'Team () is a band' END, '</p>', html)"


@query("p14_group_local", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '한글 팀' WHEN 1 THEN '가-나' ELSE '' END AS group_local FROM pages")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", text.group_local(F.expr(GROUP_INTRO)).alias("group_local"))


SCRIPT_RAW = "CASE c_custkey % 4 WHEN 0 THEN concat('ケイ / 케이', c_custkey) WHEN 1 THEN concat(c_name, ' / 의주 나') WHEN 2 THEN concat('ウィ', c_name) ELSE '가/나 다/라' END"


@query(
    "p15_script_segment",
    f"""WITH r AS (SELECT c_custkey, {SCRIPT_RAW} AS raw FROM customer),
s AS (SELECT c_custkey, raw, unnest(string_split(raw, '/')) AS p, unnest(range(0, len(string_split(raw, '/')))) AS i FROM r),
b AS (SELECT c_custkey, CASE WHEN contains(raw, '/') THEN trim(p) ELSE raw END AS p FROM s QUALIFY row_number() OVER (PARTITION BY c_custkey
  ORDER BY len(regexp_extract_all(trim(p), '[\\x{{AC00}}-\\x{{D7A3}}\\x{{1100}}-\\x{{11FF}}\\x{{3130}}-\\x{{318F}}]+')) DESC, i) = 1)
SELECT c_custkey, trim(regexp_replace(p, '[\\x{{3040}}-\\x{{30FF}}\\x{{31F0}}-\\x{{31FF}}]', '', 'g')) AS name FROM b""",
)
def _(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", text.script_segment(F.expr(SCRIPT_RAW)).alias("name"))


@query(
    "p16_dates",
    """WITH d AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 6
  WHEN 0 THEN strftime(o_orderdate, 'x Debut Date: %B %-d, %Y y') WHEN 1 THEN strftime(o_orderdate, 'debut date : %Y.%-m.%-d')
  WHEN 2 THEN strftime(o_orderdate, 'Debut Date:%-d %b %Y') WHEN 3 THEN strftime(o_orderdate, 'they debuted on %B %-d, %Y.')
  WHEN 4 THEN 'Debut Date: Febru 30, 2020' ELSE 'none' END AS page FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS debut FROM d""",
)
def _(spark, sf):
    page = F.expr(
        "CASE o_orderkey % 6 WHEN 0 THEN concat('x Debut Date: ', date_format(o_orderdate, 'MMMM d, yyyy'), ' y') "
        "WHEN 1 THEN concat('debut date : ', date_format(o_orderdate, 'yyyy.M.d')) WHEN 2 THEN concat('Debut Date:', date_format(o_orderdate, 'd MMM yyyy')) "
        "WHEN 3 THEN concat('they debuted on ', date_format(o_orderdate, 'MMMM d, yyyy'), '.') WHEN 4 THEN 'Debut Date: Febru 30, 2020' ELSE 'none' END"
    )
    return t(spark, sf, "orders").select("o_orderkey", text.date_field(page).cast("string").alias("debut"))


CLASSES = {"A": (" the ", " that "), "B": (" der ", " und "), "C": (" que ", " las ")}


@query(
    "p17_pattern_vote",
    """WITH v AS (SELECT doc_id, unnest(['A', 'B', 'C']) AS label, unnest([
  regexp_matches(text, '(?i) the ')::INT + regexp_matches(text, '(?i) that ')::INT, regexp_matches(text, '(?i) der ')::INT + regexp_matches(text, '(?i) und ')::INT,
  regexp_matches(text, '(?i) que ')::INT + regexp_matches(text, '(?i) las ')::INT]) AS s FROM documents)
SELECT doc_id, CASE WHEN count(*) FILTER (s = m) = 1 THEN min(label) FILTER (s = m) ELSE '' END AS class FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS m FROM v) GROUP BY 1""",
)
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.pattern_vote(F.col("text"), CLASSES).alias("class"))


FLAGGED = "concat('<p>', CASE doc_id % 9 WHEN 0 THEN 'They Disbanded. ' WHEN 1 THEN 'a virtual idol group ' WHEN 2 THEN 'sub-unit of X ' WHEN 3 THEN 'a project group ' ELSE '' END, '</p>', text)"
HEAD_SQL = f"regexp_replace(regexp_replace({FLAGGED}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')"


def _alt(patterns):
    return "(?i)(?:" + ")|(?:".join(patterns) + ")"


@query(
    "p18_page_flags",
    f"""WITH h AS (SELECT doc_id, {HEAD_SQL} AS head FROM documents) SELECT doc_id, regexp_matches(head, '{_alt(text.DISBANDED_WORDS)}') AS disbanded,
regexp_matches(head, '{_alt(text.VIRTUAL_WORDS)}') AS virtual, regexp_matches(head, '{_alt(text.PROJECT_WORDS)}') AS project, regexp_matches(head, '{_alt(text.UNIT_WORDS)}') AS unit FROM h""",
)
def _(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", text.page_text(F.expr(FLAGGED)).alias("head"))
    return rows.select("doc_id", *[c.alias(n) for n, c in text.page_flags(F.col("head")).items()])


@query(
    "p18_blocked_links",
    f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages)
SELECT page_id, count(*) AS n_links, count(*) FILTER ({" OR ".join(f"contains(lower(url), '{b}')" for b in ("the", "header", "icon"))}) AS n_blocked FROM l GROUP BY 1""",
)
def _(spark, sf):
    links = t(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url"))
    return links.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_links"), F.count(F.when(text.is_blocked(F.col("url"), ("the", "header", "icon")), 1)).alias("n_blocked")
    )


REG_SQL = """regraw AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN '  ' ELSE concat('  c', c_custkey, ' ') END AS member_id, concat(n_name, ' ') AS group_name,
  c_name AS member_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('hint ', c_name, ' 얼굴') END AS search_hint,
  CASE WHEN c_custkey % 2 = 0 THEN concat(c_mktsegment, '| ', n_name, ' x|') ELSE NULL END AS include_terms,
  CASE WHEN c_custkey % 5 = 0 THEN concat('low res|', lower(c_mktsegment)) ELSE '' END AS exclude_terms FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
TERMS = "list_filter(list_transform(string_split(trim(coalesce({c}, '')), '|'), lambda x: trim(x)), lambda x: x <> '')"
REGISTRY_SQL = f"""{REG_SQL}, reg AS (SELECT c_custkey, trim(member_id) AS entity_id, trim(group_name) AS group_name, trim(member_name) AS entity_name,
  CASE WHEN trim(search_hint) <> '' THEN trim(search_hint) ELSE trim(concat_ws(' ', nullif(trim(group_name), ''), nullif(trim(member_name), ''))) END AS search_hint,
  {TERMS.format(c='include_terms')} AS include_terms, {TERMS.format(c='exclude_terms')} AS exclude_terms FROM regraw WHERE trim(member_id) <> '')"""


def raw_registry(spark, sf):
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 50 = 0 THEN '  ' ELSE concat('  c', c_custkey, ' ') END AS member_id", "concat(n_name, ' ') AS group_name", "c_name AS member_name",
        "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('hint ', c_name, ' 얼굴') END AS search_hint",
        "CASE WHEN c_custkey % 2 = 0 THEN concat(c_mktsegment, '| ', n_name, ' x|') ELSE NULL END AS include_terms",
        "CASE WHEN c_custkey % 5 = 0 THEN concat('low res|', lower(c_mktsegment)) ELSE '' END AS exclude_terms",
    )


def registry(spark, sf):
    from vecrec.sources.tables import typed_registry

    return typed_registry(raw_registry(spark, sf))


_Q = "CASE WHEN contains(t, ' ') THEN concat('\"', t, '\"') ELSE t END"


def _fill_sql(template: str) -> str:
    base = "'" + template + "'"
    for mark, column in (("{hint}", "search_hint"), ("{group_en}", "group_name"), ("{member_en}", "entity_name")):
        base = f"replace({base}, '{mark}', {column})"
    return f"trim({base})"


QUERIES_SQL = " UNION ALL ".join(
    f"SELECT entity_id, {i} AS o, {_fill_sql(tpl)} AS base, include_terms, exclude_terms FROM reg" for i, tpl in enumerate(text.QUERY_TEMPLATES)
)


@query(
    "p19_search_queries",
    f"""WITH {REGISTRY_SQL}, b AS ({QUERIES_SQL}),
q AS (SELECT entity_id, o, trim(list_aggregate(list_concat(list_concat([base], list_transform(list_filter(include_terms, lambda t: NOT contains(lower(base), lower(t))), lambda t: {_Q})),
  list_transform(exclude_terms, lambda t: concat('-', {_Q}))), 'string_agg', ' ')) AS q FROM b WHERE base <> ''),
d AS (SELECT entity_id, q, min(o) AS o FROM q GROUP BY 1, 2)
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY o) AS pos, q AS query FROM d""",
)
def _(spark, sf):
    q = text.search_queries(F.col("search_hint"), F.col("group_name"), F.col("entity_name"), F.col("include_terms"), F.col("exclude_terms"))
    rows = registry(spark, sf).select("entity_id", F.posexplode(q).alias("pos", "query"))
    return rows.select("entity_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "query")


CLIPS = " OR ".join(f"contains(lower(q), '{word}')" for word in text.CLIP_WORDS)


@query(
    "p19_keyword_queries",
    f"""WITH {REGISTRY_SQL}, b AS (SELECT * FROM ({QUERIES_SQL}) WHERE o < 2 OR CAST(substr(entity_id, 2) AS BIGINT) % 4 <> 0),
q AS (SELECT entity_id, o, trim(list_aggregate(list_concat(list_concat([base], list_transform(list_filter(include_terms, lambda t: NOT contains(lower(base), lower(t))), lambda t: {_Q})),
  list_transform(exclude_terms, lambda t: concat('-', {_Q}))), 'string_agg', ' ')) AS q FROM b WHERE base <> ''),
d AS (SELECT entity_id, q, min(o) AS o FROM q WHERE {CLIPS} GROUP BY 1, 2),
a AS (SELECT entity_id, q, o FROM d UNION ALL SELECT entity_id, concat(search_hint, ' {text.CLIP_FORCED}'), 0 FROM reg WHERE entity_id NOT IN (SELECT entity_id FROM d))
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY o) AS pos, q AS query FROM a""",
)
def _(spark, sf):
    q = text.search_queries(F.col("search_hint"), F.col("group_name"), F.col("entity_name"), F.col("include_terms"), F.col("exclude_terms"))
    few = text.search_queries(F.col("search_hint"), F.col("group_name"), F.col("entity_name"), F.col("include_terms"), F.col("exclude_terms"), text.QUERY_TEMPLATES[:2])
    asked = registry(spark, sf).withColumn("q", F.when(F.substring("entity_id", 2, 20).cast("bigint") % 4 == 0, few).otherwise(q))
    rows = asked.select("entity_id", F.posexplode(text.keyword_queries(F.col("q"), F.col("search_hint"))).alias("pos", "query"))
    return rows.select("entity_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "query")


@query(
    "p20_hint_update",
    f"""WITH {REGISTRY_SQL}, h AS (SELECT entity_id, search_hint, list_last(regexp_split_to_array(CASE WHEN suffix(search_hint, '얼굴') THEN trim(search_hint[:-3]) ELSE search_hint END, '\\s+')) AS old FROM reg)
SELECT entity_id, old, CASE WHEN instr(search_hint, old) > 0 THEN concat(substr(search_hint, 1, instr(search_hint, old) - 1), '새이름', substr(search_hint, instr(search_hint, old) + length(old))) ELSE search_hint END AS new_hint FROM h""",
)
def _(spark, sf):
    rows = registry(spark, sf).withColumn("old", text.last_token(F.col("search_hint")))
    return rows.select("entity_id", "old", text.replace_first(F.col("search_hint"), F.col("old"), F.lit("새이름")).alias("new_hint"))


URL_MIX = "CASE page_id % 5 WHEN 0 THEN replace(url, 'http', 'noscheme') WHEN 1 THEN concat('/just/a path', page_id) ELSE url END"


@query(
    "p21_url_parts",
    f"""WITH u AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('/x', page_id) ELSE concat('HTTPS://Src', page_id, '.example/p?q#f') END AS source_page,
  CASE page_id % 5 WHEN 0 THEN 'image/PNG; q=1' WHEN 1 THEN 'text/html' WHEN 2 THEN NULL ELSE '' END AS kind,
  concat('http://h', page_id, '.example/a.b/c', CASE page_id % 3 WHEN 0 THEN '.JPEG?x=1.png' WHEN 1 THEN '.gif' ELSE '/noext' END) AS file_url FROM pages),
w AS (SELECT *, CASE WHEN source_page <> '' THEN source_page ELSE url END AS target, lower(trim(string_split(coalesce(kind, ''), ';')[1])) AS k,
  lower(regexp_extract(regexp_extract(file_url, '^[a-z]+://[^/]*([^?#]*)', 1), '[^/](\\.[^./]+)$', 1)) AS suffix FROM u)
SELECT page_id, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+') THEN concat(lower(regexp_extract(target, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)), '://',
  regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]+)', 1), '/') ELSE 'https://duckduckgo.com/' END AS origin,
  CASE WHEN k = 'image/png' THEN '.png' WHEN suffix IN ('.jpg', '.jpeg') THEN '.jpg' WHEN suffix IN ('.png', '.webp', '.gif', '.bmp') THEN suffix ELSE '.jpg' END AS extension FROM w""",
)
def _(spark, sf):
    u = t(spark, sf, "pages").selectExpr(
        "page_id", "url", "CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('/x', page_id) ELSE concat('HTTPS://Src', page_id, '.example/p?q#f') END AS source_page",
        "CASE page_id % 5 WHEN 0 THEN 'image/PNG; q=1' WHEN 1 THEN 'text/html' WHEN 2 THEN NULL ELSE '' END AS kind",
        "concat('http://h', page_id, '.example/a.b/c', CASE page_id % 3 WHEN 0 THEN '.JPEG?x=1.png' WHEN 1 THEN '.gif' ELSE '/noext' END) AS file_url",
    )
    return u.select("page_id", text.url_origin(F.col("url"), F.col("source_page")).alias("origin"), text.file_extension(F.col("file_url"), F.col("kind")).alias("extension"))


@query(
    "p21_quoted_links",
    """WITH l AS (SELECT DISTINCT concat('http://x.example', unnest(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS url FROM pages)
SELECT url, concat('http://x.example', replace(replace(replace(replace(url_encode(substr(url, 17)), '%2F', '/'), '%25', '%'), '%3A', ':'), '%40', '@')) AS quoted FROM l WHERE NOT contains(url, '?') AND NOT contains(url, '#')""",
)
def _(spark, sf):
    links = t(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    urls = links.select(F.concat(F.lit("http://x.example"), "href").alias("url")).distinct().where("NOT contains(url, '?') AND NOT contains(url, '#')")
    return urls.select("url", text.quote_url(F.col("url")).alias("quoted"))


@query(
    "p22_digests",
    """SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 12) AS prefix,
regexp_extract(regexp_replace(concat(lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0'), CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('_', substr(sha256(text), 1, 12)) END, '.jpg'), '\\.[^.]*$', ''), '^[^_]*_(.+)$', 1) AS stem FROM documents""",
)
def _(spark, sf):
    rows = t(spark, sf, "documents").withColumn("prefix", text.digest_prefix(F.col("text")))
    path = F.concat(F.lit("d/"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("_"), "prefix")), F.lit(".jpg"))
    return rows.select("doc_id", text.digest(F.col("text")).alias("digest"), "prefix", text.stem_digest(path).alias("stem"))


RAW_PATH = "CASE doc_id % 4 WHEN 0 THEN concat('raw\\\\', source, '\\\\', doc_id, '.jpg') WHEN 1 THEN concat('/abs/', source, '/', doc_id, '.a.png') WHEN 2 THEN '' ELSE concat(source, '/', doc_id, '.jpg ') END"


@query(
    "p23_paths",
    f"""WITH p AS (SELECT doc_id, replace(trim({RAW_PATH.replace(chr(92) * 2, chr(92))}), '\\', '/') AS p FROM documents), n AS (SELECT doc_id, CASE WHEN p = '' THEN '' WHEN p[1] = '/' THEN p ELSE concat('/root/', p) END AS path FROM p)
SELECT doc_id, path, CASE WHEN path <> '' THEN concat('/crops/', string_split(path, '/')[-2], '/', regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', ''), '_face.jpg') END AS crop FROM n""",
)
def _(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", text.normal_path(F.expr(RAW_PATH), "/root").alias("path"))
    return rows.select("doc_id", "path", F.when(F.col("path") != "", text.crop_path(F.col("path"), "/crops")).alias("crop"))


LISTED = ("concat('x 보이그룹 2020 ', c_name, ' , Foo[해체] , B ', ' 2021 a&b , ', c_mktsegment, ' [활동] , Zed X Yo , 가비 5기 2022 ', c_name, ' two , [only] , End', "
          "CASE WHEN c_custkey % 2 = 0 THEN ' 걸그룹 2023 nope' ELSE '' END)")


@query(
    "p24_year_list",
    f"""WITH s AS (SELECT c_custkey, string_split({LISTED}, '보이그룹')[2] AS body FROM customer),
b AS (SELECT c_custkey, string_split(body, '걸그룹')[1] AS body FROM s),
y AS (SELECT c_custkey, unnest(string_split(regexp_replace(body, '\\s(20\\d\\d)\\s', chr(1) || '\\1 ', 'g'), chr(1))) AS blk FROM b),
n AS (SELECT c_custkey, CAST(substr(trim(blk), 1, 4) AS INTEGER) AS year, unnest(string_split(substr(trim(blk), 6), ',')) AS raw FROM y WHERE regexp_matches(trim(blk), '^20\\d\\d\\s+.+$')),
c AS (SELECT c_custkey, year, raw, trim(regexp_replace(raw, '\\[[^\\]]*\\]', '', 'g')) AS name FROM n)
SELECT c_custkey, year, name FROM c WHERE length(name) >= 2 AND NOT regexp_matches(raw, '\\[[^\\]]*(해체|계약종료|사실상해체|프로젝트종료)[^\\]]*\\]')
AND NOT regexp_matches(name, '&|\\s+[Xx×]\\s+|/|워너비$|^음율$|^재쓰비$|^싹쓰리$|\\d+기$')""",
)
def _(spark, sf):
    section = text.section_between(F.expr(LISTED), "보이그룹", "걸그룹")
    return t(spark, sf, "customer").select("c_custkey", F.explode(text.year_list(section)).alias("e")).select("c_custkey", "e.year", "e.name")


# ---- filters -------------------------------------------------------------------------------------
@query(
    "f02_candidate_eligibility",
    f"""WITH {BUILT_SQL} SELECT entity_id, segment FROM ev WHERE entity_id NOT IN (SELECT entity_id FROM requests WHERE request_id = 'r3')
AND image_count >= 7 AND confidence >= 0.01 AND (segment = '' OR segment = 'B')""",
)
def _(spark, sf):
    liked = views.requests(spark, sf).where("request_id = 'r3'")
    return candidate_filter(entity_vectors(spark, sf), liked, 7, 0.01, "B").select("entity_id", "segment")


@query("f04_id_list", f"WITH {SAMPLES_SQL} SELECT sample_id FROM samples WHERE entity_id IN (SELECT concat('e', lpad(CAST(n_nationkey AS VARCHAR), 3, '0')) FROM nation)")
def _(spark, sf):
    ids = t(spark, sf, "nation").selectExpr("concat('e', lpad(cast(n_nationkey AS string), 3, '0')) AS entity_id")
    return views.samples(spark, sf).join(ids, "entity_id", "left_semi").select("sample_id")


@query("f05_without_prefixes", f"WITH {SAMPLES_SQL} SELECT DISTINCT entity_id FROM samples WHERE NOT starts_with(entity_id, 'e00') AND NOT starts_with(entity_id, 'e03')")
def _(spark, sf):
    return without_prefixes(views.samples(spark, sf), "entity_id", ["e00", "e03"]).select("entity_id").distinct()


@query(
    "f06_term_match",
    """WITH d AS (SELECT doc_id, trim(regexp_replace(lower(concat_ws(' ', source, lang, text)), '\\s+', ' ', 'g')) AS hay, CASE WHEN doc_id % 3 = 0 THEN [] ELSE ['The  In', 'und', source] END AS inc,
  CASE WHEN doc_id % 2 = 0 THEN ['QUE', 'der das'] ELSE [] END AS exc FROM documents)
SELECT doc_id FROM d WHERE NOT (contains(hay, 'que') AND len(exc) > 0) AND NOT (contains(hay, 'der das') AND len(exc) > 0)
AND (len(inc) = 0 OR contains(hay, 'the in') OR contains(hay, 'und') OR contains(hay, lower(inc[3])))""",
)
def _(spark, sf):
    inc = F.expr("CASE WHEN doc_id % 3 = 0 THEN cast(array() AS array<string>) ELSE array('The  In', 'und', source) END")
    exc = F.expr("CASE WHEN doc_id % 2 = 0 THEN array('QUE', 'der das') ELSE cast(array() AS array<string>) END")
    hay = F.concat_ws(" ", "source", "lang", "text")
    return t(spark, sf, "documents").where(dedupe.term_match(hay, inc, exc)).select("doc_id")


@query(
    "f07_admission_checks",
    """WITH m AS (SELECT doc_id, n_chars AS bytes, 100 + doc_id % 300 AS width, 80 + doc_id % 400 AS height, (doc_id % 97) * 1.5::DOUBLE AS blur_score FROM documents)
SELECT doc_id, CASE WHEN bytes > 5000 THEN concat('too large: ', bytes, ' bytes') WHEN bytes < 200 THEN concat('too small: ', bytes, ' bytes')
WHEN least(width, height) < 160 THEN concat('resolution ', width, 'x', height, ' below min_side 160')
WHEN blur_score < 40.0 THEN concat('blur variance ', printf('%.1f', blur_score), ' below min 40.0') END AS error FROM m""",
)
def _(spark, sf):
    m = t(spark, sf, "documents").selectExpr("doc_id", "n_chars AS bytes", "100 + doc_id % 300 AS width", "80 + doc_id % 400 AS height", "double((doc_id % 97) * 1.5) AS blur_score")
    return m.select("doc_id", dedupe.admission_error(200, 5000, 160, 40.0).alias("error"))


@query(
    "f08_low_quality_flag",
    f"""WITH {BUILT_SQL} SELECT entity_id, image_count < 7 OR confidence < 0.02 AS low,
concat(entity_id, CASE WHEN image_count < 7 OR confidence < 0.02 THEN ' (low)' ELSE '' END) AS label FROM ev""",
)
def _(spark, sf):
    low = curate.low_quality(F.col("image_count"), F.col("confidence"), 7, 0.02)
    return entity_vectors(spark, sf).select("entity_id", low.alias("low"), F.concat("entity_id", F.when(low, " (low)").otherwise("")).alias("label"))
