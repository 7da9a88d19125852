"""The registered query of each operator, over whole tables, and its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecrec.llm.common import table
from vecrec.llm.decontaminate import contaminated
from vecrec.llm.html_text import extract_text
from vecrec.llm.language import identify
from vecrec.llm.line_dedup import BREAKS, drop_boilerplate
from vecrec.llm.mixing import mix
from vecrec.llm.negatives import hard_negatives
from vecrec.llm.quality import quality_report
from vecrec.llm.simhash import simhash_groups
from vecrec.llm.spelling import spelling_variants
from vecrec.llm.suffix_dedup import remove_repeats
from vecrec.llm.token_file import token_digest
from vecrec.llm.toxicity import toxicity
from vecrec.llm.warc import page_derivatives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query()
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, i, w[i:i + 4] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper
  FROM t LEFT JOIN covered ON t.doc_id = covered.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols > 0.4 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR n_dup_lines > 0.3 * n_lines OR n_upper > 0.3 * word_chars) AS kept
FROM b"""


@query(OP4_SQL)
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query()
def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(spark, table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS r, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '(?i)</?(?:BREAKS)(?:[\s/][^>]*)?>', chr(10), 'g'), '<[A-Za-z/!?][^>]*>', '', 'g'), chr(10)),
      lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS body
  FROM pages),
held AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(body)) AS line FROM p WHERE host IS NOT NULL) GROUP BY host, line),
totals AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
dropped AS (SELECT host, list(line) AS dropped FROM held JOIN totals USING (host) WHERE n >= 3 AND n > 0.3 * pages GROUP BY host),
k AS (SELECT page_id, p.host, body, list_filter(body, lambda x: dropped IS NULL OR NOT list_contains(dropped, x)) AS kept FROM p LEFT JOIN dropped ON p.host = dropped.host)
SELECT page_id, host, len(body)::BIGINT AS n_lines, (len(body) - len(kept))::BIGINT AS n_dropped, md5(coalesce(array_to_string(kept, chr(10)), '')) AS kept_md5 FROM k""".replace("BREAKS", BREAKS)


@query(OP7_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_boilerplate(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "n_lines", "n_dropped", F.md5(F.encode("kept_text", "utf-8")).alias("kept_md5"))


@query()
def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and epoch that reads it; no source is read more than twice over."""
    return mix(table(spark, sf_dir, "documents"), max_repeats=2.0).select("doc_id", "source", "mix_epoch", "mix_block", "mix_place")


@query()
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query()
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_derivatives(table(spark, sf_dir, "pages"), keep_records=False).drop("record")


#: One run in so many of a document loses a code point before words are counted.
TYPO_EVERY = 199


@query()
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), typo_every=TYPO_EVERY)


OP12_SQL = r"""
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM r AS a, r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id,
    positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10"""


@query(OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label))


@query()
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("n_spans", F.size("spans").cast("bigint"))


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
