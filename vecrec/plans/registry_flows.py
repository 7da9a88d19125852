"""Composite registry flows: anchor mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecrec.operators.registry import match_prefix, preceding_links


def anchor_log(registry: DataFrame, pages: DataFrame, cached: DataFrame, item_pattern: str, link_pattern: str, blocked: tuple[str, ...] = ()) -> DataFrame:
    """Per registry row: the link that precedes its matching heading on the group's page, and a status.

    ``pages(group_name, html)`` holds the pages that could be fetched.
    """
    listed = pages.select("group_name", F.posexplode(preceding_links(F.col("html"), item_pattern, link_pattern, blocked)).alias("pos", "p"))
    listed = listed.select("group_name", "pos", F.col("p.item").alias("name"), "p.url")
    matched = match_prefix(registry.select("entity_id", "group_name", "entity_name"), listed).select("entity_id", "url")
    rows = (
        registry.select("entity_id", "group_name")
        .join(pages.select("group_name", F.lit(True).alias("__page")), "group_name", "left")
        .join(cached.select("entity_id", F.lit(True).alias("__cached")), "entity_id", "left")
        .join(matched, "entity_id", "left")
    )
    status = (
        F.when(F.col("__page").isNull(), "group_page_fail")
        .when(F.col("__cached"), "cached")
        .when(F.col("url").isNull(), "no_match")
        .otherwise("ok")
    )
    return rows.select("entity_id", F.when(status == "ok", F.col("url")).otherwise(F.lit("")).alias("source_url"), status.alias("status"))
