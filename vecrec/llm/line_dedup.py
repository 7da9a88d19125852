"""Site-relative line dedup, in DataFrame functions only.

Pages are grouped by host; a line that stands in more than ``ratio`` of a host's pages, and in at least
``least`` of them, is boilerplate there and is dropped from all of them. Lines are compared trimmed.

Only (host, line hash) travels, pre-aggregated, so a hot host costs no more than others. A host whose pages
have m lines on average has at most m / ratio boilerplate lines, so they go to its pages as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecrec.llm.common import cut_lineage

RATIO, LEAST = 0.3, 3
#: Boilerplate of up to this many hosts is sent to every task; of more it is joined by a shuffle.
BROADCAST_HOSTS = 20_000
#: Tags that break lines (fixed values of the HTML standard).
BREAKS = "address|article|aside|blockquote|body|br|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host(url: Column) -> Column:
    """Lower-cased host of an absolute URL; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def page_text(html: Column) -> Column:
    """Text of a page with a line per block: scripts, styles and comments out, block tags to line ends, others out."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    broken = F.regexp_replace(bare, rf"(?i)</?(?:{BREAKS})(?:[\s/][^>]*)?>", "\n")
    return F.regexp_replace(broken, r"<[A-Za-z/!?][^>]*>", "")


def lines(text: Column) -> Column:
    """The trimmed lines of a text that are not blank, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")), lambda x: x != "")


def _name(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(site, dropped) from pages with columns ``site`` and ``body`` (lines): the line names over the ratio, per site."""
    known = pages.where(F.col("site").isNotNull())
    totals = known.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    named = known.select("site", F.explode(F.array_distinct(F.transform("body", _name))).alias("line"))
    held = named.groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    over = held.join(totals, "site").where(F.col("n") > ratio * F.col("pages"))
    return over.groupBy("site").agg(F.collect_list("line").alias("dropped"))


def drop_boilerplate(pages: DataFrame, url: str = "url", text: Column | None = None, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``pages`` with columns ``host``, ``n_lines``, ``n_dropped`` and ``kept_text`` (the lines left).

    ``text`` is the text column, by default that of the column ``html``. Null and empty pages have no
    lines; a page without a host belongs to no site and keeps all; repeated rows count as pages of their
    own; a line repeated in a page counts once; an empty table gives no rows. Columns of ``pages`` named
    like the new ones are replaced.
    """
    text = page_text(pages["html"]) if text is None else text
    marked = pages.withColumns({"__site": host(pages[url]), "__body": lines(text)})
    found = cut_lineage(boilerplate(marked.select(F.col("__site").alias("site"), F.col("__body").alias("body")), ratio, least)).toDF("__key", "__dropped")
    if found.count() <= BROADCAST_HOSTS:
        found = F.broadcast(found)
    joined = marked.join(found, F.col("__site") == F.col("__key"), "left")
    kept = F.when(F.col("__dropped").isNull(), F.col("__body")).otherwise(F.filter("__body", lambda x: ~F.array_contains(F.col("__dropped"), _name(x))))
    done = joined.withColumn("__kept", kept)
    new = {"host": F.col("__site"), "n_lines": F.size("__body").cast("bigint"), "n_dropped": (F.size("__body") - F.size("__kept")).cast("bigint"), "kept_text": F.array_join("__kept", "\n")}
    return done.select(*[done[c] for c in pages.columns if c not in new], *[c.alias(n) for n, c in new.items()])
