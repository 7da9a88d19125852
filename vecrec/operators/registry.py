"""Registry maintenance from pages: page lookup, as-of pairs, name matching, intake, override precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecrec.functions import text
from vecrec.session import cut_lineage

#: Characters of the grams under which texts are listed for containment.
GRAM = 3


def preceding_links(html: Column, item_pattern: str, link_pattern: str, blocked: tuple[str, ...] = text.BLOCKED_SUBSTRINGS) -> Column:
    """``array<struct<item, url>>``: each first-seen item with the nearest earlier link that is not blocked.

    The page is tokenised once by a joint pattern, so order in the token list is order on the page. Both
    sides live in one row: the as-of pairing needs no shuffle. ``item_pattern``/``link_pattern`` have one group.
    """
    both = f"(?:{item_pattern})|(?:{link_pattern})"
    items = F.regexp_extract_all(html, F.lit(both), F.lit(1))
    links = F.regexp_extract_all(html, F.lit(both), F.lit(2))
    tokens = F.zip_with(items, links, lambda a, b: F.struct(F.trim(a).alias("item"), b.alias("url")))
    usable = lambda t: (t["url"] != "") & ~text.is_blocked(t["url"], blocked)
    placed = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t["item"].alias("item"), F.when(usable(t), t["url"]).alias("url")))
    # running last usable link, in one fold over the tokens: state = (last url, pairs)
    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<struct<item:string,url:string>>").alias("pairs"))
    folded = F.aggregate(
        placed,
        start,
        lambda s, t: F.struct(
            F.coalesce(t["url"], s["last"]).alias("last"),
            F.when(t["item"] != "", F.concat(s["pairs"], F.array(F.struct(t["item"].alias("item"), s["last"].alias("url")))))
            .otherwise(s["pairs"])
            .alias("pairs"),
        ),
        lambda s: s["pairs"],
    )
    return F.filter(text.first_of_each(folded, "item"), lambda p: p["url"].isNotNull())


def match_names(registry: DataFrame, listed: DataFrame) -> DataFrame:
    """Best listed name per registry row of the same group.

    Tiers: equal; listed last token equal; registry last token equal to the listed name; either contains
    the other (empty forms never match). Within a tier the earliest list position wins.
    ``registry(entity_id, group_name, entity_name)``, ``listed(group_name, pos, name, local)``.

    Tiers 1-3 are one equi-join on the form. Only rows they leave open reach the substring tier. Both inputs
    are stored first, so pages behind the list are parsed once. Joins are shuffled by hint: the stored tables are as long as the
    pages' lists but compress well, and their file size would have Spark broadcast them through the driver.
    """
    last = lambda c: F.try_element_at(F.split(F.trim(c), r"\s+"), F.lit(-1))
    rows = cut_lineage(
        registry.withColumn("target", text.name_form(F.col("entity_name"))).withColumn("target_last", text.name_form(last(F.col("entity_name"))))
    )
    names = cut_lineage(
        listed.select(
            "group_name", text.name_form(F.col("name")).alias("form"), text.name_form(last(F.col("name"))).alias("form_last"),
            F.struct("pos", "name", "local").alias("hit"),
        )
    )
    asked = rows.select(
        "entity_id", "group_name",
        F.inline(F.expr("array(struct(1 AS tier, 'whole' AS side, target AS key), struct(2 AS tier, 'last' AS side, target AS key), struct(3 AS tier, 'whole' AS side, target_last AS key))")),
    )
    offered = names.select("group_name", "hit", F.inline(F.expr("array(struct('whole' AS side, form AS key), struct('last' AS side, form_last AS key))")))
    offered = offered.where(F.col("key") != "").groupBy("group_name", "side", "key").agg(F.min("hit").alias("hit"))
    exact = asked.join(_shuffled(offered), ["group_name", "side", "key"]).groupBy("entity_id").agg(F.min(F.struct("tier", "hit")).alias("m"))
    exact = cut_lineage(exact)
    # Substring tier: both directions through the gram index. The ids are stored with their texts.
    forms = cut_lineage(
        names.where(F.col("form") != "").groupBy("group_name", "form").agg(F.min("hit").alias("hit")).withColumn("form_id", F.monotonically_increasing_id())
    )
    open_rows = cut_lineage(rows.join(_shuffled(exact.select("entity_id")), "entity_id", "left_anti").where(F.col("target") != "").select("entity_id", "group_name", "target"))
    targets = cut_lineage(open_rows.select("group_name", "target").distinct().withColumn("target_id", F.monotonically_increasing_id()))
    hits = forms.select("form_id", "hit")
    t, f = targets.select("group_name", F.col("target_id").alias("id"), F.col("target").alias("text")), forms.select("group_name", F.col("form_id").alias("id"), F.col("form").alias("text"))
    within = containing(t, f).select(F.col("whole").alias("target_id"), F.col("part").alias("form_id"))
    around = containing(f, t).select(F.col("part").alias("target_id"), F.col("whole").alias("form_id"))
    best = within.unionByName(around).join(_shuffled(hits), "form_id").groupBy("target_id").agg(F.min("hit").alias("hit"))
    told = targets.join(_shuffled(best), "target_id").select("group_name", "target", "hit")
    loose = open_rows.join(_shuffled(told), ["group_name", "target"]).select("entity_id", "hit")
    both = exact.unionByName(loose.select("entity_id", F.struct(F.lit(4).alias("tier"), "hit").alias("m")))
    return rows.join(_shuffled(both), "entity_id").select(
        *registry.columns, F.col("m.tier").alias("tier"), F.col("m.hit.name").alias("new_name"), F.col("m.hit.local").alias("new_local")
    )


def _shuffled(table: DataFrame) -> DataFrame:
    """``table`` for a join that is not to broadcast it, whatever its size is taken for."""
    return table.hint("merge")


def grams(column: str, sizes: range) -> Column:
    """The distinct substrings of the given lengths, each length in one pass over the text."""
    of = ", ".join(
        f"if(length({column}) >= {q}, transform(sequence(1, length({column}) - {q - 1}), i -> substring({column}, i, {q})), cast(array() AS array<string>))" for q in sizes
    )
    return F.expr(f"array_distinct(concat({of}))")


def containing(wholes: DataFrame, parts: DataFrame, key: str = "group_name", size: int = GRAM) -> DataFrame:
    """``(whole, part)``: ids of all pairs of a key where the text of a whole contains that of a part.

    Both inputs are ``(key, id, text)`` with texts that are not empty. Every whole is listed under its distinct
    grams of up to ``size`` characters, so a text of L characters makes at most ``size`` x L rows. A part asks under
    one gram only: the rarest of its own, or itself if it is shorter; a part with a gram that no whole has
    is dropped before the join. What meets is verified on the texts.
    """
    listed = wholes.select(key, F.col("id").alias("whole"), F.explode(grams("text", range(1, size + 1))).alias("gram"))
    own = F.when(F.length("text") < size, F.array("text")).otherwise(grams("text", range(size, size + 1)))
    asked = parts.select(key, F.col("id").alias("part"), own.alias("own")).select(key, "part", F.size("own").alias("n"), F.explode("own").alias("gram"))
    counts = listed.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("wholes"))
    rare = (
        asked.join(_shuffled(counts), [key, "gram"])
        .groupBy(key, "part").agg(F.min(F.struct("wholes", "gram")).alias("rare"), F.count(F.lit(1)).alias("found"), F.max("n").alias("n"))
        .where("found = n")
        .select(key, "part", F.col("rare.gram").alias("gram"))
    )
    met = rare.join(_shuffled(listed), [key, "gram"]).select("whole", "part")
    text_of = lambda t, name: t.select(F.col("id").alias(name), F.col("text").alias(f"{name}_text"))
    return met.join(_shuffled(text_of(wholes, "whole")), "whole").join(_shuffled(text_of(parts, "part")), "part").where(F.contains("whole_text", "part_text")).select("whole", "part")


def prefixes(column: str) -> Column:
    return F.expr(f"transform(sequence(1, length({column})), n -> substring({column}, 1, n))")


def match_prefix(registry: DataFrame, listed: DataFrame) -> DataFrame:
    """Variant with two tiers: equal alphanumeric form, else one is a prefix of the other."""
    rows = registry.withColumn("target", text.alnum_form(F.col("entity_name"))).where(F.col("target") != "")
    names = listed.withColumn("form", text.alnum_form(F.col("name"))).where(F.col("form") != "")
    forms = names.groupBy("group_name", "form").agg(F.min(F.struct("pos", "url")).alias("hit"))
    begun = forms.select("group_name", "form", "hit", F.explode(prefixes("form")).alias("target"))
    begun = begun.groupBy("group_name", "target").agg(F.min(F.struct(F.when(F.col("form") == F.col("target"), 1).otherwise(2).alias("tier"), "hit")).alias("m"))
    longer = rows.select("entity_id", "group_name", "target", F.explode(prefixes("target")).alias("form")).join(forms, ["group_name", "form"])
    tier = F.when(F.col("form") == F.col("target"), 1).otherwise(2).alias("tier")
    found = rows.join(begun, ["group_name", "target"]).select("entity_id", "m").unionByName(longer.select("entity_id", F.struct(tier, "hit").alias("m")))
    best = found.groupBy("entity_id").agg(F.min("m").alias("m"))
    return rows.join(best, "entity_id").select(*registry.columns, F.col("m.tier").alias("tier"), F.col("m.hit.url").alias("url"))


def first_existing_page(groups: DataFrame, pages: DataFrame, name: str, key: str, marker: str | None = None) -> DataFrame:
    """First page, in candidate order, that exists and contains the marker.

    ``groups(.., candidates array)`` joins ``pages(key, ..)`` on the candidate; one row per group is left.
    """
    ranked_keys = groups.select(name, F.posexplode("candidates").alias("pos", key))
    usable = pages.where(F.contains("html", F.lit(marker))) if marker else pages
    hits = ranked_keys.join(usable.select(key, "page_id"), key)
    best = hits.groupBy(name).agg(F.min(F.struct("pos", "page_id", key)).alias("b"))
    return best.select(name, F.col("b.pos").alias("pos"), F.col("b.page_id").alias("page_id"), F.col(f"b.{key}").alias(key))


def name_changes(matched: DataFrame, hint_suffix: str = text.FACE_SUFFIX) -> DataFrame:
    """Old and new name and hint of matched rows where something changes. ``matched`` may carry ``group_local``."""
    old = text.last_token(F.col("search_hint"), hint_suffix)
    hint = F.when(F.col("new_local") != "", text.replace_first(F.col("search_hint"), old, F.col("new_local"))).otherwise(F.col("search_hint"))
    if "group_local" in matched.columns:
        swap = (F.coalesce("group_local", F.lit("")) != "") & (F.col("group_name") != "")
        hint = F.when(swap, F.replace(hint, F.col("group_name"), F.col("group_local"))).otherwise(hint)
    renamed = text.name_form(F.col("new_name")) != text.name_form(F.col("entity_name"))
    rows = matched.withColumn("new_search_hint", hint).withColumn("new_entity_name", F.when(renamed, F.col("new_name")).otherwise(F.col("entity_name")))
    return rows.where(renamed | (F.col("new_search_hint") != F.col("search_hint"))).select(
        "entity_id", F.col("entity_name").alias("old_entity_name"), "new_entity_name", F.col("search_hint").alias("old_search_hint"), "new_search_hint"
    )


def resolve_precedence(groups: DataFrame, cached: DataFrame, manual: DataFrame, derived: DataFrame) -> DataFrame:
    """Value and its provenance: cached, then manual, then derived from the page, else ambiguous or failed.

    All inputs are ``(group_name, segment)``; a group absent from ``derived`` had no page.
    """
    def named(df: DataFrame, out: str) -> DataFrame:
        return df.select("group_name", F.col("segment").alias(out))

    rows = groups.select("group_name").distinct()
    for df, out in ((cached, "__c"), (manual, "__m"), (derived, "__d")):
        rows = rows.join(named(df, out), "group_name", "left")
    return rows.select(
        "group_name",
        F.coalesce("__c", "__m", "__d", F.lit("")).alias("segment"),
        F.when(F.col("__c").isNotNull(), "cached").when(F.col("__m").isNotNull(), "manual_override")
        .when(F.col("__d") != "", "downloaded").when(F.col("__d") == "", "ambiguous").otherwise("fetch_fail").alias("status"),
    )


def intake_status(
    groups: DataFrame, pages: DataFrame, known_groups: DataFrame, blacklist: DataFrame, today: str, members: Column, page_key: str = "url_key", marker: str | None = None
) -> DataFrame:
    """Status cascade per candidate group, with the extracted member list for ``added``.

    ``groups(group_name, debut_year, candidates)``; ``pages(page_key, page_id, html)``. The page HTML joins
    once, after the page has been chosen by key alone.
    """
    found = first_existing_page(groups, pages, "group_name", page_key, marker).select("group_name", "page_id")
    rows = (
        groups.drop("candidates")
        .join(known_groups.select("group_name").distinct().withColumn("__known", F.lit(True)), "group_name", "left")
        .join(blacklist.select("group_name").distinct().withColumn("__black", F.lit(True)), "group_name", "left")
        .join(found, "group_name", "left")
        .join(pages.select("page_id", "html"), "page_id", "left")
    )
    flags = text.page_flags(text.page_text(F.col("html")))
    debut = text.date_field(F.col("html"))
    day = F.to_date(F.lit(today))
    rows = rows.withColumn("debut", debut).withColumn("members", members)
    status = (
        F.when(F.col("__known"), "skip_existing")
        .when(F.col("__black"), "blacklisted")
        .when(F.col("page_id").isNull(), "not_found")
        .when(flags["disbanded"], "disbanded")
        .when(flags["virtual"], "virtual")
        .when(flags["project"], "project")
        .when(flags["unit"], "unit")
        .when(F.col("debut") > day, "not_debuted")
        .when(F.col("debut").isNull() & (F.col("debut_year") > F.year(day)), "not_debuted")
        .when(F.size("members") <= 0, "no_members")
        .otherwise("added")
    )
    return rows.withColumn("status", status).drop("html", "__known", "__black")


def intake_rows(statuses: DataFrame, existing_ids: DataFrame) -> DataFrame:
    """New registry rows of ``added`` groups: id, names and search hint; ids already known are skipped."""
    rows = statuses.where("status = 'added'").select("group_name", F.explode("members").alias("m")).select("group_name", "m.name", "m.local")
    rows = rows.withColumn("entity_id", text.entity_id(F.col("group_name"), F.col("name")))
    rows = rows.withColumn("search_hint", F.concat(F.lit('"'), "group_name", F.lit('" '), F.when(F.col("local") != "", F.col("local")).otherwise(F.col("name"))))
    first = rows.groupBy("entity_id").agg(F.min(F.struct("group_name", "name", "search_hint")).alias("r"))
    return first.join(existing_ids.select("entity_id").distinct(), "entity_id", "left_anti").select(
        "entity_id", "r.group_name", F.col("r.name").alias("entity_name"), "r.search_hint"
    )


def round_progress(lacking: DataFrame, before: DataFrame, after: DataFrame, minimum: int, given_up: DataFrame | None = None) -> DataFrame:
    """After a round: count of each lacking entity, whether it is still short, and whether it made no progress.

    ``lacking(entity_id)``; ``before``/``after(entity_id, n)``. Entities given up earlier take no part.
    """
    rows = lacking.select("entity_id")
    if given_up is not None:
        rows = rows.join(given_up.select("entity_id"), "entity_id", "left_anti")
    rows = rows.join(before.select("entity_id", F.col("n").alias("b")), "entity_id", "left").join(
        after.select("entity_id", F.col("n").alias("a")), "entity_id", "left"
    )
    b, a = F.coalesce("b", F.lit(0)).cast("bigint"), F.coalesce("a", F.lit(0)).cast("bigint")
    return rows.select("entity_id", b.alias("n_before"), a.alias("n_after"), (a < minimum).alias("still_short"), (a <= b).alias("given_up"))
