"""Readers, writers, text helpers, registry matching, streams and the query contract."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecrec.functions import text
from vecrec.operators import registry
from vecrec.sources import sinks, tables
from vecrec.streaming import streams

import __spark_entry__ as entry


def test_text_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write('member_id,group_name,search_hint,extra\n m1 ,"G ""x""",,1\n,,h,2\nm2,H, own hint ,3,surplus\n')
    rows = {r.entity_id: r for r in tables.typed_registry(tables.read_text_table(spark, path, tables.REGISTRY_COLUMNS)).collect()}
    assert set(rows) == {"m1", "m2"}
    assert rows["m1"].search_hint == 'G "x"' and rows["m2"].search_hint == "own hint"


def test_files(spark, tmp_path):
    for e, names in (("a", ["2.jpg", "1.PNG", "x.txt"]), ("b", ["9.webp"])):
        os.makedirs(tmp_path / e)
        for n in names:
            (tmp_path / e / n).write_bytes(b"12345")
    files = tables.file_listing(spark, str(tmp_path))
    assert sorted((r.entity_id, r.file_name, r.bytes) for r in files.collect()) == [("a", "1.PNG", 5), ("a", "2.jpg", 5), ("b", "9.webp", 5)]
    assert {r.entity_id: r.path[-5:] for r in tables.first_file_per_entity(files).collect()} == {"a": "1.PNG", "b": ".webp"[-5:]}
    used = files.where("file_name = '2.jpg'")
    total = tables.prune_totals(tables.unreferenced_files(files, used)).first()
    assert (total.n_files, total.total_bytes) == (2, 10)


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).selectExpr("id", "id % 3 AS b")
    sinks.write_entity_partitions(df, path, "b")
    sinks.write_entity_partitions(df.where("b = 1").withColumn("id", F.col("id") + 100), path, "b")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 3, 5, 6, 8, 9, 101, 104, 107]


def test_keyed_update_and_append(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, k string, s string")
    out = sinks.update_keyed(df, df.where("id = 2"), ["id"], {"s": F.lit("curated")})
    assert {r.id: r.s for r in out.collect()} == {1: "x", 2: "curated"}
    more = spark.createDataFrame([(2, "b", "z"), (3, "c", "z")], "id long, k string, s string")
    assert [r.id for r in sinks.append_missing(df, more, "id").collect()] == [3]


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    "page, day",
    [("Debut Date : January 9, 2020", "2020-01-09"), ("debut date: 2021/3/4", "2021-03-04"), ("Debut Date: 5 Sept 2019", "2019-09-05"),
     ("they debuted on Dec 31, 2018 in", "2018-12-31"), ("Debut Date: 2021.13.40", None), ("Debut Date: Smarch 3, 2020", None)],
)
def test_dates(spark, page, day):
    got = one(spark, page, text.date_field)
    assert (str(got) if got else None) == day


def test_text_helpers(spark):
    html = "<script>x</script><p>A&nbsp;&amp;&#54620; b</p><style>q</style> &#99999999; end"
    assert one(spark, html, text.strip_html) == "A &한 b &#99999999; end"
    stage = "Stage Name: </span> Ann (앤) x Stage Name: Bo (보) Stage Name: Ann (앤)"
    assert [tuple(p) for p in one(spark, stage, lambda c: text.field_pairs(c, text.STAGE_PAIR, text.STAGE_ONLY))] == [("Ann", "앤"), ("Bo", "보")]
    assert [tuple(p) for p in one(spark, "Stage Name: Cy <b>", lambda c: text.field_pairs(c, text.STAGE_PAIR, text.STAGE_ONLY))] == [("Cy", "")]
    assert one(spark, "triples", text.slug_candidates) == ["triples-members-profile", "triples-profile", "triples-members", "triples", "tripless-members-profile"]
    assert one(spark, "ケイ / 케이", text.script_segment) == "케이"
    assert one(spark, "그룹 이름 얼굴", text.last_token) == "이름"
    assert one(spark, "/a b?x=1 2#f g", lambda c: text.quote_url(F.concat(F.lit("http://h.example"), c))) == "http://h.example/a%20b?x=1%202#f%20g"
    assert one(spark, "a/b_c/012_abc.d.jpg", text.stem_digest) == "abc.d"


def test_name_tiers(spark):
    reg = spark.createDataFrame(
        [("1", "G", "Yujin"), ("2", "G", "Kim Rei"), ("3", "G", "Lizz"), ("4", "G", "Nobody"), ("5", "G", "---")], "entity_id string, group_name string, entity_name string"
    )
    listed = spark.createDataFrame([("G", 0, "Ahn Yujin", "유진"), ("G", 1, "Rei", "레이"), ("G", 2, "Liz", "리즈"), ("H", 0, "Nobody", "")], "group_name string, pos int, name string, local string")
    got = {r.entity_id: (r.tier, r.new_name) for r in registry.match_names(reg, listed).collect()}
    assert got == {"1": (2, "Ahn Yujin"), "2": (3, "Rei"), "3": (4, "Liz")}
    links = listed.select("group_name", "pos", "name", F.concat(F.lit("u"), "pos").alias("url"))
    got = {r.entity_id: (r.tier, r.url) for r in registry.match_prefix(reg, links).collect()}
    assert got == {"3": (2, "u2")}


def test_containment_by_grams(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("ab한"), n))
    wholes = [("G" if i % 2 else "H", i, word(int(rng.integers(1, 14)))) for i in range(60)] + [("G", 60, word(10_000)), ("H", 61, "c" * 10_000)]
    parts = [("G" if i % 3 else "H", i, word(int(rng.integers(1, 7)))) for i in range(60)] + [("H", 60, "c" * 9_000), ("G", 61, wholes[60][2][4_000:5_000]), ("G", 62, "abz")]
    shape = "group_name string, id long, text string"
    frames = [spark.createDataFrame(rows, shape) for rows in (wholes, parts)]
    got = sorted((r.whole, r.part) for r in registry.containing(*frames).collect())
    assert got == sorted((w, p) for g, w, t in wholes for h, p, u in parts if g == h and u in t)
    listed = frames[0].where("id = 60").select(F.explode(registry.grams("text", range(1, 4))))
    assert listed.count() <= 3 + 9 + 27
    assert registry.containing(frames[0].limit(0), frames[1]).count() == 0


def test_name_tables_are_not_broadcast(spark):
    """Stored name tables compress well: by file size Spark would take any of them for small and collect it on the driver."""
    reg = spark.createDataFrame([(f"e{i}", f"g{i % 7}", f"name {i // 7}") for i in range(500)], "entity_id string, group_name string, entity_name string")
    listed = spark.createDataFrame([(f"g{i % 7}", i, f"a name {i // 7}x", "") for i in range(500)], "group_name string, pos int, name string, local string")
    matched = registry.match_names(reg, listed)
    assert matched.where("tier = 4").count() > 300
    texts = reg.selectExpr("group_name", "xxhash64(entity_id) AS id", "entity_name AS text")
    for found in (matched, registry.containing(texts, texts)):
        plan = found._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_name_changes_broadcast_nothing(spark, tmp_path):
    """Neither the registry diff nor its group-name swap sends a table of pages or names through the driver."""
    from vecrec.catalog import registered

    html = "".join(f'<a href="/u{i}">Name {i}</a>' for i in range(3))
    spark.createDataFrame([(i, f"http://h/en/{i}", html) for i in range(30)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for name in ("j13_registry_diff", "j13_group_swap"):
        found = registered()[0][name](spark, str(tmp_path))
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name


def test_preceding_link(spark):
    html = '<img src="u1"><h1>A</h1><img src="logo.png"><h1>B</h1><img src="u2"><h1>A</h1><h1>C</h1>'
    got = one(spark, html, lambda c: registry.preceding_links(c, "<h1>([^<]*)</h1>", 'src="([^"]*)"'))
    assert [tuple(p) for p in got] == [("A", "u1"), ("B", "u1"), ("C", "u2")]


def split_events(spark, sf, path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    again = events.where("event_id % 10 = 0")  # repeats that come in a later file
    for i, part in enumerate((events.where("event_id < 300"), events.where("event_id BETWEEN 300 AND 699"), events.where("event_id >= 700").unionByName(again))):
        part.coalesce(1).write.mode("append").parquet(path)
        del i
    return events


def test_streams_equal_batch(spark, sf, tmp_path):
    src = str(tmp_path / "in")
    events = split_events(spark, sf, src)
    stream = lambda: streams.file_stream(spark, src, events.schema, files_per_batch=1)
    out = str(tmp_path / "rows")
    streams.skip_processed(stream(), ["event_id"], "ts", out, str(tmp_path / "c1"))
    with pytest.raises(ValueError):  # its epochs would replace those written under the first checkpoint
        streams.skip_processed(stream(), ["event_id"], "ts", out, str(tmp_path / "other"))
    rows = spark.read.option("basePath", out).parquet(f"{out}/epoch=*")
    assert rows.where(F.pmod(F.xxhash64("event_id"), F.lit(streams.KEY_BUCKETS)) != F.col("bucket")).count() == 0
    rows = rows.drop("bucket")
    assert rows.count() == events.count() and rows.select("epoch").distinct().count() == 3
    clean = streams.file_stream(spark, out, rows.drop("epoch").schema, files_per_batch=64)
    v = "array(value, double(event_id % 7), 1D)"
    state = str(tmp_path / "state")
    streams.accumulate_moments(clean.select("user_id", F.expr(v).alias("v")), "user_id", "v", 3, state, str(tmp_path / "c2"))
    from vecrec.operators import aggregate

    want = {r.user_id: r for r in aggregate.mean_direction(events.select("user_id", F.expr(v).alias("v")), ["user_id"], "v", 3).collect()}
    got = {r.user_id: r for r in streams.current_vectors(spark, state, "user_id", 3).collect()}
    assert got.keys() == want.keys()
    assert all(got[k].n == want[k].n and got[k].vector == pytest.approx(want[k].vector) for k in want)
    streams.compact_moments(spark, state, "user_id", 3, str(tmp_path / "compact"))
    assert {r.user_id: r.n for r in streams.current_vectors(spark, str(tmp_path / "compact"), "user_id", 3).collect()} == {k: r.n for k, r in want.items()}
    counts = str(tmp_path / "counts")
    ids = clean.select(F.concat(F.lit("u"), "user_id").alias("entity_id"))
    streams.count_progress(ids, "entity_id", counts, str(tmp_path / "c3"))
    final = {r.entity_id: r.n for r in streams.counts_upto(spark, counts, "entity_id", 99).collect()}
    assert final == {f"u{r.user_id}": r["count"] for r in events.groupBy("user_id").count().collect()}
    people = spark.createDataFrame([("u1",), ("nobody",)], "entity_id string")
    report = {r.entity_id: r for r in streams.progress_between(spark, counts, people, 10**6, 0, 2).collect()}
    assert report["nobody"].given_up and not report["u1"].given_up and report["u1"].still_short


def test_watermark_dedupe(spark, sf, tmp_path):
    src = str(tmp_path / "in")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.unionByName(events.where("event_id % 3 = 0")).coalesce(1).write.parquet(src)
    s = streams.within_watermark(streams.file_stream(spark, src, events.schema), ["event_id"], "ts", "1 hour")
    out = str(tmp_path / "out")
    streams.run_available(s, lambda b, e: b.write.mode("overwrite").parquet(streams.epoch_path(out, e)), str(tmp_path / "c"))
    assert spark.read.parquet(f"{out}/epoch=*").count() == events.count()


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    out = entry.entry(spark)
    assert out.columns[:3] == ["request_id", "rank", "entity_id"] and out.count() > 0


@pytest.mark.parametrize("name", ["a03_outlier_trim", "l2_curation", "j06_knn_graph", "l4_intake_status", "p13_strip_html", "w04_group_cap"])
def test_queries_match_duckdb(spark, sf, name):
    import check_queries as check

    got = entry.queries()[name](spark, sf).toPandas()
    assert check.compare(got, check.duck(sf).execute(entry.oracle_sql()[name]).df()) == ""


def test_entities_are_decoded_once(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "&#xAC00;&#44033;": "\uac00\uac01", "&eacute;&apos;": "\u00e9'", "&none; & &#; &#xD800; &#0;": "&none; & &#; &#xD800; &#0;", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "html string").select("html", text.tags_to_text(F.col("html")).alias("txt")).collect()
    assert {r.html: r.txt for r in rows} == cases | {None: None}


def test_page_paths_follow_overrides(spark):
    rows = spark.createDataFrame([("Red Fox",), ("Blue-Owl!",), ("Owls",)], "name string")
    got = rows.select(text.page_path(F.col("name"), {"owls": "blue-owl"}, {"blue-owl": "blue-owl-profile"}).alias("p")).collect()
    assert [r.p for r in got] == ["red-fox-members-profile", "blue-owl-profile", "blue-owl-profile"]
