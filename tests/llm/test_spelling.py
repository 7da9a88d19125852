"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from vecrec.llm import spelling

WORDS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def counted(rows, min_length, every):
    out = Counter()
    for key, text in rows:
        body = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", body):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                out[run] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, ratio):
    best, many = {}, {}
    for w in counts:
        them = [v for v in counts if near(w, v)]
        many[w] = len(them)
        top = min(them, key=lambda v: (-counts[v], v), default=None)
        best[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while best[root] is not None:
            root = best[root]
        out.add((w, n, many[w], best[w], counts[best[w]] if best[w] is not None else None, root))
    return out


@pytest.mark.parametrize("partitions", ["1", "4", "23"])
def test_variants_equal_brute_force(spark, partitions):
    rng = random.Random(7)
    counts = Counter()
    for k in range(120):
        stem = "".join(rng.choice("aabé") for _ in range(rng.randint(1, 7)))
        for _ in range(8):
            counts[stem] += rng.choice([1, 2, 5, 30, 200])
            at = rng.randrange(len(stem) + 1)
            stem = rng.choice([stem[:at] + rng.choice("abéÿ") + stem[at:], stem[:at] + stem[at + 1 :] or "a", stem[:at] + "b" + stem[at + 1 :]])
    counts["x" * 30_000], counts["x" * 29_999], counts["x" * 30_000 + "y"] = 500, 3, 4
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = [tuple(r) for r in spelling.variants(spark.createDataFrame(list(counts.items()), WORDS), 5).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    short = {w: n for w, n in counts.items() if len(w) < 100}
    assert len(got) == len(counts)
    assert {r for r in got if len(r[0]) < 100} == brute(short, 5)
    long = {r[0]: r[1:] for r in got if len(r[0]) > 100}
    assert long["x" * 29_999] == (3, 1, "x" * 30_000, 500, "x" * 30_000) and long["x" * 30_000] == (500, 2, None, None, "x" * 30_000)


def test_batches_that_cut_groups(spark):
    counts = {f"abc{c}ef": 3 + k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")} | {"abcef": 900}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(r) for r in spelling.variants(spark.createDataFrame(list(counts.items()), WORDS)).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == brute(counts, 5)


def test_words_of_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for every in (0, 3, 199):
        got = Counter({r.word: r.n for r in spelling.count_words(odd_docs, "doc_id", "text", 4, every).collect()})
        assert got == counted(rows, 4, every)
    want = {w: n for w, n in counted(rows, 4, 3).items() if n >= 2}
    got = {tuple(r) for r in spelling.spelling_variants(odd_docs, min_length=4, min_count=2, ratio=2, typo_every=3).collect()}
    assert got == brute(want, 2)
    assert spelling.spelling_variants(no_docs).count() == 0


def test_query_equals_brute_force(spark, sf):
    from vecrec.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {w: n for w, n in counted(rows, 6, 199).items() if n >= 5}
    got = {tuple(r) for r in QUERIES["op11_spelling"](spark, sf).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert len(want) > 100 and got == brute(want, 5)
