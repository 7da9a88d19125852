"""Toxic spans: the field against enumeration, the fit against differences, scores on held-out and odd texts."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tests.llm.conftest import prose

from vecrec.llm import toxicity as tx

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType())])


def enumerated(gaps, weights, moves):
    """Marginals, log Z and expected transitions by all taggings."""
    rise, fall, stay = moves
    emit = []
    for k, g in enumerate(gaps):
        emit += [0.0] * g + ([weights[k]] if k < len(weights) else [])
    at = [i for i, _ in enumerate(emit) if i in np.cumsum([g + 1 for g in gaps[:-1]]) - 1]
    total, hits, steps = 0.0, np.zeros(len(emit)), np.zeros(3)
    for tags in itertools.product((0, 1), repeat=len(emit)):
        score, seen = 0.0, np.zeros(3)
        for before, now, e in zip((0, *tags), tags, emit):
            score += e * now + {(0, 1): rise, (1, 0): fall, (1, 1): stay}.get((before, now), 0.0)
            if (before, now) != (0, 0):
                seen[{(0, 1): 0, (1, 0): 1, (1, 1): 2}[before, now]] += 1
        weight = math.exp(score)
        total += weight
        hits += weight * np.array(tags)
        steps += weight * seen
    return (hits / total)[at], math.log(total), steps / total


def test_chain_equals_enumeration():
    rng = random.Random(3)
    for _ in range(60):
        moves = [rng.uniform(-3, 1) for _ in range(3)]
        n = rng.randint(0, 4)
        gaps = [rng.choice([0, 0, 1, 2, 3]) for _ in range(n + 1)]
        weights = [rng.uniform(-2, 4) for _ in range(n)]
        steps = [0.0, 0.0, 0.0]
        found, log_z = tx.Chain(*moves).marginals(gaps, weights, steps)
        want, want_z, want_steps = enumerated(gaps, weights, moves)
        np.testing.assert_allclose(found, want, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(steps, want_steps, rtol=1e-8, atol=1e-12)
        assert math.isclose(log_z, want_z, rel_tol=1e-9, abs_tol=1e-9)


def test_long_plain_stretches_equal_single_steps():
    chain = tx.Chain(-4.0, -1.0, -2.0)
    one = chain.marginals([5000, 40, 70_000], [3.0, 1.0])
    many = chain.marginals([0] * 5000 + [0] + [0] * 40 + [0] + [0] * 70_000 + [0], [0.0] * 5000 + [3.0] + [0.0] * 40 + [1.0] + [0.0] * 70_000)
    np.testing.assert_allclose(one[0], [many[0][5000], many[0][5041]], rtol=1e-7)
    assert math.isclose(one[1], many[1], rel_tol=1e-9)


def test_slope_equals_differences(spark):
    rng = random.Random(5)
    rows = []
    for k in range(30):
        n = rng.randint(0, 4)
        held = [[rng.randrange(6) for _ in range(rng.randint(1, 2))] for _ in range(n)]
        rows.append((k % 3 == 0, [rng.randint(0, 3) for _ in range(n + 1)], [len(h) for h in held], [f for h in held for f in h]))
    packed = spark.createDataFrame([(int(t), *r) for t, *r in rows], "toxic int, gaps array<int>, sizes array<int>, held array<int>")
    at = np.array([-2.0, -0.5, 0.3, 1.0, -1.0, 0.5, 2.0, 0.1, 0.7])

    def likelihood(at):
        out = 0.0
        for toxic, gaps, sizes, held in rows:
            if toxic and not sizes:
                continue
            ends = np.cumsum([0, *sizes])
            weights = [sum(at[3 + f] for f in held[a:b]) for a, b in itertools.pairwise(ends)]
            out -= tx.Chain(*at[:3]).marginals(gaps, weights)[1]
            if toxic:
                out += sum(weights) + at[0]
                out += sum(at[2] if g == 0 else at[0] + at[1] for g in gaps[1:-1]) + (at[1] if gaps[-1] else 0.0)
        return out

    slope = tx._slope(packed, at)
    for k in range(len(at)):
        step = np.zeros(len(at))
        step[k] = 1e-5
        assert math.isclose(slope[k], (likelihood(at + step) - likelihood(at - step)) / 2e-5, rel_tol=1e-4, abs_tol=1e-4)


def planted(spark, n=400):
    """Texts with insulting words in a tenth; of half of those copies with one word changed, so that their plain words recur."""
    rng = random.Random(11)
    docs, labels = [], []
    for k in range(n):
        toxic = k % 10 == 3
        body = prose(k if k % 20 else 7, 60 + k % 200).split(" ")
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(["zzgrob", "qqmies", "zzgrobes"]))
        docs.append((k, " ".join(body)))
        labels.append((k, int(toxic)))
    copies = [(10_000 + k, docs[13][1] + f" tail{k}") for k in range(60)]
    return (
        spark.createDataFrame(docs + copies + [(99_991, None), (99_992, ""), (99_993, "1 2 3 !"), (None, "zzgrob qqmies zzgrob")], "doc_id bigint, text string"),
        spark.createDataFrame(labels + [(k, 1) for k, _ in copies] + [(3, 0), (99_991, 1), (None, 1), (7, None)], LABELS),
    )


def test_planted_words_are_found_and_plain_texts_left_alone(spark):
    docs, labels = planted(spark)
    got = {r.doc_id: r for r in tx.toxicity(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        insulted = any(w in (texts[k] or "") for w in ("zzgrob", "qqmies"))
        assert r.predicted == int(insulted), (k, r)
        marked = {w for s in r.spans for w in tx.WORD.findall(texts[k][s.begin : s.end])}
        assert marked == {w for w in tx.WORD.findall(texts[k] or "") if w.startswith(("zzgrob", "qqmies"))}
    assert len(got) == len(texts) and got[None].held_out is False
    held = {r.doc_id for r in docs.select("doc_id").where(tx.held_out(F.col("doc_id"))).collect()}
    assert {k for k, r in got.items() if r.held_out} == held


def test_held_out_accuracy(spark, sf):
    from vecrec.llm.queries import QUERIES

    sf = sf.replace("0.001", "0.01")
    found = QUERIES["op13_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in found)
    assert right >= 0.93 * len(found)


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(20, 0), (22, 1), (None, 1)], LABELS)
    extra = labels.select("doc_id", "toxic", F.lit("x").alias("text"), F.lit(1).alias("key"))
    got = tx.toxicity(odd_docs, extra).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    again = tx.toxicity(odd_docs, extra.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert tx.toxicity(no_docs, extra).count() == 0
    nothing = tx.toxicity(odd_docs, spark.createDataFrame([], LABELS))
    assert nothing.count() == odd_docs.count() and nothing.where("predicted = 1").count() == 0
    assert tx.labelled_texts(odd_docs, extra, "doc_id", "text", "toxic", 0).count() == tx.labelled_texts(odd_docs, extra, "doc_id", "text", "toxic").count()
