"""Toxic spans by a linear-chain conditional random field over the words of a text.

1. Evidence: of all labelled training texts, how many toxic and clean ones hold each word, and in how many
   surroundings (the words before it, in 64 classes) the toxic ones do, so that copies of one text count as
   one. Words add up to their features: the word, its beginnings and its endings. Features far more
   frequent in toxic texts, in several surroundings, are kept.
2. Labelled tokens: in a toxic text the words with such a feature are toxic (T), all others clean (O); in a
   clean text all are clean. Toxic texts without such a word explain nothing and are left out.
3. The field has a weight per feature for T and one per transition (O-T, T-O, T-T; O-O is zero). It is fitted
   to the token labels of a sample of documents, of ``TRAIN_DOCS`` at most, by full-gradient steps; each
   step is one Spark job that sums the gradients of the parts.
4. Forward-backward gives each word's marginal of T. Their sum over a document, as surprise that none is T,
   their maximum and the number of words give its score, by a logistic curve fitted to the labels of the
   same sample; runs of marginals of 0.5 or more are its spans.

Words without a feature have no weight, so stretches of them are powers of the transition matrix, taken
from its two eigenvalues: exact, and a long clean text costs little more than reading it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecrec.llm.common import batched, cut_lineage, rows_of

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS, ENDINGS = (3, 4, 5), (4, 5)
#: A feature is kept if it is so many times more frequent in toxic texts, with such a log-likelihood ratio, in so many surroundings.
MIN_ODDS, MIN_RATIO, MIN_AROUND = 8.0, 30.0, 4
MAX_FEATURES = 20_000
#: Bound of the sample of labelled documents the field is fitted to, steps of the fit, and the weight of the squared weights.
TRAIN_DOCS, STEPS, RIDGE = 12_000, 30, 0.02
#: Labels of up to so many documents are broadcast (about 16 bytes each).
BROADCAST_LABELS = 2_000_000
HELD_WORDS, HELD_BYTES = 200_000, 64 << 20
TOXIC = 0.3


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k), *("$" + word[-k:] for k in ENDINGS if len(word) > k)]


class Chain:
    """Two tags from a clean start: weights of O-T, T-O and T-T, and per token a weight of T."""

    def __init__(self, rise: float, fall: float, stay: float) -> None:
        self.rise, self.fall, self.stay = math.exp(rise), math.exp(fall), math.exp(stay)
        spread = math.sqrt((1 - self.stay) ** 2 + 4 * self.rise * self.fall)
        self.first, self.second = (1 + self.stay + spread) / 2, (1 + self.stay - spread) / 2
        a, b = self.first, self.second
        # M^k = a^k * one + b^k * two
        self.one = ((1 - b) / spread, self.rise / spread, self.fall / spread, (self.stay - b) / spread)
        self.two = ((a - 1) / spread, -self.rise / spread, -self.fall / spread, (a - self.stay) / spread)
        self.spread, self.ratio, self.log_first = spread, b / a, math.log(a)

    def power(self, k: int) -> tuple[float, float, float, float]:
        """M^k / first^k, by rows."""
        r = self.ratio**k
        return tuple(x + r * y for x, y in zip(self.one, self.two, strict=True))

    def marginals(self, gaps: list[int], weights: list[float], moves: list[float] | None = None) -> tuple[list[float], float]:
        """P(T) of each weighted token, with ``gaps[i]`` plain tokens before token i and ``gaps[-1]`` after the last; and log Z.

        Expected numbers of O-T, T-O and T-T are added to ``moves``.
        """
        rise, fall, stay = self.rise, self.fall, self.stay
        odds = [math.exp(min(50.0, w)) for w in weights]
        powers = {k: self.power(k) for k in set(gaps)}
        ahead: list[tuple[float, float]] = [(1.0, 0.0)]  # before each step, scaled
        log_z = 0.0
        for k, gap in enumerate(gaps):
            x, y = ahead[-1]
            if gap:
                m00, m01, m10, m11 = powers[gap]
                x, y = x * m00 + y * m10, x * m01 + y * m11
                log_z += gap * self.log_first
            scale = x + y
            x, y = x / scale, y / scale
            log_z += math.log(scale)
            ahead.append((x, y))
            if k < len(odds):
                x, y = x + y * fall, (x * rise + y * stay) * odds[k]
                scale = x + y
                x, y = x / scale, y / scale
                log_z += math.log(scale)
                ahead.append((x, y))
        u, v = 1.0, 1.0  # after each step, scaled
        found = [0.0] * len(odds)
        for k in range(len(gaps) - 1, -1, -1):
            if k < len(odds):
                x, y = ahead[2 * k + 2]
                found[k] = y * v / (x * u + y * v)
                x, y = ahead[2 * k + 1]
                v *= odds[k]
                if moves is not None:
                    total = x * (u + rise * v) + y * (fall * u + stay * v)
                    for j, part in enumerate((x * rise * v, y * fall * u, y * stay * v)):
                        moves[j] += part / total
                u, v = u + rise * v, fall * u + stay * v
                scale = u + v
                u, v = u / scale, v / scale
            if gap := gaps[k]:
                x, y = ahead[2 * k]
                m00, m01, m10, m11 = powers[gap]
                if moves is not None:
                    self._within(gap, x, y, u, v, x * (m00 * u + m01 * v) + y * (m10 * u + m11 * v), moves)
                u, v = m00 * u + m01 * v, m10 * u + m11 * v
                scale = u + v
                u, v = u / scale, v / scale
        return found, log_z

    def _within(self, gap: int, x: float, y: float, u: float, v: float, total: float, moves: list[float]) -> None:
        """Adds the expected transitions of a stretch: sums of M^j before and M^(gap-1-j) after each."""
        (a, b, c, d), (e, f, g, h) = self.one, self.two
        left = ((x * a + y * c, x * b + y * d), (x * e + y * g, x * f + y * h))
        right = ((a * u + b * v, c * u + d * v), (e * u + f * v, g * u + h * v))
        same = gap / self.first
        mixed = (1 - self.ratio**gap) / self.spread
        last = gap * self.ratio ** (gap - 1) / self.first
        times = ((same, mixed), (mixed, last))
        for j, (p, q, weight) in enumerate(((0, 1, self.rise), (1, 0, self.fall), (1, 1, self.stay))):
            moves[j] += weight * sum(times[s][t] * left[s][p] * right[t][q] for s in (0, 1) for t in (0, 1)) / total


class _Weights(dict):
    """Weight of T per word as written; remembers a bounded number of words."""

    def __init__(self, of: dict[str, float]) -> None:
        self.of = of

    def __missing__(self, word: str) -> float:
        found = sum(self.of.get(f, 0.0) for f in features(word.lower()))
        if len(self) < HELD_WORDS:
            self[word] = found
        return found


@dataclass
class Model:
    weights: dict[str, float]
    moves: tuple[float, float, float]  # O-T, T-O, T-T
    scores: tuple[float, ...]  # of aggregate()

    def tagger(self) -> _Tagger:
        return _Tagger(_Weights(self.weights), Chain(*self.moves), self.scores)


@dataclass
class _Tagger:
    weights: _Weights
    chain: Chain
    scores: tuple[float, ...]

    def score(self, marginals: list[float], words: int) -> float:
        at = sum(w * x for w, x in zip(self.scores, aggregate(marginals, words), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, at))))

    def __call__(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score and spans (first code point, end, largest marginal)."""
        words = WORD.findall(text) if text else []
        weight = np.fromiter(map(self.weights.__getitem__, words), np.float64, len(words))
        at = np.flatnonzero(weight)
        if not len(at):
            return self.score([], len(words)), []
        gaps = (np.diff(np.concatenate([[-1], at, [len(words)]])) - 1).tolist()
        marginals, _ = self.chain.marginals(gaps, weight[at].tolist())
        spans: list[tuple[int, int, float]] = []
        toxic = {k: m for k, m in zip(at.tolist(), marginals, strict=True) if m >= 0.5}
        if toxic:
            before = None
            for k, match in enumerate(WORD.finditer(text)):
                if k in toxic:
                    if before == k - 1:
                        begin, _, top = spans.pop()
                        spans.append((begin, match.end(), max(top, toxic[k])))
                    else:
                        spans.append((match.start(), match.end(), toxic[k]))
                    before = k
        return self.score(marginals, len(words)), spans


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """(key, text, toxic) of documents with a label; of several labels of a key the largest."""
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("toxic")).where("key IS NOT NULL AND toxic IS NOT NULL")
    known = cut_lineage(known.groupBy("key").agg(F.max("toxic").alias("toxic")))
    if known.count() <= broadcast_labels:
        known = F.broadcast(known)
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).where("text IS NOT NULL").join(known, "key")


def _kinds(word: Column) -> Column:
    """:func:`features` as a column."""
    size = F.char_length(word)
    cut = [F.when(size > k, F.concat(F.lit(sign), side(word, F.lit(k)))) for sign, side, ks in (("^", F.left, BEGINNINGS), ("$", F.right, ENDINGS)) for k in ks]
    return F.array_compact(F.array(F.concat(F.lit("="), word), *cut))


def evidence(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean, around): of (text, toxic), texts that hold each feature's words, summed over words, and surroundings."""
    shape = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64()), ("around", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        size = 0

        def parts() -> Iterator[pa.RecordBatch]:
            yield from batched(((w, *x) for w, x in held.items()), shape)

        for body, toxic in rows_of(batches, "text", "toxic"):
            words = WORD.findall(body.lower())
            if toxic:
                seen: dict[str, int] = {}
                before = 0
                for word in words:
                    seen[word] = seen.get(word, 0) | 1 << before
                    before = sum(word.encode()) % 64
                for word, bits in seen.items():
                    got = held.setdefault(word, [0, 0, 0])
                    got[0] += 1
                    got[2] |= bits - (1 << 64) if bits >> 63 else bits
            else:
                for word in set(words):
                    held.setdefault(word, [0, 0, 0])[1] += 1
            size += len(body)
            if len(held) > HELD_WORDS or size > HELD_BYTES:
                yield from parts()
                held, size = {}, 0
        yield from parts()

    counted = rows.mapInArrow(run, "word string, toxic bigint, clean bigint, around bigint")
    counted = counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("around").alias("around"))
    listed = counted.select(F.explode(_kinds(F.col("word"))).alias("feature"), "toxic", "clean", "around")
    return listed.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_count(F.bit_or("around")).alias("around"))


def toxic_features(rows: DataFrame, most: int = MAX_FEATURES) -> list[str]:
    """Features of toxic texts, the surest first, then the words that have one, the most frequent first; ``most`` of either at most."""
    found = cut_lineage(evidence(rows))
    totals = found.where("startswith(feature, '=')").agg(F.sum("toxic"), F.sum("clean")).first()
    sums = [float(x or 0) for x in totals]
    # as many toxic texts as there were surroundings, so that copies of a text are one; the classes count up to some 250
    classes = F.when(F.col("around") < 64, -64 * F.log(1 - F.col("around") / 64))
    toxic, clean = F.least(F.col("toxic").cast("double"), classes), F.col("clean").cast("double")
    odds = ((toxic + 0.5) / (sums[0] + 1)) / ((clean + 0.5) / (sums[1] + 1))

    def part(n: Column, share: float) -> Column:
        return F.when(n > 0, n * F.log(n / ((toxic + clean) * F.lit(max(share, 1e-12))))).otherwise(0.0)

    all_ = max(1.0, sum(sums))
    ratio = 2 * (part(toxic, sums[0] / all_) + part(clean, sums[1] / all_))
    kept = found.where((odds >= MIN_ODDS) & (F.col("around") >= MIN_AROUND)).withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO)
    sure = [r[0] for r in kept.orderBy(F.desc("ratio"), "feature").limit(most).select("feature").collect()]
    of_sure = F.broadcast(found.sparkSession.createDataFrame([(f,) for f in sure], "kind string"))  # at most ``most`` rows
    words = found.where("startswith(feature, '=') AND toxic + clean >= 4").withColumn("kind", F.explode(_kinds(F.expr("substr(feature, 2)"))))
    words = words.join(of_sure, "kind", "left_semi").select("feature", "toxic", "clean").distinct().orderBy(F.desc(F.col("toxic") + F.col("clean")), "feature").limit(most)
    return list(dict.fromkeys([*sure, *(r[0] for r in words.collect())]))


def _packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """(toxic, gaps, sizes, held): per document the words between those with a feature, and their feature numbers."""
    number = {f: k for k, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}

        def of(word: str) -> list[int]:
            if word not in known:
                if len(known) > HELD_WORDS:
                    known.clear()
                known[word] = [number[f] for f in features(word.lower()) if f in number]
            return known[word]

        def packed() -> Iterator[tuple]:
            for body, toxic in rows_of(batches, "text", "toxic"):
                found = [of(w) for w in WORD.findall(body)]
                at = [k for k, f in enumerate(found) if f]
                gaps = (np.diff([-1, *at, len(found)]) - 1).tolist()
                yield toxic, gaps, [len(found[k]) for k in at], [f for k in at for f in found[k]]

        yield from batched(packed(), pa.schema([("toxic", pa.int32()), ("gaps", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("held", pa.list_(pa.int32()))]), 512)

    return rows.mapInArrow(run, "toxic int, gaps array<int>, sizes array<int>, held array<int>")


def _slope(packed: DataFrame, at: np.ndarray) -> np.ndarray:
    """Gradient of the log-likelihood of the token labels at (three transitions, weight per feature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, weight = Chain(*at[:3]), at[3:]
        slope = np.zeros(len(at))
        for toxic, gaps, sizes, held in rows_of(batches, "toxic", "gaps", "sizes", "held"):
            if toxic and not sizes:
                continue
            ids = np.array(held, np.int64)
            own = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.bincount(own, weight[ids], len(sizes))
            moves = [0.0, 0.0, 0.0]
            marginals, _ = chain.marginals(gaps, sums.tolist(), moves)
            np.add.at(slope, 3 + ids, (toxic - np.array(marginals))[own] if len(own) else [])
            slope[:3] -= moves
            if toxic:  # of the given labels: a T after a T stays, after anything else rises
                stays = sum(1 for g in gaps[1:-1] if g == 0)
                slope[:3] += [len(sizes) - stays, len(sizes) - stays - (gaps[-1] == 0), stays]
        yield _one(slope)

    return _summed(packed, run, len(at))


def _one(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.astype("<f8").tobytes()], pa.binary())], names=["part"])


def _summed(packed: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], size: int) -> np.ndarray:
    """Sum of the vectors the tasks give, one each."""
    return sum((np.frombuffer(r[0]) for r in packed.mapInArrow(run, "part binary").toLocalIterator()), np.zeros(size))


def aggregate(marginals: list[float], words: int) -> list[float]:
    """What a document's score rests on: one, surprise that no word is T, largest marginal, number of words."""
    surprise = sum(-math.log(max(1 - m, 1e-5)) for m in marginals)
    return [1.0, math.log1p(surprise), max(marginals, default=0.0), math.log1p(words) / 10]


def fit_scores(packed: DataFrame, at: np.ndarray, steps: int = 8) -> np.ndarray:
    """Weights of :func:`aggregate` for the chance that a document is labelled toxic: Newton steps, one Spark job each."""
    n = 4
    weights = np.zeros(n)
    for _ in range(steps):

        def run(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            chain, weight, out = Chain(*at[:3]), at[3:], np.zeros(n + n * n)
            for toxic, gaps, sizes, held in rows_of(batches, "toxic", "gaps", "sizes", "held"):
                sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weight[np.array(held, np.int64)], len(sizes))
                marginals, _ = chain.marginals(gaps, sums.tolist()) if sizes else ([], 0.0)
                x = np.array(aggregate(marginals, sum(gaps) + len(sizes)))
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ weights)))))
                out[:n] += (toxic - p) * x
                out[n:] += (p * (1 - p) * np.outer(x, x)).ravel()
            yield _one(out)

        found = _summed(packed, run, n + n * n)
        step = np.linalg.solve(found[n:].reshape(n, n) + 0.1 * np.eye(n), found[:n] - 0.1 * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-3:
            break
    return weights


def fit(packed: DataFrame, n_features: int, steps: int = STEPS) -> np.ndarray:
    """Weights of the largest penalised likelihood by sign-guided steps (one size per weight)."""
    at = np.concatenate([[-6.0, 0.0, -1.0], np.full(n_features, 1.0)])
    size, before = np.full(len(at), 0.5), np.zeros(len(at))
    for _ in range(steps):
        slope = _slope(packed, at)
        slope[3:] -= RIDGE * at[3:]
        turn = slope * before
        size = np.clip(np.where(turn > 0, size * 1.3, np.where(turn < 0, size * 0.5, size)), 1e-4, 2.0)
        slope[turn < 0] = 0.0
        at, before = at + np.sign(slope) * size, slope
        if size.max() < 0.01:
            break
    return at


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, docs_used: int = TRAIN_DOCS) -> Model:
    """Learns from labelled rows of ``docs``: evidence of all, the field of ``docs_used`` of them at most, by a hash of the key."""
    rows = labelled_texts(docs, labels, key, text, label)
    names = toxic_features(rows)
    if not names:
        return Model({}, (-6.0, 0.0, -1.0), (-30.0, 0.0, 0.0, 0.0))
    n = rows.select("key").count()
    share = F.pmod(F.xxhash64(F.lit("train"), F.col("key")), F.lit(1 << 40)) < F.lit(docs_used / max(n, 1) * (1 << 40))
    packed = cut_lineage(_packed(rows.where(share), names))
    at = fit(packed, len(names))
    return Model(dict(zip(names, at[3:].tolist(), strict=True)), tuple(at[:3].tolist()), tuple(fit_scores(packed, at).tolist()))


def tag(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """(key, columns ``more`` of the document, score, spans (begin, end, p) in code points) for every row.

    Texts that are null, empty or without a word that has a feature get the score of no evidence at their
    length and have no spans; a text is read whole, whatever its length; repeated rows come out once each; an empty table gives no rows.
    """
    asked = docs.select(docs[key].alias("key"), docs[text].alias("text"), *[c.alias(n) for n, c in more.items()])
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema if f.name != "text")
    kept = ["key", *more]
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = model.tagger()
        for batch in batches:
            found = [tagger(t.as_py()) for t in batch.column("text")]
            spans = pa.array([[dict(zip(("begin", "end", "p"), s, strict=True)) for s in spans] for _, spans in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([s for s, _ in found], pa.float64()), spans], names=[*kept, "score", "spans"])

    return asked.mapInArrow(run, f"{shape}, score double, spans array<struct<begin:int,end:int,p:double>>").withColumnRenamed("key", key)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = TOXIC) -> DataFrame:
    """(key, held_out, score, predicted, spans) of every row; learns from labelled rows that are not held out.

    Rows with a null key are not held out and teach nothing. If no feature is found (no labels, or of one
    kind only), all scores are next to 0. Of several labels of a key the largest holds.
    """
    mark = F.coalesce(held_out(docs[key]), F.lit(False))
    model = train(docs.where(~mark & docs[key].isNotNull()), labels, key, text, label)
    found = tag(docs, model, key, text, held_out=mark)
    return found.select(key, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
