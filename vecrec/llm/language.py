"""Language identification by language-bitmask n-gram filters.

For each language the character n-grams most often met in its training texts go into a Bloom filter.
The filters of all languages are kept bit-sliced: slot s of the table holds one bit per language, so
the AND of an n-gram's ``HASHES`` slots is the set of all languages that contain it, in one look-up. A
text is decided by per-language counts of its n-grams, corrected for false positives: of n n-grams,
with false-positive rate p, c hits mean (c - n p) / (1 - p) true ones.

Training reads at most ``TRAIN_TEXTS`` texts per language, chosen by key hash; this bound
is a parameter. The model is ``SLOTS`` slots of one 64-bit word per 64 languages, whatever the input.
Prediction maps texts in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecrec.llm.common import batched, cut_lineage, rows_of

GRAM, HASHES, SLOTS = 4, 3, 1 << 17
#: Texts per language to learn from, n-grams per language in its filter, and most languages.
TRAIN_TEXTS, TRAIN_GRAMS, MAX_LANGUAGES = 1_000, 4_000, 1_024
UNKNOWN = "und"
#: Characters of a text that are hashed at once.
PIECE = 1 << 20


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters than letters as one space, one at each end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    kept = _is_letter(codes)
    if not kept.any():
        return np.zeros(0, np.uint64)
    marked = np.where(kept, codes, 32)
    inside = np.ones(len(marked), bool)
    inside[1:] = kept[1:] | kept[:-1]
    body = marked[inside].astype(np.uint64)
    space = np.full(1, 32, np.uint64)
    return np.concatenate([space[: int(body[0] != 32)], body, space[: int(body[-1] != 32)]])


_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    return _LETTER[codes]


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram."""
    n = len(codes) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = codes[:n].copy()
    for k in range(1, GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slots(h: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (slots, words of 64 languages)
    false_rate: np.ndarray  # per language

    @staticmethod
    def of(learned: dict[str, list[int]]) -> Model:
        names = sorted(learned)
        table = np.zeros((SLOTS, max(1, -(-len(names) // 64))), np.uint64)
        for k, name in enumerate(names):
            h = np.array(learned[name], np.int64).view(np.uint64)
            for at in slots(h):
                table[at, k // 64] |= np.uint64(1) << np.uint64(k % 64)
        fill = np.array([(table[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(names))])
        return Model(names, table, fill**HASHES)

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Hits per language and the number of n-grams."""
        hits, total = np.zeros(len(self.languages), np.int64), 0
        codes = letters(text)
        for k in range(0, max(0, len(codes) - GRAM + 1), PIECE):
            h = grams(codes[k : k + PIECE + GRAM - 1])
            total += len(h)
            first, *rest = slots(h)
            met = self.table[first]
            for at in rest:
                met &= self.table[at]
            for w in range(met.shape[1]):
                seen, n = np.unique(met[:, w], return_counts=True)
                for j in range(w * 64, min(len(hits), w * 64 + 64)):
                    hits[j] += n[(seen >> np.uint64(j % 64) & np.uint64(1)) == 1].sum()
        return hits, total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the corrected counts; ties go to the first name."""
        if text is None or not self.languages:
            return UNKNOWN, 0.0
        hits, total = self.counts(text)
        if not total:  # letters, but no whole n-gram: "a" is padded to three characters
            return (UNKNOWN, 0.0) if not len(letters(text)) else (self.languages[0], 0.0)
        true = np.clip((hits - total * self.false_rate) / (1 - self.false_rate), 0, total)
        best = int(true.argmax())
        return self.languages[best], float(true[best] / true.sum()) if true.sum() > 0 else 0.0


def train(docs: DataFrame, key: str, text: str, lang: str, texts: int = TRAIN_TEXTS, keep: int = TRAIN_GRAMS) -> Model:
    """Learns from the rows of ``docs`` with a language; at most ``texts`` keys per language, each with its texts of that language.

    More than ``MAX_LANGUAGES`` languages are an error.
    """
    rows = docs.select(docs[key].alias("key"), docs[lang].alias("lang"), F.xxhash64(F.lit("train"), docs[key]).alias("h")).where(F.col("lang").isNotNull())
    sizes = cut_lineage(rows.groupBy("lang").count())
    if sizes.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # twice as many as wanted pass by their hash, so that a language with most of the rows sends few
    near = F.pmod(F.col("h"), F.lit(1 << 40)) < F.lit(2.0 * texts * (1 << 40)) / F.col("count")
    rows = rows.join(F.broadcast(sizes), "lang").where(near).drop("count")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "key"))).where(F.col("r") <= texts)
    names = [r[0] for r in sizes.select("lang").collect()]
    chosen = first.select("key", "lang").distinct()  # at most texts * MAX_LANGUAGES rows
    texts_of = docs.select(docs[key].alias("key"), docs[lang].alias("lang"), docs[text].alias("text")).where(F.col("text").isNotNull())
    sample = cut_lineage(texts_of.join(F.broadcast(chosen), ["key", "lang"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, body in rows_of(batches, "lang", "text"):
            h = np.unique(grams(letters(body))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h, pa.int64())], names=["lang", "gram"])

    counted = sample.repartition("key").mapInArrow(run, "lang string, gram bigint").groupBy("lang", "gram").count()
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "gram"))).where(F.col("r") <= keep)
    learned: dict[str, list[int]] = {name: [] for name in names}
    for name, gram in ranked.select("lang", "gram").toLocalIterator():
        learned[name].append(gram)
    return Model.of(learned)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """(key, lang_pred, score, and columns ``more`` of the document) for every row.

    Null texts and texts without a letter are ``und`` at 0, as is every text if nothing was learned; ties
    go to the first language by name; repeated rows come out once each.
    """
    asked = docs.select(docs[key].alias("key"), docs[text].alias("text"), *[c.alias(n) for n, c in more.items()])
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*kept, "lang_pred", "score"])

    return asked.mapInArrow(run, f"{shape}, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(3)) == 1


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts all: (key, held_out, lang_pred, score)."""
    mark = F.coalesce(held_out(docs[key]), F.lit(False))
    model = train(docs.where(~mark & docs[key].isNotNull()), key, text, lang)
    return predict(docs, model, key, text, held_out=mark).select(key, "held_out", "lang_pred", "score")
