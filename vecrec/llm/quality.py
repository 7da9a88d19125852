"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a reject condition over a few measures of the text. ``order_rules`` times each rule on a
bounded sample and sees what share it rejects; ``cascade`` nests the rules in a CASE in the order of
rejections per second, so that a text rejected early never pays for the later measures. The order
changes the cost only: a document is kept if no rule rejects it, in whichever order.

Defined results: a null or empty text has no words and fails the base rule; ties and repeated rows are
judged each for itself; an empty table gives no rows (rules then keep their given order); columns of
the input are only read by name and never clash, since measures are expressions, not columns.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecrec.llm.common import SPACE, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Column that holds a text's words while it is judged.
FOUND = "__quality_words"
#: Rows of the sample that cost and selectivity are estimated on, and the longest text in it.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 20_000


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once per row: a lambda variable is a value, not an expression to repeat."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_words(text: Column, found: Column | None = None) -> Column:
    """Words of the text; ``found`` may hold their array already."""
    return F.size(words(text) if found is None else found).cast("bigint")


def _without(text: Column, runs: str) -> Column:
    """Code points left when all runs of a class are taken out."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), runs, "")).cast("bigint")


def word_chars(text: Column) -> Column:
    """Code points of the text that are not white space."""
    return _without(text, f"[{SPACE}]+")


def n_symbols(text: Column) -> Column:
    return _without(text, f"[^{SYMBOLS}]+")


def _lines(text: Column) -> Column:
    """Lines with at least one word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def n_dup_lines(text: Column) -> Column:
    return _let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def dup_line_share(text: Column) -> Column:
    return _let(_lines(text), lambda x: F.when(F.size(x) == 0, 0.0).otherwise((F.size(x) - F.size(F.array_distinct(x))) / F.size(x)))


def upper_share(text: Column) -> Column:
    """Share of capital letters among the characters of words."""
    chars = word_chars(text)
    return F.when(chars == 0, 0.0).otherwise(_without(text, r"[^\p{Lu}]+") / chars)


def n_repeat_words(text: Column, found: Column | None = None) -> Column:
    """Words inside 5-word windows that the text holds twice or more, the first included.

    Windows are compared by a 64-bit hash, made of their words' hashes two, four and five at a time. Only texts whose hashes are not all different sort them.
    """

    def windows(w: Column) -> Column:
        return F.when(F.size(w) > WINDOW, _let(F.transform(w, lambda x: F.xxhash64(x)), five))

    def five(h: Column) -> Column:
        pair = lambda a, b: F.xxhash64(a, b)
        off = lambda a, k: F.slice(a, k + 1, F.size(h))
        fours = _let(F.zip_with(h, off(h, 1), pair), lambda two: F.zip_with(two, off(two, 2), pair))
        return F.slice(F.zip_with(fours, off(h, 4), pair), 1, F.size(h) - WINDOW + 1)

    def repeated(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(placed, covered)

    def covered(p: Column) -> Column:
        same = lambda j, k: F.get(p, j)["h"].eqNullSafe(F.get(p, k)["h"])
        at = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda j: ((j > 0) & same(j, j - 1)) | ((j < F.size(p) - 1) & same(j, j + 1)))
        starts = F.sort_array(F.transform(at, lambda j: F.get(p, j)["i"]))
        return _let(starts, width)

    def width(s: Column) -> Column:
        step = lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))
        return F.aggregate(F.transform(s, step), F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), repeated(h))

    return F.coalesce(_let(words(text) if found is None else found, lambda w: _let(windows(w), count)), F.lit(0)).cast("bigint")


def base_failed(n: Column, repeat: Column) -> Column:
    return (n < 10) | (100 * repeat > 20 * n)


def rules(text: Column, **known: Column) -> list[Rule]:
    """The rules beside the base rule; the thresholds leave ordinary prose of any language far inside.

    ``known`` may name columns that already hold ``n_words``, ``word_chars`` or ``n_symbols``.
    """
    n, chars, symbols = (known.get(f.__name__, f(text)) for f in (n_words, word_chars, n_symbols))
    return [
        Rule("symbols", symbols > 0.4 * n),
        Rule("mean_word_length", (chars < 2 * n) | (chars > 15 * n)),
        Rule("duplicate_lines", dup_line_share(text) > 0.3),
        Rule("capitals", upper_share(text) > 0.3),
    ]


def base_rules(text: Column, found: Column | None = None) -> list[Rule]:
    n = n_words(text, found)
    return [Rule("few_words", n < 10), Rule("repeated_words", 100 * n_repeat_words(text, found) > 20 * n)]


def order_rules(docs: DataFrame, of: Callable[[Column], list[Rule]], text: str, sample_rows: int = SAMPLE_ROWS) -> list[int]:
    """Numbers of the rules ``of`` gives for a text, by rejections per second of work on a sample, best first.

    The sample is the first ``sample_rows`` texts of up to ``SAMPLE_CHARS`` characters that ``take`` meets,
    which reads few partitions; whole columns are judged by all rules in any case. A run with
    no rule is taken off as the cost of the scan.
    """
    spark = docs.sparkSession
    known = docs.select(docs[text].alias("text")).where(F.coalesce(F.char_length("text"), F.lit(0)) <= SAMPLE_CHARS)
    sample = spark.createDataFrame(known.take(sample_rows), "text string")

    def measured(expr: Column) -> tuple[float, float]:
        began = time.perf_counter()
        row = sample.agg(F.avg(expr.cast("int")).alias("r")).first()
        return time.perf_counter() - began, float(row["r"] or 0.0)

    scan = min(measured(F.lit(False))[0] for _ in range(2))
    seen = [(max(t - scan, 1e-3), r, k) for k, (t, r) in enumerate(measured(x.rejects) for x in of(F.col("text")))]
    return [k for _, _, k in sorted(((-r / t, t, k) for t, r, k in seen))]


def cascade(ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that pass the base rule and every other rule."""
    order = order_rules(docs, lambda t: base_rules(t) + rules(t), text)
    marked = docs.withColumn(FOUND, words(docs[text]))
    body, found = marked[text], F.col(FOUND)
    known = base_rules(body, found) + rules(body, n_words=n_words(body, found))
    return marked.where(cascade([known[k] for k in order]).isNull()).drop(FOUND)


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the measures of the base rule, its verdict and that of the cascade."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    order = order_rules(docs, rules, text)
    split = docs.select(docs[key].alias("key"), docs[text].alias("text"), words(docs[text]).alias(FOUND))
    body, found = F.col("text"), F.col(FOUND)
    measures = [n_words(body, found), word_chars(body), n_symbols(body), n_dup_lines(body), n_repeat_words(body, found)]
    measured = split.select("key", "text", *[m.alias(n) for m, n in zip(measures, names, strict=True)])
    known = rules(body, **{n: F.col(n) for n in names[:3]})
    rejected = cascade([known[k] for k in order]).isNotNull()
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return measured.select(F.col("key").alias(key), *names, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
