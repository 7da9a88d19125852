"""Temperature mixing of sources, realised as budgeted permutations of blocks. DataFrame functions only.

A source with T tokens gets weight proportional to T ** a. The exponent a in [0, 1] (1: as they are, 0: all
alike) is bisected to the largest value that meets a target: an entropy of the weights, or the smallest
that keeps a repetition limit. The token budget is the least at which the source most favoured as it is
still gives every document once, so nothing is dropped and smaller sources are repeated: source s is read
``epochs`` = budget * weight / T times.

Documents fall into ``BLOCKS`` hash blocks per source. Each epoch has its own permutation of a source's
blocks; the last, unfinished epoch takes blocks in that order while the budget lasts, and of the block
where it ends the documents below a hash threshold. Budgets are met up to that block's hash error. Only
block totals are grouped, so a source with a third of all rows costs no more than others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecrec.llm.common import cut_lineage, words

BLOCKS = 1024
#: Sources with plans up to this number go to every task; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Points a bisection step tries at once, and steps.
POINTS, STEPS = 15, 8


def _unit(*of: Column) -> Column:
    """Uniform hash in [0, 1)."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 40)) / float(1 << 40)


def source_totals(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))


def exponent_for_entropy(totals: DataFrame, target: float) -> float:
    """The largest exponent in [0, 1] whose weights have entropy (nats) ``target`` or more; 0 if none has.

    Each step narrows the bracket by a factor of ``POINTS`` + 1 with one aggregation of the totals.
    """
    known = totals.where("tokens > 0").select(F.log("tokens").alias("l"))
    top = known.agg(F.max("l")).first()[0]
    if top is None:
        return 1.0
    low, high = 0.0, 1.0

    def entropies(points: list[float]) -> list[float]:
        powers = [F.exp(a * (F.col("l") - top)) for a in points]
        row = known.agg(*[F.sum(p) for p in powers], *[F.sum(p * a * (F.col("l") - top)) for p, a in zip(powers, points, strict=True)]).first()
        return [math.log(z) - m / z for z, m in zip(row[: len(points)], row[len(points) :], strict=True)]

    if entropies([1.0])[0] >= target:
        return 1.0
    for _ in range(STEPS):
        points = [low + (high - low) * k / (POINTS + 1) for k in range(1, POINTS + 1)]
        met = [h >= target for h in entropies(points)]
        passed = met.index(False) if False in met else POINTS
        low, high = ([low, *points][passed], [*points, high][passed])
    return low


def exponent_for_repeats(totals: DataFrame, most: float) -> float:
    """The smallest exponent in [0, 1] at which no source is read more than ``most`` (1 or more) times."""
    row = totals.where("tokens > 0").agg(F.min("tokens"), F.max("tokens")).first()
    if row[0] is None:
        return 1.0
    low, high = 0.0, 1.0
    if (row[1] / row[0]) ** (1 - low) <= most:
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (row[1] / row[0]) ** (1 - mid) <= most else (mid, high)
    return high


def plan_mixture(blocks: DataFrame, max_repeats: float | None, target_entropy: float | None, seed: int = 0) -> DataFrame:
    """(source, tokens, weight, full, taken, cut_block, cut): one row per source with what each epoch takes.

    ``full`` whole epochs; of epoch number ``full`` the blocks in ``taken``, and of ``cut_block`` the
    documents whose hash is below ``cut``. Sources without a token are read once.
    """
    totals = cut_lineage(source_totals(blocks))
    bounds = []
    if max_repeats is not None:
        bounds.append(exponent_for_repeats(totals, max_repeats))
    if target_entropy is not None:
        bounds.append(exponent_for_entropy(totals, target_entropy))
    exponent = max(bounds, default=1.0)  # a repetition limit stands above an entropy
    top, whole = totals.agg(F.max("tokens"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(exponent)))).first()
    epochs = F.when(F.col("tokens") > 0, F.pow(F.lit(float(top or 1)) / F.greatest("tokens", F.lit(1)), F.lit(1.0 - exponent))).otherwise(1.0)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent)) / float(whole or 1)).otherwise(0.0)
    known = totals.select("source", "tokens", weight.alias("weight"), F.floor(epochs + 1e-9).cast("int").alias("full"), epochs.alias("epochs"))
    rest = known.withColumn("rest", F.when(F.col("epochs") - F.col("full") > 1e-9, (F.col("epochs") - F.col("full")) * F.col("tokens")).otherwise(0.0))
    parts = blocks.withColumnRenamed("tokens", "size").withColumnRenamed("source", "of")
    order = Window.partitionBy("source").orderBy(block_order(F.col("source"), F.col("full"), F.col("block"), seed), "block")
    run = rest.join(parts, rest["source"].eqNullSafe(parts["of"])).drop("of")
    placed = run.withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = (F.col("rest") > 0) & (F.col("before") + F.col("size") <= F.col("rest"))
    partly = (F.col("size") > 0) & (F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))
    return placed.groupBy("source", "tokens", "weight", "full").agg(
        F.collect_list(F.when(inside, F.col("block"))).alias("taken"),
        F.max(F.when(partly, F.col("block"))).alias("cut_block"),
        F.max(F.when(partly, (F.col("rest") - F.col("before")) / F.col("size"))).alias("cut"),
    )


def block_order(source: Column, epoch: Column, block: Column, seed: int) -> Column:
    """The place of a block in the permutation of an epoch, in [0, 1)."""
    return _unit(F.lit(seed), F.coalesce(source, F.lit("\0")), epoch.cast("int"), block.cast("int"))


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", max_repeats: float | None = 2.0, target_entropy: float | None = None, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, once per epoch that takes them, with new columns ``mix_epoch``, ``mix_block`` and ``mix_place``.

    Reading in the order of ``mix_place`` interleaves the sources at their weights: each epoch spreads its
    blocks over [0, 1), and blocks keep their documents together. Tokens are words. A null source is a
    source of its own; null and empty texts count no token and stay; repeated rows are mixed each for
    itself; an empty table gives no rows. Columns of ``docs`` named like the new ones are replaced.
    """
    out = _mixed(docs, source, key, text, max_repeats, target_entropy, seed)
    new = ("epoch", "block", "place")
    return out.select(*[out[c] for c in docs.columns if c not in [f"mix_{n}" for n in new]], *[F.col(f"__mix_{n}").alias(f"mix_{n}") for n in new])


def mixed_documents(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", max_repeats: float | None = 2.0, target_entropy: float | None = None, seed: int = 0) -> DataFrame:
    """``mix`` with the columns of ``docs`` alone."""
    return _mixed(docs, source, key, text, max_repeats, target_entropy, seed).select(*docs.columns)


def _mixed(docs: DataFrame, source: str, key: str, text: str, max_repeats: float | None, target_entropy: float | None, seed: int) -> DataFrame:
    size = F.size(words(docs[text])).cast("bigint")
    chance = _unit(F.lit(seed + 1), docs[key], F.char_length(docs[text]))
    marked = docs.withColumns({"__mix_block": F.floor(chance * BLOCKS).cast("int"), "__mix_u": chance * BLOCKS - F.floor(chance * BLOCKS)})
    blocks = cut_lineage(marked.groupBy(marked[source].alias("source"), F.col("__mix_block").alias("block")).agg(F.sum(size).alias("tokens")))
    plan = cut_lineage(plan_mixture(blocks, max_repeats, target_entropy, seed))
    plan = plan.select(*[F.col(c).alias(f"__mix_{c}") for c in ("source", "full", "taken", "cut_block", "cut")])
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    met = marked.join(plan, marked[source].eqNullSafe(plan["__mix_source"]))
    more = F.array_contains("__mix_taken", F.col("__mix_block")) | ((F.col("__mix_block") == F.col("__mix_cut_block")) & (F.col("__mix_u") < F.col("__mix_cut")))
    last = F.col("__mix_full") - 1 + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)
    out = met.withColumn("__mix_epoch", F.explode(F.sequence(F.lit(0), last)))
    place = block_order(out[source], F.col("__mix_epoch"), F.col("__mix_block"), seed)
    return out.withColumn("__mix_place", place)
