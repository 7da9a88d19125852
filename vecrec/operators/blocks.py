"""Block products: apply a vectorised function to every (left block, right block).

This is how all comparisons of many vectors with many vectors run here. Only what the function
returns (matches above a bound, running maxima, top-n) leaves a block; pairs never become rows.

* The right side fits a checked byte budget: it is broadcast once and the left side is mapped in
  place, without any shuffle.
* It does not: both sides are cut into hash blocks of bounded size and each (left, right) block pair is
  one bounded co-group, spread evenly over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
LEFT_ROWS = 4096
RIGHT_ROWS = 2048
PENDING_ROWS = 200_000
#: Bytes of rows in a block of ``grid_apply``, and block pairs for each core at least.
GRID_BYTES, GRID_PAIRS = 32 << 20, 4
#: Most tasks that block pairs are dealt out to by ``task_pairs``.
MOST_TASKS = 20_000

Frame = pd.DataFrame
BlockFn = Callable[[Frame, Frame], Frame]


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False) if len(column) else np.zeros((0, 0))


def _chunks(pdf: Frame, rows: int) -> list[Frame]:
    return [pdf.iloc[i : i + rows].reset_index(drop=True) for i in range(0, len(pdf), rows)]


def block_apply(
    left: DataFrame,
    right: DataFrame,
    fn: BlockFn,
    schema: str,
    left_key: str,
    right_key: str,
    row_bytes: int,
    combine: Callable[[Frame], Frame] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    left_rows: int = LEFT_ROWS,
    right_rows: int = RIGHT_ROWS,
    task_pairs: int | None = None,
) -> DataFrame:
    """``fn(left_rows, right_rows)`` over all block pairs.

    ``combine`` may shrink a task's output (it must be safe to apply repeatedly); the caller still
    aggregates over tasks. With ``task_pairs`` the left side is dealt out, so that a task has about that many pairs of rows,
    or one block pair, however many there are in all.
    """
    budget = max(1, broadcast_bytes // max(1, row_bytes))
    small = right.limit(budget + 1).toPandas()  # bounded by the budget
    if len(small) <= budget:
        shared = left.sparkSession.sparkContext.broadcast(small)

        def run(batches: Iterator[Frame]) -> Iterator[Frame]:
            parts = _chunks(shared.value, right_rows)
            pending: list[Frame] = []
            size = 0
            for batch in batches:
                for piece in _chunks(batch, left_rows):
                    for part in parts:
                        out = fn(piece, part)
                        if combine is None:
                            yield out
                            continue
                        pending.append(out)
                        size += len(out)
                        if size > PENDING_ROWS:
                            pending = [combine(pd.concat(pending, ignore_index=True))]
                            size = len(pending[0])
            if pending:
                yield combine(pd.concat(pending, ignore_index=True))

        if task_pairs:
            left = left.repartition(max(1, math.ceil(left.count() * len(small) / task_pairs)), left_key)
        return left.mapInPandas(run, schema)

    n_right = math.ceil(right.count() / right_rows)
    n_left = math.ceil(left.count() / left_rows)
    left_grid = left.withColumn("__l", F.pmod(F.xxhash64(left_key), F.lit(n_left))).withColumn(
        "__r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_right - 1).cast("bigint")))
    )
    right_grid = right.withColumn("__r", F.pmod(F.xxhash64(right_key), F.lit(n_right))).withColumn(
        "__l", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_left - 1).cast("bigint")))
    )
    right_grid = right_grid.select(*[F.col(c).alias(c) for c in right_grid.columns])  # fresh column identities
    if task_pairs:
        tasks = max(1, min(n_left * n_right, MOST_TASKS))
        left_grid, right_grid = (grid.repartition(tasks, "__l", "__r") for grid in (left_grid, right_grid))
    return _cogroup(left_grid, right_grid, fn, schema, combine)


def _cogroup(left: DataFrame, right: DataFrame, fn: BlockFn, schema: str, combine=None) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(lpdf: Frame, rpdf: Frame) -> Frame:
        if lpdf.empty or rpdf.empty:
            return pd.DataFrame(columns=names)
        out = fn(lpdf, rpdf)
        return combine(out) if combine is not None else out

    return left.groupBy("__l", "__r").cogroup(right.groupBy("__l", "__r")).applyInPandas(run, schema)


def self_block_apply(
    df: DataFrame,
    fn: Callable[[Frame, Frame, bool], Frame],
    schema: str,
    key: str,
    row_bytes: int,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = RIGHT_ROWS,
    within: str | None = None,
) -> DataFrame:
    """Unordered block pairs of one table: ``fn(a, b, ordered)``.

    ``ordered`` tells that both blocks may hold the same rows, so only pairs with key a < key b count;
    otherwise the blocks are disjoint and met once. ``within`` limits pairs to equal values of a column.
    Without ``within`` and inside the broadcast budget ``fn`` may give its rows in several frames.
    """
    if within is None:
        budget = max(1, broadcast_bytes // max(1, row_bytes))
        small = df.limit(budget + 1).toPandas()
        if len(small) <= budget:
            shared = df.sparkSession.sparkContext.broadcast(small)

            def run(batches: Iterator[Frame]) -> Iterator[Frame]:
                parts = _chunks(shared.value, block_rows)
                for batch in batches:
                    for piece in _chunks(batch, LEFT_ROWS):
                        for part in parts:
                            out = fn(piece, part, True)
                            yield from [out] if isinstance(out, pd.DataFrame) else out

            return df.mapInPandas(run, schema)
        n_blocks = math.ceil(df.count() / block_rows)
        placed = df.withColumn("__nb", F.lit(n_blocks).cast("bigint"))
        keys = ["__l", "__r"]
    else:
        sizes = df.groupBy(within).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("bigint").alias("__nb"))
        placed = df.join(sizes, within)
        keys = [within, "__l", "__r"]
    placed = placed.withColumn("__b", F.pmod(F.xxhash64(key), F.col("__nb")))
    # Round-robin pairing: block b meets b, b+1, ... b+nb/2 (mod nb), so every block does the same work.
    # For an even count the far partner is met from the lower half only.
    met = F.expr(
        "filter(sequence(0L, __nb div 2), o -> o = 0 or __nb % 2 = 1 or o < __nb div 2 or __b < __nb div 2)"
    )
    back = F.expr(
        "filter(sequence(0L, __nb div 2), o -> o = 0 or __nb % 2 = 1 or o < __nb div 2 or pmod(__b - o, __nb) < __nb div 2)"
    )
    left = placed.withColumn("__o", F.explode(met)).withColumn("__l", F.col("__b")).withColumn(
        "__r", F.expr("pmod(__b + __o, __nb)")
    )
    right = placed.withColumn("__o", F.explode(back)).withColumn("__r", F.col("__b")).withColumn(
        "__l", F.expr("pmod(__b - __o, __nb)")
    )
    # fresh column identities: both sides come from one table
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def pair(lpdf: Frame, rpdf: Frame) -> Frame:
        if lpdf.empty or rpdf.empty:
            return pd.DataFrame(columns=names)
        return fn(lpdf, rpdf, bool(lpdf["__l"].iloc[0] == lpdf["__r"].iloc[0]))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, schema)


def in_stream(met: DataFrame, keys: list[str], fn: Callable[[Frame, Frame], Iterator[Frame]], schema: str, partitions: int | None = None) -> DataFrame:
    """``fn(rows with asked, the other rows)`` for every value of ``keys`` that has both.

    Both sides follow each other in one sorted stream, so that what ``fn`` finds leaves in pieces: a
    co-group would hold all of a dense block's pairs at once."""

    def solve(parts: list[Frame]) -> Iterator[Frame]:
        whole = pd.concat(parts, ignore_index=True)
        parts.clear()
        asked = whole["asked"].to_numpy(bool)
        if asked.any() and not asked.all():
            yield from fn(whole[asked].reset_index(drop=True), whole[~asked].reset_index(drop=True))

    def run(batches: Iterator[Frame]) -> Iterator[Frame]:
        at, held = None, []
        for pdf in batches:
            named = pdf[keys].to_numpy()
            cuts = (np.flatnonzero((named[1:] != named[:-1]).any(axis=1)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                if a == b:
                    continue
                if tuple(named[a]) != at and held:
                    yield from solve(held)
                    held = []
                at = tuple(named[a])
                held.append(pdf.iloc[a:b])
        if held:
            yield from solve(held)

    dealt = met.repartition(partitions, *keys) if partitions else met.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInPandas(run, schema)


def grid_blocks(rows: DataFrame, n: int, row_bytes: int, block_rows: int | None = None) -> int:
    """Number of blocks that ``n`` rows are cut into: of ``GRID_BYTES``, or less for some pairs of blocks a core."""
    most = block_rows or max(1, GRID_BYTES // row_bytes)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(n / most), min(math.ceil(n / RIGHT_ROWS), math.ceil(math.sqrt(2 * GRID_PAIRS * cores))))


def grid_apply(rows: DataFrame, fn: Callable[[Frame, Frame, bool], Iterator[Frame]], schema: str, count: int) -> DataFrame:
    """``fn(a, b, same)`` for every unordered pair of the ``count`` blocks of one table, each once, in a stream of frames.

    ``rows.block`` numbers the blocks. A row is sent once for each block, so that shuffles hold ``count`` times the table:
    blocks should be as large as a task can hold. With ``same`` both sides are the one block.
    """
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    sent = rows.withColumn("__o", other).withColumn("__l", F.least("block", "__o")).withColumn("__r", F.greatest("block", "__o"))
    sent = sent.withColumn("asked", F.col("block") == F.col("__l")).drop("__o")
    # a block meets itself: its rows come twice
    both = F.when(F.col("__l") == F.col("__r"), F.array(F.lit(True), F.lit(False))).otherwise(F.array("asked"))
    sent = sent.withColumn("asked", F.explode(both))

    def pair(a: Frame, b: Frame) -> Iterator[Frame]:
        yield from fn(a, b, bool(a["__l"].iloc[0] == a["__r"].iloc[0]))

    return in_stream(sent, ["__l", "__r"], pair, schema, min(MOST_TASKS, count * (count + 1) // 2))


def in_hash_blocks(rows: DataFrame, key: str, count: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(count).cast("bigint")))
