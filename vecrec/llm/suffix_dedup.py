"""Removal of repeated byte strings of ``SPAN`` bytes by sampled, range-partitioned suffix sorting.

A window is a string of ``SPAN`` bytes in one text. Each has an anchor: of the 16-byte tokens that lie in
it whole, the first with the least hash. The anchor depends on the window's bytes alone, so equal windows
have equal tokens at their anchor, at the same distance. Neighbouring windows with one anchor make a
segment, one per about 190 bytes, and only segments travel:

1. Every text gives its segments as 128-bit hashes with counts. A segment that occurs twice repeats all
   its windows. A segment whose anchor token leads no other segment has no other repeats.
2. The rest, one copy of each segment, are suffix-sorted: splitters sampled by the range partitioner cut
   them by the leading token at the anchor, so equal windows meet in one bucket. A token that leads very
   many segments is lengthened by its context on either side, for the windows that hold it. A
   lengthened token that still leads so many is not sorted: its windows are counted by 128-bit hashes.
3. A bucket sorts the suffixes of its windows by multikey quicksort: by the first 8 bytes, then, among
   ties only, by the next stretch, down to ``SPAN`` bytes. Suffixes that are still tied are repeats. A
   bucket cuts its work at changes of the leading token, and equal tokens never lie in two buckets, so
   nothing is tied across a boundary.
4. Texts get the verdicts on their segments and take the covered bytes out.

Stretches beyond the first 8 bytes are compared by 64-bit hashes, segments by 128-bit ones.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecrec.llm.common import batched, cut_lineage, rows_of

SPAN, TOKEN = 400, 16
#: A leading token of more segments than this is lengthened to CONTEXT bytes on either side, or counted.
HOT_SEGMENTS, CONTEXT = 20_000, (SPAN - TOKEN) // 2
#: Bytes of segments a bucket sorts at once, unless one leading token has more.
SORT_BYTES = 8_000_000


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor hash) of each segment of a text, in order."""
    n = len(data) - SPAN + 1
    if n < 1:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64)
    raw = np.frombuffer(data, np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view("<u8").ravel()
    h = _mixed(eight[: len(eight) - 8] + _mixed(eight[8:]))
    m = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width, span = SPAN - TOKEN + 1, 1
    while 2 * span <= width:
        m, span = np.minimum(m[:-span], m[span:]), 2 * span
    if span < width:
        m = np.minimum(m[: n], m[width - span :])
    at = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return first, last, at[first], h[at[first]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digest(part: memoryview) -> bytes:
    return xxhash.xxh3_128_digest(part)


def repeated(buffer: bytes, starts: np.ndarray) -> np.ndarray:
    """Which of the suffixes at ``starts`` begin with ``SPAN`` bytes that another of them begins with: multikey quicksort."""
    raw = np.frombuffer(buffer, np.uint8)
    powers = np.full(len(raw) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    undo = np.full(len(raw) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    undo[0] = 1
    undo = np.cumprod(undo)
    letter = _mixed(np.arange(1, 257, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter[raw] * powers[:-1])])
    # stretches: 8 bytes as they are, then growing ones by hash, so that most differences end early
    cuts = [8, 24, 56, 120, 248, SPAN]
    active = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    head = np.lib.stride_tricks.sliding_window_view(raw, 8)
    for k, stop in enumerate(cuts):
        at = starts[active]
        key = head[at].copy().view(">u8").ravel().astype(np.uint64) if k == 0 else (sums[at + stop] - sums[at + cuts[k - 1]]) * undo[at]
        order = np.lexsort((key, group))
        key, sorted_group = key[order], group[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (sorted_group[1:] != sorted_group[:-1])])
        alone = new & np.concatenate([new[1:], [True]])
        active, group = active[order[~alone]], np.cumsum(new)[~alone]
        if not len(active):
            break
    out = np.zeros(len(starts), bool)
    out[active] = True
    return out


def runs_of(flags: np.ndarray) -> np.ndarray:
    """(first, last) of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1)


def _texts(docs: DataFrame, text: str) -> Column:
    return F.xxhash64(F.coalesce(docs[text], F.lit("")))


_FOUND = pa.schema([("digest", pa.binary()), ("runs", pa.binary())])


def counted(crowd: DataFrame) -> DataFrame:
    """(digest, runs of windows) of segments (lead, digest, often, low, high, part), by counts of window hashes.

    Counts are partial sums per task, and no task holds a group, however many segments one lead has.
    """
    shape = pa.schema([("window", pa.binary()), ("digest", pa.binary()), ("often", pa.bool_()), ("at", pa.int32())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for name, often, low, high, part in rows_of(batches, "digest", "often", "low", "high", "part"):
                view = memoryview(part)
                yield from ((digest(view[s : s + SPAN]), name, often, low + s) for s in range(high - low + 1))

        yield from batched(rows(), shape)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for name, at in rows_of(batches, "digest", "at"):
                flags = np.zeros(max(at) + 1, bool)
                flags[at] = True
                yield name, runs_of(flags).astype("<i4").tobytes()

        yield from batched(rows(), _FOUND)

    windows = crowd.dropDuplicates(["lead", "digest", "low"]).mapInArrow(hashed, "window binary, digest binary, often boolean, at int")
    tied = windows.groupBy("window").count().where("count > 1").select("window")
    held = windows.where("NOT often").join(tied, "window").groupBy("digest").agg(F.collect_list("at").alias("at"))
    return held.mapInArrow(joined, "digest binary, runs binary")


def find_repeats(docs: DataFrame, text: str, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(row, found): for each text hash with repeats, its repeated segments as (digest, runs of windows; null: all)."""
    asked = docs.select(_texts(docs, text).alias("row"), docs[text].alias("text")).where(F.octet_length("text") >= SPAN)
    shape = pa.schema([("row", pa.int64()), ("token", pa.int64()), ("digest", pa.binary()), ("n", pa.int64())])

    def list_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for row, body in rows_of(batches, "row", "text"):
                data = body.encode()
                view = memoryview(data)
                first, last, _, tokens = segments(data)
                seen = Counter((t, digest(view[a : b + SPAN])) for a, b, t in zip(first.tolist(), last.tolist(), tokens.view(np.int64).tolist(), strict=True))
                yield from ((row, t, d, n) for (t, d), n in seen.items())

        yield from batched(rows(), shape)

    listed = cut_lineage(asked.mapInArrow(list_segments, "row bigint, token bigint, digest binary, n bigint"))
    distinct = cut_lineage(listed.groupBy("token", "digest").agg(F.sum("n").alias("n"), F.min("row").alias("row")))
    shared = distinct.groupBy("token").agg(F.count(F.lit(1)).alias("leads")).where("leads > 1")
    unclear = distinct.join(shared, "token").groupBy("row").agg(F.collect_list(F.struct("digest", (F.col("n") > 1).alias("often"), (F.col("leads") > hot_segments).alias("hot"))).alias("wanted"))
    sent = pa.schema([("lead", pa.binary()), ("digest", pa.binary()), ("often", pa.bool_()), ("low", pa.int32()), ("high", pa.int32()), ("part", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for body, wanted in rows_of(batches, "text", "wanted"):
                data, open_ = body.encode(), {w["digest"]: w for w in wanted}
                view = memoryview(data)
                first, last, at, _ = segments(data)
                for a, b, p in zip(first.tolist(), last.tolist(), at.tolist(), strict=True):
                    w = open_.pop(digest(view[a : b + SPAN]), None)
                    if w is None:
                        continue
                    if not w["hot"]:
                        yield data[p : p + TOKEN], w["digest"], w["often"], 0, b - a, data[a : b + SPAN]
                        continue
                    # windows that begin early hold the bytes before the anchor, late ones those after it
                    middle = p - CONTEXT
                    if a <= middle:
                        yield data[middle : p + TOKEN], w["digest"], w["often"], 0, min(b, middle) - a, data[a : min(b, middle) + SPAN]
                    if b > middle:
                        c = max(a, middle + 1)
                        yield data[p : p + TOKEN + CONTEXT], w["digest"], w["often"], c - a, b - a, data[c : b + SPAN]

        yield from batched(rows(), sent, 2048)

    carried = asked.join(unclear, "row").mapInArrow(send, "lead binary, digest binary, often boolean, low int, high int, part binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    carried = cut_lineage(carried)
    # only a lengthened token can lead more segments than that
    crowded = F.broadcast(cut_lineage(carried.where(F.octet_length("lead") > TOKEN).groupBy("lead").count().where(F.col("count") > hot_segments).select("lead")))
    buckets = carried.join(crowded, "lead", "left_anti").repartitionByRange(n, "lead").sortWithinPartitions("lead", "digest", "low")
    def sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def verdicts(held: list[tuple]) -> Iterator[tuple]:
            sizes = np.array([h - l + 1 for _, _, l, h, _ in held])
            begin = np.cumsum([0] + [len(p) for *_, p in held])[:-1]
            starts = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            tied = repeated(b"".join(p for *_, p in held), starts)
            for (name, often, low, _, _), flags in zip(held, np.split(tied, np.cumsum(sizes)[:-1]), strict=True):
                if flags.any() and not often:  # one that occurs twice is known to repeat whole
                    yield name, (runs_of(flags) + low).astype("<i4").tobytes()

        def rows() -> Iterator[tuple]:
            held, size, lead, before = [], 0, None, None
            for now, name, often, low, high, part in rows_of(batches, "lead", "digest", "often", "low", "high", "part"):
                if now != lead and size > SORT_BYTES:
                    yield from verdicts(held)
                    held, size = [], 0
                lead = now
                if (now, name, low) != before:  # equal texts each sent their copy
                    before = (now, name, low)
                    held.append((name, often, low, high, part))
                    size += len(part)
            if held:
                yield from verdicts(held)

        yield from batched(rows(), _FOUND, 2048)

    partly = buckets.mapInArrow(sort_bucket, "digest binary, runs binary")
    whole = distinct.where("n > 1").select("digest", F.lit(None).cast("binary").alias("runs"))
    verdict = cut_lineage(partly.unionByName(counted(carried.join(crowded, "lead", "left_semi"))).unionByName(whole))
    mine = listed.select("row", "digest").distinct().join(verdict, "digest")
    return mine.groupBy("row").agg(F.collect_list(F.struct("digest", "runs")).alias("found"))


def covered(data: bytes, found: list[dict]) -> np.ndarray:
    """(first, last) byte of each maximal run of bytes that repeated windows cover."""
    known: dict[bytes, list] = {}
    for f in found:
        known.setdefault(f["digest"], []).append(None if f["runs"] is None else np.frombuffer(f["runs"], "<i4").reshape(-1, 2))
    mark = np.zeros(len(data) + 1, np.int32)
    view = memoryview(data)
    first, last, _, _ = segments(data)
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        for runs in known.get(digest(view[a : b + SPAN]), ()):
            for low, high in [(0, b - a)] if runs is None else runs.tolist():
                mark[a + low] += 1
                mark[a + high + SPAN] -= 1
    return runs_of(np.cumsum(mark[:-1]) > 0)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_segments: int = HOT_SEGMENTS, keep_text: bool = False) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the kept bytes.

    Null and empty texts have no bytes; texts under ``SPAN`` bytes keep all; of copies every one loses its
    repeated bytes; repeated rows come out once each and repeat one another; an empty table gives no rows.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    asked = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"), _texts(docs, text).alias("row"))
    joined = asked.join(find_repeats(docs, text, hot_segments), "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, found in rows_of([batch], "text", "found"):
                data = body.encode()
                spans = covered(data, found) if found else np.zeros((0, 2), np.int64)
                edges = [0, *(x for a, b in spans.tolist() for x in (a, b + 1)), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            n, gone, spans, sha, kept = zip(*out, strict=True) if out else ((),) * 5
            arrays = [batch.column("key"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays[: 6 if keep_text else 5], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if keep_text else 5])

    shape = f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    return joined.select("key", "text", "found").mapInArrow(run, shape).withColumnRenamed("key", key)
