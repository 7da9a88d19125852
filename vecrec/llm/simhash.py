"""SimHash near-duplicates, searched by vantage-point trees.

A fingerprint bit is 1 if it is set in over half the XXH64 values of a text's word shingles. Equal
fingerprints are one class. A vantage-point tree is built on the driver from a bounded sample of
fingerprints: each inner node has a vantage point and a radius that halves its sample by Hamming
distance. Every fingerprint lives in the one leaf its distances lead to, and visits, as a guest, each
other leaf that the triangle inequality does not rule out: with a link at ``radius`` bits or fewer, a
fingerprint at distance d from the vantage point can have partners beyond the boundary only if d is
within ``radius`` of it. Of two partners on two sides only the inner one visits. Leaves are shards:
one task searches one leaf with the same rule again, down to blocks that are compared whole. The
result is exact.

A leaf returns a spanning forest of its links, not the pairs, so a dense ball of copies stays small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecrec.llm.common import ascii_words, batched, cut_lineage, fewer_files, rows_of
from vecrec.llm.components import components

SEED = 42
#: Least rows of the sample the shared top of the tree is built from, fingerprints wanted in a leaf shard, and rows of
#: the sample for each leaf wanted: the sample grows with the input, 32 KB for a million fingerprints.
SAMPLE_ROWS, LEAF_ROWS, LEAF_SAMPLE = 50_000, 4_000, 16
#: Below this many residents a node is compared whole.
BLOCK = 384


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of the space-joined ``n``-word shingles, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = np.concatenate([[0], ends[:-n] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit as a signed 64-bit integer; 0 for no hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[k : k + 65_536])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of every text, as a signed 64-bit integer. Null and empty texts have 0."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    arrow = pa.schema([("key", _arrow(kind)), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((k, fingerprint(shingle_hashes(ascii_words(t), shingle))) for k, t in rows_of(batches, "key", "text")), arrow)

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


# --- the tree


@dataclass
class Node:
    """An inner node (vantage point, radius, two children) or a leaf (its shard number)."""

    point: int = 0
    radius: int = 0
    near: Node | None = None
    far: Node | None = None
    leaf: int = -1


def distances(x: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ point)


def _halved(x: np.ndarray, rng: np.random.Generator, tries: int = 4) -> tuple[np.uint64, int, np.ndarray] | None:
    """The vantage point, of a few tried, whose boundary the fewest points lie at; None if none divides ``x``."""
    best = None
    for point in x[rng.integers(0, len(x), tries)]:
        d = distances(x, point)
        cut = int(np.median(d))
        near = int((d <= cut).sum())
        if 0 < near < len(x) and max(near, len(x) - near) <= 0.95 * len(x):
            at = int((np.abs(d.astype(np.int16) - cut) <= 1).sum()) + abs(2 * near - len(x))
            if best is None or at < best[0]:
                best = (at, point, cut, d)
    return best and best[1:]


def build_tree(sample: np.ndarray, leaves: int, seed: int = 7) -> tuple[Node, int]:
    """A tree with about ``leaves`` leaves over ``sample``, and how many it has."""
    rng, count = np.random.default_rng(seed), 0

    def grow(x: np.ndarray, depth: int) -> Node:
        nonlocal count
        cut = _halved(x, rng) if depth > 0 and len(x) >= 16 else None
        if cut is None:
            count += 1
            return Node(leaf=count - 1)
        point, radius, d = cut
        return Node(int(point), radius, grow(x[d <= radius], depth - 1), grow(x[d > radius], depth - 1))

    return grow(np.unique(sample), max(0, math.ceil(math.log2(max(1, leaves))))), count


def route(node: Node, x: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, positions in ``x``, whether resident there) for every leaf with visitors."""
    todo = [(node, np.arange(len(x)), np.ones(len(x), bool))]
    while todo:
        at, who, home = todo.pop()
        if not len(who):
            continue
        if at.leaf >= 0:
            yield at.leaf, who, home
            continue
        d = distances(x[who], np.uint64(at.point)).astype(np.int16)
        inner = d <= at.radius
        # residents stay on their side and, if inner, visit beyond the boundary; guests visit both sides in reach
        to_near = inner | (~home & (d <= at.radius + reach))
        to_far = ~inner | (d > at.radius - reach)
        todo += [(at.near, who[to_near], (home & inner)[to_near]), (at.far, who[to_far], (home & ~inner)[to_far])]


def forest(pairs: list[np.ndarray], size: int) -> np.ndarray:
    """Spanning links (node, smallest node of its component) of the pairs, as positions below ``size``."""
    if not pairs:
        return np.zeros((0, 2), np.int64)
    p, label = np.concatenate(pairs), np.arange(size)
    while True:
        low = np.minimum(label[p[:, 0]], label[p[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[p[:, 0]], low)
        np.minimum.at(new, label[p[:, 1]], low)
        new = np.minimum(new, new[new])
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(size))
    return np.stack([moved, label[moved]], axis=1)


def search(x: np.ndarray, home: np.ndarray, reach: int, seed: int = 11) -> np.ndarray:
    """Spanning links among ``x``, as positions: residents with each other and with guests."""
    rng, held, kept = np.random.default_rng(seed), 0, []
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, guests = todo.pop()
        if not len(own):
            continue
        cut = _halved(x[own], rng) if len(own) > BLOCK else None
        if cut is not None:
            point, radius, d = cut
            g = distances(x[guests], point).astype(np.int16)
            inner, d = d <= radius, d.astype(np.int16)
            cross = own[inner & (d > radius - reach)]
            if len(cross) <= 0.9 * inner.sum():  # else the boundary rules nothing out
                todo.append((own[inner], guests[g <= radius + reach]))
                todo.append((own[~inner], np.concatenate([guests[g > radius - reach], cross])))
                continue
        everyone = np.concatenate([own, guests])
        for k in range(0, len(own), BLOCK):
            rows = own[k : k + BLOCK]
            for m in range(k, len(everyone), 16_384):
                cols = everyone[m : m + 16_384]
                i, j = np.nonzero(np.bitwise_count(x[rows][:, None] ^ x[cols][None, :]) <= reach)
                pair = np.stack([rows[i], cols[j]], axis=1)
                pair = pair[pair[:, 0] != pair[:, 1]]
                if len(pair):
                    kept.append(pair)
                    held += len(pair)
                if held > 4_000_000:  # pairs give way to their spanning links
                    kept = [forest(kept, len(x))]
                    held = len(kept[0])
    return forest(kept, len(x))


def linked_fingerprints(fps: DataFrame, reach: int, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints in column ``fp`` that differ in at most ``reach`` bits."""
    total = fps.count()
    sample_rows = max(sample_rows, LEAF_SAMPLE * (total // leaf_rows))
    share = min(1.0, sample_rows / max(1, total))
    drawn = fps.where(F.pmod(F.xxhash64(F.lit("sample"), "fp"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample_rows).toPandas()["fp"]
    sample = np.sort(drawn.to_numpy(np.int64)).view(np.uint64)
    tree, leaves = build_tree(sample, min(max(1, total // leaf_rows), max(1, len(sample) // LEAF_SAMPLE)))
    # the parts must lie in as many partitions as there are leaves, not in the few a small table is read in
    spread = fps.repartition(max(1, min(leaves, 4 * fps.sparkSession.sparkContext.defaultParallelism)))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for leaf, who, home in route(tree, x, reach):
                yield pd.DataFrame({"leaf": np.int32(leaf), "fp": x[who].view(np.int64), "home": home})

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame["fp"].to_numpy(np.int64).view(np.uint64)
        found = search(x, frame["home"].to_numpy(bool), reach)
        return pd.DataFrame({"a": x[found[:, 0]].view(np.int64), "b": x[found[:, 1]].view(np.int64)})

    placed = spread.mapInPandas(place, "leaf int, fp bigint, home boolean")
    return placed.groupBy("leaf").applyInPandas(solve, "a bigint, b bigint")


def fingerprint_roots(fps: DataFrame, reach: int) -> DataFrame:
    """(fp, root): the component of every distinct fingerprint in ``fps`` under links at ``reach`` or fewer bits."""
    links = cut_lineage(linked_fingerprints(fps, reach))
    found = components(links, "a", "b").withColumnRenamed("node", "fp")
    return fps.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, reach: int = 2) -> DataFrame:
    """One row per document: key, fp (signed 64-bit), component (the smallest key reachable by links, its own included).

    Null, empty and wordless texts have fingerprint 0 and are linked like any other; repeated rows come
    out once each; a null key is no name for a component and its component is the smallest named one
    (null if there is none). An empty table gives no rows.
    """
    marked = cut_lineage(fingerprints(docs, key, text, shingle))
    classes = cut_lineage(marked.groupBy("fp").agg(F.min(key).alias("low")))
    rooted = classes.join(fingerprint_roots(classes.select("fp"), reach), "fp")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.select("fp", "root").join(lows, "root").select("fp", "component")
    return marked.join(named, "fp").select(key, "fp", "component")


# --- near duplicates by similarity: fingerprints and sketches propose (the radius is too wide for triangle bounds alone)

#: Bytes of a similarity sketch, and how far below the asked similarity it proposes (five standard errors at 0.8).
SKETCH, MARGIN = 192, 0.15
#: Minimum hashes that name the blocks a text is searched in: of pairs at 0.8, all but 0.2 ** 6 share one.
BLOCKS = 6
#: Words of a shingle of the pipeline's SimHash fingerprints, as of ``op5``.
FP_SHINGLE = 3
#: A block or cluster with more rows, or a cluster with more bytes of shingle hashes, is searched in pairs of parts of this size.
HOT_ROWS, HOT_BYTES = 20_000, 64_000_000
_MULTIPLIERS = np.random.default_rng(3).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of the shingle hashes under each of ``SKETCH`` permutations."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 4_096):
        np.minimum(out, (hashes[k : k + 4_096, None] * _MULTIPLIERS).min(axis=0), out=out)
    return out


def sketches(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, row, ident, fp, size, blocks, sketch): row and ident are hashes of the text and of its word sequence, fp
    is its SimHash fingerprint of ``FP_SHINGLE``-word shingles."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    arrow = pa.schema([("key", _arrow(kind)), ("row", pa.int64()), ("ident", pa.int64()), ("fp", pa.int64()), ("size", pa.int64()), ("blocks", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def measure(t: str | None) -> tuple:
        words = ascii_words(t)
        hashes = shingle_hashes(words, shingle)
        low = _mixed(min_hashes(hashes))
        ident = xxhash.xxh64_intdigest(b" ".join(words), SEED)
        blocks = _mixed(low[:BLOCKS] + np.arange(BLOCKS, dtype=np.uint64)).view(np.int64).tolist() if words else []
        fp = fingerprint(shingle_hashes(words, FP_SHINGLE))
        return np.uint64(ident).view(np.int64).item(), fp, len(hashes), blocks, (low & np.uint64(255)).astype(np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((k, r, *measure(t)) for k, r, t in rows_of(batches, "key", "row", "text")), arrow, 2048)

    asked = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("row"), docs[text].alias("text"))
    return asked.mapInArrow(run, f"key {kind}, row bigint, ident bigint, fp bigint, size bigint, blocks array<bigint>, sketch binary")


def agreeing(sketch: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many bytes each row of ``sketch`` agrees with ``one``."""
    lanes = (sketch == one).view(np.uint64).sum(axis=1)  # at most 24 in each byte
    return (lanes * np.uint64(0x0101010101010101)) >> np.uint64(56)


def linked(sketch: np.ndarray, least: int, alike=None) -> list[tuple[int, int]]:
    """Spanning links, as positions, of the rows whose sketches agree in ``least`` bytes or more.

    ``alike(p, rows)`` may hold such rows to a further test. A row that was reached is not compared again
    with others that were, so a dense ball costs little more than its rows.
    """
    own, left, queue, links = sketch, np.arange(len(sketch)), [], []
    while len(left):
        if queue:
            p = queue.pop()
        else:
            p, left, own = int(left[0]), left[1:], own[1:]
        near = np.flatnonzero(agreeing(own, sketch[p]) >= least)
        if alike is not None and len(near):
            near = near[alike(p, left[near])]
        if len(near):
            found = left[near].tolist()
            links += [(p, q) for q in found]
            queue += found
            left, own = np.delete(left, near), np.delete(own, near, axis=0)
    return links


def exact_test(sets: list[np.ndarray], similarity: float):
    """A function (p, rows) that tells which rows of distinct shingle hashes have a Jaccard similarity of ``similarity`` or more with row p."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mask = np.zeros(int(flat.max()) + 1, bool)

    def alike(p: int, rows: np.ndarray) -> np.ndarray:
        own, out = flat[starts[p] : starts[p] + sizes[p]], np.zeros(len(rows), bool)
        fit = np.flatnonzero(np.minimum(sizes[rows], sizes[p]) / np.maximum(sizes[rows], sizes[p]) >= similarity)
        mask[own] = True
        step = max(1, 2_000_000 // max(1, int(sizes[rows[fit]].max(initial=1))))
        for k in range(0, len(fit), step):
            some = rows[fit[k : k + step]]
            first = np.cumsum(sizes[some]) - sizes[some]
            at = np.arange(int(sizes[some].sum())) + np.repeat(starts[some] - first, sizes[some])
            both = np.add.reduceat(mask[flat[at]], first, dtype=np.int64)
            out[fit[k : k + step]] = both / (sizes[some] + sizes[p] - both) >= similarity
        mask[own] = False
        return out

    return alike


def _in_cells(rows: DataFrame, field: str, carried: list[str], solve) -> DataFrame:
    """Links (a, b) that ``solve`` finds in each cell: the rows of one ``field`` in a pair of its ``parts``.

    Every pair of parts is a cell of its own, so that no task holds more than two parts and no pair is lost.
    """
    cells = rows.withColumn("part", F.pmod(F.xxhash64("ident"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = cells.select(F.col(field).alias("name"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple]:
            at, group = None, []
            for name, i, j, *row in rows_of(batches, "name", "i", "j", *carried):
                if (name, i, j) != at:
                    if len(group) > 1:
                        yield from solve(group)
                    at, group = (name, i, j), []
                group.append(row)
            if len(group) > 1:
                yield from solve(group)

        yield from batched(links(), _LINKS)

    return placed.repartition("name", "i", "j").sortWithinPartitions("name", "i", "j").mapInArrow(run, "a bigint, b bigint")


def _table_of(group: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join(g[1] for g in group), np.uint8).reshape(len(group), SKETCH)


def proposed_links(classes: DataFrame, similarity: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Spanning links (a, b) of the classes (ident, blocks, sketch) whose sketches do not rule ``similarity`` out.

    Classes that share a minimum hash meet in its block. Blocks that one class alone names never reach Python.
    """
    asked = classes.select(F.explode("blocks").alias("block"), "ident", "sketch")
    sizes = cut_lineage(fewer_files(asked.groupBy("block").count().where("count > 1"), BLOCKS * classes.count() // 2))
    met = asked.join(sizes.select("block", F.ceil(F.col("count") / hot_rows).cast("int").alias("parts")), "block")
    least = sketch_bound(similarity)
    return _in_cells(met, "block", ["ident", "sketch"], lambda group: [(group[p][0], group[q][0]) for p, q in linked(_table_of(group), least)])


def sketch_bound(similarity: float) -> int:
    """The bytes in which the sketches of texts at ``similarity`` agree, all but about one pair in a million."""
    return int(np.ceil(((similarity - MARGIN) * 255 / 256 + 1 / 256) * SKETCH))


def exact_links(docs: DataFrame, members: DataFrame, key: str, text: str, shingle: int, similarity: float, hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Spanning links (a, b) of the members (ident, cluster, first, size, sketch) of a cluster at ``similarity`` or more.

    The similarity is the exact Jaccard index of the sets of word shingles, each named by its 64-bit hash.
    """
    held = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes"))
    parts = F.greatest(F.ceil(F.col("n") / hot_rows), F.ceil(8 * F.col("hashes") / hot_bytes)).cast("int")
    asked = members.join(held.select("cluster", parts.alias("parts")), "cluster").select("ident", "cluster", "parts", "sketch", F.col("first.key").alias("__key"), F.col("first.row").alias("__row"))
    texts = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("row"), docs[text].alias("text"))
    read = texts.join(asked, texts["key"].eqNullSafe(asked["__key"]) & (texts["row"] == asked["__row"])).select("ident", "cluster", "parts", "sketch", "text")
    arrow = pa.schema([("ident", pa.int64()), ("cluster", pa.int64()), ("parts", pa.int32()), ("sketch", pa.binary()), ("hashes", pa.binary())])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((*r, np.unique(shingle_hashes(ascii_words(t), shingle)).tobytes()) for *r, t in rows_of(batches, "ident", "cluster", "parts", "sketch", "text")), arrow, 512)

    def solve(group: list[tuple]) -> list[tuple]:
        group = list({g[0]: g for g in group}.values())  # repeated rows of a document
        alike = exact_test([np.frombuffer(g[2], np.uint64) for g in group], similarity)
        return [(group[p][0], group[q][0]) for p, q in linked(_table_of(group), least, alike)]

    least = sketch_bound(similarity)
    return _in_cells(read.mapInArrow(shingled, "ident bigint, cluster bigint, parts int, sketch binary, hashes binary"), "cluster", ["ident", "sketch", "hashes"], solve)


def fingerprint_links(classes: DataFrame, reach: int) -> DataFrame:
    """Spanning links (a, b) of the classes (ident, fp) whose fingerprints are connected at ``reach`` or fewer bits."""
    most = classes.count()
    fps = cut_lineage(fewer_files(classes.select("fp").distinct(), most))
    roots = cut_lineage(fewer_files(fingerprint_roots(fps, reach), most))
    rooted = classes.select("ident", "fp").join(roots, "fp")
    lows = rooted.groupBy("root").agg(F.min("ident").alias("b"))
    return rooted.join(lows, "root").where("ident <> b").select(F.col("ident").alias("a"), "b")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, hot_rows: int = HOT_ROWS, reach: int = 2) -> DataFrame:
    """The rows of ``docs``, with their columns, less all but one of each group of near duplicates.

    Texts with equal word sequences are one class. Two classes are linked if the Jaccard index of their
    sets of word shingles is ``similarity`` or more; a group is what links connect. SimHash fingerprints that
    :func:`simhash_groups` would link propose, and so do ``SKETCH`` one-byte minimum hashes, as such texts may
    differ in more bits: what both connect (the latter at ``similarity`` less ``MARGIN``) is a cluster, and
    within a cluster the index is computed from the sets. The row with the smallest key stays, a null key
    being the largest, and of repeated rows one. Texts without a word are copies of each other.
    """
    measured = cut_lineage(sketches(docs, key, text, shingle))
    first = F.struct(F.col("key").isNull().alias("no_key"), "key", "row")
    classes = measured.groupBy("ident").agg(F.min(first).alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("blocks").alias("blocks"), F.first("sketch").alias("sketch"))
    classes = cut_lineage(fewer_files(classes, measured.count()))
    most = classes.count()
    proposed = fingerprint_links(classes, reach).unionByName(proposed_links(classes, similarity, hot_rows))
    clusters = components(cut_lineage(proposed), "a", "b").select(F.col("node").alias("ident"), F.col("root").alias("cluster"))
    members = cut_lineage(fewer_files(classes.drop("blocks", "fp").join(clusters, "ident"), most))
    links = cut_lineage(exact_links(docs, members, key, text, shingle, similarity, hot_rows))
    found = components(links, "a", "b").withColumnRenamed("node", "ident")
    rooted = classes.select("ident", "first").join(found, "ident", "left").withColumn("root", F.coalesce("root", "ident"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("__key"), F.col("first.row").alias("__row"))
    kept = cut_lineage(fewer_files(kept, most))
    marked = docs.withColumn("__row", F.xxhash64(docs[text]))
    same = marked[key].eqNullSafe(kept["__key"]) & (marked["__row"] == kept["__row"])
    return marked.join(kept, same, "left_semi").dropDuplicates([key, "__row"]).drop("__row")
