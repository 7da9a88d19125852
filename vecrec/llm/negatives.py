"""Hard negatives by inner product: cover trees over norm-augmented candidates, searched best first.

A candidate x gets one more coordinate, sqrt(M² - |x|²), which puts all on a sphere of radius M; an anchor
gets a zero there. Inner products stay the same, and a ball around a candidate is a cap of the sphere,
so an anchor's inner products with all of a cap lie between two cosines.

* Candidates are dealt to their nearest of about one centre per ``PART_ROWS`` rows (by way of the nearest of
  the square root of as many coarse centres); what is crowded is split by a hash. A part is one task's work.
* In a part a cover tree is built: each node is a candidate with the radius that covers all below it, and
  children lie within half the radius of the level above.
* Anchors travel in packed blocks, one coarse centre's anchors to a block. A window is an interval of inner
  products of which an anchor wants the largest few. A block goes to a part only if the part's cap meets a
  window of one of its anchors. There the nodes are opened best first; a node whose cap misses all windows
  is left out with all below it, and an opened node's children are compared exactly. Windows close from
  below as their best fill up.
* First every block searches the parts of its own coarse centre, then, with what it found as lower ends,
  all others. Both searches are exact; the first only makes the second short.

Of equal vectors of one label only the few smallest ids can be among an anchor's first, so others are left
out before the search.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecrec.llm.common import cut_lineage

#: Rows of a part, anchors of a block, blocks that travel together, bytes of centres that may be sent to all tasks.
PART_ROWS, BLOCK_ROWS, CHUNK_BLOCKS, CENTRE_BYTES = 4096, 1024, 16, 32 << 20
#: Hits a block holds before it keeps the best, and leads of a node that are measured together.
PENDING, LEADS = 500_000, 64


class CoverTree:
    """Cover tree of the rows of a matrix, all put on a sphere of radius ``norm`` by one more coordinate."""

    def __init__(self, rows: np.ndarray, norm: float) -> None:
        self.rows, self.norm = rows, max(norm, 1e-300)
        lifted = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", rows, rows), 0.0))
        self.points = np.concatenate([rows, lifted[:, None]], axis=1)
        self.point: list[int] = []  # candidate of a node
        self.reach: list[float] = []  # angle that covers all below
        self.children: list[list[int]] = []
        self.again: list[bool] = []  # the parent's candidate, one level lower
        if len(rows):
            self._build()

    def _distances(self, members: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Of each member to each centre, by their inner products."""
        return np.sqrt(np.maximum(2 * (self.norm**2 - self.points[members] @ self.points[centres].T), 0.0))

    def _build(self) -> None:
        """Adds all nodes, by a stack of open work (candidate, all below it, whether it repeats its parent, parent)."""
        equal = 1e-6 * self.norm  # what inner products tell apart
        work = [(0, np.arange(1, len(self.points)), False, -1)]
        while work:
            centre, members, again, parent = work.pop()
            number = len(self.point)
            self.point.append(centre)
            self.children.append([])
            self.again.append(again)
            if parent >= 0:
                self.children[parent].append(number)
            if not len(members):
                self.reach.append(0.0)
                continue
            far = self._distances(members, np.array([centre]))[:, 0]
            widest = float(far.max())
            self.reach.append(2 * math.asin(min(1.0, (widest + equal) / (2 * self.norm))))
            if widest <= equal:
                work += [(int(m), members[:0], False, number) for m in members]
                continue
            inside = far <= widest / 2
            if inside.any():
                work.append((centre, members[inside], True, number))
            rest = members[~inside]
            while len(rest):
                # candidates for leads are measured together, and lead in order those that none before took
                leads = rest[:LEADS]
                close = self._distances(rest, leads) <= widest / 2
                open_ = np.ones(len(rest), bool)
                for k, lead in enumerate(leads.tolist()):
                    if open_[k]:
                        open_[k] = False
                        taken = open_ & close[:, k]
                        work.append((lead, rest[taken], False, number))
                        open_ &= ~taken
                rest = rest[open_]

    def search(self, anchors: np.ndarray, windows: Windows) -> None:
        """Offers every candidate inside a window to ``windows``; nodes are opened by falling upper bound."""
        if not self.point:
            return
        everyone = np.arange(len(anchors))
        norms = np.sqrt(np.einsum("ij,ij->i", anchors, anchors))
        slack = 0.25 + 1e-7 * norms * self.norm
        point, reach = np.array(self.point), np.array(self.reach)

        def bounds(who: np.ndarray, nodes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            full = np.maximum(norms[who] * self.norm, 1e-300)[:, None]
            angle = np.arccos(np.clip(scores / full, -1.0, 1.0))
            upper = full * np.cos(np.maximum(0.0, angle - reach[nodes]))
            lower = full * np.cos(np.minimum(math.pi, angle + reach[nodes]))
            return upper + slack[who, None], lower - slack[who, None]

        def push(who: np.ndarray, nodes: np.ndarray, scores: np.ndarray) -> None:
            open_ = np.array([bool(self.children[k]) for k in nodes.tolist()])
            if not open_.any():
                return
            nodes, scores = nodes[open_], scores[:, open_]
            upper, lower = bounds(who, nodes, scores)
            low, high = windows.span()
            wanted = (upper >= low[who, None]) & (lower <= high[who, None])
            for j in np.flatnonzero(wanted.any(axis=0)).tolist():
                mine = wanted[:, j]
                heapq.heappush(heap, (-float(upper[mine, j].max()), int(nodes[j]), who[mine], upper[mine, j]))

        heap: list[tuple[float, int, np.ndarray, np.ndarray]] = []
        root = np.array([0])
        scores = anchors @ self.rows[point[root]].T
        windows.offer(everyone, point[root], scores)
        push(everyone, root, scores)
        while heap:
            _, number, who, upper = heapq.heappop(heap)
            low, _ = windows.span()
            who = who[upper >= low[who]]
            if not len(who):
                continue
            nodes = np.array(self.children[number])
            scores = anchors[who] @ self.rows[point[nodes]].T
            new = np.array([not self.again[k] for k in nodes.tolist()])
            windows.offer(who, point[nodes[new]], scores[:, new])
            push(who, nodes, scores)


class Windows:
    """The largest ``k`` scores (ties: smallest ids) of each window; ``anchor`` ascends."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, anchor_ids: np.ndarray, anchor_labels: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool) -> None:
        self.anchor, self.low, self.high, self.k = anchor, low.copy(), high, k
        self.anchor_ids, self.anchor_labels, self.ids, self.labels, self.same = anchor_ids, anchor_labels, ids, labels, same
        self.first = np.searchsorted(anchor, np.arange(len(anchor_ids)))
        self.many = np.bincount(anchor, minlength=len(anchor_ids))
        self.found = [np.zeros((0,), np.int64), np.zeros((0,)), np.zeros((0,), np.int64)]  # window, score, candidate
        self.pending: list[list[np.ndarray]] = []
        self.size = 0
        self._spans()

    def _spans(self) -> None:
        """Interval that holds all windows of each anchor; an empty one without windows."""
        self.lowest = np.full(len(self.anchor_ids), np.inf)
        self.highest = np.full(len(self.anchor_ids), -np.inf)
        np.minimum.at(self.lowest, self.anchor, self.low)
        np.maximum.at(self.highest, self.anchor, self.high)

    def span(self) -> tuple[np.ndarray, np.ndarray]:
        return self.lowest, self.highest

    def offer(self, who: np.ndarray, candidates: np.ndarray, scores: np.ndarray) -> None:
        equal = self.anchor_labels[who][:, None] == self.labels[candidates][None, :]
        fits = (equal if self.same else ~equal) & (self.anchor_ids[who][:, None] != self.ids[candidates][None, :])
        fits &= (scores >= self.lowest[who, None]) & (scores <= self.highest[who, None])
        a, c = np.nonzero(fits)
        if not len(a):
            return
        value, a, c = scores[a, c], who[a], candidates[c]
        times = self.many[a]
        window = np.repeat(self.first[a] - np.cumsum(times) + times, times) + np.arange(times.sum())
        value, c = np.repeat(value, times), np.repeat(c, times)
        keep = (value >= self.low[window]) & (value <= self.high[window])
        self.pending.append([window[keep], value[keep], c[keep]])
        self.size += int(keep.sum())
        if self.size > 4 * self.k * len(self.anchor) or self.size > PENDING:
            self.settle()

    def settle(self) -> None:
        window, value, c = (np.concatenate(x) for x in zip(self.found, *self.pending, strict=True))
        order = np.lexsort((self.ids[c], -value, window))
        window, value, c = window[order], value[order], c[order]
        new = np.concatenate([[True], window[1:] != window[:-1]]) if len(window) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        rank = np.arange(len(window)) - np.repeat(start, np.diff(np.append(start, len(window))))
        keep = rank < self.k
        last = rank == self.k - 1
        self.low[window[last]] = np.maximum(self.low[window[last]], value[last])
        self.found, self.pending, self.size = [window[keep], value[keep], c[keep]], [], 0
        self._spans()


def usable(vectors: DataFrame, key: str, label: str, vector: str, scale: float) -> DataFrame:
    """(id, label, v) of rows with an id, a label and a vector of finite components; v is floor(scale * component)."""
    v = vectors[vector]
    rows = vectors.select(vectors[key].cast("bigint").alias("id"), vectors[label].alias("label"), F.transform(v, lambda x: x.cast("double")).alias("raw"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull())
    rows = rows.where(F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    floor = F.transform("raw", lambda x: F.floor(F.lit(scale) * x).cast("double") + F.lit(0.0))
    return rows.select("id", "label", floor.alias("v")).distinct()


def _matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    """Rows of a list column; short ones are filled up with zeros."""
    rows = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column
    out = np.zeros((len(rows), dim))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


class _Centres:
    """About one centre per part, each under one of the square root of as many coarse ones."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        n = max(1, math.isqrt(len(rows)))
        self.coarse = rows[:n]
        self.under = self._nearest(rows, self.coarse)
        self.members = [np.flatnonzero(self.under == c) for c in range(n)]

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (np.einsum("ij,ij->i", centres, centres) / 2 - x @ centres.T).argmin(axis=1)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(coarse centre, centre) of each row."""
        coarse = self._nearest(x, self.coarse)
        out = np.zeros(len(x), np.int64)
        for c in np.unique(coarse).tolist():
            mine = coarse == c
            near = self.members[c] if len(self.members[c]) else np.array([c])
            out[mine] = near[self._nearest(x[mine], self.rows[near])]
        # the centre decides, so that all rows of a centre share the coarse one
        return self.under[out].astype(np.int64), out


def _place(rows: DataFrame, centres: _Centres, dim: int, norm: float) -> DataFrame:
    """``rows`` with their coarse centre, centre and distance to it on the sphere."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", x, x), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            coarse, own = shared.value.place(x)
            c = shared.value.rows[own]
            apart = np.sqrt(((x - c) ** 2).sum(axis=1) + (lifted(x) - lifted(c)) ** 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coarse), pa.array(own), pa.array(apart)], names=[*batch.schema.names, "coarse", "centre", "apart"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{shape}, coarse bigint, centre bigint, apart double")


_BLOCK = "block string, coarse bigint, chunk bigint, a binary, ids binary, labels binary, v binary, w_anchor binary, w_mark binary, w_low binary, w_high binary"
_HIT = "a bigint, mark bigint, score double, id bigint"


def _packed(anchors: DataFrame, dim: int) -> DataFrame:
    """One row per block of (a, id, label_no, v, coarse, sub, windows (mark, low, high))."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a")
        windows = [(k, w["mark"], w["low"], w["high"]) for k, ws in enumerate(pdf["windows"]) for w in ws]
        who, mark, low, high = zip(*windows, strict=True) if windows else ((),) * 4
        coarse, sub = int(pdf["coarse"].iloc[0]), int(pdf["sub"].iloc[0])
        return pd.DataFrame([{
            "block": f"{coarse}-{sub}", "coarse": coarse, "chunk": (coarse * 1_000_003 + sub) // CHUNK_BLOCKS,
            "a": pdf["a"].to_numpy(np.int64).tobytes(), "ids": pdf["id"].to_numpy(np.int64).tobytes(), "labels": pdf["label_no"].to_numpy(np.int64).tobytes(),
            "v": _matrix(pdf["v"], dim).tobytes(), "w_anchor": np.array(who, np.int64).tobytes(), "w_mark": np.array(mark, np.int64).tobytes(),
            "w_low": np.array(low, np.float64).tobytes(), "w_high": np.array(high, np.float64).tobytes(),
        }])

    return anchors.groupBy("coarse", "sub").applyInPandas(pack, _BLOCK)


def _search(blocks: DataFrame, parts: DataFrame, caps: tuple[_Centres, np.ndarray, np.ndarray], dim: int, norm: float, k: int, same: bool, own: bool) -> DataFrame:
    """(a, mark, score, id): each window's best of the parts of its block's own coarse centre, or of all others."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(caps)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, reach, splits = shared.value
        for batch in batches:
            out: list[tuple] = []
            for r in batch.select(["block", "coarse", "chunk", "v", "w_anchor", "w_low", "w_high"]).to_pylist():
                q = np.frombuffer(r["v"]).reshape(-1, dim)
                who = np.frombuffer(r["w_anchor"], np.int64)
                if not len(who):
                    continue
                low, high = np.full(len(q), np.inf), np.full(len(q), -np.inf)
                np.minimum.at(low, who, np.frombuffer(r["w_low"]))
                np.maximum.at(high, who, np.frombuffer(r["w_high"]))
                full = np.maximum(np.sqrt(np.einsum("ij,ij->i", q, q)) * max(norm, 1e-300), 1e-300)[:, None]
                angle = np.arccos(np.clip(q @ centres.rows.T / full, -1.0, 1.0))
                slack = 0.25 + 1e-7 * full
                meets = (full * np.cos(np.maximum(0.0, angle - reach)) + slack >= low[:, None]) & (full * np.cos(np.minimum(math.pi, angle + reach)) - slack <= high[:, None])
                wanted = meets.any(axis=0) & (splits > 0) & ((centres.under == r["coarse"]) == own)
                out += [(r["block"], r["chunk"], c, s) for c in np.flatnonzero(wanted).tolist() for s in range(int(splits[c]))]
            if out:
                names, chunks, c, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(chunks, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64())], names=["block", "chunk", "centre", "split"])

    pairs = cut_lineage(blocks.mapInArrow(route, "block string, chunk bigint, centre bigint, split bigint"))
    left = parts.join(pairs.select("centre", "split", "chunk").distinct(), ["centre", "split"]).select("centre", "split", "chunk", "id", "label_no", "v")
    right = pairs.join(blocks.drop("chunk", "coarse"), "block")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # fresh column identities: both sides come from ``pairs``

    def find(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(rows) and len(asked):
            rows = rows.sort_values("id")
            x, ids, labels = _matrix(rows["v"], dim), rows["id"].to_numpy(np.int64), rows["label_no"].to_numpy(np.int64)
            tree = CoverTree(x, norm)
            for r in asked.itertuples():
                a, q = np.frombuffer(r.a, np.int64), np.frombuffer(r.v).reshape(-1, dim)
                who, mark = np.frombuffer(r.w_anchor, np.int64), np.frombuffer(r.w_mark, np.int64)
                windows = Windows(who, np.frombuffer(r.w_low), np.frombuffer(r.w_high), k, np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64), ids, labels, same)
                tree.search(q, windows)
                windows.settle()
                window, value, c = windows.found
                out.append(pd.DataFrame({"a": a[who[window]], "mark": mark[window], "score": value, "id": ids[c]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "mark": [], "score": [], "id": []})

    keys = ["centre", "split", "chunk"]
    return cut_lineage(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(find, _HIT))


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of each window with their rank."""
    order = Window.partitionBy("a", "mark").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """Candidates in parts around centres, ready to be searched by blocks of anchors."""

    def __init__(self, rows: DataFrame, copies: int, part_rows: int = PART_ROWS, centre_bytes: int = CENTRE_BYTES) -> None:
        """``rows`` (id, label, v) stored; of equal rows the ``copies`` smallest ids are searched."""
        n, dim, norm = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
        self.n, self.dim, self.norm = n, max(1, dim or 1), float(norm or 0.0) * (1 + 1e-12)
        alike = Window.partitionBy("label", "v").orderBy("id")
        kept = rows.withColumn("r", F.row_number().over(alike)).where(F.col("r") <= copies).drop("r")
        wanted = min(max(1, math.ceil(n / part_rows)), max(1, centre_bytes // (8 * self.dim)))
        drawn = rows.select("v", F.xxhash64(F.lit("centre"), "id").alias("h")).orderBy("h", "v").limit(wanted).select("v").collect()
        points = _matrix(pd.Series([r[0] for r in drawn]), self.dim) if drawn else np.zeros((1, self.dim))
        self.centres = _Centres(points)
        # labels as numbers, so that blocks are plain arrays; equal hashes would need 2^32 labels
        placed = _place(kept.withColumn("label_no", F.xxhash64(F.col("label").cast("string"))).drop("label"), self.centres, self.dim, self.norm)
        placed = cut_lineage(placed)
        sizes = placed.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("apart"))
        self.reach, self.splits = np.zeros(len(points)), np.zeros(len(points), np.int64)
        for r in sizes.collect():  # at most one row per centre
            self.reach[r.centre] = 2 * math.asin(min(1.0, r.apart / (2 * max(self.norm, 1e-300)) * (1 + 1e-9) + 1e-12))
            self.splits[r.centre] = math.ceil(r.n / (2 * part_rows))
        many = F.broadcast(sizes.select("centre", F.ceil(F.col("n") / (2 * part_rows)).alias("many")))  # one row per centre
        self.parts = placed.join(many, "centre").withColumn("split", F.pmod(F.xxhash64("id"), F.col("many"))).select("centre", "split", "id", "label_no", "v")

    def anchors(self, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """(a, id, label_no, v, coarse, sub) of anchors (a, id, label, v)."""
        placed = _place(rows.withColumn("label_no", F.xxhash64(F.col("label").cast("string"))).drop("label"), self.centres, self.dim, self.norm).drop("centre", "apart")
        placed = cut_lineage(placed)
        many = F.broadcast(placed.groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("many")))  # at most one row per coarse centre
        return cut_lineage(placed.join(many, "coarse").withColumn("sub", F.pmod(F.xxhash64("a"), F.col("many"))).drop("many"))

    def first(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(a, mark, score, id, rank): the ``k`` best of each window of anchors (..., windows)."""
        caps = (self.centres, self.reach, self.splits)
        blocks = cut_lineage(_packed(asked, self.dim))
        found = _search(blocks, self.parts, caps, self.dim, self.norm, k, same, own=True)
        full = _best(found, k).where(F.col("rank") == k).select("a", "mark", F.col("score").alias("reached"))
        opened = asked.withColumn("w", F.explode("windows")).select("a", *(F.col(f"w.{c}").alias(c) for c in ("mark", "low", "high")))
        opened = opened.join(full, ["a", "mark"], "left").withColumn("low", F.greatest("low", "reached"))
        again = opened.groupBy("a").agg(F.collect_list(F.struct("mark", "low", "high")).alias("windows"))  # as few as it had
        blocks = cut_lineage(_packed(asked.drop("windows").join(again, "a"), self.dim))
        return _best(found.unionByName(_search(blocks, self.parts, caps, self.dim, self.norm, k, same, own=False)), k)


def hard_negatives(
    vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 100, scale: float = 256.0,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. Components become floor(scale * component);
    a score is the inner product, larger first, ties by smaller id. An anchor's positives are its first
    ``positives`` other rows of its label; per positive the first ``negatives`` rows of another label come
    back whose score is between ``low`` and ``high`` percent of the positive's.

    Rows with a null id, label or vector or a null or non-finite component take no part; vectors of other
    lengths are filled up with zeros; fully equal rows are one row; rows that share an id are rows of
    their own, but never another row than an anchor of that id. Anchors without positives, and positives
    without rows in their window, give none; an empty table gives none. Scores beyond 2^53 are rounded.
    """
    rows = cut_lineage(usable(vectors, key, label, vector, scale))
    index = Index(rows, max(positives, negatives) + 1, part_rows)
    anchors = cut_lineage(rows.where(F.col("id") % every == 0).withColumn("a", F.monotonically_increasing_id()))
    anchors = index.anchors(anchors, block_rows)

    def window(mark: Column, low: Column, high: Column) -> Column:
        return F.struct(mark.cast("bigint").alias("mark"), low.cast("double").alias("low"), high.cast("double").alias("high"))

    whole = F.array(window(F.lit(0), F.lit(float("-inf")), F.lit(float("inf"))))
    positive = cut_lineage(index.first(anchors.withColumn("windows", whole), positives, True).select("a", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").cast("bigint").alias("mark")))
    ends = window(F.col("mark"), F.ceil(F.col("positive_score") * low / 100), F.floor(F.col("positive_score") * high / 100))
    asked = positive.where("positive_score >= 0").groupBy("a").agg(F.sort_array(F.collect_list(ends)).alias("windows"))  # at most ``positives``
    negative = index.first(anchors.join(asked, "a"), negatives, False)
    found = negative.join(positive, ["a", "mark"]).join(anchors.select("a", F.col("id").alias("anchor_id")), "a")
    return found.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("positive_score").cast("bigint").alias("positive_score"), F.col("score").cast("bigint").alias("negative_score"),
    )


__all__ = ["CoverTree", "Index", "Windows", "hard_negatives", "usable"]
