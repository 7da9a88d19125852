"""Benchmark decontamination under edit distance.

Texts and items are read as lower-cased word sequences. A text holds an item if some window of it is
within ``edits`` word edits (a fifth of the item's words) of the whole item.

1. Windows: an edit breaks at most two of an item's word pairs, so a window within e edits of an item
   of n words keeps n - 1 - 2e of them. Item-sized windows with fewer pairs of any item are passed
   over; this loses nothing.
2. CGK embedding: a random walk reads a word, writes it, and moves on or stays by a random bit of (step,
   word). Two sequences few edits apart fall into step again after an edit, so edit distance becomes
   Hamming distance of what was written. Items are embedded from the starts of their thirds, or of more
   parts if they are long (one for ``PART_WORDS`` words), texts from every start within the windows.
3. Bit sampling: each of ``TABLES`` walks is hashed at ``SAMPLED`` random steps; equal hashes make a
   candidate. With these numbers recall at the full edit allowance is above 0.97 (tests measure it to 400 words).
4. Candidates are verified by the exact least edit distance of the item to any window around.

Documents never leave their partition. Items are a stated query set: blocks of at most
``BLOCK_CHARS`` characters go to the tasks, one pass per block. Letters of scripts without spaces are
words of their own.

Items of under ``MIN_WORDS`` words are too short for walks; their allowance is none below 5 words and
one edit from there. They are looked up exactly: whole windows, windows without one inner word (a
word replaced or put in) and windows a word short (a word left out) meet the item, or the
item without that word, by hash, and are compared word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecrec.llm.common import cut_lineage

MIN_WORDS = 8
EDIT_SHARE = 0.2
TABLES, SAMPLED = 12, 5
#: Parts an item is walked from, at least; long items have one for so many words, so that no walk meets too many edits.
THIRDS, PART_WORDS = 3, 20
BLOCK_CHARS = 16_000_000
#: Words of documents that are looked at together.
CHUNK_WORDS = 400_000
#: Letters of scripts written without spaces: Thai, Lao, Burmese, Khmer, kana and Han. Each is a word of its own.
UNSPACED = "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ecd\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u1780-\u17d3\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
WORD = re.compile(f"[{UNSPACED}]|[^\\W{UNSPACED}]+")
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def allowed(n: int) -> int:
    return int(EDIT_SHARE * n)


def walk(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, run: int) -> np.ndarray:
    """(steps, starts): the words that walk number ``run`` writes from each start; word 0 beyond the end."""
    out = np.empty((steps, len(starts)), np.uint64)
    at, salt = starts.copy(), np.uint64((run * 1000 + 1) * int(M2) % (1 << 64))
    for j in range(steps):
        out[j] = np.where(at < ends, ids[np.minimum(at, len(ids) - 1)], 0)
        at += (mixed(out[j] * np.uint64(4096) + np.uint64(j) + salt) >> np.uint64(63)).astype(np.int64)
    return out


def sample_key(written: np.ndarray, chosen: np.ndarray, run: int) -> np.ndarray:
    """Hash of what a walk wrote at the chosen steps."""
    key = np.full(written.shape[1], run + 1, np.uint64)
    for j in chosen:
        key = mixed(key ^ (written[j] + np.uint64(1)))
    return key


def least_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least word edits that turn some window of ``text`` into ``item``, and the end of the first such window."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class Items:
    """A block of items, ready for search."""

    ids: list = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    vocab: dict[str, int] = field(default_factory=dict)
    pairs: np.ndarray | None = None
    classes: list[tuple] = field(default_factory=list)
    short: list[tuple] = field(default_factory=list)

    @staticmethod
    def of(rows: list[tuple], least_words: int = 1) -> Items:
        block = Items()
        for key, text in rows:
            found = tokens(text)
            if key is None or len(found) < max(1, least_words):
                continue
            block.ids.append(key)
            block.words.append(np.array([block.vocab.setdefault(w, len(block.vocab) + 1) for w in found], np.int64))
        if not block.ids:
            return block
        rng, lengths = np.random.default_rng(23), np.array([len(w) for w in block.words])
        for n in range(1, MIN_WORDS):
            members = np.flatnonzero(lengths == n)
            if not len(members):
                continue
            whole = np.stack([block.words[m] for m in members])
            pairs = np.unique(whole[:, :-1] * np.int64(1 << 31) + whole[:, 1:])
            patterns = []
            for width, places, kept, edits in short_patterns(n):
                held = whole[:, kept]
                keys = sample_key(held.T.astype(np.uint64), np.arange(len(kept)), n)
                order = np.argsort(keys, kind="stable")
                patterns.append((width, places, keys[order], held[order], members[order], edits))
            block.short.append((n, pairs, patterns))
        if lengths.max() < MIN_WORDS:
            return block
        block.pairs = np.unique(np.concatenate([pair_keys(w) for w in block.words if len(w) >= MIN_WORDS]))
        low = lengths[lengths >= MIN_WORDS].min()
        while low <= lengths.max():  # items of similar length are searched together
            top = max(int(low * 1.15), low)
            members = np.flatnonzero((lengths >= low) & (lengths <= top))
            if len(members):
                parts = max(THIRDS, int(low) // PART_WORDS)
                steps = max(SAMPLED, 2 * (low // parts))
                sampled = [np.sort(rng.choice(steps, SAMPLED, replace=False)) for _ in range(TABLES)]
                flat = np.concatenate([block.words[m] for m in members])
                stop = np.cumsum(lengths[members])
                offsets = np.array([[k * lengths[m] // parts for k in range(parts)] for m in members])
                begin = (stop - lengths[members])[:, None] + offsets
                runs = (walk(flat, begin.ravel(), np.repeat(stop, parts), steps, t) for t in range(TABLES))
                keys = np.stack([sample_key(w, c, t) for t, (w, c) in enumerate(zip(runs, sampled, strict=True))])
                order = np.argsort(keys.ravel(), kind="stable")
                owner = np.tile(np.repeat(members, parts), TABLES)[order]
                shift = np.tile(offsets.ravel(), TABLES)[order]
                block.classes.append((int(low), int(top), steps, sampled, keys.ravel()[order], owner, shift))
            low = top + 1
        return block


def equal_ranges(keys: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``drawn``, position in the sorted ``keys``) of all that are equal."""
    first, last = np.searchsorted(keys, drawn, side="left"), np.searchsorted(keys, drawn, side="right")
    met = np.flatnonzero(last > first)
    count = (last - first)[met]
    return np.repeat(met, count), np.repeat(first[met], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def short_patterns(n: int) -> list[tuple[int, list[int], list[int], int]]:
    """(width of the window, its words that count, the item's words they equal, edits) for items of ``n`` words.

    A word replaced or put in at either end needs no pattern of its own: the window without it has one.
    """
    every = list(range(n))
    out = [(n, every, every, 0)]
    if allowed(n) >= 1:
        without = lambda k, size: [j for j in range(size) if j != k]
        out += [(n, without(k, n), without(k, n), 1) for k in range(1, n - 1)]
        out += [(n + 1, without(k, n + 1), every, 1) for k in range(1, n)]
        out += [(n - 1, every[:-1], without(k, n), 1) for k in range(n)]
    return out


def short_matches(items: Items, ids: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text number, item number, edits) of every text that holds an item of under ``MIN_WORDS`` words."""
    for n, pairs, patterns in items.short:
        begins = np.flatnonzero(ids > 0)
        if n > 1 + 2 * allowed(n):  # a window within the allowance keeps so many word pairs of the item
            known = pair_keys(ids)
            hits = np.zeros(len(ids) + 1, np.int64)
            hits[1:-1] = np.cumsum(pairs[np.minimum(np.searchsorted(pairs, known), len(pairs) - 1)] == known)
            hits[-1] = hits[-2]
            last = np.minimum(begins + n + allowed(n) - 1, len(ids))
            begins = begins[hits[last] - hits[begins] >= n - 1 - 2 * allowed(n)]
        best: dict[tuple[int, int], int] = {}
        for width, places, keys, held, members, edits in patterns:  # those without edits come first
            begin = begins[begins + width <= len(ids)]
            begin = begin[np.all([ids[begin + j] > 0 for j in places], axis=0)]
            drawn = sample_key(np.stack([ids[begin + j] for j in places]).astype(np.uint64), np.arange(len(places)), n)
            where, at = equal_ranges(keys, drawn)
            same = np.all([ids[begin[where] + j] == held[at, i] for i, j in enumerate(places)], axis=0)
            first, at = begin[where[same]], at[same]
            own = np.searchsorted(stops, first, side="right")
            inside = first + width < stops[own]  # a window does not reach into the next text
            for text, item in np.unique(np.stack([own[inside], members[at[inside]]], axis=1), axis=0).tolist():
                best.setdefault((text, item), edits)
        for (text, item), edits in best.items():
            yield text, item, edits


def pair_keys(ids: np.ndarray) -> np.ndarray:
    return ids[:-1] * np.int64(1 << 31) + ids[1:]


def search(items: Items, texts: list[list[str]]) -> Iterator[tuple[int, int, int]]:
    """(text number, item number, edits) of every text that holds an item; each pair once, with the least edits."""
    get = items.vocab.get
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(sizes + 1)  # a 0 after each text keeps pairs apart
    ids = np.zeros(int(stops[-1]) if len(stops) else 0, np.int64)
    for text, stop, n in zip(texts, stops, sizes, strict=True):
        ids[stop - 1 - n : stop - 1] = np.fromiter(map(get, text, repeat(0)), np.int64, n)
    if len(ids) < 2:
        return
    yield from short_matches(items, ids, stops)
    if not items.classes:
        return
    both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    known = pair_keys(ids)[both]
    found = items.pairs[np.minimum(np.searchsorted(items.pairs, known), len(items.pairs) - 1)] == known
    hits = np.zeros(len(ids) + 1, np.int64)
    hits[both[found] + 1] = 1
    hits = np.cumsum(hits)  # hits[i]: pairs of some item that begin before i
    wanted: dict[tuple[int, int], set[int]] = {}
    per_class = []
    for low, top, *_ in items.classes:
        # the least number of kept pairs over the lengths of the class
        need = max(1, min(n - 1 - 2 * allowed(n) for n in range(low, top + 1)))
        ends = np.minimum(np.arange(len(ids)) + top + allowed(top), len(ids))
        dense = np.flatnonzero(hits[ends] - hits[:-1] >= need)
        inside = np.zeros(len(ids) + 1, np.int64)  # every start within a dense window
        np.add.at(inside, dense, 1)
        np.add.at(inside, ends[dense], -1)
        per_class.append((np.cumsum(inside)[:-1] > 0) & (ids > 0))
    starts = np.flatnonzero(np.logical_or.reduce(per_class))
    for k in range(0, len(starts), 50_000):
        begin = starts[k : k + 50_000]
        own = np.searchsorted(stops, begin, side="right")
        for t in range(TABLES):
            written = walk(ids, begin, stops[own] - 1, max(c[2] for c in items.classes), t)
            for (low, _, _, sampled, keys, owner, shift), mask in zip(items.classes, per_class, strict=True):
                who = np.flatnonzero(mask[begin])
                drawn = sample_key(written[:, who], sampled[t], t)
                met, at = equal_ranges(keys, drawn)
                where, grain = who[met], max(1, low // 4)
                guess = np.unique(np.stack([own[where], owner[at], (begin[where] - shift[at]) // grain], axis=1), axis=0)
                for text, item, place in guess.tolist():
                    wanted.setdefault((text, item), set()).add(place * grain)
    for (text, item), places in wanted.items():
        word, n = items.words[item], len(items.words[item])
        slack, own_pairs = allowed(n) + n // 2 + 2, pair_keys(word)
        base, stop, best = int(stops[text] - 1 - sizes[text]), int(stops[text] - 1), n
        reach = -1
        for place in sorted(places):
            a, b = max(base, place - slack), min(stop, place + n + 2 * slack)
            if b <= reach or a >= b:
                continue
            reach = b
            if np.isin(pair_keys(ids[a:b]), own_pairs).sum() < n - 1 - 2 * allowed(n):
                continue
            best = min(best, least_edits(word, ids[a:b])[0])
        if best <= allowed(n):
            yield text, item, best


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
    """Tokenised texts in runs of about ``CHUNK_WORDS`` words, with the number of the first."""
    begin, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(tokens(text))
        size += len(held[-1]) + 1
        if size >= CHUNK_WORDS:
            yield begin, held
            begin, held, size = k + 1, [], 0
    if held:
        yield begin, held


def item_blocks(items: DataFrame, key: str, text: str, block_chars: int, least_words: int = 1) -> Iterator[Items]:
    """The items in blocks of about ``block_chars`` characters; one block at a time is on the driver."""
    rows = items.select(F.col(key).alias("key"), F.col(text).alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == b) if n > 1 else rows
        yield Items.of([tuple(r) for r in part.orderBy("key", "text").collect()], least_words)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, least_words: int = 1) -> DataFrame:
    """One row (key, item key, edits, item_words) for each document row and item it holds.

    Null and wordless texts hold nothing; null or wordless item texts and null keys match nothing; repeated document
    rows come out once each; an empty table on either side gives no rows. Document keys may be null. Texts of any
    length are searched whole. Of an item's windows the least edits count; items that tie all come out. Other columns,
    whatever their names, are not read. Items of fewer than ``least_words`` words are not asked for.
    """
    kind, item_kind = (f.select(k).schema[0].dataType for f, k in ((docs, key), (items, item_key)))
    shape = f"{key} {kind.simpleString()}, {item_key} {item_kind.simpleString()}, edits bigint, item_words bigint"
    asked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    out = None
    for block in item_blocks(items, item_key, item_text, block_chars, least_words):
        found = asked.mapInArrow(lambda batches, block=block: _report(batches, block, key, item_key), shape)
        out = found if out is None else out.unionByName(found)
    return out


def _report(batches: Iterator[pa.RecordBatch], block: Items, key: str, item_key: str) -> Iterator[pa.RecordBatch]:
    for batch in batches if block.ids else ():
        keys, rows = batch.column("key"), []
        for begin, texts in _chunks(batch.column("text").to_pylist()):
            rows += [(begin + t, block.ids[i], e, len(block.words[i])) for t, i, e in search(block, texts)]
        if rows:
            at, items, edits, sizes = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(items), pa.array(edits, pa.int64()), pa.array(sizes, pa.int64())], names=[key, item_key, "edits", "item_words"])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, least_words: int = 1) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no item of ``least_words`` words or more."""
    position = docs.columns.index(text)
    for k, block in enumerate(item_blocks(items, item_key, item_text, block_chars, least_words)):
        if k:
            docs = cut_lineage(docs)
        docs = docs.mapInArrow(lambda batches, block=block: _clean(batches, block, position), docs.schema)
    return docs


def _clean(batches: Iterator[pa.RecordBatch], block: Items, position: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for begin, texts in _chunks(batch.column(position).to_pylist()) if block.ids else ():
            keep[[begin + t for t, _, _ in search(block, texts)]] = False
        yield batch.filter(pa.array(keep))
