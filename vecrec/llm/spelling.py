"""Spelling variants: words one code point apart, by a dictionary of trie-node pairs.

A word of the vocabulary is a path in the trie of all words, and its reversal a path in the trie of all
reversals. Both tries' nodes are numbered, so that a split of a word at a place is a pair of integers
(node of the part before, node of the part after), and the pair says all about the string. Per word two
kinds of pairs are listed:

* skips: the parts around one left-out place (one pair per place),
* splits: the parts around a gap of no width (one pair per gap).

Words with an equal skip pair differ by one replaced code point; a word whose skip pair is another's split
pair becomes that word by one deletion. Deleting any place of a run of equal letters gives the same
string, so only the first of a run may meet a split: each pair of near words meets in exactly one node
pair. A node pair is held by at most one split and one skip per letter of the alphabet, so no group
grows with the vocabulary, and what a word needs of a group (how many there are, the best that is not
itself) follows from the group's two best: pairs of words never become rows.

Numbering takes no string per node: the words are range-partitioned and sorted, a node is new where a word
leaves the path of the word before it, and each partition numbers its own. Paths that a partition's first
word shares with the last word before it are renamed by a small table of the boundary words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecrec.llm.common import LOWER_AZ, batched, cut_lineage, rows_of
from vecrec.session import cut_and_count

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: A task sends its partial counts when it holds so many words, or has read so many bytes since the last time.
HELD_WORDS, HELD_BYTES = 200_000, 64 << 20
SKIP, FIRST_SKIP, SPLIT = 0, 1, 2


def count_words(docs: DataFrame, key: str, text: str, min_length: int = MIN_LENGTH, typo_every: int = 0) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lower-cased, of at least ``min_length`` code points.

    With ``typo_every`` a run of a document loses the code point ``h % length`` if that number divides
    ``h``, the crc32 of ``<key>:<run>`` (a null key is the empty string); lengths are judged afterwards.
    """
    asked = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("key"), docs[text].alias("text")).where("text IS NOT NULL")
    shape = pa.schema([("word", pa.string()), ("n", pa.int64())])
    # a run that is too short stays too short without a code point
    run_of = re.compile(f"[{LETTERS}]{{{max(1, min_length)},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0
        for name, body in rows_of(batches, "key", "text"):
            found = Counter(run_of.findall(body.encode().translate(LOWER_AZ).decode()))
            if typo_every:
                begin = zlib.crc32(f"{name}:".encode())
                for word, n in list(found.items()):
                    h = zlib.crc32(word.encode(), begin)
                    if h % typo_every == 0:
                        at = h % len(word)
                        del found[word]
                        if len(word) > min_length:
                            held[word[:at] + word[at + 1 :]] += n
            held.update(found)
            size += len(body)
            if len(held) > HELD_WORDS or size > HELD_BYTES:
                yield from batched(held.items(), shape)
                held, size = Counter(), 0
        yield from batched(held.items(), shape)

    return asked.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _common(a: str, b: str) -> int:
    m = min(len(a), len(b))
    if a[:m] == b[:m]:
        return m
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


def trie_nodes(words: DataFrame, backwards: bool) -> tuple[DataFrame, dict[int, int]]:
    """((id, word, nodes), renamed): per distinct word its path of node numbers from the root (0), ids in code-point order.

    ``renamed`` gives the valid number of nodes on paths that cross a partition's boundary: at most one
    path per partition.
    """
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = words.select((F.reverse("word") if backwards else F.col("word")).alias("key")).repartitionByRange(n, "key").sortWithinPartitions("key")
    shape = pa.schema([("part", pa.int64()), ("id", pa.int64()), ("key", pa.string()), ("nodes", pa.list_(pa.int64()))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            base = (part + 1) << 40
            free, before, path = base, "", [0]
            for k, (word,) in enumerate(rows_of(batches, "key")):
                shared = _common(before, word)
                more = len(word) - shared
                path = path[: shared + 1] + list(range(free, free + more))
                free, before = free + more, word
                yield part, base + k, word, path

        yield from batched(rows(), shape, 4096)

    stored = cut_lineage(ordered.mapInArrow(number, "part bigint, id bigint, key string, nodes array<bigint>"))
    row = F.struct("key", "nodes")
    ends = stored.groupBy("part").agg(F.min_by(row, "id").alias("first"), F.max_by(row, "id").alias("last")).orderBy("part").collect()
    renamed: dict[int, int] = {}
    before, path = "", [0]
    for r in ends:
        shared = _common(before, r.first.key)
        renamed |= dict(zip(r.first.nodes[1 : shared + 1], path[1 : shared + 1], strict=True))
        before, path = r.last.key, [renamed.get(x, x) for x in r.last.nodes]
    word = F.reverse("key") if backwards else F.col("key")
    return stored.select("id", word.alias("word"), "nodes"), renamed


def _valid(nodes: np.ndarray, renamed: dict[int, int]) -> np.ndarray:
    if renamed:
        old = np.array(sorted(renamed), np.int64)
        new = np.array([renamed[x] for x in old.tolist()], np.int64)
        at = np.minimum(np.searchsorted(old, nodes), len(old) - 1)
        return np.where(old[at] == nodes, new[at], nodes)
    return nodes


_PAIRS = pa.schema([("prefix", pa.int64()), ("suffix", pa.int64()), ("role", pa.int8()), ("id", pa.int64()), ("n", pa.int64())])
_PAIR_BYTES = 1 << 22


def node_pairs(paths: DataFrame, renamed: dict[int, int], renamed_back: dict[int, int]) -> DataFrame:
    """(prefix, suffix, role, id, n) for all skips and splits of (id, word, n, nodes, back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield from pieces(batch.slice(at, 4096))

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ahead, back = batch.column("nodes"), batch.column("back")
        prefix = _valid(ahead.flatten().to_numpy(zero_copy_only=False), renamed)
        suffix = _valid(back.flatten().to_numpy(zero_copy_only=False), renamed_back)
        sizes = np.diff(ahead.offsets.to_numpy())  # length + 1 of each word
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(prefix))
        mirror = (starts + ends - 1)[word] - place  # the suffix that begins at this place
        ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
        inside = place < (ends - 1)[word]
        letters = np.zeros(len(prefix), np.uint32)
        letters[inside] = np.frombuffer("".join(batch.column("word").to_pylist()).encode("utf-32-le"), "<u4")
        first = (place == starts[word]) | (letters != np.roll(letters, 1))
        p = np.concatenate([prefix, prefix[inside]])
        s = np.concatenate([suffix[mirror], suffix[mirror[inside] - 1]])
        role = np.concatenate([np.full(len(prefix), SPLIT, np.int8), first[inside].astype(np.int8)])
        w = np.concatenate([word, word[inside]])
        for k in range(0, len(p), _PAIR_BYTES // 32):
            cut = slice(k, k + _PAIR_BYTES // 32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p[cut], s[cut], role[cut], ids[w[cut]], n[w[cut]])], schema=_PAIRS)

    return paths.mapInArrow(run, "prefix bigint, suffix bigint, role tinyint, id bigint, n bigint")


_MET = pa.schema([("id", pa.int64()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near_id", pa.int64())])


def meet(pairs: DataFrame) -> DataFrame:
    """(id, n_near, near_n, near_id): what each word meets in each node pair held more than once; the best of each."""
    placed = pairs.repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix", F.desc("n"), "id")

    def of(p: np.ndarray, s: np.ndarray, role: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
        """Whole groups, each by falling n, then id."""
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])
        alone = new & np.concatenate([new[1:], [True]])
        role, ids, n, new = role[~alone], ids[~alone], n[~alone], new[~alone]
        if not len(ids):
            return None
        group = np.cumsum(new) - 1
        count = int(group[-1]) + 1

        def best(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(how many, first, second) row per group among the kept ones; -1 where there is none."""
            at = np.flatnonzero(keep)
            own = group[at]
            many = np.bincount(own, minlength=count)
            begin = np.cumsum(many) - many
            at = np.append(at, [-1, -1])
            return many, np.where(many > 0, at[np.minimum(begin, len(at) - 1)], -1), np.where(many > 1, at[np.minimum(begin + 1, len(at) - 1)], -1)

        skips, top, second = best(role != SPLIT)
        shorter, top_shorter, _ = best(role == FIRST_SKIP)
        _, split, _ = best(role == SPLIT)
        row = np.arange(len(ids))
        is_split = role == SPLIT
        near = np.where(is_split, shorter[group], skips[group] - 1 + ((role == FIRST_SKIP) & (split[group] >= 0)))
        other = np.where(top[group] == row, second[group], top[group])
        gap = np.where(role == FIRST_SKIP, split[group], -1)
        # of two rows of a group the earlier is the better
        both = np.where((other < 0) | ((gap >= 0) & (gap < other)), gap, other)
        pick = np.where(is_split, top_shorter[group], both)
        keep = near > 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[keep], near[keep].astype(np.int64), n[pick[keep]], ids[pick[keep]])], schema=_MET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            # the last group may go on in the next batch
            p, s = now[:2]
            last = len(p) - int(np.argmax((p != p[-1])[::-1] | (s != s[-1])[::-1])) if (p[0], s[0]) != (p[-1], s[-1]) else 0
            rest = [x[last:] for x in now]
            if last and (out := of(*(x[:last] for x in now))) is not None:
                yield out
        if rest is not None and len(rest[0]) and (out := of(*rest)) is not None:
            yield out

    return placed.mapInArrow(run, "id bigint, n_near bigint, near_n bigint, near_id bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, form): the last form reached, by doubling. Counts grow on every step, so there is no ring."""
    forms = cut_lineage(forms)
    reached = forms.select("id", F.col("form").alias("root"))
    changed = 1
    while changed:
        further = reached.select(F.col("id").alias("root"), F.col("root").alias("further"))
        reached, changed = cut_and_count(
            reached.join(further, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), F.col("moved")
        )
        reached = reached.select("id", "root")
    return reached


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of (word, n), whose words are distinct.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. The form is
    the near word of largest n (ties: smallest in code-point order) if its n is ``ratio`` times the word's
    at least, else null; the root is the end of the chain of forms. No words give no rows; words of any
    length cost their length.
    """
    words = cut_lineage(words.select("word", "n").where("word IS NOT NULL"))
    ahead, renamed = trie_nodes(words, False)
    back, renamed_back = trie_nodes(words, True)
    paths = ahead.join(words, "word").join(back.select("word", F.col("nodes").alias("back")), "word")
    paths = cut_lineage(paths.select("id", "word", "n", "nodes", "back"))
    better = F.max(F.struct(F.col("near_n").alias("n"), (-F.col("near_id")).alias("minus"))).alias("best")
    met = meet(node_pairs(paths, renamed, renamed_back)).groupBy("id").agg(F.sum("n_near").alias("n_near"), better)
    known = paths.select("id", "word", "n")
    found = cut_lineage(
        known.join(met, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.minus")).alias("form_id"), F.col("best.n").alias("best_n"),
        )
    )
    roots = _roots(found.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("form")))

    def named(column: str, word: str) -> DataFrame:
        return known.select(F.col("id").alias(column), F.col("word").alias(word))

    linked = found.where("form_id IS NOT NULL").join(roots.withColumnRenamed("root", "root_id"), "id")
    linked = linked.join(named("form_id", "form"), "form_id").join(named("root_id", "root"), "root_id")
    columns = ["word", "n", "n_near", "form", F.col("best_n").alias("form_n"), "root"]
    single = found.where("form_id IS NULL").withColumn("form", F.lit(None).cast("string")).withColumn("root", F.col("word"))
    return linked.select(*columns).unionByName(single.withColumn("best_n", F.lit(None).cast("bigint")).select(*columns))


def spelling_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, typo_every: int = 0
) -> DataFrame:
    """:func:`variants` over the words of all texts that occur ``min_count`` times or more.

    Null and empty texts have no words; repeated rows count each time; a text is read whole, whatever its
    length; other columns, whatever their names, are not looked at; an empty table gives no rows.
    """
    return variants(count_words(docs, key, text, min_length, typo_every).where(F.col("n") >= min_count), ratio)


__all__ = ["count_words", "node_pairs", "spelling_variants", "trie_nodes", "variants"]
