"""Token ids in patched frame-of-reference files.

A shard file holds the ids of consecutive documents:

    blocks     each of up to BLOCK ids: least id (4 bytes), width, count and exceptions (2 bytes each), the
               ids less the least at ``width`` bits each, then places (2 bytes) and values (4 bytes) of
               the exceptions
    starts     the place of each block in the file, 8 bytes each
    documents  key (8 bytes), whether it is null (1 byte) and number of ids (8 bytes) of each
    tail       number of blocks, documents and ids, 8 bytes each, and the mark

``width`` is what the ids at the ``PERCENTILE`` need; larger ones are exceptions. All numbers are
little-endian. Any id can be read from its block alone. A task writes a file under a name of its own and
renames it at the end, so a repeated attempt gives the same shard.
"""

from __future__ import annotations

import functools
import io
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecrec.llm.common import batched, cut_lineage, rows_of
from vecrec.session import shared_dir

BLOCK, PERCENTILE, MARK = 8192, 95, b"PFORIDS1"
END_ID = 1
#: Words a Python worker remembers the ids of, twice over at most.
MEMO_WORDS = 800_000
#: New words that the library encodes as one text.
JOINED = 2000
#: Characters that str.split takes for white space but the tokenizer does not.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


# --- blocks


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One block of 1 to 65,535 ids below 2 ** 32."""
    low = int(ids.min())
    rest = ids.astype(np.uint64) - np.uint64(low)
    at = -(-percentile * (len(rest) - 1) // 100)
    width = int(np.partition(rest, at)[at]).bit_length()
    odd = np.flatnonzero(rest >> np.uint64(width)) if width < 32 else np.zeros(0, np.int64)
    head = np.array([width, len(ids), len(odd)], "<u2").tobytes()
    octets = rest.astype("<u4").view(np.uint8).reshape(-1, 4)
    bits = np.unpackbits(octets, axis=1, count=width, bitorder="little") if width else np.zeros((0, 0), np.uint8)
    return b"".join([np.uint32(low).astype("<u4").tobytes(), head, np.packbits(bits, bitorder="little").tobytes(), odd.astype("<u2").tobytes(), ids[odd].astype("<u4").tobytes()])


def unpack(data: bytes) -> np.ndarray:
    low, (width, n, odd) = int.from_bytes(data[:4], "little"), np.frombuffer(data, "<u2", 3, 4).tolist()
    at = 10 + -(-n * width // 8)
    octets = np.zeros((n, 4), np.uint8)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, at - 10, 10), count=n * width, bitorder="little").reshape(n, width)
        packed = np.packbits(bits, axis=1, bitorder="little")
        octets[:, : packed.shape[1]] = packed
    ids = octets.view("<u4").ravel() + np.uint32(low)
    ids[np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    return ids


# --- files


def write_shard(out: io.IOBase, docs: Iterable[tuple[int | None, np.ndarray]], block: int = BLOCK) -> tuple[int, int]:
    """Writes (key, ids) documents; gives the number of documents and of ids."""
    starts, keys, sizes, at, held, waiting = [], [], [], 0, [], 0

    def flush(last: bool) -> None:
        nonlocal at, held, waiting
        ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // block * block
        for k in range(0, stop, block):
            starts.append(at)
            at += out.write(pack(ids[k : k + block]))
        held, waiting = [ids[stop:]], len(ids) - stop

    for key, ids in docs:
        keys.append(key)
        sizes.append(len(ids))
        held.append(ids)
        waiting += len(ids)
        if waiting >= 16 * block:
            flush(False)
    flush(True)
    out.write(np.array(starts, "<u8").tobytes())
    out.write(np.array([k or 0 for k in keys], "<i8").tobytes())
    out.write(np.array([k is None for k in keys], "u1").tobytes())
    out.write(np.array(sizes, "<u8").tobytes())
    out.write(np.array([len(starts), len(keys), sum(sizes)], "<u8").tobytes() + MARK)
    return len(keys), sum(sizes)


class Shard:
    """A shard file open for reading; ids are decoded block by block."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        tail = file.read_at(32, size - 32)
        if tail[24:] != MARK:
            raise ValueError("not a token file, or not whole")
        blocks, docs, self.n_ids = np.frombuffer(tail, "<u8", 3).tolist()
        at = size - 32 - 17 * docs - 8 * blocks
        self.starts = np.append(np.frombuffer(file.read_at(8 * blocks, at), "<u8"), np.uint64(at)).astype(np.int64)
        index = file.read_at(17 * docs, at + 8 * blocks)
        keys, null, self.sizes = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "u1", docs, 8 * docs), np.frombuffer(index, "<u8", docs, 9 * docs)
        self.keys = [None if n else k for k, n in zip(keys.tolist(), null.tolist(), strict=True)]

    def block(self, k: int) -> np.ndarray:
        return unpack(self.file.read_at(int(self.starts[k + 1] - self.starts[k]), int(self.starts[k])))

    def ids(self, start: int, stop: int, block: int = BLOCK) -> Iterator[np.ndarray]:
        """The ids of positions [start, stop), in pieces."""
        for k in range(start // block, -(-stop // block)):
            yield self.block(k)[max(0, start - k * block) : stop - k * block]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(key, start, ids, CRC-32 of the ids) of each document; one block is held at a time."""
        left, k, start = np.zeros(0, np.uint32), 0, 0
        for key, size in zip(self.keys, self.sizes.tolist(), strict=True):
            crc, need = 0, size
            while need:
                if not len(left):
                    left, k = self.block(k), k + 1
                crc = zlib.crc32(left[:need].tobytes(), crc)
                need, left = need - len(left[:need]), left[need:]
            yield key, start, size, crc
            start += size


# --- encoding


class Encoder:
    """Ids of whole texts, by the words between white space.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words, each
    encoded by the library once while it is remembered. A text with a character on which the two notions of white space differ
    is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # words are encoded together, with a special token between them
        self.between = next((t.content for t in self.library.get_added_tokens_decoder().values() if t.special), None)
        self.mark = self.library.token_to_id(self.between) if self.between else None
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word."""
        plain = [w for w in words if self.between is None or self.between in w]
        alone = dict(zip(plain, (i.tobytes() for i in self._encode(plain)), strict=True))
        for k in range(0, len(words), JOINED):
            part = [w for w in words[k : k + JOINED] if w not in alone]
            ids = self._encode([self.between.join(part)])[0] if part else np.zeros(0, "<u4")
            data, ends = ids.tobytes(), (np.flatnonzero(ids == self.mark) * 4).tolist()
            cut = iter(zip([0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True))
            for w in words[k : k + JOINED]:
                if w in alone:
                    yield alone[w]
                else:
                    a, b = next(cut)
                    yield data[a:b]

    def _known(self, wanted: set[str]) -> dict[str, bytes]:
        """The memo with all of ``wanted``; words not asked for lately leave when it is full."""
        if len(self.recent) > MEMO_WORDS:
            self.recent, self.older = {}, self.recent
        # set.difference of a dict looks up the words wanted; ``-`` of its keys would walk through the whole memo
        missing = wanted.difference(self.recent)
        new = missing.difference(self.older)
        for w in missing.difference(new):
            self.recent[w] = self.older[w]
        new = list(new)
        self.recent.update(zip(new, self._words(new), strict=True))
        return self.recent

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [None if any(c in t for c in NOT_SPACE) else t.split() for t in texts]
        get = self._known(set().union(*(w for w in split if w))).__getitem__
        end, out = np.uint32(END_ID).astype("<u4").tobytes(), []
        for text, words in zip(texts, split, strict=True):
            data = self._encode([text])[0].tobytes() if words is None else b"".join(map(get, words))
            out.append(np.frombuffer(data + end, "<u4"))
        return out


@functools.cache
def worker_encoder(tokenizer: str) -> Encoder:
    """The encoder of this Python worker; tasks that follow one another in it share the words it remembers."""
    return Encoder(tokenizer)


def _runs(rows: Iterable[tuple], chars: int = 4_000_000) -> Iterator[list[tuple]]:
    """Rows (key, text) in runs of bounded text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def write_token_files(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Encodes every text and writes ids in ascending key order; one row (shard, path, docs, ids, before) per file.

    Shards are ranges of the key, cut at quantiles of the key column alone; ``before`` counts the ids of
    all earlier shards. Null texts are empty and have the end id only; null keys come first; rows that
    repeat a key keep their own ids, ordered by text. ``folder`` must be reachable from every executor.
    An empty table writes no file and gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = docs.select(docs[key].cast("bigint").alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    cuts = sorted(set(asked.agg(F.percentile_approx("key", [k / shards for k in range(1, shards)] or [1.0], 20 * shards).alias("q")).first()["q"] or []))
    shard = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("key"))), F.lit(0)) if cuts else F.lit(0)
    shard = F.when(F.col("key").isNull(), 0).otherwise(shard).cast("int")
    placed = asked.withColumn("shard", shard).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches, "shard", "key", "text")
        first = next(rows, None)
        if first is None:
            return
        encode = worker_encoder(tokenizer)
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name, draft = f"{root}/shard-{first[0]:06d}.ids", f"{root}/.{uuid.uuid4().hex}"
        texts = _runs((k, t) for _, k, t in chain([first], rows))
        with store.open_output_stream(draft) as out:
            n_docs, n_ids = write_shard(out, ((k, ids) for part in texts for (k, _), ids in zip(part, encode([t for _, t in part]), strict=True)))
        store.move(draft, name)
        uri = f"{folder}/shard-{first[0]:06d}.ids"
        yield pa.RecordBatch.from_pydict({"shard": pa.array([first[0]], pa.int32()), "path": [uri], "docs": [n_docs], "ids": [n_ids]})

    written = cut_lineage(placed.mapInArrow(run, "shard int, path string, docs bigint, ids bigint"))
    # one row per file
    return written.withColumn("before", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files that ``write_token_files`` lists."""
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, before in rows_of(batches, "path", "before"):
            store, name = pafs.FileSystem.from_uri(path)
            with store.open_input_file(name) as file:
                yield from batched(((k, before + s, n, c) for k, s, n, c in Shard(file).documents()), arrow)

    n = max(1, files.count())
    spread = files.repartitionById(n, F.pmod(F.col("shard"), F.lit(n)).cast("int"))
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the token files of ``docs`` and reads them back."""
    return read_token_files(write_token_files(docs, tokenizer or default_tokenizer(), key, text))
