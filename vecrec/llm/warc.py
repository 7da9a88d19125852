"""WARC derivative builder: metadata and plain-text conversion records for responses.

A response record gives one ``metadata`` record (block in warc-fields: what the source said of itself) and
one ``conversion`` record (its text). Both name their source in WARC-Refers-To with its target URI and
date, and carry its headers and digests on as WARC-Source-* fields. Record ids are derived from the
source's id, so a repeated run or a retried task gives the same records.

Records travel as rows; files are gzip members, one file per partition, renamed into place when whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecrec.llm.common import batched, cut_lineage, rows_of
from vecrec.llm.html_text import render
from vecrec.session import shared_dir

VERSION = "WARC/1.1"
NAMES = uuid.UUID("5b1a7c0e-52d5-4a52-9a59-6e0c2f8f3f10")
#: Source headers that derivatives carry on.
CARRIED = ("WARC-Record-ID", "WARC-Type", "WARC-Date", "WARC-Target-URI", "WARC-Block-Digest", "WARC-Payload-Digest", "WARC-IP-Address", "WARC-Identified-Payload-Type", "Content-Type", "Content-Length")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, chr(0).join(map(str, of)))}>"


def _one_line(value: object) -> str:
    return " ".join(str(value).split())


def build(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in headers if v is not None)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _fields(data: bytes) -> list[tuple[str, str]]:
    found: list[tuple[str, str]] = []
    for line in data.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and found:  # a folded line
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            found.append((name.strip(), value.strip()))
    return found


def block_of(record: bytes) -> str:
    """Text of a record that :func:`build` made."""
    return record.partition(b"\r\n\r\n")[2][:-4].decode("utf-8", "replace")


def _members(data: bytes) -> Iterator[bytes]:
    """What the gzip members hold, as far as they are whole; of a cut or broken one, what comes before the break."""
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            yield member.decompress(data)
        except zlib.error:
            return
        if not member.eof:
            return
        data = member.unused_data.lstrip(b"\0")


def _dechunked(body: bytes) -> bytes:
    """The chunks of a chunked body put together; from what is no chunk on, the body as it is."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return b"".join(parts) + body[at:]
        if not int(size, 16):
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 2 + int(size, 16)
        if body[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(body):
            return b"".join(parts)


def payload(body: bytes, http: dict[str, str]) -> bytes:
    """The body without its transfer and content codings (chunked, gzip, deflate), as far as it can be read;
    a coding it does not have, or another one, leaves it as it is."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    for coding in reversed(http.get("content-encoding", "").lower().split(",")):
        if coding.strip() in ("gzip", "x-gzip"):
            body = b"".join(_members(body)) or body
        elif coding.strip() == "deflate":
            for window in (15, -15):
                try:
                    body = zlib.decompressobj(window).decompress(body)
                    break
                except zlib.error:
                    continue
    return body


def records(data: bytes | None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in plain bytes or gzip members; what is cut off or no record ends the list.

    Header names are given in the writing of ``CARRIED`` where they are among them, else as written.
    """
    if not data:
        return
    if data[:2] == b"\x1f\x8b":
        data = b"".join(_members(data))
    usual, at = {n.lower(): n for n in CARRIED}, 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = {usual.get(k.lower(), k): v for k, v in _fields(data[at:end].partition(b"\r\n")[2])}
        size = headers.get("Content-Length", "")
        if not size.isdigit() or len(data) < end + 4 + int(size):
            return
        yield headers, data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)
        while data.startswith(b"\r\n", at):
            at += 2


def response(url: str | None, page: str | None, source: object, date: str) -> bytes:
    """A response record of a stored page."""
    body = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", source, url)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", sha1(body)), ("WARC-Block-Digest", sha1(block)), ("Content-Type", "application/http; msgtype=response")]
    return build(headers, block)


def derive(headers: dict[str, str], block: bytes) -> Iterator[tuple[str, str, str, bytes]]:
    """(type, record id, block digest, record) of what a response record gives; nothing for others."""
    if headers.get("WARC-Type", "").lower() != "response" or not headers.get("WARC-Record-ID"):
        return
    source = headers["WARC-Record-ID"]
    head, _, body = block.partition(b"\r\n\r\n")
    status, _, rest = head.partition(b"\r\n")
    http = {k.lower(): v for k, v in _fields(rest)}
    stored, body = body, payload(body, http)
    kind = http.get("content-type", "text/html" if body.lstrip()[:1] == b"<" else "")
    shared = [("WARC-Date", headers.get("WARC-Date")), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", headers.get("WARC-Target-URI")), ("WARC-Refers-To-Date", headers.get("WARC-Date")), ("WARC-Target-URI", headers.get("WARC-Target-URI"))]
    shared += [(f"WARC-Source-{k.removeprefix('WARC-')}", headers.get(k)) for k in CARRIED if k not in ("WARC-Record-ID", "WARC-Date", "WARC-Target-URI")]
    named = _CHARSET.search(kind.encode()) or _CHARSET.search(body[:2048])
    charset = named.group(1).decode() if named else "utf-8"
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        charset, page = "utf-8", body.decode("utf-8", "replace")
    markup = "html" in kind or "xml" in kind
    text = (render(page) if markup else page if kind.startswith("text/") else "").encode("utf-8", "replace")
    title = _TITLE.search(page) if markup else None
    facts = [("http-status", status.decode("latin-1")), ("http-content-type", kind or None), ("charset", charset), ("title", html.unescape(title.group(1)) if title else None), ("payload-length", len(stored)), ("payload-digest", sha1(stored)), ("text-length", len(text)), *((f"http-{k}", v) for k, v in http.items() if k != "content-type")]
    fields = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in facts if v is not None).encode("utf-8", "replace")
    ids = {t: record_id(t, source) for t in ("metadata", "conversion")}
    for name, content, data in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", text)):
        other = ids["conversion" if name == "metadata" else "metadata"]
        digest = sha1(data)
        yield name, ids[name], digest, build([("WARC-Type", name), ("WARC-Record-ID", ids[name]), *shared, ("WARC-Concurrent-To", other), ("WARC-Block-Digest", digest), ("Content-Type", content)], data)


SHAPE = "kind string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, n_bytes bigint, text string, record binary"


def derivatives(sources: DataFrame, key: str, record: str = "record", keep_records: bool = True) -> DataFrame:
    """Two rows for each response record in the binary column ``record`` (one or several records, plain or gzipped).

    Null, empty and broken records, and those of other types, give none; repeated rows give theirs again;
    payloads are read without their transfer and content codings. ``text`` is the conversion's text (null
    in metadata rows); ``keep_records`` false leaves the column ``record`` null.
    """
    asked = sources.select(sources[key].alias("key"), sources[record].alias("record"))
    return _derived(asked, key, lambda batch: zip(batch.column("key").to_pylist(), batch.column("record").to_pylist(), strict=True), keep_records)


def page_derivatives(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = "1970-01-01T00:00:00Z", keep_records: bool = True) -> DataFrame:
    """The derivatives of stored pages, each first put in a response record of its own; a null page is an empty one."""
    asked = pages.select(pages[key].alias("key"), pages[url].alias("url"), pages[page].alias("page"))
    return _derived(asked, key, lambda batch: ((k, response(u, p, k, date)) for k, u, p in rows_of([batch], "key", "url", "page")), keep_records)


def _derived(asked: DataFrame, key: str, of, keep: bool) -> DataFrame:
    kind = asked.select("key").schema[0].dataType.simpleString()
    arrow = pa.schema([("key", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), *((n, pa.string()) for n in ("kind", "record_id", "refers_to", "target_uri", "source_digest", "block_digest")), ("n_bytes", pa.int64()), ("text", pa.string()), ("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k, data in of(batch):
                    for headers, block in records(data):
                        for name, rid, digest, made in derive(headers, block):
                            yield k, name, rid, headers["WARC-Record-ID"], headers.get("WARC-Target-URI"), headers.get("WARC-Payload-Digest"), digest, len(made), block_of(made) if name == "conversion" else None, made if keep else None

        yield from batched(rows(), arrow, 1024)

    return asked.mapInArrow(run, f"key {kind}, {SHAPE}").withColumnRenamed("key", key)


def write_warc(rows: DataFrame, record: str = "record", folder: str | None = None) -> DataFrame:
    """Writes the records of each partition to one ``.warc.gz`` file; (path, records, bytes) per file."""
    folder = folder or f"{shared_dir(rows.sparkSession)}/warc-{uuid.uuid4().hex}"
    asked = rows.select(rows[record].alias("record"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root)
        found, count, size, part, draft = rows_of(batches, "record", "part"), 0, 0, 0, f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            for data, part in found:
                if data:
                    size += out.write(gzip.compress(data, 6, mtime=0))
                    count += 1
        name = f"part-{part:06d}.warc.gz"
        if not count:
            store.delete_file(draft)
            return
        store.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return cut_lineage(asked.mapInArrow(run, "path string, records bigint, bytes bigint"))


def read_warc(files: DataFrame) -> DataFrame:
    """(path, record) for every record in the files, one gzip member at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (path,) in rows_of(batches, "path"):
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression="gzip") as raw, io.BufferedReader(raw, 1 << 20) as file:
                    while line := file.readline():
                        if not line.startswith(b"WARC/"):
                            continue
                        head = [line]
                        while (line := file.readline()) not in (b"\r\n", b""):
                            head.append(line)
                        size = next((int(x.split(b":", 1)[1]) for x in head if x.lower().startswith(b"content-length:")), 0)
                        yield path, b"".join(head) + b"\r\n" + file.read(size) + b"\r\n\r\n"

        yield from batched(rows(), pa.schema([("path", pa.string()), ("record", pa.binary())]), 256)

    n = max(1, files.count())
    return files.repartition(n).mapInArrow(run, "path string, record binary")
