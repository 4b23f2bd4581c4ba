"""WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Emitter, materialize, rows_of, shared_folder

#: Lines per index block, and entries of the block directory at most: blocks grow when there are more captures.
BLOCK_LINES, DIRECTORY = 1_000, 100_000
#: Separator keys of the directory are cut to so many characters; blocks that begin alike are all searched.
KEY_CHARS = 200
#: A task starts another archive after so many bytes.
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed-host key: host labels from the last to the first, then path and query; a null URL has an empty key."""
    text = url or ""
    _, mark, rest = text.partition("://")
    if not mark:
        return text
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, _, port = rest[:end].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (rest[end:] or "/")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(text: str | None) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def record(capture: int, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One record, a gzip member of its own.  A revisit holds no payload but its length and digest, and the id of the response."""
    body = b"" if refers is not None else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:capture:{capture}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if refers is not None:
        lines.insert(4, f"WARC-Refers-To: <urn:capture:{refers}>")
        lines.insert(5, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.insert(6, f"WARC-Refers-To-Payload-Length: {len(payload)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    return pack.compress(head) + pack.compress(body) + pack.compress(b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one gzip member; raises if it is not one whole record."""
    text = zlib.decompress(data, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length does not match")
    return headers, rest[:n]


def payload_groups(pages: DataFrame, least: int) -> DataFrame:
    """``(payload_digest, keeper)`` of payloads of at least ``least`` bytes that occur more than once; the keeper is the largest id."""
    sized = pages.filter(F.octet_length("payload") >= least).select("id", F.sha1("payload").alias("_sha"))
    groups = sized.groupBy("_sha").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
    return groups.filter("n > 1").select("_sha", "keeper")


def write_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``captures(id, url, payload, refers)``; returns ``(id, url_key, file, start, size)``.

    Each task writes archives of its own under a name with a random part, so a task that is run again or twice
    leaves files nobody refers to and never changes those of another; the rows of the attempt that counts
    name its files.  The rows must be materialized once.
    """
    schema = pa.schema([("id", pa.int64()), ("url_key", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        out, sink, at, name = Emitter(schema), None, 0, ""
        store, root = pafs.FileSystem.from_uri(folder)
        try:
            for key, url, payload, refers in rows_of(batches, "id", "url", "payload", "refers"):
                if sink is None or at >= ARCHIVE_BYTES:
                    if sink:
                        sink.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                data = record(key, url, payload, digest_of(payload), refers)
                sink.write(data)
                yield from out.add((key, url_key(url), name, at, len(data)))
                at += len(data)
        finally:
            if sink:
                sink.close()
        yield from out.flush()

    return captures.select("id", "url", "payload", "refers").mapInArrow(run, "id long, url_key string, file string, start long, size long")


def build_index(lines: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Blocks ``(block, lines)`` of compressed sorted index lines and their directory ``(block, first)``.

    Lines are range-partitioned by key and sorted; every run of lines of a partition becomes a block.
    """
    size = max(BLOCK_LINES, -(-total // DIRECTORY))
    parts = max(1, min(total // (4 * size) + 1, 2_000))
    ordered = lines.repartitionByRange(parts, "url_key", "id").sortWithinPartitions("url_key", "id")
    schema = pa.schema([("block", pa.string()), ("first", pa.string()), ("lines", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        out, held = Emitter(schema), []

        def block():
            data = pa.Table.from_pylist([dict(zip(("url_key", "id", "file", "start", "size"), row, strict=True)) for row in held])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, data.schema) as writer:
                writer.write_table(data)
            return uuid.uuid4().hex, held[0][0][:KEY_CHARS], zlib.compress(sink.getvalue().to_pybytes())

        for row in rows_of(batches, "url_key", "id", "file", "start", "size"):
            held.append(row)
            if len(held) >= size:
                yield from out.add(block(), 1 << 20)
                held = []
        if held:
            yield from out.add(block())
        yield from out.flush()

    blocks = materialize(ordered.mapInArrow(run, "block string, first string, lines binary"), "blocks")
    return blocks.select("block", "lines"), blocks.select("block", "first")


def lookup(index: tuple[DataFrame, DataFrame], wanted: DataFrame) -> DataFrame:
    """``(id, file, start, size)`` for ``wanted(url_key, id)``: the sparse directory names the block, a binary search in it the line.

    The directory has at most about ``DIRECTORY`` entries of ``KEY_CHARS`` characters, whatever the number of captures, and
    goes to every task; blocks are joined by name, and each is unpacked once per group of searches.
    """
    blocks, directory = index
    entries = sorted((r["first"], r["block"]) for r in directory.collect())
    shared = wanted.sparkSession.sparkContext.broadcast(entries)
    schema = pa.schema([("url_key", pa.string()), ("id", pa.int64()), ("block", pa.string())])

    def locate(batches: Iterator[pa.RecordBatch]):
        firsts = [f for f, _ in shared.value]
        out = Emitter(schema)
        for key, capture in rows_of(batches, "url_key", "id"):
            # The key lies in the last block that begins below it, or in any that begins with the same cut key.
            low, high = bisect_left(firsts, key[:KEY_CHARS]), bisect_right(firsts, key[:KEY_CHARS])
            for i in range(max(low - 1, 0), max(high, 1)):
                if firsts:
                    yield from out.add((key, capture, shared.value[i][1]))
        yield from out.flush()

    asked = wanted.select("url_key", "id").mapInArrow(locate, "url_key string, id long, block string")
    # A block's searches are cut into parts, each joined with the block, so a block that many ask for is many groups.
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(8)))
    names = "id long, file string, start long, size long"

    def search(key, asked_rows: pd.DataFrame, block_rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": np.empty(0, np.int64), "file": np.empty(0, object), "start": np.empty(0, np.int64), "size": np.empty(0, np.int64)})
        if not len(asked_rows) or not len(block_rows):
            return none
        table = pa.ipc.open_stream(zlib.decompress(block_rows["lines"].iloc[0])).read_all().to_pydict()
        lines = list(zip(table["url_key"], table["id"], strict=True))
        found = []
        for row in asked_rows.itertuples(index=False):
            for at in range(bisect_left(lines, (row.url_key, row.id)), bisect_right(lines, (row.url_key, row.id))):
                found.append((row.id, table["file"][at], table["start"][at], table["size"][at]))
        return pd.DataFrame(found, columns=["id", "file", "start", "size"]) if found else none

    spread = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    return asked.groupBy("block", "part").cogroup(spread.groupBy("block", "part")).applyInPandas(search, names)


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Range-read the records at ``places(file, start, size)``: ``id, payload_bytes, payload_digest, record_type, refers_to``.

    Length and digest of a response are taken from the bytes read, and the digest must be the recorded one.
    """
    names = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    schema = pa.schema(list(zip(("id", "payload_bytes", "payload_digest", "record_type", "refers_to"), kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = pafs.FileSystem.from_uri(folder)
        out, last, source = Emitter(schema), None, None
        for name, start, size in rows_of(batches, "file", "start", "size"):
            if name != last:  # places come sorted by file and offset
                if source:
                    source.close()
                last, source = name, store.open_input_file(f"{root}/{name}")
            source.seek(start)
            headers, body = parse(source.read(size))
            capture = int(headers["WARC-Record-ID"][len("<urn:capture:") : -1])
            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            kind, refers, n = headers["WARC-Type"], None, len(body)
            if kind == "revisit":
                refers = int(headers["WARC-Refers-To"][len("<urn:capture:") : -1])
                n = int(headers["WARC-Refers-To-Payload-Length"])
            elif digest_of(body) != digest:
                raise ValueError(f"digest of capture {capture} does not match")
            yield from out.add((capture, n, digest, kind, refers))
        if source:
            source.close()
        yield from out.flush()

    sorted_ = places.repartition("file", F.floor(F.col("start") / (8 << 20))).sortWithinPartitions("file", "start").select("file", "start", "size")
    return sorted_.mapInArrow(run, names)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> tuple[DataFrame, str, tuple[DataFrame, DataFrame]]:
    """Write all pages as records and index them: ``(index lines, folder, (blocks, directory))``.

    Of records with equal payloads of at least ``least`` bytes the one with the largest id is the response and
    the others revisit it; smaller payloads are always responses.  A null html is an empty payload, a null URL
    an empty target.  Rows with a null id are left out;
    a repeated row is one more record.
    """
    rows = pages.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")
    )
    groups = materialize(payload_groups(rows, least), "payloads")
    joined = rows.withColumn("_sha", F.sha1("payload")).join(groups, "_sha", "left")
    captures = joined.withColumn("refers", F.when(F.col("keeper") != F.col("id"), F.col("keeper")))
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root)
    lines = materialize(write_archives(captures, folder), "captures")
    return lines, folder, build_index(lines, lines.count())


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write all pages, then find every page by its URL through the index and read its record back."""
    lines, folder, index = archive(pages, id_col, url_col, html_col, least)
    places = materialize(lookup(index, lines.select("url_key", "id").distinct()), "places")
    return read_records(places, folder)
