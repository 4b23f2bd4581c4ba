"""URL filter on a sorted digest array that tasks map into memory."""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import cached

#: The array goes to every executor as one file, so the number of rules is bounded.
MAX_RULES = 20_000_000


def write_index(path: str, rules: list[tuple[str, str, str]]) -> None:
    """One file: counts, rule path lengths, sorted 64-bit digests, offsets and the stored strings.

    A rule is ``(verdict, host, path)``; its key is ``host + path`` and its string ``verdict host path``.
    Of rules with equal host and path the one that comes first holds.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    first: dict[tuple[str, str], str] = {}
    for verdict, host, prefix in rules:
        first.setdefault((host.lower(), prefix), verdict)
    keys = [h.encode() + b"\0" + p.encode() for h, p in first]
    digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
    order = np.argsort(digests, kind="stable")
    verdicts = list(first.values())
    stored = [keys[i] + b"\0" + verdicts[i].encode() for i in order]
    lengths = sorted({len(p) for _, p in first})
    labels = max((h.count(".") + 1 for h, _ in first), default=0)
    offsets = np.cumsum([0, *map(len, stored)]).astype(np.uint64)
    with open(path, "wb") as out:
        out.write(struct.pack("<3Q", len(keys), len(lengths), labels))
        out.write(np.array(lengths, np.uint64).tobytes() + digests[order].tobytes() + offsets.tobytes() + b"".join(stored))


class Index:
    """The mapped file; ``find`` returns the stored rule of each key that is one."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, m, self.labels = struct.unpack("<3Q", data[:24].tobytes())
        at = 24 + 8 * m
        self.lengths = data[24:at].view(np.uint64).tolist()
        self.digests = data[at : at + 8 * n].view(np.uint64)
        self.offsets = data[at + 8 * n : at + 8 * (2 * n + 1)].view(np.uint64)
        self.strings = data[at + 8 * (2 * n + 1) :]

    def find(self, keys: list[bytes]) -> list[str | None]:
        """Verdict of each key: vectorised binary search, then the stored string confirms or the next equal digest is tried."""
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        left = np.searchsorted(self.digests, wanted, "left")
        right = np.searchsorted(self.digests, wanted, "right")
        out: list[str | None] = [None] * len(keys)
        for i in np.flatnonzero(right > left):
            for at in range(int(left[i]), int(right[i])):
                stored = self.strings[int(self.offsets[at]) : int(self.offsets[at + 1])].tobytes()
                key, _, verdict = stored.rpartition(b"\0")
                if key == keys[i]:
                    out[i] = verdict.decode()
                    break
        return out


def ship_index(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Write the index on the driver and let Spark hand the file to every executor; returns its name."""
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="url-rules-")), name)
    write_index(path, rules)
    spark.sparkContext.addFile(path)  # executors fetch it from the driver, also those that start later
    return name


def candidates(host: str, path: str, lengths: list[int], labels: int) -> list[tuple[str, str]]:
    """Rules that may fit a URL: host suffixes of at most ``labels`` labels, prefixes of the lengths that rules have."""
    own = host.split(".")
    hosts = [".".join(own[i:]) for i in range(max(0, len(own) - labels), len(own))]
    return [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]


def judge_urls(urls: DataFrame, rules: list[tuple[str, str, str]], id_col: str, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)`` per row.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``,
    ``#`` or the end; a null URL or one without ``://`` has neither.  A rule fits its host and all subdomains if
    the path starts with the rule's; the longest rule (host and path) decides, ``otherwise`` where none fits.
    Rows repeat as they are; null ids are carried through; an empty table gives no row.
    """
    name = ship_index(urls.sparkSession, rules)
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
    cut = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = urls.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")).select(
        "id", F.translate(cut, upper, lower).alias("host"), F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", 2).alias("path")
    )

    def run(batches: Iterator[pa.RecordBatch]):
        index = cached(("urls", name), lambda: Index(SparkFiles.get(name)))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            keys, owner = [], []
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                own = candidates(host, path, index.lengths, index.labels)
                keys += own
                owner += [i] * len(own)
            found = index.find([h.encode() + b"\0" + p.encode() for h, p in keys])
            rule: list[str | None] = [None] * len(hosts)
            verdict = [otherwise] * len(hosts)
            for i, (h, p), v in zip(owner, keys, found, strict=True):
                if v is not None and (rule[i] is None or len(h) + len(p) > len(rule[i])):
                    rule[i], verdict[i] = h + p, v
            columns = [batch.column("id"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return parts.mapInArrow(run, "id long, host string, path string, rule string, verdict string")
