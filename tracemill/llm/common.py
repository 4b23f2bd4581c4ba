"""Helpers of the corpus operators: shared folder, word hashes, label propagation."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are Python values at one time.
ROWS_HELD = 256

#: A word is a run of characters other than space and \x09-\x0D; ``bytes.split`` cuts at just these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is taken from the session.  Only a local master may run without it; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.getCheckpointDir():
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "step", *folders: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: lineage ends, nothing is computed twice.

    Rows with one value in the columns ``folders`` go to a folder of their own, so that a filter reads only that.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def cached(key: tuple, make):
    """``make()``, kept for the life of a Python worker.

    Functions reach the workers by value, with globals of their own for each task, so what is to outlast a
    task is kept in a module of the process.
    """
    store = sys.modules.setdefault("corpus_worker_cache", types.ModuleType("corpus_worker_cache")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word, equal on every machine."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` words; none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, a slice of a batch at a time: a batch may hold thousands of whole texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_HELD):
            part = batch.slice(at, ROWS_HELD)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


class Emitter:
    """Collect rows and hand them out as Arrow batches of bounded rows and bytes."""

    def __init__(self, schema: pa.Schema, rows: int = 4096, size: int = 16 << 20):
        self.schema, self.rows, self.size = schema, rows, size
        self.data: list[tuple] = []
        self.held = 0

    def add(self, row: tuple, weight: int = 0) -> Iterator[pa.RecordBatch]:
        self.data.append(row)
        self.held += weight
        if len(self.data) >= self.rows or self.held >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.data:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.data, strict=True), self.schema.types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
            self.data, self.held = [], 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, component)``, the component being its smallest id.

    Large-star and small-star steps alternate until the edge set stands still; each step is two joins on
    keys and keeps at most as many edges as there were.  Ids without an edge are not returned.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    pairs = materialize(pairs, "links")
    seen = _fingerprint(pairs)
    while True:
        # Large star: neighbours above a node go to the smallest of its neighbourhood.
        both = pairs.union(pairs.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("least")).withColumn("least", F.least("v", "least"))
        large = both.filter("m > v").join(least, "v").select(F.col("m").alias("v"), F.col("least").alias("m"))
        large = large.filter("v <> m").distinct()
        # Small star: neighbours below a node, and the node, go to the smallest of them.
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(least, "v").select(F.col("m").alias("v"), F.col("least").alias("m")).filter("v <> m")
        pairs = materialize(small.union(least.select("v", F.col("least").alias("m"))).distinct(), "links")
        now = _fingerprint(pairs)
        if now == seen:
            break
        seen = now
    out = pairs.select(F.col("v").alias("id"), F.col("m").alias("component"))
    roots = pairs.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct()
    return out.union(roots)


def _fingerprint(pairs: DataFrame) -> tuple:
    """Number of edges and a sum over them, to see whether a step changed any."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
