"""Near-duplicate documents by SetSketch registers, verified on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Emitter, components, hash_words, materialize, mix, rows_of, windows

#: Base and offset of the register values, and registers per band.  With so small a base two registers
#: agree about as often as the minima behind them.
BASE, RATE, ROWS = 1.001, 20.0, 5
#: Where a bucket holds several components, up to so many members are paired in a join, more compared in blocks of ``BLOCK``
#: or, where documents are long, of ``WEIGHT`` shingles (a block holds one document at least); a block's matrix has ``COLUMNS`` columns at a time.
SMALL, BLOCK, WEIGHT, COLUMNS = 32, 512, 1 << 20, 2048


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; fewer words form one shingle, none form no shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    if len(h) < k:
        return windows(h, len(h)) ^ np.uint64(len(h))
    return np.unique(windows(h, k))


def registers(items: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes.

    Register i is ``floor(1 - log_b(x))`` cut to [0, 2^16 - 1], where x is the smallest of exponential
    variates that register i draws for the items.  The sketch of a union is the element-wise maximum.
    """
    rng = np.random.default_rng(0xC0FFEE)
    odd = rng.integers(0, 2**32, (2, m), dtype=np.uint32) | np.uint32(1)
    low, high = items.astype(np.uint32), (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(m, 2**32 - 1, np.uint32)
    for i in range(0, len(items), 256):  # bounded scratch memory, cache-sized
        x = low[i : i + 256, None] * odd[0]
        x ^= high[i : i + 256, None]
        x ^= x >> np.uint32(15)
        x *= odd[1]
        x ^= x >> np.uint32(13)
        np.minimum(least, x.min(axis=0), out=least)
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / math.log(BASE)) + 2**13, 0, 2**16 - 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 48) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of sketch pairs (rows of ``a`` and ``b``) with known set sizes."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    best, found = np.full(len(a), -np.inf), np.zeros(len(a))
    log_b = math.log(BASE)

    def share(x):  # probability that a register of one side is the larger, given the rate of what only it holds
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log_b

    for step in range(grid + 1):
        j = top * step / grid
        p, q = share(u - v * j), share(v - u * j)
        like = up * np.log(p + 1e-12) + down * np.log(q + 1e-12) + same * np.log(np.clip(1 - p - q, 1e-12, 1))
        better = like > best
        best, found = np.where(better, like, best), np.where(better, j, found)
    return found


def bands_for(percent: int, miss: float = 1e-4) -> int:
    """Bands so that a pair just at the threshold shares none with probability ``miss`` at most."""
    return max(8, math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** ROWS))))


def sketch(docs: DataFrame, k: int, m: int) -> DataFrame:
    """``(id, n, set_key, regs)`` per row of ``docs(id, text)``: set size, fingerprint of the set, registers."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("regs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        import xxhash

        out = Emitter(schema)
        for key, text in rows_of(batches, "id", "text"):
            items = shingle_set((text or b"").lower().split(), k)
            full = xxhash.xxh3_128_digest(items.tobytes())
            yield from out.add((key, len(items), full, registers(items, m).tobytes() if len(items) else b""))
        yield from out.flush()

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, n long, set_key binary, regs binary")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose whole shingle sets have ``100 * common >= percent * union``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        out, last, held = Emitter(schema), None, None
        for a, b, left, right in rows_of(batches, "a", "b", "left", "right"):
            if a != last:  # the join hands out the pairs of one left document in a row
                last, held = a, shingle_set(left.lower().split(), k)
            other = shingle_set(right.lower().split(), k)
            both = len(np.intersect1d(held, other, assume_unique=True))
            if 100 * both >= percent * (len(held) + len(other) - both):
                yield from out.add((a, b))
        yield from out.flush()

    texts = docs.select("id", F.col("text").cast("binary").alias("text"))
    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    both = right.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a long, b long")


def _likely(percent: int, m: int):
    """Row filter on Arrow batches: set sizes allow the threshold, and the joint estimate lies within five deviations of it."""
    margin = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / m) - 1 / 48

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
        fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, m) for c in ("ra", "rb"))
        return fits & (estimate(left, right, na, nb) >= margin)

    return keep


def _filter_pairs(pairs: DataFrame, percent: int, m: int) -> DataFrame:
    keep = _likely(percent, m)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array(keep(batch)))

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _small_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of different components in buckets of at most ``SMALL`` members, for ``rows(key, id, n, size, component)``."""
    small = rows.filter(F.col("size") <= SMALL).select("key", "id", "n", "component")
    one, two = (small.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "component"))) for side in "ab")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = one.join(two, "key").filter((F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & fits)
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _block_links(one: pa.Table, two: pa.Table, same: bool, k: int, percent: int) -> list[tuple[int, int]]:
    """Links between the documents of two blocks, exact: per document one for each component it is linked with.

    Shingles that a single document of the blocks holds take no part in any intersection; the others give
    the columns of two 0/1 matrices whose product holds all intersections, some columns at a time.
    """
    if not len(one) or not len(two):
        return []
    sides = [[shingle_set(t.lower().split(), k) for (t,) in rows_of(iter(p.to_batches()), "text")] for p in ((one,) if same else (one, two))]
    values = np.concatenate([x for own in sides for x in own])
    values.sort()  # in place, as these are the largest array here
    values = values[1:][values[1:] == values[:-1]]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    values = values[first]
    sides = [sides[0], sides[-1]]
    common = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, len(values), COLUMNS):
        part = values[at : at + COLUMNS]
        flags = [np.zeros((len(own), len(part)), np.float32) for own in sides]
        for own, flag in zip(sides, flags, strict=True):
            for i, items in enumerate(own):
                near = items[np.searchsorted(items, part[0]) : np.searchsorted(items, part[-1], "right")]
                where = np.searchsorted(part, near)
                flag[i, where[part[where] == near]] = 1
        common += flags[0] @ flags[1].T
    sizes = [np.array([len(x) for x in own], np.float64) for own in sides]
    linked = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
    linked &= one["component"].to_numpy()[:, None] != two["component"].to_numpy()[None, :]
    ids, parts, out = two["id"].to_numpy(), two["component"].to_numpy(), []
    for i, own in enumerate(one["id"].to_numpy()):
        hit = np.flatnonzero(linked[i])
        _, first = np.unique(parts[hit], return_index=True)
        out += [(int(own), int(ids[hit[x]])) for x in first]
    return out


def _large_links(rows: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between components in buckets of more than ``SMALL`` members, for ``rows(leader, id, n, size, component)``.

    Buckets with one leader are compared together, so a document that shares many bands counts once.  The members
    outside the group's largest component are compared with all others, the largest component is not compared
    with itself.  Both are cut by hash into blocks that hold about ``BLOCK`` documents and ``WEIGHT`` shingles at
    most; each pair of blocks is one group, so no group holds more than two blocks, and only links leave it.
    """
    large = rows.filter(F.col("size") > SMALL).groupBy("leader", "id", "component").agg(F.max("n").alias("n"))
    counts = large.groupBy("leader", "component").agg(F.count("*").alias("n"), F.sum("n").alias("weight"))
    sums = [F.max(F.struct("n", "component", "weight")).alias("top"), F.sum("n").alias("all"), F.sum("weight").alias("weight")]
    tops = counts.groupBy("leader").agg(*sums).filter("all > top.n")
    blocks = lambda n, weight: F.ceil(F.greatest(n / BLOCK, weight / WEIGHT))
    top = blocks(F.col("top.n"), F.col("top.weight")).alias("most")
    rest = blocks(F.col("all") - F.col("top.n"), F.col("weight") - F.col("top.weight")).alias("rest")
    tops = materialize(tops.select("leader", F.col("top.component").alias("main"), top, rest), "tops")
    placed = large.join(tops, "leader")
    is_main, draw = F.col("component") == F.col("main"), F.xxhash64("id")
    block = F.when(is_main, F.pmod(draw, F.col("most"))).otherwise(F.col("most") + F.pmod(draw, F.col("rest")))
    zero = F.lit(0).cast("long")
    others = F.when(is_main, F.sequence(F.col("most"), F.col("most") + F.col("rest") - 1)).otherwise(F.sequence(zero, F.col("most") + F.col("rest") - 1))
    texts = docs.select("id", F.col("text").cast("binary").alias("text")).join(placed.select("id").distinct(), "id", "left_semi")
    texts = materialize(texts, "texts")
    spread = placed.withColumn("block", block).withColumn("other", F.explode(others)).join(texts, "id")
    spread = spread.select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "text")

    def run(key, rows):
        i, j = key[1].as_py(), key[2].as_py()
        block = rows["block"].to_numpy()
        one = rows.filter(pa.array(block == i))
        two = one if i == j else rows.filter(pa.array(block == j))
        found = np.array(_block_links(one, two, i == j, k, percent), np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return spread.groupBy("leader", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept``.

    Documents whose ``shingle``-word sets (A-Z lower-cased) have ``100 * common >= percent * union`` are
    linked; a component is named by its smallest id, and that document is kept.

    1. One pass makes registers and a 128-bit fingerprint of each set; equal sets become one representative.
    2. Bands of register values are hashed; in a bucket each member is paired with the bucket's leader, and of
       a member's leaders the one that shares most bands is tried first.
    3. Pairs pass the joint likelihood estimate, then a test on whole sets; components follow.
    4. In buckets that still hold several components all pairs between these are tried: small buckets the same
       way, large ones on whole sets, block by block.  So every pair that shares a band is tested or lies
       within one component already, and large groups cost one test per member instead of one per pair.

    Null or wordless texts have no shingle and no link.  Rows with a null id are dropped; a repeated id counts
    as one document per distinct text, all linked through the id.  Other columns are ignored.
    """
    m = bands_for(percent) * ROWS
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    rows = materialize(sketch(base, shingle, m), "sketches")
    sets = rows.filter("n > 0").groupBy("set_key", "n").agg(F.min("id").alias("rep"), F.first("regs").alias("regs"))
    sets = materialize(sets.select(F.col("rep").alias("id"), "n", "regs", "set_key"), "sets")
    width = 2 * ROWS
    keys = [F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(m // ROWS)]
    banded = sets.select("id", F.explode(F.array(*keys)).alias("key"))
    buckets = materialize(banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = materialize(banded.join(buckets, "key"), "members")

    # A bucket is led by the member that shares buckets with most others over all bands: in a group of copies
    # that is the one in the middle, to which more of them are linked than to any other.
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    heads = members.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("least"))).alias("head"))
    heads = materialize(heads.select("key", F.col("head.weight").alias("weight"), (-F.col("head.least")).alias("leader")), "heads")
    shared = members.join(heads, "key").filter("id <> leader").groupBy("id", "leader", "weight").agg(F.count("*").alias("bands"))
    first = shared.groupBy("id").agg(F.max(F.struct("bands", "weight", (-F.col("leader")).alias("least"))).alias("best"))
    first = first.select((-F.col("best.least")).alias("a"), F.col("id").alias("b"))
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    first = materialize(first, "first")
    likely = materialize(_filter_pairs(first.join(right, "b").join(left, "a"), percent, m), "likely")
    links = materialize(_verified(likely, base, shingle, percent), "links")

    label = components(links)
    placed = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    placed = placed.join(mixed, "key").join(heads.select("key", "leader"), "key").join(sets.select("id", "n"), "id")
    placed = materialize(placed, "mixed")
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossed = _small_pairs(placed, percent).join(tried, ["a", "b"], "left_anti")
    more = materialize(_filter_pairs(crossed.join(right, "b").join(left, "a"), percent, m), "likely")
    links = links.union(materialize(_verified(more, base, shingle, percent), "links"))
    links = links.union(materialize(_large_links(placed, base, shingle, percent), "links"))

    # Every document of a set hangs on the set's representative.
    own = sets.select("set_key", F.col("id").alias("rep"))
    joined = rows.select("id", "n", "set_key").join(own, "set_key", "left")
    label = components(links.union(joined.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    out = joined.join(label, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns; rows with a null id stay.

    A repeated id is kept once per group: of its rows the one with the smallest text hash stays.
    """
    verdict = near_duplicates(docs, id_col, text_col, shingle, percent).filter("kept").select(F.col("id").alias("_kept")).distinct()
    known = docs.join(verdict, docs[id_col].cast("long") == verdict["_kept"], "left_semi").dropDuplicates([id_col])
    return known.unionByName(docs.filter(F.col(id_col).isNull()))
