"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import components, materialize

#: Trees of the forest; levels that one round splits.
TREES, LEVELS = 8, 8
#: Vectors (by seeded hash) of a node that its split points are fitted on, about; every node is sampled anew.
SAMPLE = 8192
#: A node with more vectors than this is split, into nodes of about two thirds of it.
LEAF = 768
#: Share of a node's vectors, those nearest to the split point, that go to both sides.
SPILL = 0.1
#: A node whose projections, but for a tenth, lie within this width is one dense group and is not split.
DENSE = 0.06
#: Vectors per block where a leaf is compared; larger leaves are compared block by block.
BLOCK = 768
#: A part of a sample with fewer vectors than this gives no split point.
LEAST = 16
#: A node of a tree is ``tree * 2^56`` and the path to it: 1, then a bit per level.  All trees begin at 0.
_TREE = 56
#: Nodes at this level are not split any more.
LAST = 50


def directions(tree: int, width: int) -> np.ndarray:
    """Unit directions of a tree, one per level, for vectors of ``width`` entries."""
    out = np.random.default_rng([7, tree, width]).normal(size=(_TREE, width))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def starts(code: int) -> list[int]:
    """Nodes to descend from: the roots of all trees, or the node itself."""
    return [(t << _TREE) + 1 for t in range(TREES)] if code == 0 else [code]


def _level(code: int) -> tuple[int, int, int]:
    """Tree, path and level of a node."""
    path = code & ((1 << _TREE) - 1)
    return code >> _TREE, path, path.bit_length() - 1


def fit_node(sample: np.ndarray, code: int, total: int) -> np.ndarray:
    """Split points and spill distances below a node of ``total`` vectors: two rows in heap order.

    The split point is the sampled median of the projections.  NaN marks a dense group, or a node below the last level;
    infinity a node whose part of the sample is too small: it is left for the next round.
    """
    tree, _, level = _level(code)
    depth = int(np.ceil(np.log(max(1.5 * total / LEAF, 1)) / np.log(2 / (1 + SPILL))))
    depth = max(1, min(depth, LEVELS, int(np.log2(max(len(sample) / LEAST, 2)))))
    if level + depth > LAST:
        return np.full((2, 1), np.nan)
    projected = sample @ directions(tree, sample.shape[1])[level : level + depth].T
    out = np.full((2, (1 << depth) - 1), np.inf)
    nodes = {0: np.arange(len(sample))}
    for at in range(out.shape[1]):
        own = nodes.pop(at, None)
        if own is None or at and len(own) < LEAST:
            continue
        x = projected[own, (at + 1).bit_length() - 1]
        if np.quantile(x, 0.95) - np.quantile(x, 0.05) <= DENSE:
            out[:, at] = np.nan
            continue
        cut = np.median(x)
        out[:, at] = cut, np.quantile(np.abs(x - cut), SPILL)
        nodes[2 * at + 1], nodes[2 * at + 2] = own[x <= cut], own[x > cut]
    return out


def descend(unit: np.ndarray, code: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and nodes that vectors of a node come to, and whether the node is a dense group."""
    tree, path, level = _level(code)
    depth = cuts.shape[1].bit_length()
    projected = unit @ directions(tree, unit.shape[1])[level : level + depth].T
    rows, at = np.arange(len(unit)), np.zeros(len(unit), np.int64)
    done = []
    for step in range(depth):
        cut, spill, x = cuts[0, at], cuts[1, at], projected[rows, step]
        ends = ~np.isfinite(cut)
        done.append((rows[ends], at[ends], np.isnan(cut[ends])))
        left, right = ~ends & (x <= cut + spill), ~ends & (x > cut - spill)
        rows, at = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
    done.append((rows, at, np.zeros(len(rows), bool)))
    rows, at, dense = (np.concatenate(c) for c in zip(*done, strict=True))
    # A place in the heap is a path below the node: 1 and a bit per level.
    below = at + 1
    steps = np.floor(np.log2(below)).astype(np.int64)
    return rows, (tree << _TREE) + (path << steps) + (below - (1 << steps)), dense


def unit_vectors(rows: list) -> np.ndarray:
    x = rescaled(rows)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def place(classes: DataFrame) -> DataFrame:
    """``(id, codes)``: the leaves of each of ``classes(id, width, vector)`` over all trees, ascending.

    All trees of one length of vectors begin as one node.  While a node holds more than ``LEAF`` vectors and is no dense
    group, a round samples it, fits up to ``LEVELS`` levels below it in a task, and sends its vectors down.  So
    leaves stay small however many vectors there are; samples, fits and split points are rows of tables, keyed by
    node.  A vector visits ``(1 + SPILL)`` nodes per node and level at most, on average.
    """
    visits = classes.select("id", "width", F.lit(0).cast("long").alias("code"), F.lit(False).alias("dense"))
    settled = []
    while True:
        sizes = visits.filter("not dense").groupBy("width", "code").agg(F.count("*").alias("total")).filter(F.col("total") > LEAF)
        sizes = materialize(sizes, "sizes")
        if sizes.isEmpty():
            break
        settled.append(visits.join(sizes, ["width", "code"], "left_anti").select("id", "code"))
        full = visits.join(sizes, ["width", "code"]).select("id", "width", "code", "total").join(classes.select("id", "vector"), "id")
        draw = F.pmod(F.xxhash64("id", "code"), F.lit(1 << 30)) < (SAMPLE / F.col("total") * (1 << 30))
        models = full.filter(draw).groupBy("width", "code").applyInArrow(_fit, "width int, code long, start long, cuts array<double>, spills array<double>")
        models = materialize(models, "models").groupBy("width", "code").agg(F.collect_list(F.struct("start", "cuts", "spills")).alias("models"))
        sent = full.join(models, ["width", "code"]).select("id", "width", "code", "vector", "models")
        if settled[1:]:  # many nodes: the vectors of one follow each other
            sent = sent.repartition("width", "code", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("width", "code")
        visits = materialize(sent.mapInArrow(_send, "id long, width int, code long, dense boolean"), "visits")
    for other in settled:
        visits = visits.select("id", "code").union(other)
    return visits.groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("codes"))


def _fit(key: tuple, rows: pa.Table) -> pa.Table:
    width, code = (k.as_py() for k in key)
    sample = unit_vectors(rows["vector"].to_pylist())
    begin, total = starts(code), rows["total"][0].as_py()
    fitted = [fit_node(sample, c, total) for c in begin]
    columns = [[width] * len(begin), [code] * len(begin), begin, [f[0].tolist() for f in fitted], [f[1].tolist() for f in fitted]]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["width", "code", "start", "cuts", "spills"])


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("width", pa.int32()), ("code", pa.int64()), ("dense", pa.bool_())])
    for batch in batches:
        ids, widths, codes = (batch.column(n).to_numpy() for n in ("id", "width", "code"))
        order = np.lexsort((codes, widths))
        edges = np.flatnonzero((np.diff(codes[order]) != 0) | (np.diff(widths[order]) != 0)) + 1
        for own in np.split(order, edges) if len(order) else []:
            vectors = batch.column("vector").take(pa.array(own))
            unit = unit_vectors(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1))
            for model in batch.column("models")[int(own[0])].as_py():
                rows, nodes, dense = descend(unit, model["start"], np.array([model["cuts"], model["spills"]]))
                kept = ids[own[rows]]
                yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(np.full(len(kept), widths[own[0]])), pa.array(nodes), pa.array(dense)], schema=schema)


def _shared_before(a: list, b: list, code: int) -> np.ndarray:
    """Which pairs of rows share a leaf whose code is below ``code``: those are counted there."""
    ids: dict[int, int] = {}
    sides = []
    for rows in (a, b):
        at = [(i, ids.setdefault(c, len(ids))) for i, codes in enumerate(rows) for c in codes if c < code]
        sides.append(at)
    if not ids:
        return np.zeros((len(a), len(b)), bool)
    flags = [np.zeros((len(rows), len(ids)), np.float32) for rows in (a, b)]
    for flag, at in zip(flags, sides, strict=True):
        if at:
            flag[tuple(np.array(at).T)] = 1
    return flags[0] @ flags[1].T > 0


def rescaled(rows: list) -> np.ndarray:
    """Vectors as doubles; those whose squares would leave the range of doubles are divided by their largest component."""
    x = np.array(rows, np.float64)
    peak = np.abs(x).max(axis=1, keepdims=True, initial=0)
    return np.where((peak > 1e150) | (peak < 1e-150), x / peak, x)


def _joined(close: np.ndarray, ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of each row's and each column's component in a block of links."""
    none = np.iinfo(np.int64).max
    left, right = ids.copy(), others.copy()
    while True:
        low = np.minimum(left, np.where(close, right[None, :], none).min(axis=1))
        below = np.minimum(right, np.where(close, low[:, None], none).min(axis=0))
        if (low == left).all() and (below == right).all():
            return left, right
        left, right = low, below


def compare(pdf: pd.DataFrame, code: int, i: int, j: int, least: float) -> pd.DataFrame:
    """Links between block ``i`` and block ``j`` of a leaf: the links of each vector counted here, and an edge that joins it to its component."""
    one, two = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
    if not len(one) or not len(two):
        return pd.DataFrame({"id": np.empty(0, np.int64), "links": np.empty(0, np.int64), "partner": np.empty(0, np.int64)})
    x, y = rescaled(one["vector"].tolist()), rescaled(two["vector"].tolist())
    close = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) >= least
    if i == j:
        np.fill_diagonal(close, False)
    if close.any():
        close &= ~_shared_before(one["codes"].tolist(), two["codes"].tolist(), code)
    ids, others = one["id"].to_numpy(), two["id"].to_numpy()
    left, right = _joined(close, ids, others)
    some, far = close.any(axis=1), close.any(axis=0)
    out = [pd.DataFrame({"id": ids[some], "links": (close @ two["copies"].to_numpy())[some], "partner": left[some]})]
    if i != j:
        out.append(pd.DataFrame({"id": others[far], "links": (close.T @ one["copies"].to_numpy())[far], "partner": right[far]}))
    return pd.concat(out)


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """``(id, n_links, component_id, kept)`` per row; links are pairs found with a cosine of ``least`` or more.

    Equal vectors are one class with a count.  Classes go down every tree (``place``); a leaf is compared in blocks,
    however large it is, and a pair is counted in the first leaf that it shares, so links are counted
    without writing pairs.  Edges to partners are kept per vector and leaf; components follow.

    Vectors link with vectors of the same length only.  Null or zero vectors and those with null or non-finite
    components link with nothing.  A repeated row is one more vector with the same id.  Null ids link with nothing
    and have a null component.  An empty table gives no row; other columns are ignored.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = materialize(rows.withColumn("usable", usable), "vectors")
    good = rows.filter("usable").groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = good.withColumn("width", F.size("vector"))
    # Ids name classes; rows of different vectors may share one, so a class has a number of its own.
    classes = materialize(classes.withColumnRenamed("id", "name").withColumn("id", F.monotonically_increasing_id()), "classes")
    placed = materialize(classes.join(place(classes), "id"), "placed")
    visits = placed.withColumn("code", F.explode("codes"))
    sizes = visits.groupBy("width", "code").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")).filter("blocks > 1")
    visits = visits.join(sizes, ["width", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    visits = visits.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    visits = visits.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    visits = visits.select("width", "code", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "copies", "vector", "codes")

    def run(key, pdf):
        return compare(pdf, int(key[1]), int(key[2]), int(key[3]), least)

    found = materialize(visits.groupBy("width", "code", "i", "j").applyInPandas(run, "id long, links long, partner long"), "found")
    label = components(found.select(F.col("id").alias("a"), F.col("partner").alias("b")))
    linked = found.groupBy("id").agg(F.sum("links").alias("links")).join(label, "id", "full")
    # Results go from classes to their members; a component is named by the smallest id of its rows.
    own = classes.join(linked, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    own = materialize(own, "own")
    names = own.groupBy("group").agg(F.min("name").alias("component"))
    own = own.join(names, "group").select("vector", "copies", "links", "component", F.lit(True).alias("usable"))
    out = rows.join(own, ["vector", "usable"], "left")
    links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    part = F.coalesce("component", "id")
    return out.select("id", links.cast("long").alias("n_links"), part.alias("component_id"), (F.col("id") == part).alias("kept"))
