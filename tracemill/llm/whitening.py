"""Whitening of vectors by spectral divide and conquer on their covariance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import materialize, rows_of

#: Added to the grid value of every entry, and the number of grid steps in 1.
OFFSET, STEPS = 1_000_000, 64
#: Bytes of components and means that may be sent to the tasks, over all lengths of vectors.
MODEL_BYTES = 256 << 20
#: Longest vector: a task holds the square of it.
LONGEST = 8192

_EPS, _TINY = np.finfo(np.float64).eps, np.finfo(np.float64).tiny


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iteration in QR form."""
    n = len(a)
    x = a / max(np.linalg.norm(a), _TINY)
    low = _EPS  # below the smallest singular value, unless the matrix is singular
    for _ in range(60):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square)) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))
        new = (q / r) * x + (p - q / r) / np.sqrt(r) * (both[:n] @ both[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (p + q * square) / (1 + r * square), 1.0)
        if moved <= 10 * n * _EPS or (low >= 1 - 10 * _EPS and moved <= np.cbrt(_EPS)):
            break
    return x


def _shifts(a: np.ndarray) -> list[float]:
    """Shifts to try: near the median of the diagonal, strictly within its range, then the mean and points between."""
    d = np.sort(np.diag(a))
    middle = (d[(len(d) - 1) // 2] + d[len(d) // 2]) / 2
    spread = np.linalg.norm(a - middle * np.eye(len(a)), 1)
    return [middle, d.mean(), *(middle + f * spread for f in (0.03, -0.03, 0.11, -0.11, 0.29, -0.29, 0.53, -0.53, 0.83, -0.83))]


def _split(a: np.ndarray, rng: np.random.Generator, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces: eigenvalues above a shift and below it; None if there is but one value."""
    n = len(a)
    best = None
    for shift in _shifts(a):
        moved = a - shift * np.eye(n)
        if np.linalg.norm(moved) <= 4 * n * _EPS * size:
            return None
        upper = (polar(moved) + np.eye(n)) / 2  # projector on the eigenvectors above the shift
        rank = int(round(np.trace(upper)))
        if not 0 < rank < n:
            continue
        basis = upper @ rng.normal(size=(n, rank))
        for _ in range(2):
            basis = upper @ np.linalg.qr(basis)[0]
        full = np.linalg.qr(basis, mode="complete")[0]
        high, below = full[:, :rank], full[:, rank:]
        left = np.linalg.norm(below.T @ a @ high)
        if best is None or left < best[0]:
            best = (left, high, below)
        if left <= 20 * n * _EPS * size:
            break
    return best[1:] if best else None


def spectral(a: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    The polar factor of the shifted matrix gives the projectors on the eigenvectors above and below the shift;
    the matrix is carried over to bases of both subspaces, and each part is split in turn, down to one dimension
    or to a multiple of the identity.  No other eigensolver is used.
    """
    a = np.asarray(a, np.float64)
    a = (a + a.T) / 2
    rng = np.random.default_rng(seed)
    size = np.linalg.norm(a)
    found = []
    todo = [(a, np.eye(len(a)))] if len(a) else []
    while todo:
        part, basis = todo.pop()
        cut = _split(part, rng, size) if len(part) > 1 else None
        if cut is None:
            found += list(zip(np.diag(part), basis.T, strict=True))
            continue
        for own in cut:
            inner = own.T @ part @ own
            todo.append(((inner + inner.T) / 2, basis @ own))
    vectors = np.array([v for _, v in found]).T.reshape(len(a), len(found))
    if len(a):
        vectors = vectors / np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _grid(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Grid values less ``OFFSET`` of the vectors of one length, as doubles (whole numbers)."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return np.floor(STEPS * flat.reshape(-1, width))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Batches of vectors of one length each, as they come: ``(length, rows, grid values)``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        width = batch.column("width").to_numpy()
        for w in np.unique(width):
            own = batch if (width == w).all() else batch.filter(pa.array(width == w))
            yield int(w), own, _grid(own, int(w))


def _sums(rows: DataFrame, of, names: str) -> DataFrame:
    """Sums by (width, i, j) of the matrices that ``of(width, rows, grid)`` makes of each batch, one row per cell and task."""
    schema = pa.schema([("width", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for width, own, grid in _by_length(batches):
            now = of(width, own, grid)
            total[width] = total[width] + now if width in total else now
        for width, cells in total.items():
            for i, line in enumerate(cells):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(line), width, np.int32)), pa.array(np.full(len(line), i, np.int32)), pa.array(np.arange(len(line), dtype=np.int32)), pa.array(line)],
                    schema=schema,
                )

    cells = rows.mapInArrow(run, "width int, i int, j int, value double")
    return materialize(cells.groupBy("width", "i", "j").agg(F.sum("value").alias("value")), names)


def whiten(table: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: each vector on the leading components.

    An entry c becomes the whole number ``x = floor(64 c) + 1000000``.  With n vectors and sums S per dimension, the
    components are unit eigenvectors of the covariance of x (``spectral``), numbered from 1 by falling eigenvalue e.
    ``whitened`` is x - S/n on the component over sqrt(e), ``explained`` is e over the trace, ``deviation`` the exact sum of
    (n x - S)^2 over the dimensions, ``identity_error`` the largest entry by which the covariance of ``whitened``
    differs from the identity.

    Four passes read the vectors: sums, covariance, covariance of the result, result.  For the covariance, x is centred at
    the whole number next to its mean and the rest of the mean, at most 1/2, is taken off after: sums of products are then
    whole numbers, exact in doubles in any order while they are below 2^53.  Each task sends one row per cell of
    its matrix; Spark adds them up; the cells of a length meet in one task, which holds the square of the length
    (at most ``LONGEST``).  Components and means are sent to the tasks; their bytes are checked (``MODEL_BYTES``).

    Rows whose vector is null or holds null or non-finite entries, or entries without a long x, are dropped.  Vectors of
    different lengths are whitened apart, each length by its own rows (n counts those); empty vectors have no component.
    Components without variance, beyond rounding, are left out: a single vector, or equal ones, give no row.  A deviation
    that is no long is null.  Repeated rows and null ids count like others.  An empty table gives no row; other
    columns are ignored.
    """
    spark = table.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**56)))
    rows = rows.filter(F.coalesce(fine, F.lit(False)) & (F.size("vector") > 0)).withColumn("width", F.size("vector"))

    # Sums of whole numbers are exact in doubles below 2^53; entries above 2^26 are summed in two parts.
    half = float(1 << 26)

    def first(width, own, grid):
        high = np.trunc(grid / half)
        return np.vstack([high.sum(axis=0), (grid - high * half).sum(axis=0), np.full(width, float(len(grid)))])

    means = {}
    for r in _sums(rows, first, "sums").collect():
        means.setdefault(r["width"], np.zeros((3, r["width"])))[r["i"], r["j"]] = r["value"]
    if any(w > LONGEST for w in means):
        raise ValueError(f"vectors of more than {LONGEST} entries")
    models = {}
    for width, (high, low, count) in means.items():
        n = int(count[0])
        total = [int(h) * (1 << 26) + int(l) for h, l in zip(high, low, strict=True)]
        centre = [(2 * t + n) // (2 * n) for t in total]
        rest = np.array([t - n * c for t, c in zip(total, centre, strict=True)], np.float64) / n
        models[width] = {"n": n, "total": total, "centre": np.array(centre, np.float64), "rest": rest}
    if sum(64 * w for w in models) > MODEL_BYTES:
        raise ValueError(f"the means of all lengths take more than {MODEL_BYTES} bytes")
    sent = spark.sparkContext.broadcast(models)

    def second(width, own, grid):
        x = grid - sent.value[width]["centre"]
        return x.T @ x

    cells = _sums(rows, second, "covariance")

    def solve(key, cells):
        width = key[0].as_py()
        model = sent.value[width]
        v = np.zeros((width, width))
        v[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["value"].to_numpy()
        v = v / model["n"] - np.outer(model["rest"], model["rest"])
        values, vectors = spectral(v)
        kept = int((values[:components] > 8 * width * _EPS * max(values[0], 0.0)).sum())
        columns = [np.full(kept, width, np.int32), np.arange(1, kept + 1, dtype=np.int32), values[:kept], values[:kept] / max(np.trace(v), _TINY), vectors.T[:kept].tolist()]
        types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["width", "component", "e", "explained", "axis"])

    solved = cells.groupBy("width").applyInArrow(solve, "width int, component int, e double, explained double, axis array<double>")
    solved = materialize(solved, "components")
    size = solved.agg(F.sum(F.size("axis") * 8)).first()[0] or 0
    if size > MODEL_BYTES:
        raise ValueError(f"the components of all lengths take more than {MODEL_BYTES} bytes")
    for r in solved.orderBy("width", "component").collect():
        models[r["width"]].setdefault("e", []).append(r["e"])
        models[r["width"]].setdefault("explained", []).append(r["explained"])
        models[r["width"]].setdefault("axes", []).append(r["axis"])
    models = {w: {**m, "axes": np.array(m["axes"]).T / np.sqrt(m["e"])} for w, m in models.items() if "axes" in m}
    sent_2 = spark.sparkContext.broadcast(models)

    def project(width, grid):
        model = sent_2.value[width]
        return (grid - model["centre"] - model["rest"]) @ model["axes"]

    def third(width, own, grid):
        if width not in sent_2.value:
            return np.zeros((0, 0))
        y = project(width, grid)
        return np.vstack([y.sum(axis=0), y.T @ y])

    checks: dict[int, np.ndarray] = {}
    for r in _sums(rows, third, "check").collect():
        k = len(models[r["width"]]["e"])
        checks.setdefault(r["width"], np.zeros((k + 1, k)))[r["i"], r["j"]] = r["value"]
    error = 0.0
    for width, got in checks.items():
        mean, n = got[0] / models[width]["n"], models[width]["n"]
        error = max(error, float(np.abs(got[1:] / n - np.outer(mean, mean) - np.eye(len(mean))).max()))

    schema = pa.schema(
        [("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())]
    )

    def last(batches):
        for width, own, grid in _by_length(batches):
            if width not in sent_2.value:
                continue
            model, y = sent_2.value[width], project(width, grid)
            k, ids = y.shape[1], own.column("id").take(pa.array(np.repeat(np.arange(len(y)), y.shape[1])))
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                pa.array(np.full(len(y) * k, model["n"], np.int64)),
                pa.array(deviations(grid, model["n"], model["total"]), pa.int64()).take(pa.array(np.repeat(np.arange(len(y)), k))),
                pa.array(y.ravel()),
                pa.array(np.tile(np.array(model["explained"]), len(y))),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = rows.mapInArrow(last, "id long, component int, n long, deviation long, whitened double, explained double")
    return out.withColumn("identity_error", F.lit(error))


def deviations(grid: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Per row the exact sum of ``(n x - S)^2``; None where it is no long.  The offset of x cancels out."""
    far = np.abs(grid).max(initial=0.0) * n + max(map(abs, total), default=0)
    if far < 2.0**52 and (far * far) * grid.shape[1] < 2.0**62:
        d = grid.astype(np.int64) * n - np.array(total, np.int64)
        return (d * d).sum(axis=1).tolist()
    out = []
    for line in grid.tolist():
        value = sum((n * int(x) - t) ** 2 for x, t in zip(line, total, strict=True))
        out.append(value if value < 1 << 63 else None)
    return out
