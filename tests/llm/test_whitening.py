import math

import numpy as np
import pandas as pd
import pytest

from tests.conftest import SMALL
from tracemill.llm import whitening as wh


def random_symmetric(rng, values):
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [3.0], [2.0, 2.0], [1.0, 0.0, 0.0], [5.0, -5.0, 1.0], list(range(1, 41)), [1.0] * 20 + [2.0] * 20, [10.0**-k for k in range(14)],
        [1.0, 1 + 1e-9, 1 + 2e-9, 7.0], [0.0] * 6, list(np.linspace(-1, 1, 101)),
    ],
)
def test_eigenpairs(values):
    a = random_symmetric(np.random.default_rng(len(values)), values)
    e, v = wh.spectral(a)
    scale = max(np.abs(a).max(), 1e-300)
    assert np.allclose(e, np.sort(values)[::-1], atol=1e-13 * max(1, len(values)) * scale, rtol=0)
    assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-13 * len(values)
    assert np.abs(a @ v - v * e).max() <= 2e-14 * len(values) * scale


def test_polar_factor():
    rng = np.random.default_rng(0)
    a = random_symmetric(rng, [3.0, 1e-6, -2.0, -1e-9, 0.5])
    u = wh.polar(a)
    w, q = np.linalg.eigh(a)
    assert np.abs(u - (q * np.sign(w)) @ q.T).max() < 1e-6  # the smallest value limits the comparison, not the iteration
    assert np.abs(u @ u - np.eye(5)).max() < 1e-13


def brute(rows, components):
    """Whitening by the definition, with whole numbers of any size and a library eigensolver."""
    ids, vectors = zip(*rows, strict=True)
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - t) ** 2 for a, t in zip(v, total, strict=True)) for v in x]
    d = np.array([[(n * a - t) / n for a, t in zip(v, total, strict=True)] for v in x])
    e, v = np.linalg.eigh(d.T @ d / n)
    e, v = e[::-1], v[:, ::-1]
    return ids, n, deviation, (d @ v / np.sqrt(e))[:, :components], e / e.sum()


def check(rows, got, components):
    ids, n, deviation, white, explained = brute(rows, components)
    k = white.shape[1]
    table = {(r["id"], r["component"]): r for r in got}
    assert len(got) == len(rows) * k == len(table)
    mine = np.array([[table[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-8
    for i, dev in zip(ids, deviation, strict=True):
        for c in range(k):
            r = table[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, dev)
            assert abs(r["explained"] / explained[c] - 1) < 1e-10
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_query_matches_the_definition(spark):
    from tracemill.llm.catalog import QUERIES

    table = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    got = QUERIES["op11_spectral_whitening"](spark, SMALL).withColumnRenamed("vec_id", "id").collect()
    check(list(zip(table["vec_id"].tolist(), table["embedding"].tolist(), strict=True)), got, 32)


def test_offset_scales_and_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (1000 + rng.normal(size=7) * np.array([50, 20, 5, 2, 1, 0.5, 0.2])).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = wh.whiten(df.repartition(1), 5).collect()
    check(rows, one, 5)
    many = {(r["id"], r["component"]): r["whitened"] for r in wh.whiten(df.repartition(9), 5).collect()}
    assert many == {(r["id"], r["component"]): r["whitened"] for r in one}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.5]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (None, [3.0, -1.0]), (3, [-2.0, 0.25])]
    bad = [(4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1e300, 1.0]), (10, [1.0, 2.0, 3.0])]
    clash = ("id", "vector", "width", "component", "n")
    df = spark.createDataFrame([(*r, *clash) for r in good + bad], "vec_id long, embedding array<double>, id string, vector string, width string, component string, n string")
    got = wh.whiten(df, 32).collect()
    assert sorted((r["id"] or -1, r["component"], r["n"]) for r in got) == sorted((i or -1, c, 5) for i, _ in good for c in (1, 2))
    named = [(k, v) for k, (_, v) in enumerate(good)]
    _, _, deviation, _, explained = brute(named, 2)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    assert abs({r["explained"] for r in got if r["component"] == 2}.pop() - explained[1]) < 1e-12
    assert wh.whiten(df.limit(0)).count() == 0
    assert wh.whiten(df.filter("vec_id = 2")).count() == 0  # equal vectors have no component
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(20)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in wh.whiten(flat).collect()} == {1}


def test_lengths_apart(spark):
    rng = np.random.default_rng(9)
    short = [(i, rng.normal(size=3).tolist()) for i in range(50)]
    long = [(i + 100, rng.normal(size=6).tolist()) for i in range(40)]
    df = spark.createDataFrame(short + long, "vec_id long, embedding array<double>")
    got = wh.whiten(df).collect()
    check(short, [r for r in got if r["id"] < 100], 3)
    check(long, [r for r in got if r["id"] >= 100], 6)


def test_large_deviations():
    grid = np.array([[2.0**40, -3.0], [1.0, 5.0]])
    assert wh.deviations(grid, 1 << 20, [7, 9]) == [None, ((1 << 20) - 7) ** 2 + (5 * (1 << 20) - 9) ** 2]
