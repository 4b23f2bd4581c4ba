import numpy as np

from tracemill.llm import forest as fo


def brute(vectors):
    """``id -> (links, component)`` over all pairs, in doubles."""
    ids = [i for i, _ in vectors]
    x = np.array([v for _, v in vectors], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(*np.nonzero(close), strict=True):
        p, q = sorted((find(ids[a]), find(ids[b])))
        root[q] = p
    return {i: (int(n), find(i)) for i, n in zip(ids, close.sum(axis=1), strict=True)}


def planted(rng, n, groups, copies, noise):
    rows = [rng.normal(size=32) for _ in range(n)]
    for _ in range(groups):
        base = rng.normal(size=32)
        rows += [base + rng.normal(size=32) * noise for _ in range(copies)]
    base = rng.normal(size=32)
    rows += [base] * 25  # equal vectors
    order = rng.permutation(len(rows))
    return [(int(i), [float(np.float32(y)) for y in rows[i]]) for i in order]


def test_links_match_brute_force(spark, monkeypatch):
    """Small leaves and blocks, groups larger than a leaf, pairs close to the threshold."""
    for name, value in (("LEAF", 40), ("BLOCK", 32)):
        monkeypatch.setattr(fo, name, value)
    rng = np.random.default_rng(4)
    vectors = planted(rng, 600, 12, 6, 0.3) + [(i + 10_000, v) for i, v in planted(rng, 0, 1, 150, 0.05)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in fo.near_vectors(df).collect()}
    want = brute(vectors)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)  # nothing below the threshold, nothing twice
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [None, 1.0, 0.0]),
        (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 1.0, 0.0]), (9, []), (None, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (11, [1e-300, 0.0, 0.0]), (12, [-1.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, id string, vector string")
    got = sorted((r["id"] if r["id"] is not None else -1, r["n_links"], r["component_id"]) for r in fo.near_vectors(df).collect())
    linked = [(1, 4, 1), (2, 4, 1), (3, 4, 1), (3, 4, 1), (11, 4, 1)]
    alone = [(i, 0, i) for i in (4, 5, 6, 7, 8, 9, 10, 12)]
    assert got == sorted([*linked, *alone, (-1, 0, None)], key=lambda r: r[:2])
    assert fo.near_vectors(df.limit(0)).count() == 0


def test_lengths_and_shared_ids(spark):
    """Vectors link within their own length; rows of one id and different vectors are linked apart."""
    rows = [(1, [1.0, 0.01]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.01, 0.0]), (5, [0.0, 0.0, 1.0]), (6, [0.0, 1.0]), (6, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in fo.near_vectors(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True), (6, 0, 6, True)]


def forest_recall(spark, n, leaf, monkeypatch):
    """Leaves of random vectors with a partner at a cosine of 0.9 to 0.95: share of partners met, levels, leaf sizes, visits."""
    monkeypatch.setattr(fo, "LEAF", leaf)
    monkeypatch.setattr(fo, "SAMPLE", 1024)
    rng = np.random.default_rng(n)
    x = fo.unit_vectors(rng.normal(size=(n // 2, 64)))
    y = fo.unit_vectors(x + fo.unit_vectors(rng.normal(size=x.shape)) * rng.uniform(0.33, 0.48, (len(x), 1)))
    rows = [(i, 64, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame(rows, "id long, width int, vector array<double>").repartition(8)
    codes = {r["id"]: r["codes"] for r in fo.place(df).collect()}
    assert set(codes) == set(range(n))
    met = [bool(set(codes[i]) & set(codes[i + len(x)])) for i in range(len(x))]
    levels = [fo._level(c)[2] for own in codes.values() for c in own]
    sizes = np.unique([c for own in codes.values() for c in own], return_counts=True)[1]
    return np.mean(met), np.median(levels), sizes, sum(map(len, codes.values())) / n


def test_recall_and_leaf_sizes_over_many_levels(spark, monkeypatch):
    recall, levels, sizes, visits = forest_recall(spark, 12_000, 10, monkeypatch)
    assert levels >= 10 and sizes.max() <= 10
    assert recall >= 0.95
    assert visits <= fo.TREES * (1 + fo.SPILL) ** (levels + 2)


def test_leaves_stay_small_as_vectors_grow(spark, monkeypatch):
    found = [forest_recall(spark, n, 64, monkeypatch) for n in (2000, 8000)]
    assert all(sizes.max() <= 64 and recall >= 0.95 for recall, _, sizes, _ in found)
    assert found[1][3] <= found[0][3] * (1 + fo.SPILL) ** 3  # two levels more, and one for chance


def test_dense_groups_are_not_split(spark, monkeypatch):
    monkeypatch.setattr(fo, "LEAF", 50)
    rng = np.random.default_rng(3)
    base = rng.normal(size=32)
    rows = [(i, 32, (base + rng.normal(size=32) * 0.01).tolist()) for i in range(400)]
    codes = [r["codes"] for r in fo.place(spark.createDataFrame(rows, "id long, width int, vector array<double>")).collect()]
    assert all(c == codes[0] and len(c) == fo.TREES for c in codes)
