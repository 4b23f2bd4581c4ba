import random

import numpy as np

from tests.llm.util import empty_documents, odd_documents, prose
from tracemill.llm import setsketch as ss


def shingles(text, k):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent):
    """Components by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[n + 1 :]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def test_components_match_brute_force(spark):
    """Groups of copies, chains of ever more distant copies, and groups larger than a block."""
    rng = random.Random(3)
    rows = []
    for base_length, copies, edits in ((300, 1, 0), (200, 8, 6), (150, 60, 9), (60, 40, 1), (400, 12, 25), (30, 15, 1)):
        base = prose(rng, base_length)
        for c in range(copies):
            words = list(base)
            for _ in range(rng.randrange(edits + 1)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
            rows.append(" ".join(words))
            if c % 5 == 0:
                rows.append(" ".join(words).upper())
            if c % 2:
                base = words  # drift: a chain
    rows += [" ".join(prose(rng, rng.randrange(1, 80))) for _ in range(60)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 85), (5, 80)):
        got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in ss.near_duplicates(df, shingle=k, percent=percent).collect()}
        assert got == brute(rows, k, percent)


def test_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ss, "SMALL", 2)
    monkeypatch.setattr(ss, "BLOCK", 4)
    rng = random.Random(5)
    base = prose(rng, 80)
    rows = []
    for i in range(30):
        words = list(base)
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = f"e{rng.randrange(99999)}"
        rows.append((i, " ".join(words)))
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in ss.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_odd_rows(spark):
    out = ss.near_duplicates(odd_documents(spark), shingle=3, percent=85)
    got = sorted((r["id"], r["n_shingles"], r["component_id"]) for r in out.collect())
    assert [x for x in got if x[0] == 5] == [(5, 1, 5)] * 2  # a repeated row
    assert (9, 1, 5) in got and (10, 1, 5) in got  # equal text, and equal but for A-Z
    assert {x for x in got if x[0] in (0, 1, 2)} == {(0, 0, 0), (1, 0, 1), (2, 0, 2)}
    assert all(x[0] is not None for x in got) and len(got) == 13
    kept = ss.keep_one(odd_documents(spark))
    assert sorted(kept.columns) == sorted(odd_documents(spark).columns)
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and 9 not in ids and 10 not in ids and ids.count(None) == 2
    assert ss.near_duplicates(empty_documents(spark)).count() == 0


def test_sketch_is_mergeable_and_estimates():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = items[:2000], items[500:]
    m = 400
    ra, rb = ss.registers(a, m), ss.registers(b, m)
    assert (np.maximum(ra, rb) == ss.registers(items, m)).all()
    j = ss.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(j - 1500 / 3000) < 0.1
    assert ss.bands_for(85) < ss.bands_for(80)
