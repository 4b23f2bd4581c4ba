import itertools

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.util import empty_documents, odd_documents
from tracemill.llm import mixing as mx


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=12))
def test_targets_reshare_until_none_is_above(sizes):
    sizes = dict(enumerate(sizes))
    weights = {s: s % 3 + 1 for s in sizes}
    out = mx.targets(sizes, weights)
    assert abs(sum(out.values()) - sum(sizes.values())) <= 1e-6 * max(1, sum(sizes.values()))
    free = [s for s in sizes if out[s] < 3 * sizes[s] - 1e-6]
    assert all(out[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
    assert len({round(out[s] / weights[s], 6) for s in free}) <= 1


def best(patterns, quotas, unit):
    """Most words and then least cost, trying all splits in units."""
    names = list(patterns)
    found = (-1, 0)
    ranges = [range(0, 3 * patterns[p] // unit + 1) for p in names]
    for amounts in itertools.product(*ranges):
        words = [a * unit for a in amounts]
        if not fits(dict(zip(names, words, strict=True)), quotas, unit):
            continue
        cost = 0
        for p, w in zip(names, words, strict=True):
            for c, price in enumerate(mx.COPY_COST):
                cost += price * max(0, min(w - c * patterns[p], patterns[p]))
        found = max(found, (sum(words), -cost))
    return found


def fits(amounts, quotas, unit):
    """Hall's condition: the patterns within any set of sources give at most the quotas of the set."""
    sources = list(quotas)
    for n in range(1, len(sources) + 1):
        for own in itertools.combinations(sources, n):
            if sum(w for p, w in amounts.items() if set(p) <= set(own)) > sum(quotas[s] for s in own):
                return False
    return True


def test_flow_is_optimal_on_small_cases():
    cases = [
        ({("a",): 20, ("a", "b"): 30, ("b",): 10}, {"a": 50, "b": 60}),
        ({("a", "b"): 20, ("b", "c"): 20, ("c",): 10}, {"a": 70, "b": 10, "c": 40}),
        ({("a",): 10, ("b",): 10, ("a", "b", "c"): 20}, {"a": 40, "b": 20, "c": 10}),
    ]
    for patterns, quotas in cases:
        got = mx.flow(patterns, quotas)
        cost = sum(price * max(0, min(w - c * patterns[p], patterns[p])) for p, w in got.items() for c, price in enumerate(mx.COPY_COST))
        assert (round(sum(got.values())), -round(cost)) == best(patterns, quotas, 10)


def test_mix_comes_near_targets_and_repeats(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 400)), f"s{i % 5}" if i % 11 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mx.mix(df, mx.cycle_weights).collect()
    by = {}
    for r in out:
        assert 0 <= r["copies"] <= 3
        t = by.setdefault(r["sources"][0], [r["target"], r["source_size"], 0, 0])
        t[2] += r["copies"] * r["size"]
        t[3] += r["size"]
    assert len(by) == 6 and all(abs(t[2] - t[0]) < 0.004 * t[0] and t[1] == t[3] for t in by.values())
    again = mx.mix(df.repartition(13), mx.cycle_weights).collect()
    assert sorted((r["id"], r["copies"]) for r in out) == sorted((r["id"], r["copies"]) for r in again)


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, [["a"], ["a", "b"], ["b", "c"], None][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    out = mx.mix(df, lambda names: {"a": 1, "b": 1, "c": 2}).collect()
    taken = sum(r["copies"] * r["size"] for r in out)
    assert abs(taken - 3000) <= 30 and all(not r["copies"] for r in out if not r["sources"])


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = mx.mix(docs, mx.cycle_weights).collect()
    assert len(out) == docs.count() and {r["size"] for r in out if r["id"] in (0, 1, 2)} == {0}
    rows = mx.mix_documents(docs, mx.cycle_weights)
    assert rows.columns == docs.columns
    copies = {r["id"]: r["copies"] for r in out if r["id"] is not None}
    got = {r["doc_id"]: r["n"] for r in rows.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(got.get(i, 0) == c * (2 if i == 5 else 1) for i, c in copies.items())
    assert mx.mix(empty_documents(spark), mx.cycle_weights).count() == 0


def test_one_long_document_leaves_no_gap(spark):
    """Whatever is left out is larger than the gap, also where thousands of small documents must fill it."""
    rows = [(i, 200 + i * 7919 % 400, "a") for i in range(4000)] + [(9000 + i, 200_000, "a") for i in range(4)]
    rows += [(10_000 + i, 400, "b") for i in range(3000)] + [(20_000, 17, "b"), (20_000, 17, "b")]
    df = spark.createDataFrame(rows, "id long, n int, source string").select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.col("n")).alias("text"), "source")
    for seed in range(6):
        out = mx.mix(df, mx.cycle_weights, seed=seed).collect()
        assert len(out) == len(rows)
        for s in "ab":
            own = [r for r in out if r["sources"] == [s]]
            low = min(r["copies"] for r in own)
            gap = own[0]["target"] - sum(r["copies"] * r["size"] for r in own)
            assert -1 <= gap < min(r["size"] * (2 if r["id"] == 20_000 else 1) for r in own if r["copies"] == low) + 1
        assert len({r["copies"] for r in out if r["id"] == 20_000}) == 1


def test_fill_leaves_nothing_that_fits():
    assert mx.fill(1000, [(599, 5), (300, 1), (100, 9), (7, 1)]) == [(599, 1), (300, 1), (100, 1)]
    assert mx.fill(5, [(6, 3)]) == []


def test_any_number_of_sources(spark):
    docs = spark.range(45_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 37 % 50 + 1).cast("int")).alias("text"), F.concat(F.lit("h"), F.col("id") % 30_000).alias("source")
    )
    out = mx.mix(docs, mx.cycle_weights)
    sizes = {}
    for r in out.select("sources", "size", "source_size", "target").collect():
        sizes.setdefault(r["sources"][0], [0, r["source_size"], r["target"]])[0] += r["size"]
    names = sorted(sizes)
    want = mx.targets({s: sizes[s][0] for s in names}, mx.cycle_weights(names))
    assert len(names) == 30_000 and all(n == m and abs(t - want[s]) <= 1e-6 * want[s] for s, (n, m, t) in sizes.items())
    # Some sources overlap, most do not.
    several = docs.select("doc_id", "text", F.when(F.col("doc_id") < 10, F.array(F.lit("x"), F.lit("h3"))).otherwise(F.array("source")).alias("source"))
    assert mx.mix(several, mx.cycle_weights).filter("copies > 0 AND id < 10").count() > 0


def test_many_groups_of_overlapping_patterns(spark):
    """Groups are found by their shared sources and solved apart, in tasks; no number of patterns is refused."""
    rng = np.random.default_rng(8)
    patterns, quotas = {}, {}
    for g in range(200):
        names = [f"g{g}s{i}" for i in range(8)]
        quotas |= {n: float(rng.integers(0, 400)) for n in names}
        for _ in range(30):
            patterns[tuple(sorted(rng.choice(names, rng.integers(1, 4), replace=False).tolist()))] = int(rng.integers(0, 60))
    rows = spark.createDataFrame([(list(p), w) for p, w in patterns.items()] + [([], 5)], "sources array<string>, words long")
    quota = spark.createDataFrame([(n, 1, q) for n, q in quotas.items()], "name string, source_size long, target double")
    got = {tuple(r["sources"]): r["amount"] for r in mx.flown(rows, quota, True).collect()}
    assert got.pop(()) == 0 and set(got) == set(patterns)
    want = mx.flow(patterns, quotas)
    assert all(abs(got[p] - want[p]) < 1e-6 for p in patterns)
    assert len(patterns) > 4000


def test_a_source_of_its_own_gives_what_the_flow_says(spark):
    rows = spark.createDataFrame([(["a"], 10), ([None], 7), (["c"], 0), (["d"], 5)], "sources array<string>, words long")
    quota = spark.createDataFrame([("a", 10, 4.5), (None, 7, 30.0), ("c", 0, 0.0), ("d", 5, 12.25)], "name string, source_size long, target double")
    got = {r["sources"][0]: (r["amount"], r["source_size"], r["target"]) for r in mx.flown(rows, quota, False).collect()}
    assert got == {"a": (4.5, 10, 4.5), None: (21.0, 7, 30.0), "c": (0.0, 0, 0.0), "d": (12.25, 5, 12.25)}


def test_columns_named_like_inner_ones(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", "x", i) for i in range(4)], "doc_id long, text string, source string, _copies string, _times long")
    docs = docs.withColumns({c: F.lit("clash") for c in ("copies", "time", "c0", "c4", "id")})
    rows = mx.mix_documents(docs, mx.cycle_weights)
    assert rows.columns == docs.columns and rows.count() == 4 and {r["_times"] for r in rows.collect()} == {0, 1, 2, 3}
