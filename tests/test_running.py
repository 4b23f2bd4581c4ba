"""Blocked prefix operators against plain Python, with blocks far smaller than a key."""

import random

from pyspark.sql import functions as F

from tracemill.operators.running import block_of, first_per_key, running_before, with_position, with_previous


def skewed(seed, n=400):
    rnd = random.Random(seed)
    ids = rnd.sample(range(5000), n)
    return [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 9)}", i, rnd.randint(0, 9)) for i in ids]


def test_running_before_matches_python(spark):
    rows = skewed(1)
    df = spark.createDataFrame(rows, "k string, o long, v int")
    out = running_before(df, ["k"], ["o"], block_of("o", 64), sums={"s": F.col("v")}, maxes={"m": F.col("v")})
    got = {(r.k, r.o): (r.s, r.m) for r in out.collect()}
    for k, o, _ in rows:
        earlier = [v for kk, oo, v in rows if kk == k and oo < o]
        assert got[(k, o)] == (sum(earlier), max(earlier) if earlier else None)


def test_position_and_previous(spark):
    rows = skewed(2)
    df = spark.createDataFrame(rows, "k string, o long, v int")
    pos = {(r.k, r.o): r.position for r in with_position(df, ["k"], ["o"], block_of("o", 32)).collect()}
    prev = {(r.k, r.o): r.prev for r in with_previous(df, ["k"], "o", ["v"], where=F.col("v") > 3, width=32).collect()}
    for k, o, _ in rows:
        before = sorted((oo, v) for kk, oo, v in rows if kk == k and oo < o)
        assert pos[(k, o)] == len(before) + 1
        source = [x for x in before if x[1] > 3]
        assert (tuple(prev[(k, o)]) if prev[(k, o)] else None) == (source[-1] if source else None)


def test_global_position(spark):
    rows = skewed(3)
    df = spark.createDataFrame(rows, "k string, o long, v int")
    got = [r.o for r in with_position(df, [], ["o"], block_of("o", 100)).orderBy("position").collect()]
    assert got == sorted(o for _, o, _ in rows)


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert {tuple(r) for r in first_per_key(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", 5, "z")}
    assert {tuple(r) for r in first_per_key(df, ["k"], ["o"], last=True).collect()} == {("a", 2, "x"), ("b", 5, "z")}
