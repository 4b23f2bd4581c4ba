"""Batch and streaming forms of the incremental jobs agree."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import incremental
from tracemill.operators.running import block_of
from tracemill.streaming.resume import append_results, resume_stream
from tracemill.streaming.triggers import Rule, arm_then_fire_stream, comparable, replay_rules_stream

RULES = [
    Rule("late", ["signup"], ["purchase"], 3), Rule("start", [], ["error"], 5), Rule("args", ["click"], [], 0, {"k": 2}),
    Rule("never", ["missing"], ["click"], 0), Rule("want", ["view"], ["click"], 1, {}, {"k": 1}),
]
CALLS = "run_id long, pos long, tool string, arguments string"


def make_calls():
    rnd = random.Random(9)
    tools = ["signup", "click", "view", "purchase", "error"]
    return [(run, i, rnd.choice(tools), '{"k": %d}' % rnd.randint(0, 2)) for run in range(6) for i in range(30)]


def test_stream_equals_batch(spark, tmp_path):
    calls = spark.createDataFrame(make_calls(), CALLS)
    one = [(run, r.event_id, list(r.activation_tools), str(r.activation_args).replace("'", '"'), list(r.fire_tools), str(r.fire_args).replace("'", '"'), r.delay) for run in range(6) for r in RULES]
    schema = "run_id long, event_id string, activation_tools array<string>, activation_args string, fire_tools array<string>, fire_args string, delay int"
    batch = incremental.arm_then_fire(spark.createDataFrame(one, schema), calls, block_of("pos", 8))
    want = {(r.run_id, r.event_id, r.armed_at, r.fired_at) for r in batch.filter("fired_at IS NOT NULL").collect()}
    assert want and not any(e == "never" for _, e, _, _ in want)
    # Chunks of four calls: the order within a micro-batch must not depend on them.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    for part in range(3):  # arrival in three files, in order
        calls.filter(F.floor(F.col("pos") / 10) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        arm_then_fire_stream(source, RULES).writeStream.format("memory").queryName("fired")
        .option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.run_id, r.event_id, r.armed_at, r.fired_at) for r in spark.table("fired").collect()}
    assert got == want


def replay(rules, calls):
    """The rules of one run played call by call: ``event_id -> (armed_at, fired_at)``."""
    state = {r["event_id"]: [0, 0, None] if not r["activation_tools"] else [None, None, None] for r in rules}
    history = 0

    def meets(tools, args, tool, given):
        return (not tools or tool in tools) and all(given.get(k) == v for k, v in args.items())

    for index, (tool, given, raised) in enumerate(calls, 1):
        ended = False
        for r in rules:
            s = state[r["event_id"]]
            if s[2] is None and s[0] is not None and history - s[1] >= r["delay"] and meets(r["fire_tools"], r["fire_args"], tool, given):
                s[2] = index
                if r["effect_type"] in (None, "error_with_state_update"):
                    ended = True
                    break
        history += ended or not raised
        if not ended and not raised:
            for r in rules:
                s = state[r["event_id"]]
                if s[0] is None and meets(r["activation_tools"], r["activation_args"], tool, given):
                    s[0], s[1] = index, history
    return {e: (s[0], s[2]) for e, s in state.items() if s[0] is not None}


def test_coupled_rules_match_a_replay(spark):
    """Random rules of both kinds, several on one tool, and calls that raise, against playing each run call by call."""
    rnd = random.Random(17)
    tools = ["signup", "click", "view", "purchase"]
    rule_rows, call_rows, want = [], [], set()
    for run in range(60):
        rules = []
        for place in range(rnd.randint(0, 5)):
            rules.append({
                "event_id": f"e{place}", "activation_tools": rnd.choice([[], [rnd.choice(tools)], rnd.sample(tools, 2)]), "activation_args": rnd.choice([{}, {"k": rnd.randint(0, 1)}]),
                "fire_tools": rnd.choice([[], ["purchase"], [rnd.choice(tools)]]), "fire_args": rnd.choice([{}, {}, {"k": rnd.randint(0, 1)}]), "delay": rnd.randint(-1, 4),
                "effect_type": rnd.choice([None, "error_with_state_update", "error_with_state_update", "state_update"]),
            })
        calls = [(rnd.choice(tools), {"k": rnd.randint(0, 1)}, rnd.random() < 0.4) for _ in range(rnd.randint(0, 25))]
        text = lambda d: str(d).replace("'", '"')
        rule_rows += [(run, r["event_id"], p, r["activation_tools"], text(r["activation_args"]), r["fire_tools"], text(r["fire_args"]), r["delay"], r["effect_type"]) for p, r in enumerate(rules)]
        call_rows += [(run, 10 * i, tool, text(given), raised) for i, (tool, given, raised) in enumerate(calls)]
        want |= {(run, e, a, f) for e, (a, f) in replay(rules, calls).items()}
    schema = "run_id long, event_id string, place int, activation_tools array<string>, activation_args string, fire_tools array<string>, fire_args string, delay int, effect_type string"
    rules = spark.createDataFrame(rule_rows, schema)
    calls = spark.createDataFrame(call_rows, CALLS + ", raised boolean")
    got = incremental.replay_rules(rules, calls, block_of("pos", 40))
    assert {tuple(r) for r in got.collect()} == want and sum(f is not None for _, _, _, f in want) > 40
    assert incremental.replay_rules(rules.limit(0), calls, block_of("pos")).count() == 0
    idle = incremental.replay_rules(rules, calls.limit(0), block_of("pos")).collect()
    assert all((r.armed_at, r.fired_at) == (0, None) for r in idle)


COUPLED = [
    Rule("late", ["signup"], ["purchase"], 2, ends=True), Rule("shadow", ["view"], ["purchase"], 1), Rule("start", [], ["error", "purchase"], 3, ends=True),
    Rule("args", ["click"], [], 0, {"k": 2}),
]


def test_ordered_stream_equals_batch(spark, tmp_path):
    """Calls out of order, two restarts from the checkpoint, one call too late; state shrinks to what still waits."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rnd = random.Random(23)
    schema = CALLS + ", raised boolean, at timestamp"
    rows = [(run, i, rnd.choice(["signup", "click", "view", "purchase", "error"]), '{"k": %d}' % rnd.randint(0, 2), rnd.random() < 0.3) for run in range(5) for i in range(30)]
    rules = [(run, r.event_id, p, list(r.activation_tools), str(r.activation_args).replace("'", '"'), list(r.fire_tools), "{}", r.delay, "error_with_state_update" if r.ends else "other") for run in range(5) for p, r in enumerate(COUPLED)]
    names = "run_id long, event_id string, place int, activation_tools array<string>, activation_args string, fire_tools array<string>, fire_args string, delay int, effect_type string"
    batch = incremental.replay_rules(spark.createDataFrame(rules, names), spark.createDataFrame(rows, CALLS + ", raised boolean"), block_of("pos"))
    want = sorted((r.run_id, r.event_id, r.armed_at, r.fired_at) for r in batch.collect() if r.fired_at is not None)
    source, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")

    def arrive(part):
        df = spark.createDataFrame(part, CALLS + ", raised boolean").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("pos") * 10))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = replay_rules_stream(stream, COUPLED, "at", "100 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return query.lastProgress

    parts = [[r for r in rows if r[1] // 10 == part] for part in range(3)]
    for part in parts:
        # Neighbours of up to nine positions change places, also over the border of two arrivals.
        part.sort(key=lambda r: r[1] + rnd.uniform(0, 9))
    moved = [r for r in parts[0] if r[1] in (8, 9)]
    arrive([r for r in parts[0] if r not in moved])
    arrive(moved + parts[1])
    arrive(parts[2])
    last = arrive([(99, 1000, "click", "{}", False), (0, 3, "purchase", "{}", False)])
    spark.conf.unset(provider)
    got = spark.read.parquet(out).collect()
    assert sorted((r.run_id, r.event_id, r.armed_at, r.fired_at) for r in got if r.kind == "fired") == want and len(want) > 10
    assert [(r.run_id, r.pos) for r in got if r.kind == "late"] == [(0, 3)]
    # A row of progress and at most one mark per rule and run, their timers, and the one call that still waits.
    held = sum(s["numRowsTotal"] for s in last["stateOperators"])
    assert 0 < held <= 6 * (1 + len(COUPLED) + 2) + 1


def test_resume_stream_is_exactly_once(spark, tmp_path):
    keys, source, out, ck = ["sample_id", "behavior"], tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "sample_id string, behavior string, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        query = append_results(resume_stream(stream, keys, unbounded_state=True), out, ck)
        assert query.awaitTermination(120)

    arrive([("a", "x", "1"), ("a", "y", "1"), ("a", "x", "1")])
    arrive([("a", "x", "2"), ("b", "x", "2")])
    got = sorted((r.sample_id, r.behavior, r.text) for r in spark.read.parquet(out).collect())
    assert got == [("a", "x", "1"), ("a", "y", "1"), ("b", "x", "2")]


def test_unbounded_state_is_asked_for(spark):
    with pytest.raises(ValueError, match="unbounded_state"):
        resume_stream(spark.createDataFrame([("a",)], "s string"), ["s"])


def test_arguments_compare_as_in_the_batch_form():
    assert comparable(1) == comparable(1.0) != comparable(True) and comparable({"b": 1, "a": 2}) == comparable({"a": 2, "b": 1})


def test_resume_batch(spark):
    work = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x")], "s string, b string")
    done = spark.createDataFrame([("b", "x")], "s string, b string")
    assert [tuple(r) for r in incremental.resume(work, done, ["s", "b"]).collect()] == [("a", "x")]
