"""Trace matching and assertions against plain Python definitions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import matching as m
from tracemill.operators import state

TOOLS = ["a", "b", "c"]


def make_runs(seed, runs=25):
    rnd = random.Random(seed)
    nodes, calls = [], []
    for r in range(runs):
        run = f"r{r}"
        for i in range(rnd.randint(1, 5)):
            args = {} if rnd.random() < 0.5 else {"k": rnd.randint(0, 2)}
            nodes.append((run, i, i + 1, rnd.choice(["read", "write"]), rnd.choice(TOOLS), json.dumps(args)))
        for p in sorted(rnd.sample(range(1, 200), rnd.choice([0, 3, 12, 40]))):
            calls.append((run, p, rnd.choice(TOOLS), json.dumps({"k": rnd.randint(0, 2)})))
    return nodes, calls


def frames(spark, nodes, calls):
    n = spark.createDataFrame(nodes, "run_id string, node int, step_index int, role string, tool string, arguments string")
    c = spark.createDataFrame(calls, "run_id string, pos long, tool string, arguments string")
    return n, c


def test_greedy_assign(spark):
    nodes, calls = make_runs(7)
    n, c = frames(spark, nodes, calls)
    got = {(r.run_id, r.node): r.position for r in m.greedy_assign(n, m.candidate_matches(n, c), width=16).collect()}
    for run in {x[0] for x in nodes}:
        used = set()
        mine = sorted((x for x in nodes if x[0] == run), key=lambda x: (x[3] != "read", x[1]))
        for _, node, _, _, tool, args in mine:
            want = json.loads(args)
            fit = [
                p for r, p, t, a in calls
                if r == run and t == tool and p not in used and all(json.loads(a).get(k) == v for k, v in want.items())
            ]
            pick = min(fit) if fit else None
            used.add(pick)
            assert got[(run, node)] == pick
    placed = [(k[0], p) for k, p in got.items() if p is not None]
    assert len(placed) == len(set(placed))


@pytest.mark.parametrize("width", [4, 1000])
def test_ordered_name_match(spark, width):
    nodes, calls = make_runs(11, runs=40)
    n, c = frames(spark, nodes, calls)
    got = {(r.run_id, r.node): r.position for r in m.ordered_name_match(n, c, width=width).collect()}
    for run in {x[0] for x in nodes}:
        at = -1
        for _, node, _, _, tool, _ in sorted(x for x in nodes if x[0] == run):
            later = [p for r, p, t, _ in calls if r == run and t == tool and p > at]
            assert got[(run, node)] == (min(later) if later else None)
            at = min(later) if later else at


def test_block_results_meet_in_a_tree(spark, monkeypatch):
    """Few results a row and narrow blocks give the same matches; so do very many sparse blocks of one run."""
    monkeypatch.setattr(m, "FAN", 4)
    test_ordered_name_match(spark, 2)
    monkeypatch.setattr(m, "FAN", 1024)
    names = ["a", "b", "a", "c", "missing", "b"]
    n = spark.createDataFrame([("r", i, i + 1, t) for i, t in enumerate(names)], "run_id string, node int, step_index int, tool string")
    c = spark.range(200_000).select(F.lit("r").alias("run_id"), (F.col("id") * (1 << 21)).alias("pos"), F.when(F.col("id") % 50_000 == 7, "a").when(F.col("id") == 60_000, "b").when(F.col("id") == 190_000, "c").otherwise("b").alias("tool"))
    got = {r.node: r.position for r in m.ordered_name_match(n, c).collect()}
    assert got == {0: 7 << 21, 1: 8 << 21, 2: 50_007 << 21, 3: 190_000 << 21, 4: None, 5: 190_001 << 21}


def test_gold_trace_matches_itself(spark):
    nodes = [("r", i, i + 1, "write" if i % 2 else "read", "t", json.dumps({"i": i})) for i in range(6)]
    calls = [("r", i + 1, "t", json.dumps({"i": float(i)})) for i in range(6)]
    n, c = frames(spark, nodes, calls)
    got = {r.node: r.position for r in m.greedy_assign(n, m.candidate_matches(n, c)).collect()}
    assert got == {i: i + 1 for i in range(6)}


@pytest.mark.parametrize(
    "expected,actual,required,defaults,ok",
    [
        ({"a": 1}, {"a": 1.0}, ["a"], {}, True),
        ({"a": 1}, {"a": True}, ["a"], {}, False),
        ({"a": 1}, {}, ["a"], {}, False),
        ({}, {"a": 1}, ["a"], {}, False),
        ({"timestamp": 1}, {"timestamp": 2}, ["timestamp"], {}, True),
        ({"timestamp": 1}, {}, [], {}, False),
        ({"note": "x"}, {}, [], {}, True),
        ({"b": []}, {}, [], {}, True),
        ({"b": None}, {}, [], {}, True),
        ({"b": 5}, {}, [], {"b": 5.0}, True),
        ({"b": 5}, {}, [], {}, False),
        ({"b": {"x": 1, "y": 2}}, {"b": {"y": 2, "x": 1}}, [], {}, True),
        ({}, {"extra": 1}, [], {}, True),
    ],
)
def test_arguments_match(spark, expected, actual, required, defaults, ok):
    df = spark.createDataFrame(
        [(json.dumps(expected), json.dumps(actual), required, json.dumps(defaults))], "e string, a string, r array<string>, d string"
    )
    maps = df.select(m.argument_map("e").alias("e"), m.argument_map("a").alias("a"), "r", m.argument_map("d").alias("d"))
    got = maps.select(m.arguments_match(F.col("e"), F.col("a"), F.col("r"), F.col("d"))).first()[0]
    assert got is ok


def leaves(spark, docs, arrays=False):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "run_id string, doc string")
    return state.flatten_state(df, ["run_id"], "doc", expand_arrays=arrays)


@pytest.mark.parametrize(
    "expected,actual,ok",
    [
        ({"a": {"b": 1}}, {"a": {"b": 1.0, "c": 2}}, True),
        ({"a": {"b": 1}}, {"a": {}}, False),
        ({"a": {}}, {"a": {"b": 1}}, True),
        ({"a": {}}, {"a": 3}, False),
        ({"a": [1, {"x": 1}]}, {"a": [1, {"x": 1, "y": 2}]}, True),
        ({"a": [1]}, {"a": [1, 2]}, False),
        ({"a": {"timestamp": 1, "b": 2}}, {"a": {"timestamp": 9, "b": 2}}, True),
        ({"adherence_log": {"z": 1}}, {"other": 1}, True),
        ({"a": True}, {"a": "true"}, False),
    ],
)
def test_contained(spark, expected, actual, ok):
    e, a = leaves(spark, {"r": expected}, True), leaves(spark, {"r": actual}, True)
    assert m.contained(e, a, ["run_id"]).first()["contained"] is ok


def test_assertions(spark):
    before = leaves(spark, {"r": {"orders": {"o1": {"status": "new", "timestamp": 1}, "o2": {"status": "x"}}}})
    after = leaves(spark, {"r": {"orders": {"o1": {"status": "done", "timestamp": 5}, "o9": {"status": "new", "order_id": "o9", "qty": 1}}}})
    cases = [
        (1, "orders.o1.status", "changed", [([], "string", "done", "string", "new")], True),
        (2, "orders.o1.status", "changed", [([], "string", "other", "string", "new")], False),
        (3, "orders.o1.timestamp", "changed", [([], "number", "77.0", "number", "66.0")], True),  # soft: any change
        (4, "orders.o2", "removed", [(["status"], "string", "x", None, None)], True),
        (5, "orders.o1", "removed", [(["status"], "string", "new", None, None)], False),
        (6, "orders.o9", "added", [(["qty"], "number", "1.0", None, None)], True),
        # same entity under another generated id
        (7, "orders.o5", "added", [(["order_id"], "string", "o5", None, None), (["qty"], "number", "1.0", None, None)], True),
        (8, "orders.o5", "added", [(["qty"], "number", "2.0", None, None)], False),
        (9, "missing.path", "changed", [([], "string", "a", "string", "b")], False),
    ]
    base = spark.createDataFrame([("r", a, p, t) for a, p, t, _, _ in cases], "run_id string, assertion int, path string, assertion_type string")
    expected = spark.createDataFrame(
        [(a, *leaf) for a, _, _, rows, _ in cases for leaf in rows],
        "assertion int, rel_path array<string>, kind string, value string, old_kind string, old_value string",
    )
    got = {r.assertion: (r.passed, r.is_hard) for r in m.check_assertions(base, expected, before, after).collect()}
    assert {a: got[a][0] for a, *_ in cases} == {a: ok for a, *_, ok in cases}
    assert got[3][1] is False and got[1][1] is True


def test_forbidden_rules(spark):
    initial = leaves(
        spark,
        {"r": {
            "medications": {"m1": {"active_status": False}, "m2": {"active_status": True}},
            "reminders": {"x": {"user_id": "u", "medication_id": "m2", "status": "scheduled", "scheduled_time": "8am"}},
        }},
    )
    calls = spark.createDataFrame(
        [
            ("r", 1, "set_dose", True, '{"medication_id": "m1"}'),
            ("r", 2, "add_reminder", True, '{"user_id": "u", "medication_id": "m2", "scheduled_time": "8am"}'),
            ("r", 3, "read_dose", False, "{}"),
            ("r", 4, "drop_item", True, '{"item": " Lamp "}'),
        ],
        "run_id string, pos long, tool string, is_write boolean, arguments string",
    )
    wanted = {
        "Set dose with an inactive medication": True, "add_reminder with an inactive medication": False,
        "add reminder at a conflicting scheduled_time": True, "read_dose": False, "drop item on lamp": True,
        "drop_item on chair": False, "drop_item": True, "drop_item sometimes": False, "": False,
    }
    rules = spark.createDataFrame([("r", x) for x in wanted], "run_id string, rule string")
    hit = {r.rule for r in m.forbidden_hits(rules, calls, initial).collect()}
    assert hit == {k for k, v in wanted.items() if v}


def test_write_verb(spark):
    df = spark.createDataFrame([("Cancel_order",), ("get_order",), ("bulk__update_set",)], "t string")
    assert [r[0] for r in df.select(m.write_verb("t")).collect()] == ["cancel", "", "update"]


def check_one(spark, before, after, asserted):
    """Assertions of the diff between ``before`` and ``asserted`` judged on ``before`` and ``after``."""
    import json

    from tracemill.operators import state

    def flat(doc):
        df = spark.createDataFrame([("r", json.dumps(doc))], "run_id string, doc string")
        return state.flatten_state(df, ["run_id"], "doc")

    header, expected = state.assertion_tables(state.diff_leaves(flat(before), flat(asserted), ["run_id"]), ["run_id"])
    return {r.path: r.passed for r in m.check_assertions(header, expected, flat(before), flat(after)).collect()}


def test_assertions_compare_whole_values(spark):
    before = {"o": {"a": {"s": "x"}, "n": 1}}
    grown = {"o": {"a": {"s": "x"}, "n": 1, "b": {"k": "v", "tags": {}}}}
    filled = {"o": {"a": {"s": "x"}, "n": 1, "b": {"k": "v", "tags": {"t": 1}}}}
    assert check_one(spark, before, grown, grown) == {"o.b": True}
    assert check_one(spark, before, filled, grown) == {"o.b": True}  # an empty object that was filled later
    assert check_one(spark, before, before, grown) == {"o.b": False}
    opened = {"o": {"a": {"s": "x"}, "n": {"u": 1, "v": 2}}}
    assert check_one(spark, before, opened, opened) == {"o.n": True}  # a plain value became an object
    more = {"o": {"a": {"s": "x"}, "n": {"u": 1, "v": 2, "w": 3}}}
    assert check_one(spark, before, more, opened) == {"o.n": False}  # with another key it is not the asserted one
    closed = {"o": {"a": "gone", "n": 1}}
    assert check_one(spark, before, closed, closed) == {"o.a": True}
    assert check_one(spark, before, {"o": {"n": 1}}, {"o": {"n": 1}}) == {"o.a": True}


def test_two_schemas_for_one_tool_are_refused(spark):
    import pytest

    rows = [("r", "t", ["a"], {}), ("r", "t", [], {})]
    schemas = spark.createDataFrame(rows, "run_id string, tool string, required array<string>, defaults map<string,string>")
    nodes = spark.createDataFrame([("r", 1, 1, "read", "t", "{}")], "run_id string, node int, step_index int, role string, tool string, arguments string")
    calls = spark.createDataFrame([("r", 1, "t", "{}")], "run_id string, pos long, tool string, arguments string")
    with pytest.raises(Exception, match="two schemas"):
        m.candidate_matches(nodes, calls, schemas).collect()


def test_doubled_candidates_do_not_starve_later_nodes(spark):
    nodes = spark.createDataFrame([("r", i, i, "read", "t") for i in (1, 2)], "run_id string, node int, step_index int, role string, tool string")
    found = spark.createDataFrame([("r", 1, 3), ("r", 2, 3), ("r", 2, 3), ("r", 2, 6)], "run_id string, node int, pos long")
    assert {r.node: r.position for r in m.greedy_assign(nodes, found).collect()} == {1: 3, 2: 6}
