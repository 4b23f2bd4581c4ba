"""Blueprints, dialogues and packaging on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.operators import blueprints as bp
from tracemill.operators import dialogues as dg
from tracemill.operators import packaging as pk
from tracemill.operators.running import block_of


def test_turn_of_step_matches_groups(spark):
    cases = [(n, t) for n in range(0, 9) for t in range(1, 5)]
    rows = [(n, t, p) for n, t in cases for p in range(1, n + 1)]
    df = spark.createDataFrame(rows, "n int, t int, p int")
    got = {(r.n, r.t, r.p): r.turn for r in df.select("*", dg.turn_of_step(F.col("p"), F.col("n"), F.col("t")).alias("turn")).collect()}
    spans = spark.createDataFrame([(n, t, i) for n, t in cases for i in range(1, t + 1)], "n int, t int, i int")
    span = {(r.n, r.t, r.i): r.s for r in spans.select("*", dg.turn_span(F.col("i"), F.col("n"), F.col("t")).alias("s")).collect()}
    for n, t in cases:
        steps = list(range(1, n + 1))
        if n < t:
            groups = [[] for _ in range(t - n)] + [[s] for s in steps]
        else:
            base, extra, groups, at = n // t, n % t, [], 0
            for i in range(t):
                size = base + (i < extra)
                groups.append(steps[at : at + size])
                at += size
        for i, group in enumerate(groups, 1):
            assert all(got[(n, t, s)] == i for s in group)
            lo, hi = span[(n, t, i)]
            assert list(range(lo, hi + 1)) == group


@pytest.mark.parametrize("total", [1, 7, 50, 333])
def test_behavior_plan(spark, total):
    rnd = random.Random(total)
    rows = [(i, rnd.choice(fixed.DIALOGUE_MODES), rnd.choice(fixed.DIFFICULTY_BUCKETS)) for i in range(total)]
    df = spark.createDataFrame(rows, "o long, dialogue_mode string, difficulty_bucket string")
    got = {r.o: r.behavior_bundle for r in dg.plan_behaviors(df, "o", block_of("o", 16)).collect()}
    raw = {b: p * total for b, p in fixed.BEHAVIOR_PRIORS.items()}
    quota = {b: int(x) for b, x in raw.items()}
    spare = sorted(fixed.BEHAVIORS, key=lambda b: (raw[b] - quota[b], fixed.BEHAVIOR_PRIORS[b]), reverse=True)
    for b in spare[: total - sum(quota.values())]:
        quota[b] += 1
    sequence = [b for b in fixed.BEHAVIORS for _ in range(quota[b])]
    order = sorted(rows, key=lambda r: (r[1] != "multi_turn", {"hard": 0, "medium": 1, "easy": 2}[r[2]], r[0]))
    want = {r[0]: [b] for r, b in zip(order, sequence)}
    for r in order:
        second = fixed.SECONDARY_BEHAVIOR.get(want[r[0]][0])
        if r[1] == "multi_turn" and second:
            want[r[0]].append(second)
            break
    assert got == want and len(sequence) == total


def test_needles_with_one_prefix_have_few_candidates(spark):
    """Identifiers that share their beginning, and phrases of common words, are looked up by what sets them apart."""
    ids = spark.range(10_000).selectExpr("id AS nid", "concat('ORD-2024-', lpad(conv(id * 7919 + 13, 10, 36), 7, 'x')) AS needle")
    phrases = spark.range(300).selectExpr("id + 20000 AS nid", "concat('of the unit', id, ' and the rest') AS needle")
    needles = ids.union(phrases)
    texts = spark.range(3000).selectExpr("id", "concat('see ORD-2024-', lpad(conv((id * 3) * 7919 + 13, 10, 36), 7, 'x'), ' ORD-2024-none of the unit', id, ' and the rest') AS text")
    pairs = bp.containment_join(texts, needles, "id", "text", "nid", "needle").collect()
    assert {(r.id, r.nid) for r in pairs} == {(i, 3 * i) for i in range(3000)} | {(i, i + 20000) for i in range(300)}
    assert bp.anchored(texts, needles, "id", "text", "nid", "needle").count() <= 2 * len(pairs)


def test_containment_join_short_and_long(spark):
    rnd = random.Random(3)
    words = ["ab", "Cd", "e_1", "fg-2", "hij", "k"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 14)))) for i in range(60)]
    texts += [(60, "x\ny ab\tcd"), (61, "")]
    needles = [(0, "a"), (1, "AB"), (2, "d e"), (3, "b cd e"), (4, "ab cd e_1 fg"), (5, "hij k ab cd e_1 fg-2 hij"), (6, "k ab hij cd k hij ab k"), (7, " ")]
    needles += [(100 + i, " ".join(rnd.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 7, 8] * 4)]
    t = spark.createDataFrame(texts, "id int, text string")
    n = spark.createDataFrame(needles, "nid int, needle string")
    got = {(r.id, r.nid) for r in bp.containment_join(t, n, "id", "text", "nid", "needle").collect()}
    want = {(i, j) for i, x in texts for j, y in needles if y.strip() and y.strip().lower() in x.lower()}
    assert got == want


def test_validate_rewrite_reasons(spark):
    schema = "task string, turn_id int, user_message string"
    stable = spark.createDataFrame([(t, i, "m") for t in "abcdef" for i in (1, 2)], schema)
    new = [("a", 1, "x"), ("a", 2, "m"), ("b", 1, "x"), ("c", 1, "x"), ("c", 3, "y"), ("d", 1, "m"), ("d", 2, " m "), ("e", 1, " "), ("e", 2, "z"), ("f", 1, "q"), ("f", 2, "w")]
    leaks = spark.createDataFrame([("f", 2)], "task string, turn_id int")
    out = dg.validate_rewrite(stable, spark.createDataFrame(new, schema), leaks, "task")
    got = {r.task: r.reason for r in out.collect()}
    assert got["a"] is None and "count" in got["b"] and "turn_id" in got["c"] and "identical" in got["d"]
    assert got["e"] == "turn 1 has empty user_message" and got["f"] == "turn 2 leaks hidden tool names or identifiers"


def test_validate_dialogue_reasons(spark):
    tasks = spark.createDataFrame(
        [("ok", "multi_turn", 3), ("gap", "multi_turn", 3), ("order", "multi_turn", 2), ("none", "single_turn", 0), ("ids", "single_turn", 0), ("many", "single_turn", 0)],
        "task string, dialogue_mode string, step_count long",
    )
    turns = spark.createDataFrame(
        [("ok", 1, "a"), ("ok", 2, "b"), ("gap", 1, "a"), ("gap", 2, "b"), ("order", 1, "a"), ("order", 2, "b"), ("ids", 2, "a"), ("many", 1, "a"), ("many", 2, "b")],
        "task string, turn_id long, user_message string",
    )
    links = spark.createDataFrame(
        [("ok", 1, 1, 1), ("ok", 1, 2, 2), ("ok", 2, 1, 3), ("gap", 1, 1, 1), ("gap", 1, 2, 3), ("gap", 2, 1, 2), ("order", 1, 1, 2), ("order", 2, 1, 1)],
        "task string, turn_id long, link long, step_index long",
    )
    none = spark.createDataFrame([], "task string, turn_id long")
    got = {r.task: r.reason for r in dg.validate_dialogue(tasks, turns, links, none, "task").collect()}
    assert got["ok"] is None and "contiguous" in got["gap"] and "cover" in got["order"]
    assert "non-empty" in got["none"] and "turn_id" in got["ids"] and "exactly one" in got["many"]


def test_blueprint_rules(spark, tables):
    from tracemill.sources import tasks as src

    base = src.candidates(tables).filter("dialogue_mode = 'single_turn' AND env_id = '1-URGENT' AND goal_summary <> ' '").limit(1)
    task, env = base.select("task_id", "env_id").first()
    good = base.withColumn("user_request", F.lit("please help"))
    tools = src.known_tools(tables)

    def planned(*steps):
        rows = [(task, env, i, *s) for i, s in enumerate(steps, 1)]
        df = spark.createDataFrame(rows, "task_id long, env_id string, step long, tool_name string, arguments string")
        return bp.plan_facts(df, tools, "task_id", "env_id")

    ok = ("tool_1", "{}")
    cases = {
        None: {},
        "dialogue_mode must be single_turn or multi_turn": {"dialogue_mode": "'chat'"},
        "difficulty_bucket must be easy, medium, or hard": {"difficulty_bucket": "'epic'"},
        "task_type must be execute, clarify_then_execute, or refuse_or_scope": {"task_type": "'other'"},
        "tool_call_budget must be within 0-6": {"tool_call_budget": "'-1'"},
        "agent_action_budget must be within 1-50": {"agent_action_budget": "0"},
        "expected_phases must contain at least one non-empty item": {"expected_phases": "array(' ')"},
        "multi_turn_tasks must be a list for multi_turn tasks": {"dialogue_mode": "'multi_turn'"},
        "tool_plan step 1 uses unknown tool 'nope'": {"steps": [("nope", "{}")]},
        "tool_plan step 3 arguments must be an object": {"steps": [ok, ok, ("tool_1", "[1]"), ("nope", "{}")]},
        "tool_plan length must be within 0-6": {"steps": [ok] * 40},
        "tool_call_budget is smaller than the proposed tool plan length": {"tool_call_budget": "'0'"},
        "user_request leaks hidden tool names or identifiers": {"user_request": "'use TOOL_1 now'"},
    }
    for reason, change in cases.items():
        df = good.join(planned(*change.get("steps", [ok])), "task_id")
        for column, expr in change.items():
            if column != "steps":
                df = df.withColumn(column, F.expr(expr))
        assert bp.validate_blueprint(df).first().reason == reason


def test_micro_tasks_levels(spark):
    schema = (
        "task string, task_type string, goal_summary string, expected_final_outcome string, relevant_entities array<string>, "
        "micro_tasks array<struct<task_id:string,user_goal:string,task_type:string,expected_outcome:string>>, "
        "multi_turn_tasks array<struct<task_summary:string,expected_outcome:string,task_type:string>>"
    )
    rows = [
        ("own", "execute", "g", "o", None, [("m1", "goal", "", "out"), (None, " ", "x", "out"), (None, "g2", "x", "out")], None),
        ("turns", "execute", "g", "o", None, None, [("", "x", None), ("second", "y", None)]),
        ("goal", None, " g ", "o", None, [], [("", "", None)]),
    ]
    got = sorted((r.task, r.subtask, r.user_goal, r.kind) for r in bp.micro_tasks(spark.createDataFrame(rows, schema), "task").collect())
    assert got == [
        ("goal", "subtask_1", "g", "execute"), ("own", "m1", "goal", "execute"), ("own", "subtask_2", "g2", "x"), ("turns", "subtask_2", "second", "execute"),
    ]


def test_observation_failed(spark):
    df = spark.createDataFrame([('{"error": "x"}',), ('{"success": false}',), ('{"success": true}',), ('"text"',), (None,)], "o string")
    assert [r[0] for r in df.select(bp.observation_failed("o")).collect()] == [True, True, False, False, False]


def test_templates(spark):
    df = spark.createDataFrame([(" Do it. Now. ", ["fabricated_parameters", "goal_switching"]), ("", ["fabricated_parameters"])], "m string, b array<string>")
    first = df.select(dg.apply_templates("m", "b")).first()[0]
    assert first.startswith("I keep bouncing between tasks today. Do it. Now. If there is") and first.endswith("other thing matters.")
    spread = df.select(dg.expand_template("m", F.lit("underspecification"))).collect()
    assert [r[0] for r in spread] == ["Can you take care of this? Do it.", ""]


def test_empty_transcripts(spark):
    runs = spark.createDataFrame([("a",), ("b",)], "run string")
    turns = spark.createDataFrame([("a", i, "user" if i % 2 else " ", f"t{i}") for i in range(2500)], "run string, pos long, role string, content string")
    out = dg.format_transcript(turns, "run", "pos", "role", "content", block_of("pos", 100))
    got = {(r.run, r.part): r.transcript for r in dg.with_empty_transcripts(runs, out, "run").collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 0)} and got[("b", 0)] == "<empty transcript>"
    assert got[("a", 0)].startswith("1. unknown: t0\n2. user: t1") and got[("a", 2)].endswith("2500. user: t2499")


def test_packaging_pairs(spark, tables):
    from tracemill.plans import packaging_plans as pp

    rows, known = pp.dialogues(tables), pp.blueprints(tables)
    packed = pp.samples(tables)
    stable = packed.filter("variant = 'stable'")
    assert stable.count() == stable.select("task_id").distinct().count()
    unknown = pk.orphan_tasks(rows, known).count()
    assert unknown + packed.select("task_id").distinct().count() == rows.select("task_id").distinct().count()
    pairs = pp.pairs(tables).agg(F.sum("stable_count"), F.sum("unstable_count")).first()
    assert tuple(pairs) == (stable.count(), packed.filter("variant = 'unstable'").count())
