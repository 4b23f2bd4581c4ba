"""Scoring queries: events as recorded calls, orders as state, customers as samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.functions import text as tx
from tracemill.operators import blueprints, matching, scoring, state
from tracemill.plans import sqltext as q
from tracemill.plans.registry import plan
from tracemill.plans.state_plans import DIFF_CTE, order_diff
from tracemill.sources import bridge, gold
from tracemill.sources.stages import stored
from tracemill.sources.tables import Tables

CALLS = """calls AS (SELECT user_id AS run_id, event_id AS pos, event_type AS tool,
  CASE WHEN event_type = 'view' THEN 'respond' ELSE 'tool' END AS kind,
  event_type IN ('signup', 'purchase') AS is_write, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"""
GREEDY = f"""{CALLS}, runs AS (SELECT DISTINCT run_id FROM calls),
r2 AS (SELECT run_id, min(pos) AS p2 FROM calls WHERE tool = 'click' GROUP BY run_id),
r4 AS (SELECT run_id, min(pos) AS p4 FROM calls LEFT JOIN r2 USING (run_id) WHERE tool = 'click' AND pos > p2 GROUP BY run_id),
w1 AS (SELECT run_id, min(pos) AS p1 FROM calls WHERE tool = 'signup' GROUP BY run_id),
w3 AS (SELECT run_id, min(pos) AS p3 FROM calls WHERE tool = 'purchase' AND k = 42 GROUP BY run_id),
w5 AS (SELECT run_id, min(pos) AS p5 FROM calls LEFT JOIN w3 USING (run_id) WHERE tool = 'purchase' AND pos IS DISTINCT FROM p3 GROUP BY run_id),
wide AS (SELECT run_id, p1, p2, p3, p4, p5 FROM runs LEFT JOIN r2 USING (run_id) LEFT JOIN r4 USING (run_id)
  LEFT JOIN w1 USING (run_id) LEFT JOIN w3 USING (run_id) LEFT JOIN w5 USING (run_id)),
assigned AS (SELECT run_id, 1 AS step_index, 'write' AS role, 'signup' AS tool, p1 AS position FROM wide
  UNION ALL SELECT run_id, 2, 'read', 'click', p2 FROM wide UNION ALL SELECT run_id, 3, 'write', 'purchase', p3 FROM wide
  UNION ALL SELECT run_id, 4, 'read', 'click', p4 FROM wide UNION ALL SELECT run_id, 5, 'write', 'purchase', p5 FROM wide)"""
ORDERED = """n1 AS (SELECT run_id, min(pos) AS q1 FROM calls WHERE tool = 'signup' GROUP BY run_id),
n3 AS (SELECT run_id, min(pos) AS q3 FROM calls LEFT JOIN n1 USING (run_id) WHERE tool = 'purchase' AND pos > coalesce(q1, -1) GROUP BY run_id),
n5 AS (SELECT run_id, min(pos) AS q5 FROM calls LEFT JOIN n1 USING (run_id) LEFT JOIN n3 USING (run_id)
  WHERE tool = 'purchase' AND pos > coalesce(q3, q1, -1) GROUP BY run_id),
nw AS (SELECT run_id, q1, q3, q5 FROM runs LEFT JOIN n1 USING (run_id) LEFT JOIN n3 USING (run_id) LEFT JOIN n5 USING (run_id)),
named AS (SELECT run_id, 1 AS step_index, 'signup' AS tool, q1 AS position FROM nw
  UNION ALL SELECT run_id, 3, 'purchase', q3 FROM nw UNION ALL SELECT run_id, 5, 'purchase', q5 FROM nw)"""
EDGES = """edges AS (SELECT run_id, 1 AS before_step, 2 AS after_step, p1 AS before_position, p2 AS after_position FROM wide
  UNION ALL SELECT run_id, 2, 3, p2, p3 FROM wide UNION ALL SELECT run_id, 3, 4, p3, p4 FROM wide
  UNION ALL SELECT run_id, 4, 5, p4, p5 FROM wide),
checked_edges AS (SELECT *, coalesce(before_position < after_position, false) AS satisfied FROM edges)"""
C = f"TIMESTAMP '{bridge.CUTOFF}'"
ASSERTS = f"""o AS (SELECT o_custkey AS run_id, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS pr, o_totalprice AS tp,
    o_orderdate < {C} AS old FROM orders),
asserted AS (SELECT run_id, k AS assertion, 'orders.' || k || '.status' AS path, 'changed' AS assertion_type, s = 'P' AS passed
    FROM o WHERE old AND (s = 'P' OR (s = 'O' AND tp > 450000))
  UNION ALL SELECT run_id, k, 'orders.' || k, 'removed', true FROM o WHERE old AND s = 'F'
  UNION ALL SELECT run_id, k, 'orders.' || k, 'added', s = 'O' OR EXISTS (SELECT 1 FROM o x WHERE x.run_id = o.run_id
      AND NOT x.old AND x.s = 'O' AND x.pr = o.pr) FROM o WHERE NOT old AND tp > 400000)"""
DIFF_OK = f"""need AS (SELECT o_custkey AS run_id, o_orderstatus AS s FROM orders WHERE o_orderdate < {C}
    AND (o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_totalprice > 480000))),
diff_ok AS (SELECT run_id, bool_and(s = 'P') AS contained FROM need GROUP BY run_id)"""
REPLIES = """seen AS (SELECT run_id, min(pos) FILTER (kind = 'respond') AS first_reply,
    min(pos) FILTER (kind = 'tool' AND is_write) AS first_write FROM calls GROUP BY run_id)"""
FORBID = """broken AS (SELECT DISTINCT run_id, 'Purchase on 7' AS rule, 'purchase' AS tool FROM calls WHERE tool = 'purchase' AND k = 7
  UNION ALL SELECT DISTINCT run_id, 'signup on 42', 'signup' FROM calls WHERE tool = 'signup' AND k = 42)"""
BEHAVIOR = "CASE c_mktsegment " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in gold.SEGMENT_BEHAVIOR.items()
) + " END"
SAMPLES = f"""samples AS (SELECT c_custkey AS run_id, n_name AS env_id, CASE WHEN c_nationkey >= 13 THEN 'unstable' ELSE 'stable' END AS variant,
  CASE WHEN c_acctbal < 2000 THEN 'easy' WHEN c_acctbal < 6000 THEN 'medium' ELSE 'hard' END AS difficulty_bucket,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'unknown' ELSE 'execute' END AS task_type,
  CAST(floor(c_acctbal / 500) AS INT) AS given_turns,
  CASE WHEN c_nationkey < 13 THEN [] WHEN c_acctbal < 0 THEN [{BEHAVIOR}, {BEHAVIOR}] ELSE [{BEHAVIOR}] END AS behaviors,
  CASE WHEN c_nationkey >= 13 THEN ['{fixed.PROFILE_BUNDLE}'] ELSE [] END AS profiles,
  CASE WHEN c_nationkey >= 13 THEN {BEHAVIOR} ELSE 'unknown' END AS unstable_behavior,
  c_nationkey >= 13 AS clarify, c_mktsegment = 'BUILDING' AS refuse,
  greatest(least(CAST(trunc(round(c_acctbal / 2000, 2)) AS INT), 4), 0) AS faithfulness_score,
  greatest(least(c_nationkey, 3), 0) AS clarification_score,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS tool_discipline_score
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
TURNS = """spoken AS (SELECT conv_id AS run_id, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY conv_id),
acted AS (SELECT run_id, count(*) FILTER (kind = 'respond') AS replies, count(*) FILTER (kind = 'tool') AS tools,
  count(*) FILTER (kind = 'tool' AND is_write) AS writes FROM calls GROUP BY run_id)"""
H = {k: q.quote(v) for k, v in fixed.HARD_FAILURES.items()}
X = {k: q.quote(v) for k, v in fixed.RELAXED_FAILURES.items()}
COMPLETION = f"""{GREEDY}, {ORDERED}, {EDGES}, {ASSERTS}, {DIFF_OK}, {REPLIES}, {FORBID}, {SAMPLES}, {TURNS},
a1 AS (SELECT run_id, count(*) AS assertion_total, count(*) FILTER (passed) AS assertion_passed FROM asserted GROUP BY run_id),
f1 AS (SELECT run_id, list(format('forbidden action matched executed write tool ''{{}}'': {{}}', tool, rule) ORDER BY rule) AS forbidden FROM broken GROUP BY run_id),
e1 AS (SELECT run_id, count(*) AS edge_total, count(*) FILTER (satisfied) AS edge_ok FROM checked_edges GROUP BY run_id),
base AS (SELECT s.*, w.run_id IS NOT NULL AS ran, p1, p2, p3, p4, p5, q1, q3, q5, coalesce(edge_total, 0) AS edge_total, coalesce(edge_ok, 0) AS edge_ok,
  coalesce(assertion_total, 0) AS assertion_total, coalesce(assertion_passed, 0) AS assertion_passed,
  coalesce(contained, true) AS diff_passed, coalesce(forbidden, []) AS forbidden, first_reply, first_write,
  coalesce(user_turns, 0) AS user_turns, coalesce(replies, 0) AS replies, coalesce(tools, 0) AS tools, coalesce(writes, 0) AS writes
  FROM samples s LEFT JOIN wide w USING (run_id) LEFT JOIN nw USING (run_id) LEFT JOIN e1 USING (run_id) LEFT JOIN a1 USING (run_id)
  LEFT JOIN diff_ok USING (run_id) LEFT JOIN f1 USING (run_id) LEFT JOIN seen USING (run_id) LEFT JOIN spoken USING (run_id) LEFT JOIN acted USING (run_id)),
flags AS (SELECT *, NOT clarify OR (first_reply IS NOT NULL AND (first_write IS NULL OR first_reply < first_write)) AS clarification_satisfied,
  NOT refuse OR first_reply IS NOT NULL AS refusal_satisfied FROM base),
completion AS (SELECT *, list_concat(list_filter([
    CASE WHEN ran AND (p2 IS NULL OR p4 IS NULL) THEN {H['read']} END,
    CASE WHEN ran AND (p1 IS NULL OR p3 IS NULL OR p5 IS NULL) THEN {H['write']} END,
    CASE WHEN ran AND (q1 IS NULL OR q3 IS NULL OR q5 IS NULL) THEN {H['write_name']} END,
    CASE WHEN edge_ok < edge_total THEN {H['order']} END,
    CASE WHEN assertion_passed < assertion_total THEN {H['state']} END,
    CASE WHEN assertion_passed < assertion_total THEN {H['critical_state']} END,
    CASE WHEN NOT diff_passed THEN {H['diff']} END,
    CASE WHEN NOT clarification_satisfied THEN {H['clarify']} END,
    CASE WHEN NOT refusal_satisfied THEN {H['refuse']} END], lambda x: x IS NOT NULL), forbidden) AS hard_failures FROM flags),
relaxed AS (SELECT *, len(hard_failures) = 0 AS semantic_success, list_filter([
    CASE WHEN assertion_passed < assertion_total THEN {X['state']} END, CASE WHEN NOT diff_passed THEN {X['diff']} END,
    CASE WHEN len(forbidden) > 0 THEN {X['forbidden']} END], lambda x: x IS NOT NULL) AS relaxed_failures FROM completion),
scored AS (SELECT *, len(relaxed_failures) = 0 AS relaxed_success, len(relaxed_failures) = 0 AND NOT semantic_success AS recovered,
  user_turns + replies + tools AS total_action_turns,
  CASE WHEN given_turns > 0 THEN given_turns ELSE user_turns + CASE WHEN ran THEN 5 ELSE 0 END + 1 END AS min_turns,
  0.4::DOUBLE * (faithfulness_score / 4.0::DOUBLE) + 0.3::DOUBLE * (clarification_score / 3.0::DOUBLE) + 0.3::DOUBLE * (tool_discipline_score / 3.0::DOUBLE) AS reliability,
  CASE WHEN ran THEN NULL ELSE 'no recorded run' END AS run_error FROM relaxed),
score_rows AS (SELECT *, CASE WHEN total_action_turns <= 0 OR min_turns <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, min_turns::DOUBLE / total_action_turns) END AS efficiency FROM scored)"""
MEANS = """count(*) AS sample_count, avg(relaxed_success::INT::DOUBLE) AS success_rate, avg(relaxed_success::INT::DOUBLE) AS sr,
  avg(relaxed_success::INT::DOUBLE) AS completion_rate, avg(semantic_success::INT::DOUBLE) AS semantic_success_rate,
  avg(semantic_success::INT::DOUBLE) AS strict_success_rate, avg(efficiency) AS avg_efficiency,
  avg(CASE WHEN semantic_success THEN efficiency ELSE 0 END) AS avg_task_score, avg(reliability) AS avg_reliability,
  avg(faithfulness_score) AS avg_faithfulness_score, avg(clarification_score) AS avg_clarification_score,
  avg(tool_discipline_score) AS avg_tool_discipline_score, avg(faithfulness_score) / 4 AS avg_faithfulness_norm,
  avg(clarification_score) / 3 AS avg_clarification_norm, avg(tool_discipline_score) / 3 AS avg_tool_discipline_norm,
  count(run_error) AS run_error_count"""
SUMMARY_NAMES = [
    "sample_count", "success_rate", "sr", "completion_rate", "semantic_success_rate", "strict_success_rate",
    *scoring.MEASURES, "avg_faithfulness_norm", "avg_clarification_norm", "avg_tool_discipline_norm", "run_error_count",
]
COUNTS = ("sample_count", "run_error_count")
ROUNDED = ", ".join(n if n in COUNTS else f"round({n}, 6) AS {n}" for n in SUMMARY_NAMES)
SCALARS = {
    "variant": "variant", "difficulty": "difficulty_bucket", "task_type": "task_type", "user_turns": "user_turn_count",
    "min_turns": "min_required_action_turns", "unstable_behavior": "unstable_behavior", "env": "env_id",
}
ARRAYS = {"behavior": "behavior_bundle", "profile": "profile_bundle"}
FANNED = """fanned AS (SELECT *, unnest(list_concat([{'d': 'overall', 'k': 'all'}, {'d': 'variant', 'k': variant},
    {'d': 'difficulty', 'k': difficulty_bucket}, {'d': 'task_type', 'k': task_type}, {'d': 'user_turns', 'k': user_turns::VARCHAR},
    {'d': 'min_turns', 'k': min_turns::VARCHAR}, {'d': 'unstable_behavior', 'k': unstable_behavior}, {'d': 'env', 'k': env_id}],
    list_transform(behaviors, lambda b: {'d': 'behavior', 'k': b}), list_transform(profiles, lambda b: {'d': 'profile', 'k': b}))) AS dk FROM score_rows)"""


def assigned(t: Tables) -> DataFrame:
    nodes = gold.nodes(t)
    return matching.greedy_assign(nodes, matching.candidate_matches(nodes, gold.calls(t)))


def named(t: Tables) -> DataFrame:
    return matching.ordered_name_match(gold.nodes(t).filter("role = 'write'"), gold.calls(t))


def asserted(t: Tables) -> DataFrame:
    base, expected = gold.assertions(t)
    return matching.check_assertions(base, expected, bridge.state_before(t), bridge.state_after(t), empty_objects=False)


def diff_ok(t: Tables) -> DataFrame:
    made = order_diff(t).filter("op = 'changed'").select(
        "run_id", "path", F.lit("string").alias("kind"), F.col("new_value").alias("value")
    )
    return matching.contained(gold.expected_diff(t), made, ["run_id"], empty_objects=False)


def replies(t: Tables) -> DataFrame:
    needs = gold.samples(t).select("run_id", "clarify", "refuse")
    seen = matching.reply_rules(gold.calls(t), F.lit(True), F.lit(True), F.lit(True)).select(
        "run_id", F.col("clarification_satisfied").alias("_c"), F.col("refusal_satisfied").alias("_r")
    )
    joined = needs.join(seen, "run_id", "left").fillna(False, ["_c", "_r"])
    return joined.select(
        "run_id",
        (~F.col("clarify") | F.col("_c")).alias("clarification_satisfied"),
        (~F.col("refuse") | F.col("_r")).alias("refusal_satisfied"),
    )


def completion(t: Tables, runs: DataFrame | None = None) -> DataFrame:
    """Completion rows; every judgement is a stored step of few columns, so no plan holds all of them."""
    calls = gold.calls(t)
    nodes = gold.nodes(t)
    given = stored(matching.greedy_assign(nodes, matching.candidate_matches(nodes, calls)), "given")
    names = matching.ordered_name_match(nodes.filter("role = 'write'"), calls).select("run_id", "position")
    edges = matching.check_precedence(gold.edges(t), given).select("run_id", "satisfied")
    return scoring.completion_rows(
        gold.samples(t).drop("clarify", "refuse") if runs is None else runs,
        given,
        stored(names, "named"),
        stored(edges, "ordered"),
        stored(asserted(t).select("run_id", "is_hard", "passed"), "asserted"),
        stored(diff_ok(t), "diff_ok"),
        stored(replies(t), "replies"),
        stored(matching.forbidden_hits(gold.rules(t), calls), "forbidden"),
    )


def run_facts(t: Tables) -> DataFrame:
    """Samples with their judge scores, turn counts and run error."""
    transcript = t.conversations.select(F.col("conv_id").alias("run_id"), "role")
    counts = scoring.turn_counts(transcript, gold.calls(t))
    zero = dict.fromkeys(["user_turn_count", "response_count", "tool_call_count", "write_call_count"], 0)
    judged = scoring.reliability(gold.samples(t).drop("clarify", "refuse"), "payload")
    judged = judged.withColumn("variant", scoring.normalize_variant("variant"))
    ran = gold.calls(t).select("run_id").distinct()
    return scoring.with_run_errors(judged.join(counts, "run_id", "left"), ran, zero, "no recorded run")


def score_rows(t: Tables) -> DataFrame:
    """Full score row per sample: completion, efficiency, reliability, relaxed success, failure mode."""
    rows = completion(t, stored(run_facts(t), "run_facts"))
    steps = F.col("read_total") + F.col("write_total")
    rows = rows.withColumns(
        {
            "min_required_action_turns": blueprints.min_action_turns(F.col("given_turns"), F.col("user_turn_count"), steps),
            "strict_success": F.col("semantic_success"),
        }
    )
    rows = scoring.efficiency(
        rows, "min_required_action_turns", "user_turn_count", "response_count", "tool_call_count", F.col("semantic_success")
    )
    return scoring.failure_mode(scoring.relaxed_success(rows))


@plan(
    "r1_select_samples",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'N'
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 500""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_returnflag") == "N", "collab").otherwise("noncollab").alias("variant"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
    )
    return scoring.select_samples(rows, "ord", variant="noncollab", max_samples=500).drop("variant", "ord")


@plan(
    "r2_attach_runtime",
    """SELECT l_orderkey AS task_id, l_linenumber, o_orderpriority AS env_id, o_orderkey IS NOT NULL AS runtime_found
    FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON l_orderkey = o_orderkey""",
)
def _(t: Tables) -> DataFrame:
    samples = t.lineitem.select(F.col("l_orderkey").alias("task_id"), "l_linenumber")
    tasks = t.orders.filter("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("env_id"), F.col("o_orderdate").alias("ord")
    )
    return scoring.attach_runtime(samples, tasks, "ord")


@plan(
    "r2_missing_runtime",
    """SELECT l_orderkey AS task_id, count(*) AS samples FROM lineitem WHERE l_orderkey NOT IN
    (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    tasks = t.orders.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lost = t.lineitem.select("l_orderkey").join(tasks, "l_orderkey", "left_anti")
    return lost.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count(F.lit(1)).alias("samples"))


@plan(
    "r3_values_equivalent",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) = value OR json_extract(props, '$.k')::INT = round(value) AS same FROM events""",
)
def _(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    as_float = F.concat(k, F.lit(".0"))
    nearest = F.to_json(F.struct(F.round("value").alias("v")))
    return t.events.select(
        "event_id",
        (
            matching.values_equivalent(F.concat(F.lit('{"v":'), as_float, F.lit("}")), F.to_json(F.struct(F.col("value").alias("v"))))
            | matching.values_equivalent(as_float, F.get_json_object(nearest, "$.v"))
        ).alias("same"),
    )


@plan(
    "r4_contains_semantic",
    f"WITH {DIFF_OK} SELECT run_id, contained FROM diff_ok",
)
def _(t: Tables) -> DataFrame:
    return diff_ok(t)


@plan(
    "r5_arguments_match",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) = CAST(floor(value) AS INT) AS matched FROM events""",
)
def _(t: Tables) -> DataFrame:
    expected = F.concat(
        F.lit('{"note": "x", "timestamp": 1, "tags": [], "limit": 50, "k": '), F.floor("value").cast("string"), F.lit("}")
    )
    actual = F.concat(F.lit('{"timestamp": 2, "k": '), F.get_json_object("props", "$.k"), F.lit(".0}"))
    required = F.array(F.lit("k"), F.lit("timestamp"))
    defaults = matching.argument_map(F.lit('{"limit": 50.0}'))
    maps = t.events.select(
        "event_id", matching.argument_map(expected).alias("e"), matching.argument_map(actual).alias("a"), defaults.alias("d")
    )
    return maps.select(
        "event_id", matching.arguments_match(F.col("e"), F.col("a"), required, F.col("d")).alias("matched")
    )


@plan(
    "r6_candidate_matches",
    f"""WITH {CALLS} SELECT run_id, 1 AS step_index, pos FROM calls WHERE tool = 'signup'
    UNION ALL SELECT run_id, 2, pos FROM calls WHERE tool = 'click' UNION ALL SELECT run_id, 4, pos FROM calls WHERE tool = 'click'
    UNION ALL SELECT run_id, 3, pos FROM calls WHERE tool = 'purchase' AND k = 42 UNION ALL SELECT run_id, 5, pos FROM calls WHERE tool = 'purchase'""",
)
def _(t: Tables) -> DataFrame:
    return matching.candidate_matches(gold.nodes(t), gold.calls(t)).select("run_id", "step_index", "pos")


# Two environments with one tool name: only in one of them must ``k`` be given and agree.
SCHEMA_CTE = f"""{CALLS}, own AS (SELECT DISTINCT run_id, run_id % 2 = 0 AS strict FROM calls),
wrote AS (SELECT run_id, pos, k, k >= 50 AS effect FROM calls WHERE tool = 'purchase')"""


def _strict_nodes(t: Tables) -> DataFrame:
    """Per run: a write with ``k`` = 42 that must have an effect (1), and a read met by either of two tools (2)."""
    listed = F.array(
        *[
            F.struct(F.lit(n).alias("node"), F.lit(n).alias("step_index"), F.lit(r).alias("role"), F.lit(x).alias("tool"), F.lit(a).alias("arguments"))
            for n, r, x, a in ((1, "write", "purchase", '{"limit": []}'), (2, "read", "view", "{}"), (2, "read", "click", "{}"))
        ]
    )
    runs = t.events.select(F.col("user_id").alias("run_id")).distinct()
    return runs.select("run_id", F.explode(listed).alias("_i")).select("run_id", "_i.*")


def _run_schemas(t: Tables) -> DataFrame:
    """Even runs require ``limit``, which no call gives; odd ones do not."""
    runs = t.events.select(F.col("user_id").alias("run_id")).distinct()
    required = F.when(F.col("run_id") % 2 == 0, F.array(F.lit("limit"))).otherwise(F.array().cast("array<string>"))
    return runs.select("run_id", F.lit("purchase").alias("tool"), required.alias("required"), F.create_map().cast("map<string,string>").alias("defaults"))


def _strict_candidates(t: Tables) -> DataFrame:
    """Purchases with ``k`` of 50 and more change the state, others do nothing."""
    path = F.array(F.lit("orders"), F.lit("last"))
    wanted = _strict_nodes(t).filter("node = 1").select(
        "run_id", "node", path.alias("path"), F.lit("changed").alias("op"), F.lit("O").alias("old_value"), F.lit("P").alias("new_value")
    )
    calls = gold.calls(t)
    effect = (F.col("tool") == "purchase") & (F.get_json_object("arguments", "$.k").cast("int") >= 50)
    shown = calls.filter(effect).select(
        "run_id", "pos", path.alias("path"), F.lit("changed").alias("op"), F.lit("O").alias("old_value"), F.lit("P").alias("new_value")
    )
    return matching.candidate_matches(
        _strict_nodes(t), calls, _run_schemas(t), matching.diff_facts(wanted, ["run_id", "node"]), matching.diff_facts(shown, ["run_id", "pos"])
    )


@plan(
    "r6_schema_and_diff",
    f"""WITH {SCHEMA_CTE} SELECT run_id, 1 AS node, 'purchase' AS tool, pos FROM wrote JOIN own USING (run_id) WHERE NOT strict AND effect
    UNION ALL SELECT run_id, 2, tool, pos FROM calls WHERE tool IN ('view', 'click')""",
)
def _(t: Tables) -> DataFrame:
    return _strict_candidates(t).select("run_id", "node", "tool", "pos")


@plan(
    "r7_alternatives",
    f"""WITH {SCHEMA_CTE}, a AS (SELECT run_id, min(pos) AS p1 FROM wrote JOIN own USING (run_id) WHERE NOT strict AND effect GROUP BY run_id),
    b AS (SELECT run_id, min(pos) AS p2 FROM calls WHERE tool IN ('view', 'click') GROUP BY run_id)
    SELECT run_id, 1 AS node, 'write' AS role, 'purchase' AS tool, p1 AS position FROM own LEFT JOIN a USING (run_id)
    UNION ALL SELECT run_id, 2, 'read', 'click', p2 FROM own LEFT JOIN b USING (run_id)""",
)
def _(t: Tables) -> DataFrame:
    return matching.greedy_assign(_strict_nodes(t), _strict_candidates(t)).select("run_id", "node", "role", "tool", "position")


@plan("r7_greedy_assign", f"WITH {GREEDY} SELECT run_id, step_index, role, tool, position FROM assigned")
def _(t: Tables) -> DataFrame:
    return assigned(t).drop("node")


@plan("r8_ordered_name_match", f"WITH {GREEDY}, {ORDERED} SELECT run_id, step_index, tool, position FROM named")
def _(t: Tables) -> DataFrame:
    return named(t).drop("node")


@plan(
    "r9_check_precedence",
    f"WITH {GREEDY}, {EDGES} SELECT run_id, before_step, after_step, before_position, after_position, satisfied FROM checked_edges",
)
def _(t: Tables) -> DataFrame:
    return matching.check_precedence(gold.edges(t), assigned(t))


@plan(
    "r10_check_assertions",
    f"WITH {ASSERTS} SELECT run_id, assertion, path, assertion_type, true AS is_hard, passed FROM asserted",
)
def _(t: Tables) -> DataFrame:
    return asserted(t)


@plan(
    "r10_diff_against_itself",
    f"""WITH {DIFF_CTE} SELECT run_id, path, op AS assertion_type, true AS passed FROM diff""",
)
def _(t: Tables) -> DataFrame:
    """A recorded change holds against the states that it was taken from: diff, assertions and check compose."""
    before, after = bridge.state_before(t), bridge.state_after(t)
    leaves = stored(state.diff_leaves(before, after, ["run_id"]), "diff_leaves")
    header, expected = state.assertion_tables(leaves, ["run_id"])
    judged = matching.check_assertions(header, expected, before, after)
    return judged.select("run_id", "path", "assertion_type", "passed")


@plan(
    "r11_diff_contained",
    f"""WITH {DIFF_CTE}, made AS (SELECT run_id, path, old_value, new_value FROM diff WHERE op = 'changed'),
    need AS (SELECT o_custkey AS run_id, 'orders.' || o_orderkey || '.status' AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE 'O' END AS was
      FROM orders WHERE o_orderstatus = 'P')
    SELECT run_id, bool_and(coalesce(new_value = 'P' AND old_value = was, false)) AS contained FROM need LEFT JOIN made USING (run_id, path) GROUP BY run_id""",
)
def _(t: Tables) -> DataFrame:
    made = matching.diff_facts(state.diff_leaves(bridge.state_before(t), bridge.state_after(t), ["run_id"]), ["run_id"])
    # A change from another old value is not the change that is asked for.
    need = t.orders.filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("run_id"),
        F.array(F.lit("orders"), F.col("o_orderkey").cast("string"), F.lit("status")).alias("path"),
        F.lit("changed").alias("op"),
        F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise("O").alias("old_value"),
        F.lit("P").alias("new_value"),
    )
    return matching.contained(matching.diff_facts(need, ["run_id"]), made, ["run_id"], empty_objects=False)


@plan(
    "r12_clarified_before_write",
    f"""WITH {CALLS}, {REPLIES} SELECT run_id, first_reply, first_write,
    first_reply IS NOT NULL AND (first_write IS NULL OR first_reply < first_write) AS clarification_satisfied FROM seen""",
)
def _(t: Tables) -> DataFrame:
    return matching.reply_rules(gold.calls(t), F.lit(True), F.lit(False), F.lit(True)).drop("refusal_satisfied")


@plan(
    "r13_refusal_ok",
    f"WITH {CALLS}, {REPLIES} SELECT run_id, first_reply IS NOT NULL AND first_write IS NULL AS refusal_satisfied FROM seen",
)
def _(t: Tables) -> DataFrame:
    judged = matching.reply_rules(gold.calls(t), F.lit(False), F.lit(True), F.lit(False))
    return judged.select("run_id", "refusal_satisfied")


@plan(
    "r14_spelled_as_called",
    f"""WITH {CALLS}, w AS (SELECT run_id, pos, CASE tool WHEN 'purchase' THEN 'Buy_Item' ELSE 'buy_item' END AS tool, k FROM calls WHERE is_write)
    SELECT run_id, 'buy item' AS rule, arg_min(tool, pos) AS tool FROM w GROUP BY run_id
    UNION ALL SELECT run_id, 'BUY_ITEM on 7', arg_min(tool, pos) FROM w WHERE k = 7 GROUP BY run_id""",
)
def _(t: Tables) -> DataFrame:
    calls = gold.calls(t).withColumn("tool", F.when(F.col("tool") == "purchase", "Buy_Item").otherwise("buy_item"))
    rules = t.events.select(F.col("user_id").alias("run_id")).distinct()
    rules = rules.select("run_id", F.explode(F.array(F.lit("buy item"), F.lit("BUY_ITEM on 7"))).alias("rule"))
    return matching.forbidden_hits(rules, calls)


@plan("r14_forbidden_hits", f"WITH {CALLS}, {FORBID} SELECT run_id, rule, tool FROM broken")
def _(t: Tables) -> DataFrame:
    return matching.forbidden_hits(gold.rules(t), gold.calls(t))


@plan(
    "r15_write_verbs",
    f"""WITH n AS (SELECT p_partkey, lower(replace(p_name, ' ', '_') || CASE WHEN p_size > 25 THEN '_Set' ELSE '_update_add' END) AS tool FROM part)
    SELECT p_partkey, CASE WHEN tool LIKE '%\\_set' ESCAPE '\\' THEN 'set' ELSE 'update' END AS verb FROM n""",
)
def _(t: Tables) -> DataFrame:
    name = F.concat(
        F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") > 25, "_Set").otherwise("_update_add")
    )
    return t.part.select("p_partkey", matching.write_verb(name).alias("verb"))


@plan(
    "r16_completion_row",
    f"""WITH {COMPLETION} SELECT run_id, CASE WHEN ran THEN 2 ELSE 0 END AS read_total, (p2 IS NOT NULL)::INT + (p4 IS NOT NULL)::INT AS read_matched,
    CASE WHEN ran THEN 3 ELSE 0 END AS write_total, (p1 IS NOT NULL)::INT + (p3 IS NOT NULL)::INT + (p5 IS NOT NULL)::INT AS write_matched,
    edge_total AS precedence_total, edge_ok AS precedence_satisfied, assertion_total, assertion_passed, diff_passed,
    array_to_string(hard_failures, '; ') AS failures, semantic_success FROM relaxed""",
)
def _(t: Tables) -> DataFrame:
    return completion(t).select(
        "run_id", "read_total", "read_matched", "write_total", "write_matched", "precedence_total", "precedence_satisfied",
        "assertion_total", "assertion_passed", "diff_passed", F.array_join("hard_failures", "; ").alias("failures"), "semantic_success",
    )


@plan(
    "r17_efficiency",
    f"""WITH {CALLS}, {TURNS}, j AS (SELECT coalesce(s.run_id, a.run_id) AS run_id, coalesce(user_turns, 0) AS u, coalesce(replies, 0) + coalesce(tools, 0) AS n
      FROM spoken s FULL JOIN acted a ON s.run_id = a.run_id)
    SELECT run_id, u + n AS total_action_turns, round(CASE WHEN u + n <= 0 THEN 0 ELSE least(1.0::DOUBLE, (u + 6)::DOUBLE / (u + n)) END, 6) AS efficiency FROM j""",
)
def _(t: Tables) -> DataFrame:
    transcript = t.conversations.select(F.col("conv_id").alias("run_id"), "role")
    counts = scoring.turn_counts(transcript, gold.calls(t)).withColumn("required", F.col("user_turn_count") + 6)
    rows = scoring.efficiency(counts, "required", "user_turn_count", "response_count", "tool_call_count", F.lit(True))
    return rows.select("run_id", "total_action_turns", F.round("efficiency", 6).alias("efficiency"))


@plan(
    "r17_turn_bands",
    """WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) AS n FROM conversations GROUP BY conv_id)
    SELECT CASE WHEN n <= 3 THEN 'short' WHEN n <= 6 THEN 'medium' ELSE 'long' END AS band, count(*) AS runs,
      round(avg(least(1.0::DOUBLE, (2 * u)::DOUBLE / n)), 6) AS avg_efficiency FROM c GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    counts = t.conversations.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") != "user").alias("r")
    )
    rows = scoring.efficiency(
        counts.withColumn("need", 2 * F.col("u")).withColumn("zero", F.lit(0)), "need", "u", "r", "zero", F.lit(True)
    )
    size = F.col("total_action_turns")
    band = F.when(size <= 3, "short").when(size <= 6, "medium").otherwise("long")
    return rows.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("efficiency"), 6).alias("avg_efficiency")
    )


@plan(
    "r18_reliability",
    f"""WITH {COMPLETION} SELECT run_id, faithfulness_score, clarification_score, tool_discipline_score, round(reliability, 6) AS reliability FROM score_rows""",
)
def _(t: Tables) -> DataFrame:
    rows = scoring.reliability(gold.samples(t), "payload")
    return rows.select(
        "run_id", "faithfulness_score", "clarification_score", "tool_discipline_score", F.round("reliability", 6).alias("reliability")
    )


@plan(
    "r19_relaxed_success",
    f"WITH {COMPLETION} SELECT run_id, semantic_success, relaxed_success, recovered, array_to_string(relaxed_failures, ',') AS reasons FROM score_rows",
)
def _(t: Tables) -> DataFrame:
    rows = scoring.relaxed_success(completion(t))
    return rows.select(
        "run_id", "semantic_success", "relaxed_success", "recovered", F.array_join("relaxed_failures", ",").alias("reasons")
    )


@plan(
    "r20_failure_mode",
    f"""WITH {COMPLETION}, m AS (SELECT run_id, CASE WHEN len(forbidden) > 0 THEN 'R4'
      WHEN list_contains(hard_failures, {H['write_name']}) THEN CASE WHEN tools = 0 OR writes = 0 THEN 'R1a' ELSE 'R1b' END
      WHEN list_contains(hard_failures, {H['order']}) OR list_contains(hard_failures, {H['read']}) THEN 'R2' ELSE 'R3' END AS failure_mode
      FROM score_rows WHERE NOT semantic_success)
    SELECT run_id, failure_mode, CASE failure_mode {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.FAILURE_MODES.items())} END AS failure_label FROM m""",
)
def _(t: Tables) -> DataFrame:
    return score_rows(t).filter(~F.col("semantic_success")).select("run_id", "failure_mode", "failure_label")


@plan("r21_metric_summary", f"WITH {COMPLETION}, m AS (SELECT {MEANS} FROM score_rows) SELECT {ROUNDED} FROM m")
def _(t: Tables) -> DataFrame:
    return scoring.write_columns(scoring.metric_summary(score_rows(t)), SUMMARY_NAMES)


@plan(
    "r22_summarize_by",
    f"WITH {COMPLETION}, m AS (SELECT task_type AS key, {MEANS} FROM score_rows GROUP BY 1) SELECT key, {ROUNDED} FROM m",
)
def _(t: Tables) -> DataFrame:
    return scoring.write_columns(scoring.summarize_by(score_rows(t), "task_type"), ["key", *SUMMARY_NAMES])


@plan(
    "r23_summarize_by_label",
    f"""WITH {COMPLETION}, x AS (SELECT *, unnest(behaviors) AS key FROM score_rows), m AS (SELECT key, {MEANS} FROM x GROUP BY 1)
    SELECT key, {ROUNDED} FROM m""",
)
def _(t: Tables) -> DataFrame:
    return scoring.write_columns(scoring.summarize_by_label(score_rows(t), "behavior_bundle"), ["key", *SUMMARY_NAMES])


@plan(
    "r24_scorecard",
    f"""WITH {COMPLETION}, {FANNED}, m AS (SELECT dk.d AS dimension, dk.k AS key, {MEANS} FROM fanned GROUP BY 1, 2)
    SELECT dimension, key, {ROUNDED} FROM m""",
)
def _(t: Tables) -> DataFrame:
    card = scoring.scorecard(score_rows(t), SCALARS, ARRAYS)
    return scoring.write_columns(card, ["dimension", "key", *SUMMARY_NAMES])


@plan(
    "r25_rescore_summary",
    f"""WITH {COMPLETION}, {FANNED} SELECT dk.d AS dimension, dk.k AS key, count(*) AS sample_count,
    round(avg(semantic_success::INT::DOUBLE), 6) AS original_success_rate, round(avg(relaxed_success::INT::DOUBLE), 6) AS relaxed_success_rate,
    round(avg(relaxed_success::INT::DOUBLE) - avg(semantic_success::INT::DOUBLE), 6) AS delta_success_rate,
    count(*) FILTER (recovered) AS recovered_count, round(avg(recovered::INT::DOUBLE), 6) AS recovered_rate,
    count(*) FILTER (assertion_passed = assertion_total) AS final_state_passed_count, count(*) FILTER (diff_passed) AS expected_diff_passed_count,
    count(*) FILTER (len(forbidden) = 0) AS forbidden_passed_count FROM fanned GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    table = scoring.rescore_summary(score_rows(t), SCALARS, ARRAYS)
    return scoring.write_columns(table, table.columns)


@plan(
    "r26_failure_counters",
    f"""WITH {COMPLETION}, f AS (SELECT 'original' AS counter, unnest(hard_failures) AS failure FROM score_rows
      UNION ALL SELECT 'recovered', unnest(hard_failures) FROM score_rows WHERE recovered
      UNION ALL SELECT 'relaxed', unnest(relaxed_failures) FROM score_rows)
    SELECT counter, failure, count(*) AS n FROM f GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2""",
)
def _(t: Tables) -> DataFrame:
    return scoring.failure_counters(score_rows(t))


@plan(
    "r27_error_rows",
    f"""WITH {COMPLETION} SELECT run_id, run_error, tools AS tool_call_count, writes AS write_call_count, round(reliability, 6) AS reliability
    FROM score_rows WHERE run_error IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    rows = score_rows(t).filter("run_error IS NOT NULL")
    return rows.select(
        "run_id", "run_error", "tool_call_count", "write_call_count", F.round("reliability", 6).alias("reliability")
    )
