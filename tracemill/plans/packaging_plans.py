"""Packaging queries: open orders as blueprints, line items as stable and unstable dialogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.operators import packaging as pk
from tracemill.plans.blueprint_plans import TASKS, TRACE
from tracemill.plans.registry import plan
from tracemill.sources import tasks as src
from tracemill.sources.stages import stored
from tracemill.sources.tables import Tables

DIALOGUES = """dlg AS (SELECT l_orderkey AS tk, l_returnflag = 'N' AS is_stable, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS sample_id,
  CASE WHEN l_discount > 0.05 THEN NULL ELSE 'single_turn' END AS mode, CAST(l_quantity AS INT) AS total, CASE WHEN l_discount < 0.08 THEN 45 END AS allowed,
  l_linenumber - 1 AS stable_turns, l_tax <= 0.07 AS has_rewrite,
  CASE WHEN l_returnflag = 'N' THEN [] WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN ['underspecification'] WHEN l_returnflag = 'A' THEN ['information_overload']
    WHEN l_linestatus = 'F' THEN ['goal_switching', 'information_overload'] WHEN l_tax > 0.06 THEN [] ELSE ['contradictory_constraints'] END AS bundle FROM lineitem),
cnt AS (SELECT l_orderkey AS tk, count(*) AS calls, count(*) FILTER (l_linestatus = 'F') AS writes FROM lineitem GROUP BY 1)"""
SAMPLES = f"""{TASKS}, {DIALOGUES}, bl AS (SELECT task_id AS tk, env_id, config_id, dialogue_mode, difficulty_bucket, task_type, coalesce(calls, 0) AS calls, coalesce(writes, 0) AS writes
  FROM tasks LEFT JOIN cnt ON tk = task_id WHERE status <> 'F'),
picked AS (SELECT * FROM dlg WHERE is_stable QUALIFY row_number() OVER (PARTITION BY tk ORDER BY sample_id) = 1 UNION ALL SELECT * FROM dlg WHERE NOT is_stable),
samples AS (SELECT sample_id, tk AS task_id, env_id, config_id, CASE WHEN is_stable THEN 'stable' ELSE 'unstable' END AS variant, coalesce(mode, dialogue_mode) AS dialogue_mode,
  difficulty_bucket, task_type, bundle, CASE WHEN is_stable OR len(bundle) = 0 THEN '' ELSE bundle[1] END AS unstable_behavior, calls, writes, total, coalesce(allowed, 30) AS allowed,
  stable_turns, has_rewrite FROM picked JOIN bl USING (tk)),
checked AS (SELECT *, list_filter([CASE WHEN calls = 0 AND task_type = 'execute' THEN 'missing gold_tool_trace' END,
    CASE WHEN task_type = 'execute' AND writes = 0 THEN 'missing expected_state_diff' END, CASE WHEN task_type = 'execute' AND writes = 0 THEN 'missing final_state_assertions' END,
    CASE WHEN calls > 5 THEN 'tool_call_count ' || calls || ' exceeds tool_call_budget 5' END,
    CASE WHEN total > allowed THEN 'total_action_turns ' || total || ' exceeds max_allowed_action_turns ' || allowed END,
    CASE WHEN variant = 'unstable' AND len(bundle) = 0 THEN 'missing behavior_bundle for unstable sample' END,
    CASE WHEN variant = 'unstable' AND len(bundle) = 0 THEN 'missing unstable_behavior for unstable sample' END,
    CASE WHEN variant = 'unstable' AND NOT has_rewrite THEN 'missing rewrite_metadata for unstable sample' END,
    CASE WHEN stable_turns = 0 THEN 'missing stable_user_turns' END], lambda x: x IS NOT NULL) AS failures FROM samples),
pairs AS (SELECT tk AS task_id, bl.env_id, count(*) FILTER (variant = 'stable') AS stable_count, count(*) FILTER (variant = 'unstable') AS unstable_count,
  count(*) FILTER (variant = 'stable' AND len(failures) > 0) AS stable_failed, count(*) FILTER (variant = 'unstable' AND len(failures) > 0) AS unstable_failed
  FROM bl LEFT JOIN checked ON tk = task_id GROUP BY 1, 2),
envs AS (SELECT env_id, count(*) AS base_blueprint_count, CAST(sum(stable_count) AS BIGINT) AS stable_sample_count, CAST(sum(unstable_count) AS BIGINT) AS unstable_sample_count,
  count(*) FILTER (stable_count = 0) AS missing_stable_count, count(*) FILTER (unstable_count = 0) AS missing_unstable_count FROM pairs GROUP BY env_id)"""
KNOWN = "(VALUES " + ", ".join(f"({i}, '{b}', {p}::DOUBLE)" for i, (b, p) in enumerate(fixed.BEHAVIOR_PRIORS.items())) + ") v(i, behavior, prior)"


def blueprints(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("task_id")).agg(
        F.count(F.lit(1)).alias("tool_call_count"), F.count_if(F.col("l_linestatus") == "F").alias("write_nodes")
    )
    rows = src.tasks(t).filter("status <> 'F'").join(counts, "task_id", "left").fillna(0, ["tool_call_count", "write_nodes"])
    kind = F.col("task_type")
    listed = rows.select(
        F.col("task_id").cast("string").alias("task_id"), "env_id", "config_id", "dialogue_mode", "difficulty_bucket", "task_type",
        F.concat(F.lit("goal "), F.col("task_id").cast("string")).alias("goal_summary"),
        F.lit("request").alias("user_request"), F.lit("done").alias("expected_final_outcome"),
        F.lit(5).alias("tool_call_budget"), F.lit(30).alias("agent_action_budget"), F.lit(0).alias("min_required_action_turns"),
        "tool_call_count", (F.col("tool_call_count") - F.col("write_nodes")).alias("read_nodes"), "write_nodes",
        F.when(kind == "clarify_then_execute", 1).otherwise(0).alias("clarify_nodes"),
        F.when(kind == "refuse_or_scope", 1).otherwise(0).alias("refuse_nodes"),
        F.col("write_nodes").alias("diff_count"), F.col("write_nodes").alias("assertion_count"), F.col("task_id").alias("ord"),
    )
    return pk.index_blueprints(listed, "ord").drop("ord")


def dialogues(t: Tables) -> DataFrame:
    flag, line, tax = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_tax")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    bundle = (
        F.when(flag == "N", arr())
        .when((flag == "A") & (line == "F"), arr("underspecification"))
        .when(flag == "A", arr("information_overload"))
        .when(line == "F", arr("goal_switching", "information_overload"))
        .when(tax > 0.06, arr())
        .otherwise(arr("contradictory_constraints"))
    )
    task = F.col("l_orderkey").cast("string")
    return t.lineitem.select(
        task.alias("task_id"), task.alias("source_task_id"), (flag == "N").alias("is_stable"),
        F.concat_ws("_", task, *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]).alias("sample_id"),
        F.when(F.col("l_discount") <= 0.05, "single_turn").alias("dialogue_mode"),
        *[F.lit(None).cast("string").alias(c) for c in ("difficulty_bucket", "goal_summary", "user_request", "expected_final_outcome", "unstable_behavior")],
        bundle.alias("behavior_bundle"), F.when(flag == "N", arr()).otherwise(arr(fixed.PROFILE_BUNDLE)).alias("profile_bundle"),
        F.col("l_quantity").cast("int").alias("total_action_turns"), F.when(F.col("l_discount") < 0.08, 45).alias("max_allowed_action_turns"),
        F.lit(1).alias("user_turn_count"), (F.col("l_linenumber") - 1).alias("stable_turn_count"), F.lit(1).alias("alignment_count"),
        (tax <= 0.07).alias("has_rewrite_metadata"), "l_linenumber", "l_extendedprice",
        F.col("l_orderkey").alias("l_orderkey_"), F.col("l_linestatus").alias("l_linestatus_"),
    )


def samples(t: Tables) -> DataFrame:
    rows = dialogues(t)
    order = ["l_linenumber", "l_extendedprice"]
    return pk.package(blueprints(t), rows.filter("is_stable"), rows.filter("NOT is_stable"), order)


def checked(t: Tables) -> DataFrame:
    return pk.validate_sample(samples(t))


def pairs(t: Tables) -> DataFrame:
    return pk.pair_summary(blueprints(t), checked(t))


def envs(t: Tables) -> DataFrame:
    return pk.env_summary(pairs(t), samples(t), min_samples=10, modes=fixed.DIALOGUE_MODES, min_buckets=3)


def gate(t: Tables) -> DataFrame:
    rows, known = dialogues(t), blueprints(t)
    return pk.global_gate(
        samples(t), pk.orphan_tasks(rows.filter("is_stable"), known), pk.orphan_tasks(rows.filter("NOT is_stable"), known),
        min_count=10, modes=fixed.DIALOGUE_MODES, min_buckets=3, max_mode_ratio=1.5, max_difficulty_ratio=5.0,
    )


@plan("q1_index_blueprints", f"WITH {TASKS} SELECT task_id::VARCHAR AS task_id, env_id, config_id FROM tasks WHERE status <> 'F'")
def _(t: Tables) -> DataFrame:
    return blueprints(t).select("task_id", "env_id", "config_id")


@plan(
    "q2_package",
    f"""WITH {SAMPLES} SELECT sample_id, task_id::VARCHAR AS task_id, env_id, variant, dialogue_mode, unstable_behavior, array_to_string(bundle, ',') AS behaviors,
    CASE WHEN total > 0 THEN total ELSE 2 + calls END AS min_required_action_turns, allowed AS max_allowed_action_turns FROM samples""",
)
def _(t: Tables) -> DataFrame:
    return samples(t).select(
        "sample_id", "task_id", "env_id", "variant", "dialogue_mode", "unstable_behavior",
        F.array_join("behavior_bundle", ",").alias("behaviors"), "min_required_action_turns", "max_allowed_action_turns",
    )


def children(t: Tables, parts: Sequence[str] = pk.PARTS) -> dict[str, DataFrame]:
    """Packaged content: traces up to the line of each dialogue, a graph and assertions of their own for some tasks.

    Samples and traces are stored steps where a graph is asked for, which takes both several times.
    """
    keep = stored if "nodes" in parts or "edges" in parts else lambda df, name: df
    rows = dialogues(t).select("sample_id", F.col("l_orderkey_").alias("task_id"), "l_linenumber", "l_linestatus_")
    trace = keep(src.trace(t).select("task_id", "step_index", "tool_name", "has_diff"), "trace")
    steps = trace.withColumn("arguments", F.lit("{}"))
    told = rows.join(steps, "task_id").filter("step_index <= l_linenumber").select("sample_id", "step_index", "tool_name", "arguments", "has_diff")
    text = F.lit(None).cast("string")
    diff = lambda rows, key, path, old, new: rows.select(key, path.alias("path"), F.lit("changed").alias("op"), F.lit(old).alias("old_value"), F.lit(new).alias("new_value"))
    line = F.array(F.lit("lines"), F.col("l_linenumber").cast("string"))
    tasks = blueprints(t).select("task_id", "env_id")
    own = trace.withColumn("task_id", F.col("task_id").cast("string")).join(tasks.filter("env_id = '1-URGENT'"), "task_id")
    turn = rows.select("sample_id", F.lit(1).alias("turn"), F.lit("request").alias("text"))
    return pk.packaged_children(
        keep(samples(t).select("sample_id", "base_task_id"), "samples"),
        {
            "turns": turn, "stable_turns": turn.filter("false"), "alignment": told.select("sample_id", "step_index", F.lit(1).alias("turn")), "trace": told,
            "state_diff": diff(rows.filter("l_linestatus_ = 'F'"), "sample_id", line, "O", "F"),
        },
        {
            "nodes": own.select("task_id", "step_index", F.when(F.col("has_diff"), "write").otherwise("read").alias("node_kind"), F.concat(F.lit("gold_"), "tool_name").alias("tool_name"), F.lit("{}").alias("arguments")),
            "edges": own.select("task_id", F.col("step_index").alias("before_step"), F.col("step_index").alias("after_step")).filter("false"),
            "assertions": tasks.filter("env_id = '2-HIGH'").select(
                "task_id", F.concat(F.lit("orders."), "task_id").alias("path"), F.lit("removed").alias("assertion_type"), text.alias("old_value"), text.alias("new_value"), text.alias("value"), F.lit(True).alias("is_hard"),
            ),
            "state_diff": diff(tasks, "task_id", F.array(F.lit("orders"), F.col("task_id"), F.lit("status")), "P", "done"),
            "rules": tasks.select("task_id", F.lit("never delete orders").alias("rule")),
        },
        parts,
    )


LINES = f"""WITH {SAMPLES}, {TRACE}, s AS (SELECT *, CAST(split_part(sample_id, '_', 2) AS INT) AS line FROM samples),
    g AS (SELECT s.sample_id, s.env_id, r.step_index, r.has_diff, r.tool_name, r.step_index <= line AS told FROM s JOIN trace r ON r.task_id = s.task_id)"""


@plan(
    "q2_packaged_graph",
    f"""{LINES} SELECT sample_id, step_index AS a, CASE WHEN has_diff THEN 'write' ELSE 'read' END AS kind, CASE WHEN env_id = '1-URGENT' THEN 'gold_' ELSE '' END || tool_name AS tool
      FROM g WHERE env_id = '1-URGENT' OR told
    UNION ALL SELECT sample_id, step_index, 'edge', CAST(step_index - 1 AS VARCHAR) FROM g WHERE env_id <> '1-URGENT' AND told AND step_index > 1""",
)
def _(t: Tables) -> DataFrame:
    parts = children(t, ("nodes", "edges"))
    nodes = parts["nodes"].select("sample_id", F.col("step_index").alias("a"), F.col("node_kind").alias("kind"), F.col("tool_name").alias("tool"))
    edges = parts["edges"].select("sample_id", F.col("after_step").alias("a"), F.lit("edge").alias("kind"), F.col("before_step").cast("string").alias("tool"))
    return nodes.unionByName(edges)


@plan(
    "q2_packaged_assertions",
    f"""{LINES}, f AS (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS sample_id FROM lineitem WHERE l_linestatus = 'F')
    SELECT s.sample_id, CASE WHEN env_id = '2-HIGH' THEN 'orders.' || task_id WHEN f.sample_id IS NOT NULL THEN 'lines.' || line ELSE 'orders.' || task_id || '.status' END AS path,
      CASE WHEN env_id = '2-HIGH' THEN 'removed' ELSE 'changed' END AS assertion_type, CASE WHEN env_id = '2-HIGH' THEN NULL WHEN f.sample_id IS NOT NULL THEN 'O' ELSE 'P' END AS old_value,
      CASE WHEN env_id = '2-HIGH' THEN NULL WHEN f.sample_id IS NOT NULL THEN 'F' ELSE 'done' END AS new_value FROM s LEFT JOIN f USING (sample_id)""",
)
def _(t: Tables) -> DataFrame:
    return children(t, ("assertions",))["assertions"].select("sample_id", "path", "assertion_type", "old_value", "new_value")


@plan(
    "q3_orphan_dialogues",
    f"WITH {TASKS} SELECT DISTINCT l_orderkey::VARCHAR AS task_id FROM lineitem WHERE l_orderkey NOT IN (SELECT task_id FROM tasks WHERE status <> 'F')",
)
def _(t: Tables) -> DataFrame:
    return pk.orphan_tasks(dialogues(t), blueprints(t))


@plan("q4_validate_sample", f"WITH {SAMPLES} SELECT sample_id, array_to_string(failures, '; ') AS failures, len(failures) = 0 AS qc_passed FROM checked")
def _(t: Tables) -> DataFrame:
    return checked(t).select("sample_id", F.array_join("qc_failures", "; ").alias("failures"), "qc_passed")


PAIR_FAIL = """list_filter([CASE WHEN stable_count = 0 THEN 'missing stable variant' END, CASE WHEN unstable_count = 0 THEN 'missing unstable variant' END,
  CASE WHEN stable_failed > 0 THEN 'stable variant failed sample-level QC' END, CASE WHEN unstable_failed > 0 THEN 'unstable variants failed sample-level QC' END], lambda x: x IS NOT NULL)"""


@plan(
    "q5_pair_summary",
    f"""WITH {SAMPLES} SELECT task_id::VARCHAR AS task_id, env_id, stable_count, unstable_count, stable_failed, unstable_failed,
    array_to_string({PAIR_FAIL}, '; ') AS failures FROM pairs""",
)
def _(t: Tables) -> DataFrame:
    return pairs(t).withColumn("failures", F.array_join("qc_failures", "; ")).drop("qc_failures", "qc_passed")


@plan(
    "q6_env_summary",
    f"""WITH {SAMPLES} SELECT e.*, (SELECT array_to_string(list(DISTINCT dialogue_mode ORDER BY dialogue_mode), ',') FROM samples s WHERE s.env_id = e.env_id) AS modes_present,
    missing_stable_count = 0 AND missing_unstable_count = 0 AS qc_passed FROM envs e""",
)
def _(t: Tables) -> DataFrame:
    return envs(t).select(
        "env_id", "base_blueprint_count", "stable_sample_count", "unstable_sample_count", "missing_stable_count", "missing_unstable_count",
        F.array_join("modes_present", ",").alias("modes_present"), "qc_passed",
    )


@plan(
    "q7_imbalance_ratio",
    f"""WITH {SAMPLES}, c AS (SELECT difficulty_bucket, count(*) AS n FROM samples GROUP BY 1) SELECT round(max(n)::DOUBLE / min(n), 4) AS imbalance_ratio FROM c HAVING count(*) >= 2""",
)
def _(t: Tables) -> DataFrame:
    return pk.imbalance_ratio(samples(t), "difficulty_bucket")


@plan(
    "q8_label_distributions",
    f"""WITH {SAMPLES}, x AS (SELECT 'behavior' AS dimension, unnest(bundle) AS label FROM samples WHERE variant = 'unstable'
      UNION ALL SELECT 'bundle_size', len(bundle)::VARCHAR FROM samples WHERE variant = 'unstable' UNION ALL SELECT 'profile', '{fixed.PROFILE_BUNDLE}' FROM samples WHERE variant = 'unstable'
      UNION ALL SELECT 'dialogue_mode', dialogue_mode FROM samples UNION ALL SELECT 'difficulty_bucket', difficulty_bucket FROM samples)
    SELECT dimension, label, count(*) AS n FROM x GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return pk.label_distributions(samples(t))


@plan(
    "q9_primary_distribution",
    f"""WITH {SAMPLES}, u AS (SELECT unstable_behavior AS b FROM samples WHERE variant = 'unstable')
    SELECT behavior, (SELECT count(*) FROM u WHERE b = behavior) AS n, round((SELECT count(*) FROM u WHERE b = behavior)::DOUBLE / (SELECT count(*) FROM u), 4) AS share, prior FROM {KNOWN}""",
)
def _(t: Tables) -> DataFrame:
    return pk.primary_distribution(samples(t))


@plan(
    "q10_coverage_floor",
    f"""WITH {SAMPLES}, f AS (SELECT CAST(sum(len(bundle)) AS BIGINT) AS tokens, count(*) AS n, max(len(bundle)) AS big, count(*) FILTER (len(bundle) = 1) AS singles FROM samples WHERE variant = 'unstable'),
    g AS (SELECT *, 6 * 10000 AS token_floor, greatest(0, 6 * 10000 - n) AS needed FROM f)
    SELECT tokens AS token_count, token_floor, greatest(0, tokens - token_floor) AS token_slack, singles AS single_count, n - singles AS multi_count,
      CASE WHEN needed = 0 THEN 0 WHEN big > 1 THEN CAST(ceil(needed::DOUBLE / (big - 1)) AS BIGINT) END AS min_multi_needed,
      coalesce(needed = 0 OR ceil(needed::DOUBLE / nullif(big - 1, 0)) < n / 2, false) AS single_majority_feasible FROM g""",
)
def _(t: Tables) -> DataFrame:
    return pk.coverage_floor(pk.behavior_facts(samples(t)), min_count=10000)


GATE = f"""counts AS (SELECT behavior, i, (SELECT count(*) FROM (SELECT unnest(bundle) AS b FROM samples WHERE variant = 'unstable') WHERE b = behavior) AS n FROM {KNOWN}),
md AS (SELECT dialogue_mode, count(*) AS n FROM samples GROUP BY 1), db AS (SELECT difficulty_bucket, count(*) AS n FROM samples GROUP BY 1),
gate AS (SELECT (SELECT array_to_string(list(behavior ORDER BY i), ',') FROM counts WHERE n = 0) AS missing_behaviors, (SELECT array_to_string(list(behavior ORDER BY i), ',') FROM counts WHERE n < 10) AS under_min_behaviors,
  (SELECT round(max(n)::DOUBLE / min(n), 4) FROM md) AS mode_ratio, (SELECT round(max(n)::DOUBLE / min(n), 4) FROM db) AS difficulty_ratio,
  (SELECT count(DISTINCT tk) FROM dlg WHERE is_stable AND tk NOT IN (SELECT tk FROM bl)) AS orphan_stable, (SELECT count(DISTINCT tk) FROM dlg WHERE NOT is_stable AND tk NOT IN (SELECT tk FROM bl)) AS orphan_unstable),
verdict AS (SELECT *, list_filter([CASE WHEN orphan_stable > 0 THEN 'orphan stable dialogues' END, CASE WHEN orphan_unstable > 0 THEN 'orphan unstable dialogues' END,
  CASE WHEN missing_behaviors <> '' THEN 'missing required unstable behaviors' END, CASE WHEN under_min_behaviors <> '' THEN 'behaviors below the minimum count' END,
  CASE WHEN mode_ratio > 1.5 THEN 'dialogue mode imbalance ratio too high' END, CASE WHEN difficulty_ratio > 5 THEN 'difficulty imbalance ratio too high' END], lambda x: x IS NOT NULL) AS fails FROM gate)"""


@plan(
    "q11_global_gate",
    f"WITH {SAMPLES}, {GATE} SELECT missing_behaviors, under_min_behaviors, mode_ratio, difficulty_ratio, orphan_stable, orphan_unstable, array_to_string(fails, '; ') AS failures, len(fails) = 0 AS qc_passed FROM verdict",
)
def _(t: Tables) -> DataFrame:
    return gate(t).select(
        F.array_join("missing_behaviors", ",").alias("missing_behaviors"), F.array_join("under_min_behaviors", ",").alias("under_min_behaviors"),
        "mode_ratio", "difficulty_ratio", "orphan_stable", "orphan_unstable", F.array_join("qc_failures", "; ").alias("failures"), "qc_passed",
    )


@plan("q12_package_order", f"WITH {SAMPLES} SELECT env_id, task_id::VARCHAR AS task_id, variant, sample_id FROM samples ORDER BY 1, 2, 3, 4")
def _(t: Tables) -> DataFrame:
    return pk.package_order(samples(t)).select("env_id", "task_id", "variant", "sample_id")


@plan(
    "q13_qc_rollup",
    f"""WITH {SAMPLES}, {GATE} SELECT 'sample' AS level, count(*) FILTER (len(failures) > 0) AS failures, count(*) AS checked FROM checked
    UNION ALL SELECT 'pair', count(*) FILTER (len({PAIR_FAIL}) > 0), count(*) FROM pairs
    UNION ALL SELECT 'env', count(*) FILTER (missing_stable_count > 0 OR missing_unstable_count > 0), count(*) FROM envs
    UNION ALL SELECT 'global', count(*) FILTER (len(fails) > 0), count(*) FROM verdict""",
)
def _(t: Tables) -> DataFrame:
    return pk.qc_rollup(checked(t), pairs(t), envs(t), gate(t))
