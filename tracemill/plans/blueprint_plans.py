"""Blueprint queries: orders as tasks, line items as gold traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.functions import text as tx
from tracemill.operators import blueprints as bp
from tracemill.operators.running import block_of
from tracemill.plans import sqltext as q
from tracemill.plans.registry import plan
from tracemill.sources import tasks as src
from tracemill.sources.tables import Tables

TASKS = """tasks AS (SELECT o_orderkey AS task_id, o_orderpriority AS env_id, o_custkey AS config_id, o_orderstatus AS status, o_totalprice AS price,
  CASE WHEN o_orderstatus = 'P' THEN 'multi_turn' ELSE 'single_turn' END AS dialogue_mode,
  CASE WHEN o_totalprice < 150000 THEN 'easy' WHEN o_totalprice < 350000 THEN 'medium' ELSE 'hard' END AS difficulty_bucket,
  CASE WHEN o_totalprice < 300000 THEN 'execute' WHEN o_totalprice < 400000 THEN 'clarify_then_execute' ELSE 'refuse_or_scope' END AS task_type FROM orders)"""
TRACE = """trace AS (SELECT l_orderkey AS task_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS step_index,
  'tool_' || l_linenumber AS tool_name, l_linestatus = 'F' AS has_diff, l_returnflag = 'R' AND l_tax > 0.065 AS failed, l_discount > 0.095 AS ended FROM lineitem),
steps AS (SELECT l_orderkey AS task_id, count(*) AS step_count FROM lineitem GROUP BY 1)"""


@plan(
    "b1_validate_blueprint",
    f"""WITH {TASKS}, {TRACE}, first_bad AS (SELECT task_id, min(step_index) AS step FROM trace WHERE tool_name = 'tool_7' GROUP BY 1),
    c AS (SELECT t.*, coalesce(step_count, 0) AS n, b.step AS bad, CASE env_id WHEN '2-HIGH' THEN '4' WHEN '3-MEDIUM' THEN '7' WHEN '4-NOT SPECIFIED' THEN 'many' ELSE '6' END AS budget
      FROM tasks t LEFT JOIN steps USING (task_id) LEFT JOIN first_bad b USING (task_id))
    SELECT task_id, CASE WHEN price < 5000 THEN 'candidate is missing goal_summary, user_request, or expected_final_outcome'
      WHEN budget = 'many' THEN 'tool_call_budget must be an integer' WHEN budget = '7' THEN 'tool_call_budget must be within 0-6'
      WHEN status = 'P' AND price <= 100000 THEN 'multi_turn tasks need at least two coherent turn entries'
      WHEN n > 6 THEN 'tool_plan length must be within 0-6' WHEN n = 0 AND task_type = 'execute' THEN 'execute tasks must contain at least one tool step'
      WHEN n = 0 AND task_type = 'clarify_then_execute' AND env_id <> '1-URGENT' THEN 'clarify_then_execute tasks without tool steps must include clarification_requirements'
      WHEN n = 0 AND task_type = 'refuse_or_scope' AND env_id <> '2-HIGH' THEN 'refuse_or_scope tasks without tool steps must include refusal_requirements'
      WHEN bad IS NOT NULL THEN 'tool_plan step ' || bad || ' uses unknown tool ''tool_7'''
      WHEN budget = '4' AND n > 4 THEN 'tool_call_budget is smaller than the proposed tool plan length'
      WHEN status = 'F' THEN 'user_request leaks hidden tool names or identifiers' END AS reason FROM c""",
)
def _(t: Tables) -> DataFrame:
    facts = bp.plan_facts(src.plan_steps(t), src.known_tools(t), "task_id", "env_id")
    rows = src.candidates(t).join(facts, "task_id", "left").fillna(0, ["step_count"])
    return bp.validate_blueprint(rows).select("task_id", "reason")


@plan(
    "b2_detect_leaks",
    f"""SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower({q.strip('b.text')}))""",
)
def _(t: Tables) -> DataFrame:
    needles = t.benchmark.withColumnRenamed("text", "needle")
    return bp.containment_join(t.documents, needles, "doc_id", "text", "item_id", "needle")


@plan(
    "b3_hidden_identifiers",
    """WITH e AS (SELECT user_id AS task_id, event_type AS tool, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
    tok AS (SELECT DISTINCT task_id, 'usr_' || k AS value FROM e WHERE tool <> 'view'),
    ex AS (SELECT DISTINCT task_id, 'Looking at USR_' || k || ' now' AS text FROM e WHERE tool = 'view')
    SELECT task_id, value FROM tok WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.task_id = tok.task_id AND contains(lower(ex.text), lower(tok.value)))""",
)
def _(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    rows = t.events.select(F.col("user_id").alias("task_id"), "event_type", k.alias("k"))
    leaves = rows.filter("event_type <> 'view'").select(
        "task_id", F.lit("string").alias("kind"), F.concat(F.lit("usr_"), "k").alias("value")
    )
    exposed = rows.filter("event_type = 'view'").select(
        "task_id", F.concat(F.lit("Looking at USR_"), "k", F.lit(" now")).alias("text")
    )
    return bp.hidden_identifiers(leaves, exposed.distinct())


@plan(
    "b4_reject_duplicates",
    "SELECT doc_id, lang, doc_id > min(doc_id) OVER (PARTITION BY lang, text) AS is_duplicate FROM documents",
)
def _(t: Tables) -> DataFrame:
    plan_json = F.array(F.struct(F.lit("read").alias("tool_name")))
    rows = t.documents.select(
        "doc_id", "lang", bp.blueprint_fingerprint("lang", "text", plan_json).alias("fingerprint")
    )
    return bp.reject_duplicates(rows, "lang", "fingerprint", "doc_id").drop("fingerprint")


# Tasks with an even customer were rejected: they are no progress.
TARGET = f"""{TASKS}, prog AS (SELECT *, count(*) FILTER (config_id % 2 = 1) OVER w AS accepted,
    coalesce(max((config_id % 2 = 1 AND dialogue_mode = 'single_turn')::INT) OVER w, 0) AS has_single,
    coalesce(max((config_id % 2 = 1 AND dialogue_mode = 'multi_turn')::INT) OVER w, 0) AS has_multi,
    coalesce(max((config_id % 2 = 1 AND difficulty_bucket = 'easy')::INT) OVER w, 0) AS has_easy,
    coalesce(max((config_id % 2 = 1 AND difficulty_bucket = 'medium')::INT) OVER w, 0) AS has_medium,
    coalesce(max((config_id % 2 = 1 AND difficulty_bucket = 'hard')::INT) OVER w, 0) AS has_hard
  FROM tasks WINDOW w AS (PARTITION BY env_id ORDER BY task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
slots AS (SELECT * FROM (VALUES (0, 'T1', 'single_turn', 'easy', 1, 2), (1, 'T2', 'single_turn', 'medium', 2, 4), (2, 'T3', 'multi_turn', 'medium', 3, 5), (3, 'T4', 'multi_turn', 'hard', 4, 6)) v(i, sn, sm, sb, lo, hi)),
target AS (SELECT task_id, env_id, dialogue_mode, difficulty_bucket, task_type, accepted, sn AS slot_name,
  greatest(0, 3 - has_easy - has_medium - has_hard) > 0 AND 6 - accepted <= greatest(0, 3 - has_easy - has_medium - has_hard) AS require_new_bucket,
  array_to_string(list_filter([CASE WHEN has_single = 0 THEN 'single_turn' END, CASE WHEN has_multi = 0 THEN 'multi_turn' END], lambda x: x IS NOT NULL), ',') AS missing_modes,
  list_filter([CASE WHEN has_easy = 1 THEN 'easy' END, CASE WHEN has_medium = 1 THEN 'medium' END, CASE WHEN has_hard = 1 THEN 'hard' END], lambda x: x IS NOT NULL) AS present,
  coalesce(sm, CASE WHEN has_single = 0 THEN 'single_turn' WHEN has_multi = 0 THEN 'multi_turn' END) AS required_mode,
  CASE WHEN has_easy = 0 THEN 'easy' WHEN has_medium = 0 THEN 'medium' WHEN has_hard = 0 THEN 'hard' END AS next_bucket, sb, lo, hi
  FROM prog LEFT JOIN slots ON accepted = i)"""


def coverage_target(t: Tables) -> DataFrame:
    rows = src.tasks(t).withColumn("was_accepted", F.col("config_id") % 2 == 1).drop("config_id", "status", "price")
    return bp.running_coverage_target(
        rows, "env_id", "task_id", block_of("task_id"), target=6, min_buckets=3, accepted="was_accepted"
    )


@plan(
    "b5_running_coverage_target",
    f"""WITH {TARGET} SELECT task_id, env_id, accepted, slot_name, missing_modes, array_to_string(present, ',') AS present_buckets, require_new_bucket,
    required_mode, coalesce(sb, CASE WHEN require_new_bucket THEN next_bucket END) AS required_bucket FROM target""",
)
def _(t: Tables) -> DataFrame:
    return coverage_target(t).select(
        "task_id", "env_id", "accepted", "slot_name", F.array_join("missing_modes", ",").alias("missing_modes"),
        F.array_join("present_buckets", ",").alias("present_buckets"), "require_new_bucket", "required_mode", "required_bucket",
    )


@plan(
    "b6_check_against_target",
    f"""WITH {TARGET}, n AS (SELECT l_orderkey AS task_id, count(*) AS steps FROM lineitem GROUP BY 1),
    f AS (SELECT *, coalesce(steps, 0) AS size, coalesce(sb, CASE WHEN require_new_bucket THEN next_bucket END) AS rb FROM target LEFT JOIN n USING (task_id))
    SELECT task_id, CASE WHEN dialogue_mode <> required_mode THEN 'candidate dialogue_mode must be ''' || required_mode || ''' for current coverage target'
      WHEN difficulty_bucket <> rb THEN 'candidate difficulty_bucket must be ''' || rb || ''' for current coverage target'
      WHEN require_new_bucket AND list_contains(present, difficulty_bucket) THEN 'candidate must introduce a new difficulty bucket for current coverage target'
      WHEN size < lo THEN 'candidate tool_plan length ' || size || ' is below required min ' || lo
      WHEN size > hi THEN 'candidate tool_plan length ' || size || ' exceeds required max ' || hi
      WHEN task_type <> 'execute' THEN 'candidate task_type must remain execute for the current formal slot target' END AS reason FROM f""",
)
def _(t: Tables) -> DataFrame:
    sized = coverage_target(t).join(src.step_counts(t), "task_id", "left").fillna(0, ["step_count"])
    return bp.check_against_target(sized, "step_count").select("task_id", "reason")


@plan(
    "b7_gold_nodes",
    f"WITH {TRACE} SELECT task_id, step_index, tool_name, CASE WHEN has_diff THEN 'write' ELSE 'read' END AS node_kind FROM trace",
)
def _(t: Tables) -> DataFrame:
    return bp.gold_nodes(src.trace(t)).select("task_id", "step_index", "tool_name", "node_kind")


@plan(
    "b8_precedence_edges",
    """SELECT user_id AS run_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before_step, event_id AS after_step
    FROM events WHERE event_id > 0 QUALIFY before_step IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    calls = t.events.select(F.col("user_id").alias("run_id"), "event_id")
    return bp.precedence_edges(calls, "run_id", "event_id")


@plan(
    "b9_requirement_nodes",
    """SELECT o_orderkey AS task_id, 'clarify' AS node_kind, 'ask for the date' AS requirement FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderkey, 'refuse', 'decline refunds' FROM orders WHERE o_orderpriority = '2-HIGH'""",
)
def _(t: Tables) -> DataFrame:
    rows = src.candidates(t).select("task_id", "clarification_requirements", "refusal_requirements")
    return bp.requirement_nodes(rows, "task_id")


@plan(
    "b10_min_action_turns",
    f"""WITH {TASKS}, {TRACE} SELECT task_id, CASE WHEN floor(price / 50000) - 3 > 0 THEN CAST(floor(price / 50000) - 3 AS BIGINT)
    ELSE (CASE WHEN dialogue_mode = 'multi_turn' THEN 2 ELSE 1 END) + coalesce(step_count, 0) + 1 END AS min_turns FROM tasks LEFT JOIN steps USING (task_id)""",
)
def _(t: Tables) -> DataFrame:
    rows = src.tasks(t).join(src.step_counts(t), "task_id", "left").fillna(0, ["step_count"])
    given = F.floor(F.col("price") / 50000) - 3
    users = F.when(F.col("dialogue_mode") == "multi_turn", 2).otherwise(1)
    return rows.select("task_id", bp.min_action_turns(given, users, F.col("step_count")).alias("min_turns"))


@plan(
    "b11_micro_tasks",
    f"""WITH {TASKS} SELECT task_id, 'subtask_' || i AS subtask, 'look up the order' AS user_goal, 'execute' AS kind, 'order found' AS expected_outcome
      FROM tasks, unnest(CASE WHEN price > 100000 THEN [1, 2] ELSE [1] END) u(i) WHERE status = 'P'
    UNION ALL SELECT task_id, 'subtask_1', CASE WHEN price < 5000 THEN '' ELSE 'Goal ORD-' || task_id END, task_type, 'order handled' FROM tasks WHERE status = 'O'
    UNION ALL SELECT task_id, 'own', 'ready made', 'execute', 'ready' FROM tasks WHERE status = 'F'""",
)
def _(t: Tables) -> DataFrame:
    own = F.array(
        F.struct(
            F.lit("own").alias("task_id"), F.lit(" ready made").alias("user_goal"), F.lit("").alias("task_type"), F.lit("ready").alias("expected_outcome")
        )
    )
    blank = F.transform(own, lambda x: F.struct(x["task_id"].alias("task_id"), F.lit(" ").alias("user_goal"), x["task_type"].alias("task_type"), x["expected_outcome"].alias("expected_outcome")))
    is_leak = F.contains("user_request", F.lit("ord-"))
    rows = src.candidates(t).withColumn("micro_tasks", F.when(is_leak, own).otherwise(blank))
    return bp.micro_tasks(rows, "task_id").drop("position")


@plan(
    "b12_replay_outcome",
    f"""WITH {TRACE}, g AS (SELECT task_id, count(*) AS step_count, count(*) FILTER (has_diff) AS mutating_count,
      min(step_index) FILTER (failed OR ended) AS stop, arg_min(failed, step_index) FILTER (failed OR ended) AS stop_failed FROM trace GROUP BY task_id),
    r AS (SELECT *, CASE WHEN stop_failed THEN 'tool step ' || stop || ' failed' WHEN stop IS NOT NULL THEN 'environment terminated early at tool step ' || stop
      WHEN steps > 0 AND NOT changed THEN 'replay produced no objective state change'
      WHEN steps > 0 AND mutated < 1 THEN 'replay did not include any mutating tool step' END AS reason
      FROM (SELECT o_orderkey AS task_id, o_totalprice > 20000 AS changed, coalesce(step_count, 0) AS steps, coalesce(mutating_count, 0) AS mutated, stop, stop_failed
        FROM orders LEFT JOIN g ON o_orderkey = task_id))
    SELECT task_id, steps AS step_count, mutated AS mutating_count, reason, reason IS NULL AS is_valid FROM r""",
)
def _(t: Tables) -> DataFrame:
    # Cheap orders end where they began although steps changed them on the way.
    final = src.tasks(t).select("task_id", (F.col("price") > 20000).alias("state_changed"))
    return bp.replay_outcome(src.trace(t), "task_id", "step_index", final)


@plan(
    "b13_truncate_trace",
    """SELECT * FROM (SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, step = 50 AS truncated FROM events) WHERE step <= 50""",
)
def _(t: Tables) -> DataFrame:
    calls = t.events.select(F.col("user_id").alias("run_id"), "event_id")
    return bp.truncate_trace(calls, "run_id", "event_id", block_of("event_id"), 50)


@plan(
    "b14_blueprint_coverage",
    f"""WITH {TASKS}, req AS (SELECT config_id, count(*) AS requested_count FROM tasks GROUP BY 1),
    got AS (SELECT config_id, count(*) AS realized_count, list(DISTINCT dialogue_mode ORDER BY dialogue_mode) AS modes, list(DISTINCT difficulty_bucket ORDER BY difficulty_bucket) AS buckets
      FROM tasks WHERE status <> 'F' GROUP BY 1), j AS (SELECT config_id, requested_count, coalesce(realized_count, 0) AS realized_count, coalesce(modes, []) AS modes, coalesce(buckets, []) AS buckets FROM req LEFT JOIN got USING (config_id)),
    f AS (SELECT *, list_filter([CASE WHEN requested_count > realized_count THEN 'fewer blueprints than requested' END, CASE WHEN realized_count < 4 THEN 'fewer blueprints than the minimum' END,
      CASE WHEN len(modes) < 2 THEN 'missing required dialogue modes' END, CASE WHEN len(buckets) < 2 THEN 'too few difficulty buckets' END], lambda x: x IS NOT NULL) AS failures FROM j)
    SELECT config_id, requested_count, realized_count, array_to_string(modes, ',') AS modes_present, array_to_string(buckets, ',') AS buckets_present,
      array_to_string(failures, '; ') AS failures, len(failures) = 0 AS coverage_passed FROM f""",
)
def _(t: Tables) -> DataFrame:
    all_tasks = src.tasks(t)
    requested = all_tasks.groupBy("config_id").agg(F.count(F.lit(1)).alias("requested_count"))
    out = bp.coverage(
        all_tasks.filter("status <> 'F'"), ["config_id"], requested, min_count=4, min_buckets=2, modes=fixed.DIALOGUE_MODES
    )
    return out.select(
        "config_id", "requested_count", "realized_count", F.array_join("modes_present", ",").alias("modes_present"),
        F.array_join("buckets_present", ",").alias("buckets_present"), F.array_join("failures", "; ").alias("failures"), "coverage_passed",
    )


@plan(
    "b15_failure_log_summary",
    f"""WITH {TASKS}, {TRACE}, r AS (SELECT task_id, min(step_index) FILTER (failed) AS f FROM trace GROUP BY task_id)
    SELECT env_id, 'tool step ' || f || ' failed' AS reason, count(*) AS failures FROM r JOIN tasks USING (task_id) WHERE f IS NOT NULL GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    log = bp.replay_outcome(src.trace(t).withColumn("ended", F.lit(False)).withColumn("has_diff", F.lit(True)), "task_id", "step_index")
    return bp.failure_log_summary(log.join(src.tasks(t).select("task_id", "env_id"), "task_id"), ["env_id"], "reason")
