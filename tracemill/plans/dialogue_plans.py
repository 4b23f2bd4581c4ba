"""Dialogue queries: order tasks for turn allocation, conversations for rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.functions import text as tx
from tracemill.operators import blueprints as bp
from tracemill.operators import dialogues as dg
from tracemill.operators.running import block_of
from tracemill.plans import sqltext as q
from tracemill.plans.blueprint_plans import TASKS, TRACE
from tracemill.plans.registry import plan
from tracemill.sources import tasks as src
from tracemill.sources.tables import Tables

# Order tasks: one turn, or two to three for multi-turn orders (four for very large ones).
SIZED = f"""{TASKS}, {TRACE}, sized AS (SELECT t.*, coalesce(step_count, 0) AS n, CASE WHEN dialogue_mode = 'single_turn' THEN 1 WHEN price > 450000 THEN 4
    WHEN price > 250000 THEN 3 ELSE 2 END AS turns FROM tasks t LEFT JOIN steps USING (task_id)),
alloc AS (SELECT s.task_id, step_index, tool_name, CASE WHEN n < turns THEN turns - n + step_index
    WHEN step_index <= (n % turns) * (n // turns + 1) THEN (step_index - 1) // (n // turns + 1) + 1
    ELSE (n % turns) + (step_index - (n % turns) * (n // turns + 1) - 1) // greatest(n // turns, 1) + 1 END AS turn_id
  FROM trace JOIN sized s USING (task_id)),
turn_rows AS (SELECT task_id, i AS turn_id, CASE WHEN price < 5000 THEN ' ' ELSE 'turn ' || i || ' of ' || task_id END AS user_message FROM sized, unnest(range(1, turns + 1)) u(i))"""


def sized(t: Tables) -> DataFrame:
    price = F.col("price")
    count = (
        F.when(F.col("dialogue_mode") == "single_turn", 1).when(price > 450000, 4).when(price > 250000, 3).otherwise(2)
    )
    return src.tasks(t).join(src.step_counts(t), "task_id", "left").fillna(0, ["step_count"]).withColumn("turns", count)


def allocated(t: Tables) -> DataFrame:
    sizes = sized(t).select("task_id", "step_count", "turns")
    return src.trace(t).join(sizes, "task_id").select(
        "task_id",
        "step_index",
        "tool_name",
        dg.turn_of_step(F.col("step_index"), F.col("step_count"), F.col("turns")).alias("turn_id"),
    )


def turn_rows(t: Tables) -> DataFrame:
    ids = F.explode(F.sequence(F.lit(1), F.col("turns")))
    rows = sized(t).select("task_id", "price", ids.alias("turn_id"))
    text = F.concat(F.lit("turn "), F.col("turn_id").cast("string"), F.lit(" of "), F.col("task_id").cast("string"))
    return rows.select(
        "task_id", F.col("turn_id").cast("long").alias("turn_id"), F.when(F.col("price") < 5000, " ").otherwise(text).alias("user_message")
    )


def links(t: Tables) -> DataFrame:
    return allocated(t).select("task_id", "turn_id", F.col("step_index").alias("link"), "step_index")


@plan("d1_allocate_steps", f"WITH {SIZED} SELECT task_id, step_index, turn_id FROM alloc")
def _(t: Tables) -> DataFrame:
    return allocated(t).select("task_id", "step_index", "turn_id")


@plan(
    "d2_turn_count",
    """SELECT conv_id, greatest(2, least(3, CASE WHEN count(*) FILTER (role = 'user') > 0 THEN count(*) FILTER (role = 'user') ELSE 2 END)) AS turns
    FROM conversations GROUP BY conv_id""",
)
def _(t: Tables) -> DataFrame:
    users = t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n"))
    return users.select("conv_id", dg.turn_count(F.col("n")).alias("turns"))


@plan(
    "d3_default_dialogue",
    f"""WITH {TASKS}, {TRACE}, d AS (SELECT task_id, price, status, coalesce(step_count, 0) AS n, CASE WHEN status = 'P' THEN 2 ELSE 1 END AS turns,
      CASE WHEN status = 'P' AND price > 100000 THEN 2 WHEN status = 'P' THEN 1 ELSE 0 END AS hints,
      CASE WHEN status = 'F' THEN 'Please handle my order ord-' || task_id ELSE 'Please handle my order' END AS request,
      CASE WHEN price < 5000 THEN 'task' ELSE 'Goal ORD-' || task_id END AS goal FROM tasks LEFT JOIN steps USING (task_id)),
    r AS (SELECT *, CASE WHEN status = 'P' THEN CASE WHEN i <= hints THEN 'look up the order' ELSE 'turn ' || i END ELSE goal END AS task_summary,
      n // turns AS b, n % turns AS x FROM d, unnest(range(1, turns + 1)) u(i))
    SELECT task_id, i AS turn_id, CASE WHEN i = 1 THEN request ELSE 'Thanks. Please continue by handling this next part as well: ' || task_summary || '.' END AS user_message,
      task_summary, CASE WHEN status = 'P' AND i <= hints THEN 'order found' ELSE 'order handled' END AS expected_outcome,
      CASE WHEN n < turns THEN greatest(i - (turns - n), 1) ELSE (i - 1) * b + least(i - 1, x) + 1 END AS first_step,
      CASE WHEN n < turns THEN greatest(i - (turns - n), 0) ELSE i * b + least(i, x) END AS last_step FROM r""",
)
def _(t: Tables) -> DataFrame:
    rows = src.candidates(t).join(src.step_counts(t), "task_id", "left").fillna(0, ["step_count"])
    return dg.default_dialogue(rows, "task_id")


@plan(
    "d4_validate_dialogue",
    f"""WITH {SIZED}, shifted AS (SELECT a.task_id, turn_id, step_index + CASE WHEN env_id = '5-LOW' THEN 1 ELSE 0 END AS s FROM alloc a JOIN tasks USING (task_id))
    SELECT task_id, CASE WHEN turns = 4 THEN 'multi_turn blueprint must realize 2-3 user turns' WHEN price < 5000 THEN 'user turn 1 has empty user_message'
      WHEN env_id = '1-URGENT' AND price < 50000 THEN 'user turn ' || turns || ' leaks hidden tool names or identifiers'
      WHEN env_id = '5-LOW' AND n > 0 THEN 'linked tool steps must cover the gold trace exactly once and in order'
      WHEN env_id = '3-MEDIUM' AND price > 300000 THEN 'assistant_final_response is required' END AS reason FROM sized""",
)
def _(t: Tables) -> DataFrame:
    tasks = sized(t)
    envs = tasks.select("task_id", "env_id")
    shift = F.when(F.col("env_id") == "5-LOW", 1).otherwise(0)
    moved = links(t).join(envs, "task_id").withColumn("step_index", F.col("step_index") + shift).drop("env_id")
    # The last turn leaks; where the first is empty as well, that comes first.
    leaks = tasks.filter("env_id = '1-URGENT' AND price < 50000").select("task_id", F.col("turns").cast("long").alias("turn_id"))
    reply = F.when((F.col("env_id") == "3-MEDIUM") & (F.col("price") > 300000), " ").otherwise("done")
    asked = tasks.select("task_id", "dialogue_mode", "step_count", reply.alias("final_response"))
    return dg.validate_dialogue(asked, turn_rows(t), moved, leaks, "task_id")


@plan(
    "d5_annotate_trace",
    f"""WITH {SIZED} SELECT task_id, step_index, CASE WHEN step_index = 1 THEN turns ELSE turn_id END AS user_turn_id FROM alloc JOIN sized USING (task_id)""",
)
def _(t: Tables) -> DataFrame:
    # Every last turn also links step 1 again: the later link must win.
    extra = sized(t).filter("step_count > 0").select(
        "task_id", F.col("turns").cast("long").alias("turn_id"), F.lit(1 << 40).alias("link"), F.lit(1).cast("long").alias("step_index")
    )
    both = links(t).unionByName(extra)
    return dg.annotate_trace(src.trace(t).select("task_id", "step_index"), both, "task_id")


def annotated(t: Tables) -> DataFrame:
    return allocated(t).withColumnRenamed("turn_id", "user_turn_id")


@plan(
    "d6_turn_alignment",
    f"WITH {SIZED} SELECT task_id, turn_id, step_index, tool_name FROM turn_rows LEFT JOIN alloc USING (task_id, turn_id)",
)
def _(t: Tables) -> DataFrame:
    return dg.turn_alignment(turn_rows(t).select("task_id", "turn_id"), annotated(t), "task_id")


@plan(
    "d7_realized_dialogue",
    f"""WITH {SIZED} SELECT task_id, turn_id, 0 AS part, 0 AS step_index, 'user' AS role, user_message AS content FROM turn_rows
    UNION ALL SELECT task_id, turn_id, 1, step_index, 'assistant_tool_trace', tool_name FROM alloc
    UNION ALL SELECT task_id, turns, 2, 0, 'assistant', 'done ' || task_id FROM sized""",
)
def _(t: Tables) -> DataFrame:
    finals = src.tasks(t).select("task_id", F.concat(F.lit("done "), F.col("task_id").cast("string")).alias("content"))
    return dg.realized_dialogue(turn_rows(t), annotated(t), finals, "task_id")


@plan(
    "d8_action_budget",
    f"""WITH {SIZED} SELECT task_id, turns + n + 1 AS total_action_turns, CASE WHEN env_id = '5-LOW' THEN 50 ELSE 6 END AS max_allowed_action_turns,
    turns + n + 1 <= CASE WHEN env_id = '5-LOW' THEN 50 ELSE 6 END AS within_budget FROM sized""",
)
def _(t: Tables) -> DataFrame:
    rows = sized(t).withColumn("allowed", F.when(F.col("env_id") != "5-LOW", 6))
    return dg.action_budget(rows, "turns", "step_count", "allowed").select(
        "task_id", "total_action_turns", "max_allowed_action_turns", "within_budget"
    )


PRIORS = ", ".join(f"({i}, '{b}', {p}::DOUBLE)" for i, (b, p) in enumerate(fixed.BEHAVIOR_PRIORS.items()))
SECOND = "CASE primary_behavior " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.SECONDARY_BEHAVIOR.items()) + " END"


@plan(
    "d9_plan_behaviors",
    f"""WITH {TASKS}, ranked AS (SELECT task_id, dialogue_mode, row_number() OVER (ORDER BY dialogue_mode = 'single_turn',
      CASE difficulty_bucket WHEN 'hard' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, task_id) AS rank FROM tasks),
    p AS (SELECT i, b, w, w * (SELECT count(*) FROM tasks) AS raw FROM (VALUES {PRIORS}) v(i, b, w)),
    r AS (SELECT *, floor(raw) AS whole, row_number() OVER (ORDER BY raw - floor(raw) DESC, w DESC, i) AS rk FROM p),
    quota AS (SELECT i, b, whole + CASE WHEN rk <= (SELECT count(*) FROM tasks) - (SELECT sum(whole) FROM r) THEN 1 ELSE 0 END AS n FROM r),
    bounds AS (SELECT b, sum(n) OVER (ORDER BY i) - n AS lo, sum(n) OVER (ORDER BY i) AS hi FROM quota),
    a AS (SELECT task_id, dialogue_mode, rank, b AS primary_behavior FROM ranked JOIN bounds ON rank > lo AND rank <= hi),
    s AS (SELECT *, {SECOND} AS second FROM a), pick AS (SELECT min(rank) AS m FROM s WHERE dialogue_mode = 'multi_turn' AND second IS NOT NULL AND second <> primary_behavior)
    SELECT task_id, rank, primary_behavior || CASE WHEN rank = (SELECT m FROM pick) THEN ',' || second ELSE '' END AS behaviors FROM s""",
)
def _(t: Tables) -> DataFrame:
    rows = src.tasks(t).select("task_id", "dialogue_mode", "difficulty_bucket")
    out = dg.plan_behaviors(rows, "task_id", block_of("task_id"))
    return out.select("task_id", "rank", F.array_join("behavior_bundle", ",").alias("behaviors"))


@plan(
    "d10_dedupe_bundle",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'underspecification' WHEN value > 50 THEN event_type || ',goal_switching' ELSE event_type END AS bundle FROM events""",
)
def _(t: Tables) -> DataFrame:
    blank = F.array(F.lit(" "), F.lit(None).cast("string"))
    named = F.when(F.col("value") > 50, F.array("event_type", F.lit(""), F.lit("goal_switching"), F.col("event_type"))).otherwise(
        F.array("event_type", "event_type")
    )
    raw = F.when(F.col("event_type") == "error", blank).otherwise(named)
    return t.events.select("event_id", F.array_join(dg.dedupe_bundle(raw), ",").alias("bundle"))


USERS = f"""u AS (SELECT conv_id AS task_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_id, text AS user_message FROM conversations WHERE role = 'user')"""
T = {k: (q.quote(a), None if b is None else q.quote(b)) for k, (a, b) in fixed.REWRITE_TEMPLATES.items()}
X = {k: (q.quote(a), q.quote(b)) for k, (a, b) in fixed.EXPANSION_TEMPLATES.items()}
MSG = q.strip("user_message")


def long_turn() -> Column:
    return F.length("user_message") > 120


@plan(
    "d11_apply_templates",
    f"""WITH {USERS} SELECT task_id, turn_id, CASE WHEN length(user_message) > 120
      THEN {T['goal_switching'][0]} || {T['information_overload'][0]} || {MSG} || {T['information_overload'][1]} || {T['goal_switching'][1]}
      ELSE {T['impatience_and_hostility'][0]} || {MSG} || {T['impatience_and_hostility'][1]} END AS rewritten FROM u""",
)
def _(t: Tables) -> DataFrame:
    bundle = F.when(long_turn(), F.array(F.lit("information_overload"), F.lit("goal_switching"))).otherwise(
        F.array(F.lit("impatience_and_hostility"))
    )
    return src.turns(t).select("task_id", "turn_id", dg.apply_templates("user_message", bundle).alias("rewritten"))


@plan(
    "d12_validate_rewrite",
    f"""WITH {USERS}, c AS (SELECT task_id, count(*) AS n, max(length(user_message)) AS longest, min(length(user_message)) AS shortest,
      min(turn_id) FILTER (length(user_message) > 400) AS leaking FROM u GROUP BY task_id)
    SELECT task_id, n AS stable_turns, n - CASE WHEN n > 3 THEN 1 ELSE 0 END AS rewritten_turns,
      CASE WHEN n > 3 THEN 'rewritten turn count must exactly match baseline stable turn count'
        WHEN longest > 400 THEN 'turn ' || leaking || ' leaks hidden tool names or identifiers' WHEN shortest > 120 THEN 'all rewritten turns are identical to the stable baseline' END AS reason FROM c""",
)
def _(t: Tables) -> DataFrame:
    stable = src.turns(t)
    hostile = F.array(F.lit("impatience_and_hostility"))
    rewritten = stable.filter("turn_id <= 3").unionByName(stable.filter("turn_id > 4")).select(
        "task_id", "turn_id",
        F.when(long_turn(), F.col("user_message")).otherwise(dg.apply_templates("user_message", hostile)).alias("user_message"),
    )
    # Dropping the fourth turn makes rewrites of another length on purpose.
    leaks = stable.filter(F.length("user_message") > 400).select("task_id", "turn_id")
    return dg.validate_rewrite(stable, rewritten, leaks, "task_id")


STABLE_CTE = f"""{USERS}, st AS (SELECT task_id, 'conv_' || task_id || '_' || turn_id || '_stable' AS sample_id, 'stable' AS variant, user_message,
  task_id * 1000 + turn_id AS ord FROM u)"""
EXPAND = "CASE b " + " ".join(
    f"WHEN '{k}' THEN {a} || " + (f"split_part({MSG}, '.', 1)" if k == "underspecification" else MSG) + f" || {z}"
    for k, (a, z) in X.items()
) + " END"
BEH = "[" + ", ".join(q.quote(b) for b in fixed.BEHAVIORS) + "]"


def stable(t: Tables) -> DataFrame:
    return src.turns(t).select(
        "task_id",
        F.concat_ws("_", F.lit("conv"), F.col("task_id").cast("string"), F.col("turn_id").cast("string"), F.lit("stable")).alias("sample_id"),
        F.lit("stable").alias("variant"),
        "user_message",
        (F.col("task_id") * 1000 + F.col("turn_id")).alias("ord"),
    )


@plan(
    "d13_expand_variants",
    f"""WITH {STABLE_CTE} SELECT replace(sample_id, '_stable', '') || '_' || b AS sample_id, sample_id AS source_sample_id, b AS unstable_behavior, {EXPAND} AS user_message
    FROM st, unnest({BEH}) x(b)""",
)
def _(t: Tables) -> DataFrame:
    return dg.expand_variants(stable(t)).select("sample_id", "source_sample_id", "unstable_behavior", "user_message")


@plan(
    "d14_hostile_variants",
    f"""WITH {STABLE_CTE}, p AS (SELECT * FROM st ORDER BY sha256('42:' || sample_id), sample_id LIMIT 20)
    SELECT replace(sample_id, '_stable', '_ih') AS sample_id, sample_id AS source_sample_id, 'impatience_and_hostility' AS unstable_behavior,
      {q.quote(fixed.HOSTILE_TEMPLATE[0])} || {q.strip('user_message')} || {q.quote(fixed.HOSTILE_TEMPLATE[1])} AS user_message FROM p""",
)
def _(t: Tables) -> DataFrame:
    return dg.hostile_variants(stable(t), 20, seed=42).select(
        "sample_id", "source_sample_id", "unstable_behavior", "user_message"
    )


@plan(
    "d15_interleave_full",
    f"""WITH {STABLE_CTE} SELECT ord, -1 AS behavior_order, sample_id, variant, '' AS unstable_behavior, user_message FROM st
    UNION ALL SELECT ord, i - 1, replace(sample_id, '_stable', '') || '_' || b, 'unstable', b, {EXPAND} FROM (SELECT *, unnest({BEH}) AS b, generate_subscripts({BEH}, 1) AS i FROM st)
    ORDER BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    base = stable(t)
    return dg.interleave_full(base, dg.expand_variants(base), "ord")


@plan(
    "d16_coverage",
    f"""WITH {TASKS}, e AS (SELECT DISTINCT config_id, task_id FROM tasks),
    r AS (SELECT DISTINCT config_id, task_id, dialogue_mode, difficulty_bucket FROM tasks JOIN lineitem ON l_orderkey = task_id WHERE l_returnflag = 'N')
    SELECT e.config_id, count(*) AS expected_count, count(r.task_id) AS realized_count, count(*) - count(r.task_id) AS missing_count,
      array_to_string(coalesce(list(DISTINCT dialogue_mode ORDER BY dialogue_mode) FILTER (dialogue_mode IS NOT NULL), []), ',') AS modes_present,
      array_to_string(coalesce(list(DISTINCT difficulty_bucket ORDER BY difficulty_bucket) FILTER (difficulty_bucket IS NOT NULL), []), ',') AS buckets_present,
      count(*) = count(r.task_id) AS coverage_passed FROM e LEFT JOIN r USING (config_id, task_id) GROUP BY e.config_id""",
)
def _(t: Tables) -> DataFrame:
    out = dg.coverage(src.tasks(t), realized(t), "config_id", "task_id")
    return out.withColumn("modes_present", F.array_join("modes_present", ",")).withColumn(
        "buckets_present", F.array_join("buckets_present", ",")
    )


def realized(t: Tables) -> DataFrame:
    spoken = t.lineitem.filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("task_id"))
    return src.tasks(t).join(spoken, "task_id").select("config_id", "task_id", "dialogue_mode", "difficulty_bucket")


@plan(
    "d16_missing_tasks",
    """SELECT o_custkey AS config_id, o_orderkey AS task_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')""",
)
def _(t: Tables) -> DataFrame:
    return dg.missing_tasks(src.tasks(t), realized(t), "config_id", "task_id")


@plan(
    "d17_bundle_counts",
    """SELECT token, count(*) AS n FROM (SELECT unnest([lang, source, CASE WHEN n_chars > 2000 THEN lang ELSE ' ' END]) AS token FROM documents) WHERE trim(token) <> '' GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    tokens = F.array("lang", "source", F.when(F.col("n_chars") > 2000, F.col("lang")).otherwise(" "))
    return dg.bundle_counts(t.documents.select(tokens.alias("bundle")), "bundle")


@plan(
    "d18_format_transcript",
    f"""SELECT conv_id, (i - 1) // 1000 AS part, string_agg(i || '. ' || role || ': ' || {q.strip('text')}, chr(10) ORDER BY i) AS transcript
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return dg.format_transcript(t.conversations, "conv_id", "turn", "role", "text", block_of("turn", 4096))


@plan(
    "d18_tool_sequence",
    """SELECT user_id, (i - 1) // 1000 AS part, string_agg(i || '. ' || event_type || ': ' || CASE WHEN event_type IN ('signup', 'purchase') THEN 'write' ELSE 'read' END, chr(10) ORDER BY i) AS transcript
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "write").otherwise("read")
    rows = t.events.select("user_id", "event_id", "event_type", kind.alias("kind"))
    return dg.format_transcript(rows, "user_id", "event_id", "event_type", "kind", block_of("event_id"))


@plan(
    "d19_choose_or_fallback",
    f"""WITH {USERS}, f AS (SELECT task_id * 1000 + turn_id AS task, {MSG} AS m, length(user_message) AS n FROM u)
    SELECT task, CASE WHEN n > 200 THEN 'rewritten: ' || m WHEN n > 60 THEN {T['impatience_and_hostility'][0]} || m || {T['impatience_and_hostility'][1]} END AS text,
      n <= 200 AND n > 60 AS used_fallback, CASE WHEN n <= 60 THEN 'too short' END AS failure_reason FROM f""",
)
def _(t: Tables) -> DataFrame:
    rows = src.turns(t).select((F.col("task_id") * 1000 + F.col("turn_id")).alias("task"), "user_message")
    size = F.length("user_message")
    own = rows.select(
        "task", F.concat(F.lit("rewritten: "), tx.strip("user_message")).alias("text"), F.when(size <= 200, "rejected").alias("reason")
    )
    spare = rows.select(
        "task", dg.apply_templates("user_message", F.array(F.lit("impatience_and_hostility"))).alias("text"),
        F.when(size <= 60, "too short").alias("reason"),
    )
    return dg.choose_or_fallback(own, spare, "task")
