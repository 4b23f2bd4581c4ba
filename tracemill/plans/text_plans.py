"""Text-to-column and incremental queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.operators import incremental, textcols
from tracemill.operators.running import block_of
from tracemill.plans import sqltext as q
from tracemill.plans.registry import plan
from tracemill.sources import gold
from tracemill.sources.tables import Tables


@plan(
    "x1_extract_sections",
    f"""SELECT doc_id, lang <> 'de' AS parsed_ok, CASE WHEN lang <> 'de' THEN {q.strip('text')} END AS analysis,
    CASE WHEN lang = 'en' THEN true WHEN lang = 'fr' THEN false END AS verdict FROM documents""",
)
def _(t: Tables) -> DataFrame:
    answer = F.when(F.col("lang") == "en", "YES").when(F.col("lang") == "fr", "NO, not this one").otherwise("maybe")
    mark = F.when(F.col("lang") == "de", "# Reply").otherwise("# Answer")
    raw = F.concat(F.lit("Intro\n# Analysis\n"), "text", F.lit("\n\n"), mark, F.lit("\n"), answer)
    parsed = textcols.extract_sections(
        t.documents.select("doc_id", raw.alias("raw")), "raw", {"analysis": "# Analysis", "answer": "# Answer"}
    )
    return parsed.select("doc_id", "parsed_ok", "analysis", textcols.yes_no("answer").alias("verdict"))


@plan(
    "x1_optional_section",
    f"""SELECT doc_id, true AS parsed_ok, {q.strip('text')} AS analysis, CASE WHEN lang = 'en' THEN 'T1, S2' ELSE 'none' END AS codes FROM documents""",
)
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("# Analysis\n"), "text", F.when(F.col("lang") == "en", "\n# Conflict Codes\n T1, S2 \n").otherwise(""))
    sections = {"analysis": "# Analysis", "codes": "# Conflict Codes"}
    rows = t.documents.select("doc_id", raw.alias("raw"))
    return textcols.extract_sections(rows, "raw", sections, optional={"codes": "none"}).drop("raw")


@plan(
    "x2_extract_scores",
    "SELECT doc_id, n_chars::INT AS usefulness, CASE WHEN lang = 'en' THEN length(source) END AS modelability FROM documents",
)
def _(t: Tables) -> DataFrame:
    level = F.when(F.col("lang") == "en", F.length("source").cast("string")).otherwise("unknown")
    raw = F.concat(F.col("text"), F.lit("\n# Metrics\nUsefulness:  "), F.col("n_chars").cast("string"), F.lit(" points\nModelability: "), level)
    rows = t.documents.select("doc_id", raw.alias("raw"))
    return rows.select(
        "doc_id",
        textcols.extract_score("raw", "Usefulness").alias("usefulness"),
        textcols.extract_score("raw", "Modelability").alias("modelability"),
    )


@plan(
    "x3_extract_bullets",
    """SELECT s_suppkey, 'Supplier' AS entity, 'key, ' || s_name AS attributes, 'a supplier' AS description FROM supplier
    UNION ALL SELECT s_suppkey, 'Balance', 'amount', 'worth ' || CAST(s_acctbal AS VARCHAR) FROM supplier""",
)
def _(t: Tables) -> DataFrame:
    raw = F.concat(
        F.lit("State:\n- Entity: Supplier\n  - Attributes: key, "), "s_name", F.lit("\n - Description: a supplier\n\n- Entity: Broken\n"),
        F.lit("- Entity: Balance\n- Attributes: amount\n- Description: worth "), F.col("s_acctbal").cast("string"), F.lit("\n"),
    )
    return textcols.state_bullets(t.supplier.select("s_suppkey", raw.alias("raw")), ["s_suppkey"], "raw").drop("position")


@plan(
    "x3_operation_bullets",
    "SELECT p_partkey, 'get_' || p_type AS operation_name, 'reads ' || p_name AS operation_description, 'query' AS operation_type FROM part",
)
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("- Operation: get_"), "p_type", F.lit("\n  Description: reads "), "p_name", F.lit("\n- Operation: none\n"))
    rows = t.part.select("p_partkey", raw.alias("raw"))
    return textcols.operation_bullets(rows, ["p_partkey"], "raw", "query").drop("position")


@plan(
    "x4_extract_json",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN '{"k":' || k || '}' ELSE '{"k":' || k || ',"t":"a}b"}' END AS found,
    CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN '{"k":' || k || '}' WHEN event_type = 'error' THEN '{"k":' || k || '}' ELSE '{"k":' || k || ',"t":"a}b"}' END AS config
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)""",
)
def _(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    plain = F.concat(F.lit('Here: {"t": "a}b", "k": '), k, F.lit("} and {more}"))
    fenced = F.concat(F.lit('Not {this}\n```json\n{"t": "a}b", "k": '), k, F.lit(",}\n```\nbye"))
    quoted = F.concat(F.lit("Use {'t': 'a}b', 'k': "), k, F.lit("} ok"))
    listed = F.concat(F.lit('list: [{"k": '), k, F.lit("}, 2] end"))
    raw = (
        F.when(kind == "signup", plain).when(kind == "purchase", fenced).when(kind == "error", quoted).when(kind == "click", listed).otherwise("no json here")
    )
    wrapped = F.when(kind == "error", F.concat(F.lit('{"config": {"k": '), k, F.lit("}}"))).otherwise(raw)
    rows = t.events.select("event_id", raw.alias("raw"), wrapped.alias("wrapped"))
    return rows.select(
        "event_id", textcols.extract_json("raw").alias("found"), textcols.extract_config("wrapped").alias("config")
    )


@plan(
    "x5_extract_tool_calls",
    """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
    SELECT event_id, CASE event_type WHEN 'signup' THEN 'tagged' WHEN 'purchase' THEN 'python_tag' WHEN 'click' THEN 'json' WHEN 'view' THEN 'json_list' ELSE 'none' END AS call_format,
      CASE event_type WHEN 'signup' THEN 'signup{"k":' || k || '};other{}' WHEN 'purchase' THEN 'purchase{"k": ' || k || '}' WHEN 'click' THEN 'click{"k":' || k || '}'
        WHEN 'view' THEN 'view{};view{"k":' || k || '}' ELSE '' END AS calls,
      CASE event_type WHEN 'signup' THEN 'before  after' WHEN 'purchase' THEN 'so' WHEN 'error' THEN 'just text ' || k ELSE '' END AS remaining_text FROM e""",
)
def _(t: Tables) -> DataFrame:
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    args = F.concat(F.lit('{"k": '), k, F.lit("}"))
    tagged = F.concat(
        F.lit('<think>hmm <tool_call></think>before <tool_call>\n{"name": "signup", "arguments": '), args,
        F.lit('}</tool_call> <tool_call>broken</tool_call><tool_call>{"name": "other"}</tool_call>after'),
    )
    # Arguments encoded as a string stay as they are.
    python = F.concat(F.lit('so <|python_tag|>{"name": "purchase", "parameters": "{\\"k\\": '), k, F.lit('}"}<|eom_id|>'))
    single = F.concat(F.lit(' {"name": "click", "parameters": {}, "arguments": '), args, F.lit("} "))
    many = F.concat(F.lit('[{"name": "view"}, 7, {"name": "view", "arguments": '), args, F.lit("}]"))
    raw = (
        F.when(kind == "signup", tagged).when(kind == "purchase", python).when(kind == "click", single).when(kind == "view", many)
        .otherwise(F.concat(F.lit("<think>x</think> just text "), k))
    )
    rows = t.events.select("event_id", textcols.strip_thinking(raw).alias("raw"))
    parsed = textcols.extract_tool_calls(rows, "raw")
    calls = F.array_join(F.transform("tool_calls", lambda c: F.concat(c["name"], c["arguments"])), ";")
    return parsed.select("event_id", "call_format", calls.alias("calls"), "remaining_text")


BEHAVIORS = "[" + ", ".join(q.quote(b) for b in fixed.BEHAVIORS) + "]"


@plan(
    "t1_resume",
    f"""SELECT doc_id, b AS behavior FROM documents, unnest({BEHAVIORS}) u(b) WHERE NOT EXISTS
    (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND (quality = 1 OR b = 'goal_switching'))""",
)
def _(t: Tables) -> DataFrame:
    listed = F.array(*[F.lit(b) for b in fixed.BEHAVIORS])
    work = t.documents.select("doc_id", F.explode(listed).alias("behavior"))
    finished = F.when(F.col("quality") == 1, listed).otherwise(F.array(F.lit("goal_switching")))
    done = t.labels.select("doc_id", F.explode(finished).alias("behavior"))
    return incremental.resume(work, done, ["doc_id", "behavior"])


@plan(
    "t2_arm_then_fire",
    """WITH c AS (SELECT user_id AS run_id, event_type AS tool, CAST(json_extract(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    armed AS (SELECT run_id, 'late_purchase' AS event_id, min(i) AS armed_at FROM c WHERE tool = 'signup' GROUP BY run_id
      UNION ALL SELECT run_id, 'any_error', 0 FROM c GROUP BY run_id UNION ALL SELECT run_id, 'lucky', min(i) FROM c WHERE tool IN ('click', 'view') AND k = 7 GROUP BY run_id),
    fired AS (SELECT a.run_id, a.event_id, min(i) AS fired_at FROM armed a JOIN c ON a.run_id = c.run_id
      WHERE (event_id = 'late_purchase' AND tool = 'purchase' AND i > armed_at + 5) OR (event_id = 'any_error' AND tool = 'error' AND i > armed_at + 10) OR (event_id = 'lucky' AND i > armed_at + 3)
      GROUP BY 1, 2)
    SELECT run_id, event_id, armed_at, fired_at FROM armed LEFT JOIN fired USING (run_id, event_id)""",
)
def _(t: Tables) -> DataFrame:
    calls = gold.calls(t).select("run_id", "pos", "tool", "arguments")
    return incremental.arm_then_fire(trigger_rules(t), calls, block_of("pos"))


def trigger_rules(t: Tables) -> DataFrame:
    """Three rules for every run."""
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")

    def rule(event_id, on, on_args, fire, delay):
        return F.struct(
            F.lit(event_id).alias("event_id"), on.alias("activation_tools"), F.lit(on_args).alias("activation_args"),
            fire.alias("fire_tools"), F.lit("{}").alias("fire_args"), F.lit(delay).alias("delay"),
        )

    rules = F.array(
        rule("late_purchase", texts("signup"), "{}", texts("purchase"), 5),
        rule("any_error", texts(), "{}", texts("error"), 10),
        rule("lucky", texts("click", "view"), '{"k": 7}', texts(), 3),
    )
    runs = t.events.select(F.col("user_id").alias("run_id")).distinct()
    return runs.select("run_id", F.explode(rules).alias("_r")).select("run_id", "_r.*")


SQL_REPLAY = """WITH RECURSIVE c AS (
  SELECT user_id AS run_id, event_type AS tool, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS INT) % 5 = 0 AS raised,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events
), s AS (
  SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS h, CAST(NULL AS BIGINT) AS a0, CAST(NULL AS BIGINT) AS l0, CAST(NULL AS BIGINT) AS f0,
    CAST(NULL AS BIGINT) AS a1, CAST(NULL AS BIGINT) AS l1, CAST(NULL AS BIGINT) AS f1, CAST(NULL AS BIGINT) AS f2, CAST(NULL AS BIGINT) AS a3, CAST(NULL AS BIGINT) AS l3,
    CAST(NULL AS BIGINT) AS f3 FROM c
  UNION ALL
  SELECT run_id, i, h + CAST((e0 OR e2 OR NOT raised) AS INT),
    CASE WHEN a0 IS NULL AND NOT (e0 OR e2 OR raised) AND tool = 'signup' THEN i ELSE a0 END, CASE WHEN a0 IS NULL AND NOT (e0 OR e2 OR raised) AND tool = 'signup' THEN h + 1 ELSE l0 END,
    CASE WHEN e0 THEN i ELSE f0 END,
    CASE WHEN a1 IS NULL AND NOT (e0 OR e2 OR raised) AND tool = 'view' THEN i ELSE a1 END, CASE WHEN a1 IS NULL AND NOT (e0 OR e2 OR raised) AND tool = 'view' THEN h + 1 ELSE l1 END,
    CASE WHEN e1 THEN i ELSE f1 END, CASE WHEN e2 THEN i ELSE f2 END,
    CASE WHEN a3 IS NULL AND NOT (e0 OR e2 OR raised) AND tool IN ('click', 'view') AND k = 7 THEN i ELSE a3 END,
    CASE WHEN a3 IS NULL AND NOT (e0 OR e2 OR raised) AND tool IN ('click', 'view') AND k = 7 THEN h + 1 ELSE l3 END, CASE WHEN e3 THEN i ELSE f3 END
  FROM (SELECT *, NOT e0 AND NOT e2 AND f3 IS NULL AND a3 IS NOT NULL AND h - l3 >= 1 AS e3 FROM (SELECT *, NOT e0 AND f1 IS NULL AND a1 IS NOT NULL AND h - l1 >= 1 AND tool = 'purchase' AS e1,
      NOT e0 AND f2 IS NULL AND h >= 3 AND tool IN ('error', 'purchase') AS e2
    FROM (SELECT s.*  EXCLUDE (i), c.i, c.tool, c.k, c.raised, f0 IS NULL AND a0 IS NOT NULL AND h - l0 >= 2 AND tool = 'purchase' AS e0 FROM s JOIN c ON c.run_id = s.run_id AND c.i = s.i + 1) x) y) z
), d AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY i DESC) AS n FROM s)
SELECT run_id, event_id, armed_at, fired_at FROM (
  SELECT run_id, unnest(['late_purchase', 'shadow_purchase', 'any_error', 'lucky']) AS event_id, unnest([a0, a1, 0, a3]) AS armed_at, unnest([f0, f1, f2, f3]) AS fired_at
  FROM d WHERE n = 1) WHERE armed_at IS NOT NULL"""


@plan("t2_error_rules", SQL_REPLAY)
def _(t: Tables) -> DataFrame:
    """Rules of both kinds, two of them on one tool, and calls that raise."""
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")

    def rule(event_id, place, on, on_args, fire, delay, effect):
        return F.struct(
            F.lit(event_id).alias("event_id"), F.lit(place).alias("place"), on.alias("activation_tools"), F.lit(on_args).alias("activation_args"), fire.alias("fire_tools"),
            F.lit("{}").alias("fire_args"), F.lit(delay).alias("delay"), F.lit(effect).cast("string").alias("effect_type"),
        )

    rules = F.array(
        rule("late_purchase", 0, texts("signup"), "{}", texts("purchase"), 2, fixed.ERROR_EFFECT),
        rule("shadow_purchase", 1, texts("view"), "{}", texts("purchase"), 1, "state_update"),
        rule("any_error", 2, texts(), "{}", texts("error", "purchase"), 3, None),
        rule("lucky", 3, texts("click", "view"), '{"k": 7}', texts(), 1, "state_update"),
    )
    runs = t.events.select(F.col("user_id").alias("run_id")).distinct()
    calls = gold.calls(t).select("run_id", "pos", "tool", "arguments", (F.get_json_object("arguments", "$.k").cast("int") % 5 == 0).alias("raised"))
    return incremental.replay_rules(runs.select("run_id", F.explode(rules).alias("_r")).select("run_id", "_r.*"), calls, block_of("pos"))
