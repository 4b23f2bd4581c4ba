"""Task blueprints and gold traces: validation, leak checks, coverage, graph nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.functions import text as tx
from tracemill.operators.running import running_before, with_position, with_previous

MAX_PLAN = 6


def min_action_turns(given: Column, user_turns: Column, tool_steps: Column) -> Column:
    """A positive given value wins, else user turns + tool steps + the final reply."""
    return F.when(given > 0, given).otherwise(user_turns + tool_steps + 1)


def _texts(c: str) -> Column:
    values = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: tx.clean(x))
    return F.filter(values, lambda x: x.isNotNull())


def leaked_tools(text: Column, tools: Column) -> Column:
    """Tool names found inside a text, ignoring case."""
    body = F.lower(text)
    return F.filter(tools, lambda x: (x != "") & F.contains(body, F.lower(x)))


def leaked_entities(text: Column, entities: Column) -> Column:
    """Identifier-like entities found inside a text, ignoring case."""
    body = F.lower(text)
    trimmed = F.transform(entities, tx.strip)
    return F.filter(trimmed, lambda x: (x != "") & tx.looks_like_identifier(x) & F.contains(body, F.lower(x)))


def micro_turns(tasks: Column, entities: Column, default_type: Column, limit: int | None = None) -> Column:
    """Usable turn entries: trimmed, typed, with the blueprint's entities as default."""
    head = tasks if limit is None else F.slice(tasks, 1, limit)

    def tidy(x: Column) -> Column:
        kind = tx.clean(x["task_type"])
        return F.struct(
            tx.clean(x["task_summary"]).alias("task_summary"),
            tx.clean(x["expected_outcome"]).alias("expected_outcome"),
            F.when(kind.isin(fixed.TASK_TYPES), kind).otherwise(default_type).alias("task_type"),
            F.filter(F.coalesce(x["required_entities"], entities), lambda e: tx.strip(e) != "").alias("required_entities"),
        )

    return F.filter(
        F.transform(head, tidy), lambda x: x["task_summary"].isNotNull() & x["expected_outcome"].isNotNull()
    )


def plan_facts(steps: DataFrame, tools: DataFrame, task: str, env: str) -> DataFrame:
    """Per task: ``step_count`` and the first step that cannot run, ``bad_step(step, tool, known)``.

    ``steps(task, env, step, tool_name, arguments)`` holds plans of any length as rows;
    ``tools(env, tool_name)`` are the environments' own tools.
    """
    known = tools.select(env, "tool_name").distinct().withColumn("_known", F.lit(True))
    tool = tx.clean("tool_name", "")
    judged = steps.withColumn("tool_name", tool).join(known, [env, "tool_name"], "left")
    is_object = F.coalesce(F.startswith(F.to_json(F.try_parse_json("arguments")), F.lit("{")), F.lit(False))
    bad = F.col("_known").isNull() | ~is_object
    entry = F.struct("step", F.col("tool_name").alias("tool"), F.col("_known").isNotNull().alias("known"))
    return judged.groupBy(task).agg(
        F.count(F.lit(1)).alias("step_count"), F.min_by(F.when(bad, entry), F.when(bad, F.col("step"))).alias("bad_step")
    )


def validate_blueprint(df: DataFrame) -> DataFrame:
    """Add ``reason``: the first broken rule, or null.

    ``step_count`` and ``bad_step`` come from :func:`plan_facts`; a null ``step_count`` means that the plan is
    no list.  ``known_tools`` is the environment's own tool list.
    """
    goal, request, outcome = tx.clean("goal_summary"), tx.clean("user_request"), tx.clean("expected_final_outcome")
    mode = tx.clean("dialogue_mode", "single_turn")
    bucket = tx.clean("difficulty_bucket", "medium")
    task_type = tx.clean("task_type", "execute")
    calls = tx.col("tool_call_budget").cast("string").try_cast("int")
    actions = tx.col("agent_action_budget").cast("string").try_cast("int")
    none = F.array().cast("array<string>")
    entities = F.coalesce("relevant_entities", none)
    turns = F.col("_turns")
    steps = F.col("step_count")
    # Named columns keep the costly pieces from being evaluated once per rule.
    staged = df.withColumns(
        {
            "_turns": micro_turns(F.col("multi_turn_tasks"), entities, task_type, limit=3),
            "_leaks": (F.size(leaked_tools(request, F.col("known_tools"))) > 0)
            | (F.size(leaked_entities(request, entities)) > 0),
        }
    )
    bad = F.col("bad_step")
    bad_step = F.when(
        bad["known"],
        F.concat(F.lit("tool_plan step "), bad["step"].cast("string"), F.lit(" arguments must be an object")),
    ).otherwise(
        F.concat(F.lit("tool_plan step "), bad["step"].cast("string"), F.lit(" uses unknown tool '"), bad["tool"], F.lit("'"))
    )
    reason = (
        F.when(goal.isNull() | request.isNull() | outcome.isNull(), "candidate is missing goal_summary, user_request, or expected_final_outcome")
        .when(~mode.isin(fixed.DIALOGUE_MODES), "dialogue_mode must be single_turn or multi_turn")
        .when(~bucket.isin(fixed.DIFFICULTY_BUCKETS), "difficulty_bucket must be easy, medium, or hard")
        .when(~task_type.isin(fixed.TASK_TYPES), "task_type must be execute, clarify_then_execute, or refuse_or_scope")
        .when(calls.isNull(), "tool_call_budget must be an integer")
        .when(~calls.between(0, 6), "tool_call_budget must be within 0-6")
        .when(actions.isNull(), "agent_action_budget must be an integer")
        .when(~actions.between(1, 50), "agent_action_budget must be within 1-50")
        .when(F.size(_texts("expected_phases")) == 0, "expected_phases must contain at least one non-empty item")
        .when((mode == "multi_turn") & F.col("multi_turn_tasks").isNull(), "multi_turn_tasks must be a list for multi_turn tasks")
        .when((mode == "multi_turn") & (F.size(turns) < 2), "multi_turn tasks need at least two coherent turn entries")
        .when(steps.isNull(), "tool_plan must be a list")
        .when(steps > MAX_PLAN, "tool_plan length must be within 0-6")
        .when((steps == 0) & (task_type == "execute"), "execute tasks must contain at least one tool step")
        .when(
            (steps == 0) & (task_type == "clarify_then_execute") & (F.size(_texts("clarification_requirements")) == 0),
            "clarify_then_execute tasks without tool steps must include clarification_requirements",
        )
        .when(
            (steps == 0) & (task_type == "refuse_or_scope") & (F.size(_texts("refusal_requirements")) == 0),
            "refuse_or_scope tasks without tool steps must include refusal_requirements",
        )
        .when(bad.isNotNull(), bad_step)
        .when(calls < steps, "tool_call_budget is smaller than the proposed tool plan length")
        .when(F.col("_leaks"), "user_request leaks hidden tool names or identifiers")
    )
    return staged.withColumn("reason", reason).drop("_turns", "_leaks")


# --- containment join -------------------------------------------------------------------------
#
# "needle occurs in text" has no equi-key.  Tokens strictly inside a needle are whole tokens of
# any text that contains it, and so are its runs of characters, so both sides can compute grams
# of these.  A needle is looked up by the one of its grams that fewest texts have; a needle with a gram that
# no text has occurs nowhere.  Every candidate is then verified.

_WORDS = {"w5": 5, "w2": 2, "w1": 1}
_CHARS = {"c8": 8, "c3": 3, "c1": 1}


def _tokens(c: Column) -> Column:
    return F.split(F.lower(c), r"(?U)\s+")


def _anchor_level(needle: Column) -> Column:
    inner, size = F.size(_tokens(needle)) - 2, F.length(needle)
    words = F.when(inner >= 5, "w5").when(inner >= 2, "w2").when(inner >= 1, "w1")
    return words.when(size >= 8, "c8").when(size >= 3, "c3").otherwise("c1")


def _word_grams(hashed: Column, n: int) -> Column:
    """Hashes of runs of ``n`` token hashes."""
    starts = F.sequence(F.lit(0), F.size(hashed) - n)
    grams = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(n)]))
    return F.when(F.size(hashed) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>"))


def _char_grams(body: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(body) - (n - 1))
    grams = F.transform(starts, lambda i: F.xxhash64(F.substr(body, i, F.lit(n))))
    return F.when(F.length(body) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>"))


def _grams(text: Column, level: str) -> Column:
    hashed = F.transform(_tokens(text), lambda w: F.xxhash64(w))
    if level in _WORDS:
        return tx.let(hashed, lambda items: _word_grams(items, _WORDS[level]))
    return tx.let(F.lower(text), lambda body: _char_grams(body, _CHARS[level]))


def _needle_grams(needle: Column, level: Column) -> Column:
    """All grams of a needle at its level; of its tokens only those strictly inside."""
    hashed = F.transform(_tokens(needle), lambda w: F.xxhash64(w))
    inner = F.slice(hashed, F.lit(2), F.greatest(F.size(hashed) - 2, F.lit(0)))
    out = F.when(level == "w5", _word_grams(inner, 5)).when(level == "w2", _word_grams(inner, 2)).when(level == "w1", _word_grams(inner, 1))
    body = F.lower(needle)
    return out.when(level == "c8", _char_grams(body, 8)).when(level == "c3", _char_grams(body, 3)).otherwise(_char_grams(body, 1))


def containment_join(
    texts: DataFrame, needles: DataFrame, text_id: str, text: str, needle_id: str, needle: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Exact pairs ``(*keys, text_id, needle_id)`` where the needle occurs in the text, ignoring case.

    Two passes over the texts: how many have each gram of a needle, partially aggregated, and which
    have the rarest gram of each needle.  Only ids and hashes are exploded and shuffled; texts are joined
    back for the candidates.  Texts produce the gram sizes that some needle has; which, a scalar subquery says.
    """
    keys = list(keys)
    bodies = texts.select(*keys, text_id, text)
    return (
        anchored(texts, needles, text_id, text, needle_id, needle, keys)
        .join(bodies, [*keys, text_id])
        .filter(F.contains(F.lower(text), F.lower("_needle")))
        .select(*keys, text_id, needle_id)
    )


def anchored(
    texts: DataFrame, needles: DataFrame, text_id: str, text: str, needle_id: str, needle: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Candidates ``(*keys, text_id, needle_id, _needle)``: texts that have the rarest gram of a needle."""
    keys = list(keys)
    wanted = needles.select(*keys, needle_id, tx.strip(needle).alias("_needle")).filter("_needle <> ''")
    wanted = wanted.withColumn("_level", _anchor_level(F.col("_needle")))
    levels = wanted.agg(F.collect_set("_level")).scalar()
    grams = F.concat(*[_leveled(text, level, levels) for level in [*_WORDS, *_CHARS]])
    exploded = texts.select(*keys, text_id, F.explode(grams).alias("_g")).select(
        *keys, text_id, F.col("_g.level").alias("_level"), F.col("_g.h").alias("_h")
    )
    key = [*keys, "_level", "_h"]
    held = wanted.select(*keys, needle_id, "_needle", "_level", F.explode(_needle_grams(F.col("_needle"), F.col("_level"))).alias("_h"))
    counts = exploded.join(held.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count("*").alias("_n"))
    # A gram that no text has counts 0 and is the rarest; it then finds no text.
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_h").alias("h"))).alias("_least")
    anchors = held.join(counts, key, "left").groupBy(*keys, needle_id, "_needle", "_level").agg(rarest)
    anchors = anchors.filter("_least.n > 0").select(*keys, needle_id, "_needle", "_level", F.col("_least.h").alias("_h"))
    return exploded.join(anchors, key).select(*keys, text_id, needle_id, "_needle")


def _leveled(text: str, level: str, levels: Column) -> Column:
    found = F.transform(_grams(F.col(text), level), lambda h: F.struct(F.lit(level).alias("level"), h.alias("h")))
    return F.when(F.array_contains(levels, level), found).otherwise(F.array().cast("array<struct<level:string,h:bigint>>"))


def hidden_identifiers(leaves: DataFrame, exposed: DataFrame) -> DataFrame:
    """Identifier-like strings of a trace that no exposed text of the task mentions.

    ``leaves(task_id, kind, value)`` come from arguments, observations and diffs;
    ``exposed(task_id, text)`` holds the request and the user turns.
    """
    strings = F.col("kind") == "string"
    tokens = leaves.filter(strings & tx.looks_like_hidden_identifier("value")).select("task_id", "value").distinct()
    shown = exposed.withColumn("_t", F.xxhash64("text"))
    seen = containment_join(shown, tokens, "_t", "text", "value", "value", ["task_id"])
    return tokens.join(seen, ["task_id", "value"], "left_anti")


def blueprint_fingerprint(goal: str, request: str, plan: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(F.col(goal).alias("g"), F.col(request).alias("r"), tx.col(plan).alias("p"))), 256)


def reject_duplicates(df: DataFrame, env: str, fingerprint: str, order: str) -> DataFrame:
    """Flag every candidate whose fingerprint appeared earlier in its environment."""
    first = df.groupBy(env, fingerprint).agg(F.min(order).alias("_first"))
    return df.join(first, [env, fingerprint]).withColumn("is_duplicate", F.col(order) > F.col("_first")).drop("_first")


def running_coverage_target(
    df: DataFrame, env: str, order: str, block: Column, target: int, min_buckets: int = 2, accepted: str | None = None
) -> DataFrame:
    """What the next blueprint of an environment has to cover, given the accepted ones before it.

    ``accepted`` names a boolean column; candidates that were rejected do not count as progress.
    """
    counts = F.lit(True) if accepted is None else F.coalesce(F.col(accepted), F.lit(False))
    flag = lambda c, v: F.when(counts & (F.col(c) == v), 1).otherwise(0)
    modes = {f"_m{i}": flag("dialogue_mode", m) for i, m in enumerate(fixed.DIALOGUE_MODES)}
    buckets = {f"_b{i}": flag("difficulty_bucket", b) for i, b in enumerate(fixed.DIFFICULTY_BUCKETS)}
    out = running_before(df, [env], [order], block, sums={"_done": F.when(counts, 1).otherwise(0)}, maxes={**modes, **buckets})
    out = out.withColumn("_done", F.col("_done").cast("int"))

    def listed(names: list[str], prefix: str, present: bool) -> Column:
        picks = [
            F.when(F.coalesce(f"{prefix}{i}", F.lit(0)) == (1 if present else 0), v) for i, v in enumerate(names)
        ]
        return F.filter(F.array(*picks), lambda x: x.isNotNull())

    out = out.withColumn("missing_modes", listed(fixed.DIALOGUE_MODES, "_m", False))
    out = out.withColumn("present_buckets", listed(fixed.DIFFICULTY_BUCKETS, "_b", True))
    open_buckets = listed(fixed.DIFFICULTY_BUCKETS, "_b", False)
    remaining = F.lit(target) - F.col("_done")
    lacking = F.greatest(F.lit(0), F.lit(min_buckets) - F.size("present_buckets"))
    slots = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"), F.lit(m).alias("mode"), F.lit(b).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")
            )
            for n, m, b, lo, hi in fixed.COVERAGE_SLOTS
        ]
    )
    slot = F.when((F.lit(target) >= 4) & (F.col("_done") < 4), F.get(slots, F.col("_done")))
    out = out.withColumn("_slot", slot).withColumn("require_new_bucket", (lacking > 0) & (remaining <= lacking))
    return out.select(
        *[c for c in df.columns if c != "accepted"],
        F.col("_done").cast("long").alias("accepted"),
        F.col("_slot.name").alias("slot_name"),
        "missing_modes",
        "present_buckets",
        "require_new_bucket",
        F.coalesce("_slot.mode", F.get("missing_modes", F.lit(0))).alias("required_mode"),
        F.coalesce(
            "_slot.bucket", F.when(F.col("require_new_bucket"), F.get(open_buckets, F.lit(0)))
        ).alias("required_bucket"),
        F.col("_slot.lo").alias("min_calls"),
        F.col("_slot.hi").alias("max_calls"),
    )


def check_against_target(df: DataFrame, plan_size: Column | str) -> DataFrame:
    """First reason a candidate misses its coverage target, or null."""
    size = tx.col(plan_size)
    must = lambda what, c: F.concat(F.lit(f"candidate {what} must be '"), F.col(c), F.lit("' for current coverage target"))
    length = lambda text, c: F.concat(F.lit("candidate tool_plan length "), size.cast("string"), F.lit(text), F.col(c).cast("string"))
    reason = (
        F.when(F.col("dialogue_mode") != F.col("required_mode"), must("dialogue_mode", "required_mode"))
        .when(F.col("difficulty_bucket") != F.col("required_bucket"), must("difficulty_bucket", "required_bucket"))
        .when(
            F.col("require_new_bucket") & F.array_contains("present_buckets", F.col("difficulty_bucket")),
            "candidate must introduce a new difficulty bucket for current coverage target",
        )
        .when(size < F.col("min_calls"), length(" is below required min ", "min_calls"))
        .when(size > F.col("max_calls"), length(" exceeds required max ", "max_calls"))
        .when(F.col("task_type") != "execute", "candidate task_type must remain execute for the current formal slot target")
    )
    return df.withColumn("reason", reason)


def gold_nodes(trace: DataFrame) -> DataFrame:
    """Steps with a state diff are required writes, the others required reads."""
    return trace.withColumn("node_kind", F.when(F.col("has_diff"), "write").otherwise("read"))


def precedence_edges(trace: DataFrame, task: str, step: str) -> DataFrame:
    """Edge from the previous valid step to each step."""
    valid = trace.filter(F.col(step) > 0).select(task, step)
    edges = with_previous(valid, [task], step, [])
    return edges.filter(F.col("prev").isNotNull()).select(
        task, F.col(f"prev.{step}").alias("before_step"), F.col(step).alias("after_step")
    )


def requirement_nodes(df: DataFrame, task: str) -> DataFrame:
    """Non-blank clarify and refuse requirements as rows."""
    tag = lambda kind, c: F.transform(_texts(c), lambda x: F.struct(F.lit(kind).alias("node_kind"), x.alias("requirement")))
    pairs = F.concat(tag("clarify", "clarification_requirements"), tag("refuse", "refusal_requirements"))
    return df.select(task, F.explode(pairs).alias("_n")).select(task, "_n.*")


def micro_tasks(df: DataFrame, task: str) -> DataFrame:
    """Micro tasks: existing ones, else the usable turn entries, else the goal itself."""
    none = F.array().cast("array<string>")
    entities = F.coalesce("relevant_entities", none)
    default = tx.clean("task_type", "execute")
    own = F.filter(
        F.coalesce("micro_tasks", F.array().cast(dict(df.dtypes)["micro_tasks"])),
        lambda x: tx.clean(x["user_goal"]).isNotNull() & tx.clean(x["expected_outcome"]).isNotNull(),
    )
    existing = F.transform(
        own,
        lambda x, i: F.struct(
            tx.clean(x["task_id"], None).alias("subtask"), tx.clean(x["user_goal"]).alias("user_goal"),
            tx.clean(x["task_type"], "execute").alias("kind"), tx.clean(x["expected_outcome"]).alias("expected_outcome"),
            (i + 1).alias("position"),
        ),
    )
    turns = F.filter(
        F.transform(
            F.coalesce("multi_turn_tasks", F.array().cast(dict(df.dtypes)["multi_turn_tasks"])),
            lambda x, i: F.struct(
                F.concat(F.lit("subtask_"), (i + 1).cast("string")).alias("subtask"), tx.clean(x["task_summary"]).alias("user_goal"),
                F.coalesce(tx.clean(x["task_type"]), default).alias("kind"), tx.clean(x["expected_outcome"]).alias("expected_outcome"),
                (i + 1).alias("position"),
            ),
        ),
        lambda x: x["user_goal"].isNotNull() & x["expected_outcome"].isNotNull(),
    )
    goal = F.array(
        F.struct(
            F.lit("subtask_1").alias("subtask"), tx.clean("goal_summary", "").alias("user_goal"), default.alias("kind"),
            tx.clean("expected_final_outcome", "").alias("expected_outcome"), F.lit(1).alias("position"),
        )
    )
    best = F.when(F.size(existing) > 0, existing).when(F.size(turns) > 0, turns).otherwise(goal)
    named = df.select(task, F.explode(best).alias("_m")).select(task, "_m.*")
    return named.withColumn("subtask", F.coalesce("subtask", F.concat(F.lit("subtask_"), F.col("position").cast("string"))))


def replay_outcome(trace: DataFrame, task: str, step: str, final: DataFrame | None = None) -> DataFrame:
    """Verdict on a recorded replay: first failure or early end, else whether state changed.

    ``final(task, state_changed)`` tells whether the final state differs from the initial one; steps that
    cancel out leave no change.  Its tasks without a step are valid as they stand.
    """
    stops = F.col("failed") | F.col("ended")
    seen = trace.groupBy(task).agg(
        F.min_by(F.struct(step, "failed"), F.when(stops, F.col(step))).alias("_stop"),
        F.count(F.lit(1)).alias("step_count"),
        F.count_if("has_diff").alias("mutating_count"),
    )
    changed = F.lit(True)
    if final is not None:
        seen = final.select(task, "state_changed").join(seen, task, "left").fillna(0, ["step_count", "mutating_count"])
        changed = F.coalesce(F.col("state_changed"), F.lit(False)) | (F.col("step_count") == 0)
    at = F.col(f"_stop.{step}").cast("string")
    reason = (
        F.when(F.col("_stop.failed"), F.concat(F.lit("tool step "), at, F.lit(" failed")))
        .when(F.col("_stop").isNotNull(), F.concat(F.lit("environment terminated early at tool step "), at))
        .when(~changed, "replay produced no objective state change")
        .when((F.col("step_count") > 0) & (F.col("mutating_count") < 1), "replay did not include any mutating tool step")
    )
    return seen.select(task, "step_count", "mutating_count", reason.alias("reason"), reason.isNull().alias("is_valid"))


def observation_failed(observation: Column | str) -> Column:
    """An observation with an ``error`` key, or ``success`` false."""
    parsed = F.try_parse_json(tx.col(observation))
    has_error = F.array_contains(F.coalesce(F.json_object_keys(tx.col(observation)), F.array().cast("array<string>")), "error")
    return has_error | F.coalesce(~F.try_variant_get(parsed, "$.success", "boolean"), F.lit(False))


def truncate_trace(trace: DataFrame, run: str, order: str, block: Column, max_steps: int) -> DataFrame:
    """First ``max_steps`` steps of each run; the last allowed one is marked truncated."""
    placed = with_position(trace, [run], [order], block, "step")
    return placed.filter(F.col("step") <= max_steps).withColumn("truncated", F.col("step") == max_steps)


def coverage(
    df: DataFrame, keys: Sequence[str], requested: DataFrame | None = None, min_count: int = 0, min_buckets: int = 0,
    modes: Sequence[str] = (),
) -> DataFrame:
    """Requested against realised blueprints, modes and buckets present, and the failures."""
    keys = list(keys)
    found = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("realized_count"),
        # Values come from two short fixed lists.
        F.array_sort(F.collect_set("dialogue_mode")).alias("modes_present"),
        F.array_sort(F.collect_set("difficulty_bucket")).alias("buckets_present"),
    )
    wanted = F.array(*[F.lit(m) for m in modes]).cast("array<string>")
    out = found
    none = F.array().cast("array<string>")
    if requested is not None:
        out = requested.join(found, keys, "left")
    out = (
        out.fillna(0, ["realized_count"])
        .withColumn("modes_present", F.coalesce("modes_present", none))
        .withColumn("buckets_present", F.coalesce("buckets_present", none))
        .withColumn("missing_modes", F.array_except(wanted, "modes_present"))
    )
    realized = F.col("realized_count")
    checks = []
    if requested is not None:
        checks.append(F.when(F.col("requested_count") > realized, "fewer blueprints than requested"))
    checks += [
        F.when(F.lit(min_count > 0) & (realized < min_count), "fewer blueprints than the minimum"),
        F.when(F.size("missing_modes") > 0, "missing required dialogue modes"),
        F.when(F.lit(min_buckets > 0) & (F.size("buckets_present") < min_buckets), "too few difficulty buckets"),
    ]
    failures = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return out.withColumn("failures", failures).withColumn("coverage_passed", F.size("failures") == 0)


def failure_log_summary(log: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """Generation failures per environment and reason."""
    return log.filter(F.col(reason).isNotNull()).groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("failures"))
