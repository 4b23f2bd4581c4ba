"""Dialogues: turns over gold traces, unstable rewrites, variants and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.functions import text as tx
from tracemill.operators import corpus
from tracemill.operators.running import running_before, with_position


def turn_of_step(position: Column, steps: Column, turns: Column) -> Column:
    """Turn that owns a step when steps are split into contiguous, near-equal groups.

    With fewer steps than turns the first turns stay empty.
    """
    base, extra = F.floor(steps / turns), steps % turns
    wide = extra * (base + 1)
    even = F.when(position <= wide, F.ceil(position / (base + 1))).otherwise(
        extra + F.ceil((position - wide) / F.greatest(base, F.lit(1)))
    )
    return F.when(steps < turns, turns - steps + position).otherwise(even).cast("long")


def turn_span(turn: Column, steps: Column, turns: Column) -> Column:
    """(first, last) step of a turn under the same split; first > last means none."""
    base, extra = F.floor(steps / turns), steps % turns
    first = (turn - 1) * base + F.least(turn - 1, extra) + 1
    last = first + base + F.when(turn <= extra, 1).otherwise(0) - 1
    late = turn - (turns - steps)
    short = steps < turns
    return F.struct(
        F.when(short, F.greatest(late, F.lit(1))).otherwise(first).cast("long").alias("first_step"),
        F.when(short, F.greatest(late, F.lit(0))).otherwise(last).cast("long").alias("last_step"),
    )


def turn_count(hinted: Column) -> Column:
    """Turns of a multi-turn dialogue: the hint clamped to 2..3, or 2."""
    return F.greatest(F.lit(2), F.least(F.lit(3), F.when(hinted > 0, hinted).otherwise(2)))


def default_dialogue(df: DataFrame, task: str) -> DataFrame:
    """Template turns for blueprints without a realised dialogue.

    Needs ``dialogue_mode, goal_summary, user_request, expected_final_outcome,
    multi_turn_tasks, step_count``.
    """
    hints = F.coalesce("multi_turn_tasks", F.array().cast(dict(df.dtypes)["multi_turn_tasks"]))
    multi = F.col("dialogue_mode") == "multi_turn"
    turns = F.when(multi, turn_count(F.size(hints))).otherwise(1)
    rows = df.withColumn("_n", turns).withColumn("turn_id", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    hint = F.get(hints, F.col("turn_id") - 1)
    named = F.coalesce(tx.clean(hint["task_summary"]), F.concat(F.lit("turn "), F.col("turn_id").cast("string")))
    summary = F.when(multi, named).otherwise(tx.clean("goal_summary", "task"))
    outcome = F.when(
        multi, F.coalesce(tx.clean(hint["expected_outcome"]), tx.clean("expected_final_outcome", ""))
    ).otherwise(tx.clean("expected_final_outcome", ""))
    opening = F.coalesce(tx.clean("user_request"), F.when(multi, summary).otherwise(tx.clean("goal_summary", "Please complete this task.")))
    start, end = fixed.CONTINUE_TEMPLATE
    message = F.when(F.col("turn_id") == 1, opening).otherwise(F.concat(F.lit(start), summary, F.lit(end)))
    return rows.select(
        task,
        "turn_id",
        message.alias("user_message"),
        summary.alias("task_summary"),
        outcome.alias("expected_outcome"),
        turn_span(F.col("turn_id"), F.col("step_count"), F.col("_n")).alias("_span"),
    ).select(task, "turn_id", "user_message", "task_summary", "expected_outcome", "_span.first_step", "_span.last_step")


def validate_dialogue(tasks: DataFrame, turns: DataFrame, links: DataFrame, leaks: DataFrame, task: str) -> DataFrame:
    """First reason a realised dialogue is unusable, or null.

    ``tasks(task, dialogue_mode, step_count)``, ``turns(task, turn_id, user_message)``,
    ``links(task, turn_id, link, step_index)``, ``leaks(task, turn_id)``.  Turn ids must be 1..n, each
    turn links consecutive steps, and the turns together cover steps 1..step_count in order.  Turns are
    judged in their order, so the first faulty turn gives the reason; if ``tasks`` has ``final_response``, it
    must not be blank.  Checked with per-turn minima, maxima and counts, so no list of steps is ever gathered.
    """
    per_turn = links.groupBy(task, "turn_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("step_index").alias("_lo"),
        (F.min(F.col("step_index") - F.col("link")) == F.max(F.col("step_index") - F.col("link"))).alias("_run"),
    )
    placed = turns.join(per_turn, [task, "turn_id"], "left").fillna(0, ["_n"])
    chained = running_before(
        placed, [task], ["turn_id"], F.floor(F.col("turn_id") / 4096), sums={"_before": F.col("_n"), "_pos": F.lit(1)}
    )
    leaked = leaks.select(task, "turn_id").distinct().withColumn("_leak", F.lit(True))
    chained = chained.join(leaked, [task, "turn_id"], "left")
    at = F.col("_pos") + 1
    fault = (
        F.when(F.col("turn_id") != at, "has invalid turn_id")
        .when(~F.coalesce(tx.strip("user_message") != "", F.lit(False)), "has empty user_message")
        .when(F.col("_leak"), "leaks hidden tool names or identifiers")
        .when(~F.coalesce("_run", F.lit(True)), "must use contiguous tool step indices")
    )
    fault = F.concat(F.lit("user turn "), at.cast("string"), F.lit(" "), fault)
    facts = chained.groupBy(task).agg(
        F.count(F.lit(1)).alias("_turns"),
        F.min_by(fault, F.when(fault.isNotNull(), at)).alias("_fault"),
        F.bool_and((F.col("_n") == 0) | (F.col("_lo") == F.col("_before") + 1)).alias("_ordered"),
        F.sum("_n").alias("_linked"),
    )
    judged = tasks.join(facts, task, "left")
    size, mode = F.col("_turns"), F.col("dialogue_mode")
    answered = tx.clean("final_response").isNotNull() if "final_response" in tasks.columns else F.lit(True)
    reason = (
        F.when(size.isNull(), "user_turns must be a non-empty list")
        .when((mode == "single_turn") & (size != 1), "single_turn blueprint must realize exactly one user turn")
        .when((mode == "multi_turn") & ~size.between(2, 3), "multi_turn blueprint must realize 2-3 user turns")
        .when(F.col("_fault").isNotNull(), F.col("_fault"))
        .when(
            ~F.col("_ordered") | (F.col("_linked") != F.col("step_count")),
            "linked tool steps must cover the gold trace exactly once and in order",
        )
        .when(~answered, "assistant_final_response is required")
    )
    return judged.select(task, reason.alias("reason"))


def annotate_trace(trace: DataFrame, links: DataFrame, task: str) -> DataFrame:
    """Turn of every gold step; the last link wins, unlinked steps get null."""
    owner = links.groupBy(task, "step_index").agg(F.max_by("turn_id", F.struct("turn_id", "link")).alias("user_turn_id"))
    return trace.join(owner, [task, "step_index"], "left")


def turn_alignment(turns: DataFrame, annotated: DataFrame, task: str) -> DataFrame:
    """One row per (turn, step); turns without steps are kept with a null step."""
    steps = annotated.filter(F.col("user_turn_id").isNotNull()).select(
        task, F.col("user_turn_id").alias("turn_id"), "step_index", "tool_name"
    )
    return turns.join(steps, [task, "turn_id"], "left")


def realized_dialogue(turns: DataFrame, annotated: DataFrame, finals: DataFrame, task: str) -> DataFrame:
    """User turn, its tool steps and the final reply as rows ordered by (turn, part, step)."""
    user = turns.select(
        task, "turn_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("step_index"), F.lit("user").alias("role"), F.col("user_message").alias("content")
    )
    tools = annotated.filter(F.col("user_turn_id").isNotNull()).select(
        task, F.col("user_turn_id").alias("turn_id"), F.lit(1).alias("part"), F.col("step_index").cast("long").alias("step_index"),
        F.lit("assistant_tool_trace").alias("role"), F.col("tool_name").alias("content"),
    )
    last = turns.groupBy(task).agg(F.max("turn_id").alias("turn_id"))
    final = finals.join(last, task).select(
        task, "turn_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("step_index"), F.lit("assistant").alias("role"), "content"
    )
    return user.unionByName(tools).unionByName(final)


def action_budget(df: DataFrame, user_turns: str, tool_calls: str, allowed: str) -> DataFrame:
    total = F.col(user_turns) + F.col(tool_calls) + 1
    limit = F.coalesce(allowed, F.lit(50))
    return (
        df.withColumn("total_action_turns", total)
        .withColumn("max_allowed_action_turns", limit)
        .withColumn("within_budget", total <= limit)
    )


def behavior_quotas(counts: DataFrame, total: str) -> DataFrame:
    """Add ``bounds``: cumulative quota per behaviour by largest remainder (upper ranks).

    ``counts`` is a one-row frame, so this is computed once and not per dialogue.
    """
    priors = F.array(*[F.lit(p) for p in fixed.BEHAVIOR_PRIORS.values()])
    out = counts.withColumn("_p", priors).withColumn("_raw", F.transform("_p", lambda p: p * F.col(total)))
    out = out.withColumn("_whole", F.transform("_raw", lambda r: F.floor(r)))
    out = out.withColumn("_frac", F.zip_with("_raw", "_whole", lambda r, w: r - w))
    # Sorted by remainder, then prior, then listed order.
    order = F.array_sort(
        F.transform("_frac", lambda f, i: F.struct((-f).alias("f"), (-F.get("_p", i)).alias("p"), i.alias("i")))
    )
    out = out.withColumn("_order", F.transform(order, lambda x: x["i"]))
    zero = F.lit(0).cast("long")
    left = F.col(total) - F.aggregate("_whole", zero, lambda acc, x: acc + x)
    out = out.withColumn("_left", left).withColumn(
        "_quota",
        F.transform(
            "_whole", lambda w, i: w + F.when(F.array_position("_order", i) <= F.col("_left"), 1).otherwise(0)
        ),
    )
    bounds = F.transform("_quota", lambda _, i: F.aggregate(F.slice("_quota", F.lit(1), i + 1), zero, lambda acc, x: acc + x))
    return out.withColumn("bounds", bounds).select(*counts.columns, "bounds")


def plan_behaviors(df: DataFrame, order: str, block: Column, max_behaviors: int = 2) -> DataFrame:
    """Assign behaviours by quota: multi-turn first, hard to easy, then input order.

    The global rank is (rows in earlier priority classes) + (position inside the class), both
    from counts, so there is no single-task sort of all dialogues.
    """
    mode = tx.clean("dialogue_mode", "single_turn")
    bucket = tx.clean("difficulty_bucket", "medium")
    hardness = F.when(bucket == "hard", 0).when(bucket == "medium", 1).when(bucket == "easy", 2).otherwise(3)
    classed = df.withColumn("_class", F.when(mode == "multi_turn", 0).otherwise(4) + hardness)
    sizes = classed.groupBy("_class").agg(F.count(F.lit(1)).alias("n"))  # at most eight rows
    totals = sizes.agg(
        F.map_from_entries(F.collect_list(F.struct("_class", "n"))).alias("sizes"), F.sum("n").alias("total")
    )
    table = behavior_quotas(totals, "total").select(F.struct("sizes", "bounds")).scalar()
    placed = with_position(classed, ["_class"], [order], block, "_pos").withColumn("_t", table)
    earlier = F.aggregate(
        F.map_entries("_t.sizes"),
        F.lit(0).cast("long"),
        lambda acc, e: acc + F.when(e["key"] < F.col("_class"), e["value"]).otherwise(0),
    )
    ranked = placed.withColumn("rank", earlier + F.col("_pos"))
    taken = F.size(F.filter("_t.bounds", lambda b: b < F.col("rank")))
    names = F.array(*[F.lit(b) for b in fixed.BEHAVIORS])
    out = ranked.withColumn("primary_behavior", F.coalesce(F.get(names, taken), F.lit("underspecification")))
    second = F.create_map(*[F.lit(x) for p in fixed.SECONDARY_BEHAVIOR.items() for x in p])
    out = out.withColumn("_second", F.try_element_at(second, F.col("primary_behavior")))
    bundle = F.array("primary_behavior")
    if max_behaviors > 1:
        eligible = (mode == "multi_turn") & F.col("_second").isNotNull() & (F.col("_second") != F.col("primary_behavior"))
        chosen = out.filter(eligible).agg(F.min("rank")).scalar()
        bundle = F.when(F.col("rank") == chosen, F.array("primary_behavior", "_second")).otherwise(bundle)
    return out.withColumn("behavior_bundle", bundle).select(*df.columns, "rank", "behavior_bundle")


def dedupe_bundle(bundle: Column | str) -> Column:
    """Non-blank behaviours in order without repeats; the first known one when empty."""
    kept = F.array_distinct(F.filter(tx.col(bundle), lambda b: F.coalesce(tx.strip(b) != "", F.lit(False))))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(fixed.BEHAVIORS[0])))


def _template(text: Column, behavior: Column, templates: Mapping[str, tuple]) -> Column:
    out = text
    for name, (before, after) in templates.items():
        body = F.lit(before) if after is None else F.concat(F.lit(before), text, F.lit(after))
        out = F.when(behavior == name, body).otherwise(out)
    return out


def apply_templates(message: Column | str, bundle: Column | str) -> Column:
    """Rewrite a message by every behaviour of the bundle, in order."""
    return F.aggregate(
        tx.col(bundle), tx.clean(message, ""), lambda text, b: _template(tx.strip(text), b, fixed.REWRITE_TEMPLATES)
    )


def expand_template(message: Column | str, behavior: Column | str) -> Column:
    """One-behaviour rewrite used when stable samples are expanded; blank stays blank."""
    text, name = tx.clean(message, ""), tx.col(behavior)
    first_sentence = F.substring_index(text, ".", 1)
    body = F.when(name == "underspecification", first_sentence).otherwise(text)
    return F.when(text == "", text).otherwise(_template(body, name, fixed.EXPANSION_TEMPLATES))


def validate_rewrite(stable: DataFrame, rewritten: DataFrame, leaks: DataFrame, task: str) -> DataFrame:
    """First reason a rewritten dialogue is unusable, or null.

    Both sides are ``(task, turn_id, user_message)``; ``leaks(task, turn_id)`` lists leaking turns.  The first
    faulty turn gives the reason.
    """
    left = stable.select(task, "turn_id", F.col("user_message").alias("_old"), F.lit(1).alias("_s"))
    right = rewritten.select(task, "turn_id", F.col("user_message").alias("_new"), F.lit(1).alias("_r"))
    both = left.join(right, [task, "turn_id"], "full")
    old, new = tx.clean("_old", ""), tx.clean("_new", "")
    both = both.join(leaks.select(task, "turn_id").distinct().withColumn("_leak", F.lit(True)), [task, "turn_id"], "left")
    fault = (
        F.when(F.col("_s").isNull() | F.col("_r").isNull(), "has invalid turn_id")
        .when(new == "", "has empty user_message")
        .when(F.col("_leak"), "leaks hidden tool names or identifiers")
    )
    fault = F.concat(F.lit("turn "), F.col("turn_id").cast("string"), F.lit(" "), fault)
    facts = both.groupBy(task).agg(
        F.count("_s").alias("stable_turns"),
        F.count("_r").alias("rewritten_turns"),
        F.min_by(fault, F.when(fault.isNotNull(), F.col("turn_id"))).alias("_fault"),
        F.bool_or(F.col("_s").isNotNull() & F.col("_r").isNotNull() & (old != new)).alias("_changed"),
    )
    reason = (
        F.when(F.col("stable_turns") != F.col("rewritten_turns"), "rewritten turn count must exactly match baseline stable turn count")
        .when(F.col("_fault").isNotNull(), F.col("_fault"))
        .when(~F.col("_changed"), "all rewritten turns are identical to the stable baseline")
    )
    return facts.select(task, "stable_turns", "rewritten_turns", reason.alias("reason"))


def expand_variants(stable: DataFrame, behaviors: Sequence[str] = tuple(fixed.BEHAVIORS)) -> DataFrame:
    """One unstable row per stable row and behaviour; the stable message is kept next to it.

    The behaviours are a fixed short list, exploded in place instead of cross joined.
    """
    listed = F.array(*[F.lit(b) for b in behaviors])
    rows = stable.select("*", F.posexplode(listed).alias("behavior_order", "unstable_behavior"))
    base = F.replace("sample_id", F.lit("_stable"), F.lit(""))
    return (
        rows.withColumn("source_sample_id", F.col("sample_id"))
        .withColumn("sample_id", F.concat_ws("_", base, "unstable_behavior"))
        .withColumn("variant", F.lit("unstable"))
        .withColumn("stable_user_message", F.col("user_message"))
        .withColumn("user_message", expand_template("stable_user_message", "unstable_behavior"))
    )


def hostile_variants(stable: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` seeded samples rewritten as impatient and hostile."""
    start, end = fixed.HOSTILE_TEMPLATE
    picked = corpus.sample_exact(stable, "sample_id", n, seed)
    return (
        picked.withColumn("source_sample_id", F.col("sample_id"))
        .withColumn("sample_id", F.replace("sample_id", F.lit("_stable"), F.lit("_ih")))
        .withColumn("variant", F.lit("unstable"))
        .withColumn("unstable_behavior", F.lit("impatience_and_hostility"))
        .withColumn("stable_user_message", F.col("user_message"))
        .withColumn("user_message", F.concat(F.lit(start), tx.strip("stable_user_message"), F.lit(end)))
    )


def interleave_full(stable: DataFrame, variants: DataFrame, order: str) -> DataFrame:
    """Each stable row followed by its variants in behaviour order; sort at the sink."""
    head = stable.withColumn("behavior_order", F.lit(-1)).withColumn("unstable_behavior", F.lit(""))
    columns = [order, "behavior_order", "sample_id", "variant", "unstable_behavior", "user_message"]
    return head.select(*columns).unionByName(variants.select(*columns)).orderBy(order, "behavior_order")


def coverage(expected: DataFrame, realized: DataFrame, group: str, task: str) -> DataFrame:
    """Expected and realised task counts, missing tasks, modes and buckets per group."""
    done = realized.groupBy(group, task).agg(
        F.max(F.struct("dialogue_mode", "difficulty_bucket")).alias("_d"), F.count(F.lit(1)).alias("_dialogues")
    )
    wanted = expected.select(group, task).distinct()
    both = wanted.withColumn("_e", F.lit(1)).join(done, [group, task], "full")
    out = both.groupBy(group).agg(
        F.count("_e").alias("expected_count"),
        F.count("_dialogues").alias("realized_count"),
        F.count_if(F.col("_e").isNotNull() & F.col("_dialogues").isNull()).alias("missing_count"),
        F.array_sort(F.collect_set("_d.dialogue_mode")).alias("modes_present"),
        F.array_sort(F.collect_set("_d.difficulty_bucket")).alias("buckets_present"),
    )
    return out.withColumn("coverage_passed", F.col("missing_count") == 0)


def missing_tasks(expected: DataFrame, realized: DataFrame, group: str, task: str) -> DataFrame:
    """Expected tasks without a realised dialogue, as rows."""
    return expected.select(group, task).distinct().join(realized.select(group, task), [group, task], "left_anti")


def bundle_counts(df: DataFrame, field: str) -> DataFrame:
    """Token counts of an array column."""
    tokens = F.filter(F.transform(field, lambda x: tx.clean(x)), lambda x: x.isNotNull())
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


PART_LINES = 1000


def format_transcript(turns: DataFrame, run: str, order: str, role: str, content: str, block: Column) -> DataFrame:
    """Numbered ``i. role: content`` lines, joined in parts of ``PART_LINES`` lines.

    A normal transcript is part 0; a huge one continues in further parts, so no single row
    has to hold it.
    """
    placed = with_position(turns, [run], [order], block, "_i")
    line = F.concat(
        F.col("_i").cast("string"), F.lit(". "), tx.clean(role, "unknown"), F.lit(": "), tx.clean(content, "")
    )
    parts = placed.select(run, F.floor((F.col("_i") - 1) / PART_LINES).alias("part"), "_i", line.alias("_l"))
    packed = parts.groupBy(run, "part").agg(F.array_sort(F.collect_list(F.struct("_i", "_l"))).alias("_x"))
    return packed.select(run, "part", F.array_join(F.transform("_x", lambda x: x["_l"]), "\n").alias("transcript"))


def with_empty_transcripts(runs: DataFrame, transcripts: DataFrame, run: str) -> DataFrame:
    """Runs without any turn show a placeholder."""
    joined = runs.join(transcripts, run, "left").fillna(0, ["part"])
    return joined.withColumn("transcript", F.coalesce("transcript", F.lit("<empty transcript>")))


def choose_or_fallback(candidates: DataFrame, templates: DataFrame, task: str) -> DataFrame:
    """Proposed rewrite if valid, else the template if valid, else a failure row.

    Both inputs are ``(task, text, reason)`` where a null reason means valid.
    """
    good = candidates.filter("reason IS NULL").select(task, F.col("text").alias("_own"))
    spare = templates.select(task, F.col("text").alias("_spare"), F.col("reason").alias("_why"))
    joined = spare.join(good, task, "left")
    usable = F.when(F.col("_why").isNull(), F.col("_spare"))
    return joined.select(
        task,
        F.coalesce("_own", usable).alias("text"),
        (F.col("_own").isNull() & usable.isNotNull()).alias("used_fallback"),
        F.when(F.col("_own").isNull(), F.col("_why")).alias("failure_reason"),
    )
