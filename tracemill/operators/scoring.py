"""Per-run scores and the reports rolled up from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.functions import text as tx
from tracemill.operators.running import first_per_key


def normalize_variant(c: Column | str) -> Column:
    v = tx.strip(c)
    return F.when(v == "collab", "stable").when(v == "noncollab", "unstable").otherwise(v)


def select_samples(
    samples: DataFrame, order: str, variant: str = "all", sample_id: str | None = None, max_samples: int = 0
) -> DataFrame:
    """Filter by variant and id, then keep the first rows in input order."""
    wanted = {"collab": "stable", "noncollab": "unstable"}.get(variant.strip(), variant.strip())
    out = samples
    if wanted != "all":
        out = out.filter(normalize_variant("variant") == wanted)
    if sample_id:
        out = out.filter(tx.strip("sample_id") == sample_id)
    return out.orderBy(order).limit(max_samples) if max_samples > 0 else out


def attach_runtime(samples: DataFrame, blueprints: DataFrame, order: str) -> DataFrame:
    """Join each sample to its task's environment (the last blueprint of a task wins).

    ``runtime_found`` is false for samples whose task is unknown.
    """
    index = first_per_key(blueprints.filter(F.col("task_id").isNotNull()), ["task_id"], [order], last=True).drop(order)
    joined = samples.join(index.withColumn("runtime_found", F.lit(True)), "task_id", "left")
    return joined.fillna(False, ["runtime_found"])


def _present(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def efficiency(rows: DataFrame, required: str, user_turns: str, replies: str, tools: str, success: Column) -> DataFrame:
    """Required over actual action turns, capped at one; ``task_score`` is 0 unless it succeeded."""
    total = F.col(user_turns) + F.col(replies) + F.col(tools)
    needed = F.coalesce(required, F.lit(0))
    ratio = F.when((total <= 0) | (needed <= 0), 0.0).otherwise(F.least(F.lit(1.0), needed / total))
    out = rows.withColumn("total_action_turns", total).withColumn("efficiency", ratio)
    return out.withColumn("task_score", F.when(success, F.col("efficiency")).otherwise(0.0))


def turn_counts(transcript: DataFrame, calls: DataFrame) -> DataFrame:
    """User turns, replies and tool calls per run."""
    spoken = transcript.groupBy("run_id").agg(F.count_if(F.col("role") == "user").alias("user_turn_count"))
    acted = calls.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "respond").alias("response_count"),
        F.count_if(F.col("kind") == "tool").alias("tool_call_count"),
        F.count_if((F.col("kind") == "tool") & F.col("is_write")).alias("write_call_count"),
    )
    counts = ["user_turn_count", "response_count", "tool_call_count", "write_call_count"]
    return spoken.join(acted, "run_id", "full").fillna(0, counts)


def judge_score(payload: Column, name: str, top: int) -> Column:
    """Integer part of a judge score, clamped; unreadable values become 0."""
    value = F.try_variant_get(payload, f"$.{name}", "variant")
    text = F.to_json(value)
    number = F.when(text == "true", 1.0).when(text == "false", 0.0).when(
        F.startswith(text, F.lit('"')),
        F.when(
            tx.strip(F.try_variant_get(value, "$", "string")).rlike(r"^[+-]?\d+$"),
            tx.strip(F.try_variant_get(value, "$", "string")).try_cast("double"),
        ),
    ).otherwise(text.try_cast("double"))
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    return F.least(F.greatest(F.coalesce(whole, F.lit(0)), F.lit(0)), F.lit(top)).cast("int")


def reliability(rows: DataFrame, payload: str) -> DataFrame:
    """Clamped judge scores and their weighted mean; an unreadable payload scores 0."""
    parsed = F.try_parse_json(payload)
    out = rows
    for name, top, _ in fixed.RELIABILITY_PARTS:
        out = out.withColumn(name, judge_score(parsed, name, top))
    parts = [F.lit(weight) * (F.col(name) / F.lit(float(top))) for name, top, weight in fixed.RELIABILITY_PARTS]
    is_object = F.startswith(F.to_json(parsed), F.lit("{"))
    error = F.when(~F.coalesce(is_object, F.lit(False)), F.lit("judge payload is not a JSON object"))
    return out.withColumn("reliability", parts[0] + parts[1] + parts[2]).withColumn("judge_error", error)


def completion_rows(
    runs: DataFrame,
    assigned: DataFrame,
    named: DataFrame,
    precedence: DataFrame,
    assertions: DataFrame,
    diff: DataFrame,
    replies: DataFrame,
    forbidden: DataFrame,
) -> DataFrame:
    """One row per run: pass counts, totals, hard failures and success flags.

    Every input is reduced to one row per run with partial aggregation before the joins, and
    requirements without rows count as passed.
    """
    hit = F.col("position").isNotNull()
    read, write = F.col("role") == "read", F.col("role") == "write"
    nodes = assigned.groupBy("run_id").agg(
        F.count_if(read).alias("read_total"),
        F.count_if(read & hit).alias("read_matched"),
        F.count_if(write).alias("write_total"),
        F.count_if(write & hit).alias("write_matched"),
    )
    names = named.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("write_name_total"), F.count_if(hit).alias("write_name_matched")
    )
    edges = precedence.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("precedence_total"), F.count_if("satisfied").alias("precedence_satisfied")
    )
    states = assertions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("assertion_total"),
        F.count_if("passed").alias("assertion_passed"),
        F.count_if("is_hard").alias("critical_total"),
        F.count_if(F.col("is_hard") & F.col("passed")).alias("critical_passed"),
    )
    message = F.format_string("forbidden action matched executed write tool '%s': %s", "tool", "rule")
    # One message per broken rule of the sample: bounded by the sample's own rule list.
    broken = forbidden.groupBy("run_id").agg(F.array_sort(F.collect_list(message)).alias("forbidden_violations"))
    out = runs
    for part in (nodes, names, edges, states, broken):
        out = out.join(part, "run_id", "left")
    out = out.join(diff.select("run_id", F.col("contained").alias("diff_passed")), "run_id", "left")
    out = out.join(replies.select("run_id", "clarification_satisfied", "refusal_satisfied"), "run_id", "left")
    totals = [c for c in out.columns if c.endswith(("_total", "_matched", "_satisfied", "_passed")) and c not in ("diff_passed", "clarification_satisfied", "refusal_satisfied")]
    out = out.fillna(0, totals).fillna(True, ["diff_passed"]).withColumn(
        "forbidden_violations", F.coalesce("forbidden_violations", F.array().cast("array<string>"))
    )
    short = lambda a, b: F.col(a) < F.col(b)
    text = fixed.HARD_FAILURES
    failures = F.concat(
        _present(
            F.when(short("read_matched", "read_total"), text["read"]),
            F.when(short("write_matched", "write_total"), text["write"]),
            F.when(short("write_name_matched", "write_name_total"), text["write_name"]),
            F.when(short("precedence_satisfied", "precedence_total"), text["order"]),
            F.when(short("assertion_passed", "assertion_total"), text["state"]),
            F.when(short("critical_passed", "critical_total"), text["critical_state"]),
            F.when(~F.col("diff_passed"), text["diff"]),
            F.when(~F.col("clarification_satisfied"), text["clarify"]),
            F.when(~F.col("refusal_satisfied"), text["refuse"]),
        ),
        F.col("forbidden_violations"),
    )
    return out.withColumn("hard_failures", failures).withColumn("semantic_success", F.size("hard_failures") == 0)


def relaxed_success(rows: DataFrame) -> DataFrame:
    """Success by final state, state diff and forbidden rules only."""
    state_ok = (F.col("assertion_total") == 0) | (F.col("assertion_passed") == F.col("assertion_total"))
    text = fixed.RELAXED_FAILURES
    failures = _present(
        F.when(~state_ok, text["state"]),
        F.when(~F.col("diff_passed"), text["diff"]),
        F.when(F.size("forbidden_violations") > 0, text["forbidden"]),
    )
    out = rows.withColumn("relaxed_failures", failures).withColumn("relaxed_success", F.size("relaxed_failures") == 0)
    return out.withColumn("recovered", F.col("relaxed_success") & ~F.col("semantic_success"))


def failure_mode(rows: DataFrame) -> DataFrame:
    """Deterministic failure label."""
    failed = lambda key: F.array_contains("hard_failures", fixed.HARD_FAILURES[key])
    gave_up = (F.col("tool_call_count") == 0) | (F.col("write_call_count") == 0)
    mode = (
        F.when(F.size("forbidden_violations") > 0, "R4")
        .when(failed("write_name") & gave_up, "R1a")
        .when(failed("write_name"), "R1b")
        .when(failed("order") | failed("read"), "R2")
        .otherwise("R3")
    )
    labels = F.create_map(*[F.lit(x) for pair in fixed.FAILURE_MODES.items() for x in pair])
    return rows.withColumn("failure_mode", mode).withColumn(
        "failure_label", F.element_at(labels, F.col("failure_mode"))
    )


def with_run_errors(samples: DataFrame, recorded: DataFrame, defaults: Mapping[str, object], message: str) -> DataFrame:
    """Keep samples whose run failed, with empty-run defaults and the error."""
    joined = samples.join(recorded.withColumn("_ran", F.lit(True)), "run_id", "left")
    return (
        joined.withColumn("run_error", F.when(F.col("_ran").isNull(), F.lit(message)))
        .fillna(dict(defaults))
        .drop("_ran")
    )


MEASURES = [
    "avg_efficiency", "avg_task_score", "avg_reliability", "avg_faithfulness_score",
    "avg_clarification_score", "avg_tool_discipline_score",
]


def summary_columns() -> list[Column]:
    """Sample count, the fourteen means (0 when empty) and the run error count."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    rate = lambda c: mean(F.when(c, 1.0).otherwise(0.0))
    relaxed = rate(F.col("relaxed_success"))
    source = {m: F.col(m.removeprefix("avg_")) for m in MEASURES}
    return [
        F.count(F.lit(1)).alias("sample_count"),
        relaxed.alias("success_rate"),
        relaxed.alias("sr"),
        relaxed.alias("completion_rate"),
        rate(F.col("semantic_success")).alias("semantic_success_rate"),
        rate(F.col("strict_success")).alias("strict_success_rate"),
        *[mean(c.cast("double")).alias(m) for m, c in source.items()],
        *[
            (mean(F.col(name).cast("double")) / float(top)).alias(f"avg_{name.removesuffix('_score')}_norm")
            for name, top, _ in fixed.RELIABILITY_PARTS
        ],
        F.count_if(F.col("run_error").isNotNull() & (F.col("run_error") != "")).alias("run_error_count"),
    ]


def group_key(c: Column | str) -> Column:
    """Report key: trimmed text, blank and null become 'unknown'."""
    return tx.clean(tx.col(c).cast("string"), "unknown")


def metric_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*summary_columns())


def summarize_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(group_key(column).alias("key")).agg(*summary_columns())


def labels_of(column: str) -> Column:
    """Non-blank labels of an array column, repeats kept."""
    labels = F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: tx.clean(x))
    return F.filter(labels, lambda x: x.isNotNull())


def summarize_by_label(rows: DataFrame, column: str) -> DataFrame:
    """Rows counted once per label occurrence."""
    exploded = rows.withColumn("key", F.explode(labels_of(column)))
    return exploded.groupBy("key").agg(*summary_columns())


def by_dimension(rows: DataFrame, scalars: Mapping[str, str], arrays: Mapping[str, str]) -> DataFrame:
    """Fan each row out to its (dimension, key) pairs, plus the overall one."""

    def pair(name: str, key: Column) -> Column:
        return F.struct(F.lit(name).alias("dimension"), key.alias("key"))

    def label_pairs(name: str, column: str) -> Column:
        return F.transform(labels_of(column), lambda x: pair(name, x))

    pairs = F.concat(
        F.array(pair("overall", F.lit("all")), *[pair(n, group_key(c)) for n, c in scalars.items()]),
        *[label_pairs(n, c) for n, c in arrays.items()],
    )
    return rows.withColumn("_p", F.explode(pairs)).select("*", "_p.dimension", "_p.key").drop("_p")


def scorecard(rows: DataFrame, scalars: Mapping[str, str], arrays: Mapping[str, str]) -> DataFrame:
    """All report dimensions in one pass over the score rows and one small shuffle."""
    return by_dimension(rows, scalars, arrays).groupBy("dimension", "key").agg(*summary_columns())


def rescore_summary(rows: DataFrame, scalars: Mapping[str, str], arrays: Mapping[str, str]) -> DataFrame:
    """Original against relaxed success by dimension."""
    number = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    state_ok = (F.col("assertion_total") == 0) | (F.col("assertion_passed") == F.col("assertion_total"))
    original, relaxed = F.avg(number("semantic_success")), F.avg(number("relaxed_success"))
    return (
        by_dimension(rows, scalars, arrays)
        .groupBy("dimension", "key")
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            original.alias("original_success_rate"),
            relaxed.alias("relaxed_success_rate"),
            (relaxed - original).alias("delta_success_rate"),
            F.count_if("recovered").alias("recovered_count"),
            F.avg(number("recovered")).alias("recovered_rate"),
            F.count_if(state_ok).alias("final_state_passed_count"),
            F.count_if("diff_passed").alias("expected_diff_passed_count"),
            F.count_if(F.size("forbidden_violations") == 0).alias("forbidden_passed_count"),
        )
    )


def failure_counters(rows: DataFrame) -> DataFrame:
    """Failure texts by kind (original, recovered, relaxed), most common first."""
    kind = lambda name, c: F.transform(c, lambda x: F.struct(F.lit(name).alias("counter"), tx.strip(x).alias("failure")))
    none = F.array().cast("array<string>")
    pairs = F.concat(
        kind("original", F.col("hard_failures")),
        kind("recovered", F.when(F.col("recovered"), F.col("hard_failures")).otherwise(none)),
        kind("relaxed", F.col("relaxed_failures")),
    )
    counted = rows.select(F.explode(pairs).alias("_f")).select("_f.*").groupBy("counter", "failure").count()
    return counted.withColumnRenamed("count", "n").orderBy("counter", F.desc("n"), "failure")


def write_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Report columns in a fixed order, numbers rounded for stable output."""
    return rows.select(*[F.round(n, 6).alias(n) if dict(rows.dtypes)[n] == "double" else F.col(n) for n in names])
