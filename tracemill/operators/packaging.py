"""Packaging paired stable/unstable samples and the quality gates over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.functions import text as tx
from tracemill.operators.blueprints import gold_nodes, min_action_turns, precedence_edges
from tracemill.operators.running import first_per_key
from tracemill.operators.state import diff_to_assertions
from tracemill.sources.stages import stored


def index_blueprints(df: DataFrame, order: str) -> DataFrame:
    """One blueprint per non-blank task id; the last duplicate wins."""
    named = df.withColumn("task_id", tx.clean("task_id")).filter("task_id IS NOT NULL")
    return first_per_key(named, ["task_id"], [order], last=True)


def first_stable(stable: DataFrame, order: Sequence[str]) -> DataFrame:
    """First stable dialogue per task by sample id (else task id), then input order."""
    ranked = stable.withColumn("_key", F.coalesce(tx.clean("sample_id"), tx.clean("task_id"), F.lit("")))
    return first_per_key(ranked, ["source_task_id"], ["_key", *order]).drop("_key")


def _packaged(blueprints: DataFrame, dialogues: DataFrame, variant: str) -> DataFrame:
    b = blueprints.select([F.col(c).alias(f"b_{c}") for c in blueprints.columns])
    d = dialogues.join(b, dialogues["source_task_id"] == b["b_task_id"])
    text = lambda c, default=None: tx.clean(c, default)
    either = lambda c: F.coalesce(text(c), text(f"b_{c}"), F.lit(""))
    none = F.array().cast("array<string>")
    bundle = F.coalesce("behavior_bundle", none)
    behavior = F.coalesce(text("unstable_behavior"), F.get(bundle, F.lit(0)), F.lit(""))
    turns = F.when(F.col("total_action_turns") > 0, F.col("total_action_turns")).otherwise(
        F.coalesce("user_turn_count", F.lit(0)) + F.col("b_tool_call_count") + 1
    )
    unstable = variant == "unstable"
    return d.select(
        F.coalesce(text("sample_id"), F.concat(text("task_id", ""), F.lit(f"_{variant}"))).alias("sample_id"),
        F.col("b_env_id").alias("env_id"),
        F.col("b_config_id").alias("config_id"),
        F.col("b_task_id").alias("base_task_id"),
        text("task_id", "").alias("task_id"),
        F.lit(variant).alias("variant"),
        F.coalesce(text("source_task_id"), text("task_id", "")).alias("source_task_id"),
        F.coalesce("profile_bundle", none).alias("profile_bundle"),
        bundle.alias("behavior_bundle"),
        (behavior if unstable else F.lit("")).alias("unstable_behavior"),
        *[either(c).alias(c) for c in ("dialogue_mode", "difficulty_bucket", "goal_summary", "user_request", "expected_final_outcome")],
        text("b_task_type", "execute").alias("task_type"),
        F.coalesce("b_tool_call_budget", F.lit(0)).alias("tool_call_budget"),
        F.when(F.col("b_min_required_action_turns") > 0, F.col("b_min_required_action_turns")).otherwise(turns).alias("min_required_action_turns"),
        F.coalesce("max_allowed_action_turns", "b_agent_action_budget", F.lit(50)).alias("max_allowed_action_turns"),
        F.col("total_action_turns"),
        *[F.col(f"b_{c}").alias(c) for c in ("tool_call_count", "read_nodes", "write_nodes", "clarify_nodes", "refuse_nodes", "diff_count", "assertion_count")],
        F.coalesce("stable_turn_count", F.lit(0)).alias("stable_turn_count"),
        F.coalesce("alignment_count", F.lit(0)).alias("alignment_count"),
        (F.coalesce("has_rewrite_metadata", F.lit(False)) if unstable else F.lit(False)).alias("has_rewrite_metadata"),
    )


def package(blueprints: DataFrame, stable: DataFrame, unstable: DataFrame, order: Sequence[str]) -> DataFrame:
    """One stable and every unstable sample per known task, dialogue values over blueprint values.

    ``blueprints`` come from :func:`index_blueprints`; each dialogue carries its
    ``source_task_id``.  Blueprints are unique per task, so a task with very many dialogues is a
    skewed many-to-one join, which adaptive execution splits.
    """
    return _packaged(blueprints, first_stable(stable, order), "stable").unionByName(
        _packaged(blueprints, unstable, "unstable")
    )


def orphan_tasks(dialogues: DataFrame, blueprints: DataFrame) -> DataFrame:
    """Task ids of dialogues that no blueprint knows."""
    seen = dialogues.select(tx.clean("source_task_id").alias("task_id")).filter("task_id IS NOT NULL").distinct()
    return seen.join(blueprints.select("task_id"), "task_id", "left_anti")


def validate_sample(df: DataFrame) -> DataFrame:
    """Add ``qc_failures`` (every broken rule) and ``qc_passed``."""
    execute, unstable = F.col("task_type") == "execute", F.col("variant") == "unstable"
    talk = (F.col("clarify_nodes") > 0) | (F.col("refuse_nodes") > 0)
    calls, budget = F.col("tool_call_count"), F.col("tool_call_budget")
    total = F.coalesce("total_action_turns", "min_required_action_turns", F.lit(0))
    allowed = F.coalesce("max_allowed_action_turns", F.lit(0))
    over = lambda name, a, limit, b: F.concat(F.lit(f"{name} "), a.cast("string"), F.lit(f" exceeds {limit} "), b.cast("string"))
    checks = [
        F.when((calls == 0) & ~talk, "missing gold_tool_trace"),
        F.when((F.col("read_nodes") == 0) & (F.col("write_nodes") == 0) & ~talk, "missing gold_action_graph"),
        F.when((F.col("diff_count") == 0) & execute, "missing expected_state_diff"),
        F.when((F.col("assertion_count") == 0) & execute, "missing final_state_assertions"),
        F.when((budget > 0) & (calls > budget), over("tool_call_count", calls, "tool_call_budget", budget)),
        F.when((allowed > 0) & (total > allowed), over("total_action_turns", total, "max_allowed_action_turns", allowed)),
        F.when(unstable & (F.size("behavior_bundle") == 0), "missing behavior_bundle for unstable sample"),
        F.when(unstable & (F.col("unstable_behavior") == ""), "missing unstable_behavior for unstable sample"),
        F.when(unstable & ~F.col("has_rewrite_metadata"), "missing rewrite_metadata for unstable sample"),
        F.when(F.col("stable_turn_count") == 0, "missing stable_user_turns"),
        F.when(F.col("alignment_count") == 0, "missing trace_to_turn_alignment"),
    ]
    failures = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.withColumn("qc_failures", failures).withColumn("qc_passed", F.size("qc_failures") == 0)


def pair_summary(blueprints: DataFrame, checked: DataFrame) -> DataFrame:
    """Per task: variants present and failed."""
    stable, unstable, failed = F.col("variant") == "stable", F.col("variant") == "unstable", ~F.col("qc_passed")
    counts = checked.groupBy(F.col("base_task_id").alias("task_id")).agg(
        F.count_if(stable).alias("stable_count"),
        F.count_if(unstable).alias("unstable_count"),
        F.count_if(stable & failed).alias("stable_failed"),
        F.count_if(unstable & failed).alias("unstable_failed"),
    )
    out = blueprints.select("task_id", "env_id").join(counts, "task_id", "left").fillna(0)
    failures = F.filter(
        F.array(
            F.when(F.col("stable_count") == 0, "missing stable variant"),
            F.when(F.col("unstable_count") == 0, "missing unstable variant"),
            F.when(F.col("stable_failed") > 0, "stable variant failed sample-level QC"),
            F.when(F.col("unstable_failed") > 0, "unstable variants failed sample-level QC"),
        ),
        lambda x: x.isNotNull(),
    )
    return out.withColumn("qc_failures", failures).withColumn("qc_passed", F.size("qc_failures") == 0)


def env_summary(
    pairs: DataFrame, samples: DataFrame, min_blueprints: int = 0, min_samples: int = 0,
    modes: Sequence[str] = (), min_buckets: int = 0,
) -> DataFrame:
    """Per environment: counts, missing variants, modes, buckets and threshold failures.

    Task ids that miss a variant stay rows of :func:`pair_summary`; the summary counts them.
    """
    tasks = pairs.groupBy("env_id").agg(
        F.count(F.lit(1)).alias("base_blueprint_count"),
        F.sum("stable_count").alias("stable_sample_count"),
        F.sum("unstable_count").alias("unstable_sample_count"),
        F.count_if(F.col("stable_count") == 0).alias("missing_stable_count"),
        F.count_if(F.col("unstable_count") == 0).alias("missing_unstable_count"),
    )
    filled = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))  # noqa: E731  short fixed lists
    present = samples.groupBy("env_id").agg(
        filled("dialogue_mode").alias("modes_present"), filled("difficulty_bucket").alias("buckets_present")
    )
    none = F.array().cast("array<string>")
    out = tasks.join(present, "env_id", "left")
    out = out.withColumn("modes_present", F.coalesce("modes_present", none)).withColumn(
        "buckets_present", F.coalesce("buckets_present", none)
    )
    out = out.withColumn("sample_count", F.col("stable_sample_count") + F.col("unstable_sample_count"))
    wanted = F.array(*[F.lit(m) for m in modes]).cast("array<string>")
    failures = F.filter(
        F.array(
            F.when(F.lit(min_blueprints > 0) & (F.col("base_blueprint_count") < min_blueprints), "too few blueprints"),
            F.when(F.col("missing_stable_count") > 0, "missing stable variants"),
            F.when(F.col("missing_unstable_count") > 0, "missing unstable variants"),
            F.when(F.lit(min_samples > 0) & (F.col("sample_count") < min_samples), "too few samples"),
            F.when(F.size(F.array_except(wanted, "modes_present")) > 0, "missing required dialogue modes"),
            F.when(F.lit(min_buckets > 0) & (F.size("buckets_present") < min_buckets), "too few difficulty buckets"),
        ),
        lambda x: x.isNotNull(),
    )
    return out.withColumn("qc_failures", failures).withColumn("qc_passed", F.size("qc_failures") == 0)


def imbalance_ratio(df: DataFrame, column: str) -> DataFrame:
    """Largest over smallest non-blank group, null with fewer than two groups."""
    counts = df.filter(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.when(F.count(F.lit(1)) >= 2, F.bround(F.max("_n") / F.min("_n"), 4)).alias("imbalance_ratio")
    )


def label_distributions(samples: DataFrame) -> DataFrame:
    """Counts of behaviours, bundle sizes, profiles, modes and difficulties in one pass."""
    unstable = F.col("variant") == "unstable"
    none = F.array().cast("array<struct<dimension:string,label:string>>")

    def tag(name: str, values: Column) -> Column:
        kept = F.filter(F.transform(values, lambda x: tx.clean(x)), lambda x: x.isNotNull())
        return F.transform(kept, lambda x: F.struct(F.lit(name).alias("dimension"), x.alias("label")))

    size = F.array(F.size("behavior_bundle").cast("string"))
    own = F.concat(tag("behavior", F.col("behavior_bundle")), tag("bundle_size", size), tag("profile", F.col("profile_bundle")))
    shared = F.concat(
        tag("dialogue_mode", F.array("dialogue_mode")), tag("difficulty_bucket", F.array("difficulty_bucket"))
    )
    pairs = F.concat(F.when(unstable, own).otherwise(none), shared)
    return samples.select(F.explode(pairs).alias("_p")).select("_p.*").groupBy("dimension", "label").agg(
        F.count(F.lit(1)).alias("n")
    )


def primary_distribution(samples: DataFrame) -> DataFrame:
    """Share of each known behaviour among unstable samples next to its prior, zero-filled."""
    unstable = samples.filter("variant = 'unstable'")
    counted = unstable.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("unstable_behavior") == b).alias(b) for b in fixed.BEHAVIORS],
    )
    rows = F.array(
        *[
            F.struct(F.lit(b).alias("behavior"), F.col(b).alias("n"), F.lit(p).alias("prior"))
            for b, p in fixed.BEHAVIOR_PRIORS.items()
        ]
    )
    share = F.when(F.col("total") > 0, F.bround(F.col("_r.n") / F.col("total"), 4)).otherwise(0.0)
    return counted.select("total", F.explode(rows).alias("_r")).select(
        "_r.behavior", "_r.n", share.alias("share"), "_r.prior"
    )


def behavior_facts(samples: DataFrame) -> DataFrame:
    """One row of counts that the floor and the global gate need."""
    unstable = F.col("variant") == "unstable"
    size = F.size("behavior_bundle")
    occurrences = lambda b: F.sum(F.when(unstable, F.size(F.filter("behavior_bundle", lambda x: x == b))).otherwise(0))
    mode = lambda m: F.count_if(F.col("dialogue_mode") == m)
    return samples.agg(
        F.count_if(unstable).alias("unstable_count"),
        F.sum(F.when(unstable, size).otherwise(0)).alias("token_count"),
        F.max(F.when(unstable, size)).alias("max_bundle"),
        F.count_if(unstable & (size == 1)).alias("single_count"),
        *[occurrences(b).alias(f"n_{b}") for b in fixed.BEHAVIORS],
        *[mode(m).alias(f"mode_{m}") for m in fixed.DIALOGUE_MODES],
        F.count_distinct(F.nullif(F.col("difficulty_bucket"), F.lit(""))).alias("bucket_count"),
    )


def coverage_floor(facts: DataFrame, min_count: int, require_all: bool = True) -> DataFrame:
    """Can the split hold every behaviour often enough, and how many multi-behaviour dialogues that takes."""
    floor = len(fixed.BEHAVIORS) * max(1 if require_all else 0, min_count)
    needed = F.greatest(F.lit(0), F.lit(floor) - F.col("unstable_count"))
    multi = (
        F.when(needed == 0, 0)
        .when(F.coalesce("max_bundle", F.lit(0)) <= 1, F.lit(None))
        .otherwise(F.ceil(needed / (F.col("max_bundle") - 1)))
    ).cast("long")
    return facts.select(
        "token_count",
        F.lit(floor).alias("token_floor"),
        F.greatest(F.lit(0), F.col("token_count") - floor).alias("token_slack"),
        "single_count",
        (F.col("unstable_count") - F.col("single_count")).alias("multi_count"),
        multi.alias("min_multi_needed"),
        F.coalesce((needed == 0) | (multi < F.col("unstable_count") / 2), F.lit(False)).alias("single_majority_feasible"),
    )


def global_gate(
    samples: DataFrame, orphan_stable: DataFrame, orphan_unstable: DataFrame, min_count: int = 0, require_all: bool = True,
    modes: Sequence[str] = (), min_buckets: int = 0, max_mode_ratio: float = 0.0, max_difficulty_ratio: float = 0.0,
) -> DataFrame:
    """Dataset-level failures and verdict, one row."""
    facts = behavior_facts(samples).select(
        "*",
        imbalance_ratio(samples, "dialogue_mode").scalar().alias("mode_ratio"),
        imbalance_ratio(samples, "difficulty_bucket").scalar().alias("difficulty_ratio"),
        orphan_stable.agg(F.count(F.lit(1))).scalar().alias("orphan_stable"),
        orphan_unstable.agg(F.count(F.lit(1))).scalar().alias("orphan_unstable"),
    )
    keep = lambda items: F.filter(F.array(*items), lambda x: x.isNotNull())
    missing = keep([F.when(F.col(f"n_{b}") == 0, b) for b in fixed.BEHAVIORS])
    under = keep([F.when(F.lit(min_count > 0) & (F.col(f"n_{b}") < min_count), b) for b in fixed.BEHAVIORS])
    absent = keep([F.when(F.col(f"mode_{m}") == 0, m) for m in fixed.DIALOGUE_MODES if m in modes]) if modes else F.array().cast("array<string>")
    out = facts.withColumn("missing_behaviors", missing).withColumn("under_min_behaviors", under).withColumn("missing_modes", absent)
    above = lambda c, limit: F.lit(limit > 0) & F.coalesce(F.col(c) > limit, F.lit(False))
    failures = keep(
        [
            F.when(F.col("orphan_stable") > 0, "orphan stable dialogues"),
            F.when(F.col("orphan_unstable") > 0, "orphan unstable dialogues"),
            F.when(F.lit(require_all) & (F.size("missing_behaviors") > 0), "missing required unstable behaviors"),
            F.when(F.size("under_min_behaviors") > 0, "behaviors below the minimum count"),
            F.when(F.size("missing_modes") > 0, "missing required dialogue modes"),
            F.when(F.lit(min_buckets > 0) & (F.col("bucket_count") < min_buckets), "too few difficulty buckets"),
            F.when(above("mode_ratio", max_mode_ratio), "dialogue mode imbalance ratio too high"),
            F.when(above("difficulty_ratio", max_difficulty_ratio), "difficulty imbalance ratio too high"),
        ]
    )
    return out.withColumn("qc_failures", failures).withColumn("qc_passed", F.size("qc_failures") == 0)


def package_order(samples: DataFrame) -> DataFrame:
    """Environment, task, stable first, sample id: a range-partitioned sort at the sink."""
    return samples.orderBy(
        tx.clean("env_id", ""), tx.clean("task_id", ""), F.when(F.col("variant") == "stable", 0).otherwise(1), tx.clean("sample_id", "")
    )


def qc_rollup(checked: DataFrame, pairs: DataFrame, envs: DataFrame, gate: DataFrame) -> DataFrame:
    """Failures at sample, pair, environment and global level."""
    out = None
    for level, df in (("sample", checked), ("pair", pairs), ("env", envs), ("global", gate)):
        part = df.agg(F.count_if(~F.col("qc_passed")).alias("failures"), F.count(F.lit(1)).alias("checked")).select(
            F.lit(level).alias("level"), "failures", "checked"
        )
        out = part if out is None else out.unionByName(part)
    return out


__all__ = [
    "behavior_facts", "coverage_floor", "env_summary", "first_stable", "global_gate", "imbalance_ratio", "index_blueprints",
    "label_distributions", "min_action_turns", "orphan_tasks", "package", "package_order", "packaged_children", "packaged_rows", "pair_summary",
    "primary_distribution", "qc_rollup", "validate_sample",
]


#: Child tables of a packaged sample.
PARTS = ("turns", "stable_turns", "alignment", "trace", "nodes", "edges", "state_diff", "assertions", "rules")


def _without(samples: DataFrame, own: DataFrame) -> DataFrame:
    """Ids of samples that have no row of their own."""
    return samples.select("sample_id").join(own.select("sample_id").distinct(), "sample_id", "left_anti")


def _own_or(samples: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """Rows ``own`` per sample; samples without any take those of ``other``."""
    return own.unionByName(other.join(_without(samples, own), "sample_id", "left_semi"))


def packaged_children(
    samples: DataFrame, dialogue: Mapping[str, DataFrame], blueprint: Mapping[str, DataFrame], parts: Sequence[str] = PARTS
) -> dict[str, DataFrame]:
    """Content of packaged samples: one table per name in ``parts``, each with a ``sample_id``.

    ``dialogue`` tables carry the ``sample_id`` of :func:`package`: ``turns``, ``stable_turns``, ``alignment``,
    ``trace(step_index, tool_name, arguments, has_diff)`` and ``state_diff(path, op, old_value, new_value)``.
    ``blueprint`` tables carry a ``task_id``: ``nodes(step_index, node_kind, tool_name, arguments)``,
    ``edges(before_step, after_step)``, ``assertions(path, assertion_type, old_value, new_value, value, is_hard)``, ``state_diff`` and
    ``rules``.

    Per sample: stable turns are the turns where there are none; a dialogue's state diff goes before the
    blueprint's; the graph is the blueprint's, or read off the trace; assertions are the blueprint's, or one per
    row of the state diff.  Children stay rows; nothing of a sample is gathered.  For the graph, the blueprint's nodes and
    the traces of samples without them are stored steps.
    """
    tasks = samples.select("sample_id", F.col("base_task_id").alias("task_id"))
    known = samples.select("sample_id")
    told = {name: dialogue[name].join(known, "sample_id", "left_semi") for name in ("turns", "stable_turns", "alignment", "trace", "state_diff")}
    given = {name: tasks.join(blueprint[name], "task_id").drop("task_id") for name in ("nodes", "edges", "assertions", "state_diff", "rules")}
    diff = _own_or(samples, told["state_diff"], given["state_diff"])
    out = {
        "turns": told["turns"],
        "stable_turns": _own_or(samples, told["stable_turns"], told["turns"]),
        "alignment": told["alignment"],
        "trace": told["trace"],
        "state_diff": diff,
        "assertions": _own_or(samples, given["assertions"], diff_to_assertions(diff)),
        "rules": given["rules"],
    }
    if "nodes" in parts or "edges" in parts:
        out |= _graph(samples, dialogue["trace"], stored(given["nodes"], "given_nodes"), given["edges"])
    return {name: out[name] for name in parts}


def _graph(samples: DataFrame, trace: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Nodes and edges as given, or read off the trace for samples that have neither."""
    missing = _without(samples, nodes.select("sample_id").unionByName(edges.select("sample_id")))
    steps = trace.select("sample_id", "step_index", "tool_name", "arguments", "has_diff").join(missing, "sample_id", "left_semi")
    steps = stored(steps, "told_steps")
    read = gold_nodes(steps).select("sample_id", "step_index", "node_kind", "tool_name", "arguments")
    return {"nodes": nodes.unionByName(read), "edges": edges.unionByName(precedence_edges(steps, "sample_id", "step_index"))}


def packaged_rows(samples: DataFrame, children: Mapping[str, DataFrame]) -> DataFrame:
    """Samples and children as one table ``(part, sample_id, content)``, the content as JSON: one job writes it all."""
    out = None
    for part, rows in {"samples": samples, **children}.items():
        content = F.to_json(F.struct(*[c for c in rows.columns if c != "sample_id"]))
        shaped = rows.select(F.lit(part).alias("part"), "sample_id", content.alias("content"))
        out = shaped if out is None else out.unionByName(shaped)
    return out
