"""Environment catalogue: normalisation, tools, test statistics, ids and gates."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.functions import text as tx
from tracemill.operators.matching import canonical_value
from tracemill.operators.running import first_per_key, with_position

LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TEXT_FIELDS = ["env_id", "environment_summary", "environment_introduction", "env_class_name"]


def normalize_constraints(rules: Column | str, listed: bool = False) -> Column:
    """Distinct trimmed rules in order; a fixed sentence when there are none.

    A text is split into lines; a list has its whitespace folded item by item.
    """
    if listed:
        items = F.transform(tx.col(rules), tx.collapse)
    else:
        items = F.transform(F.split(tx.col(rules), LINE_BREAKS), tx.strip)
    kept = F.array_distinct(F.filter(items, lambda x: x != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(fixed.NO_CONSTRAINTS)))


def numbered(items: Column | str) -> Column:
    """``1. first`` lines of an array."""
    lines = F.transform(tx.col(items), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.array_join(lines, "\n")


def normalize_env(df: DataFrame, constraints: str = "constraints_rules", states: str = "states", methods: str = "methods") -> DataFrame:
    """Clean the text fields and derive rule lists and name lists.

    ``states`` and ``methods`` are JSON objects; their keys are the container and method names.
    """
    none = F.array().cast("array<string>")
    out = df
    for name in TEXT_FIELDS:
        if name in df.columns:
            out = out.withColumn(name, tx.collapse(name))
    is_list = dict(df.dtypes)[constraints].startswith("array")
    out = out.withColumn("constraints_rules_list", normalize_constraints(constraints, listed=is_list))
    return (
        out.withColumn("constraints_rules_text", numbered("constraints_rules_list"))
        .withColumn("state_container_names", F.coalesce(F.json_object_keys(states), none))
        .withColumn("method_names", F.coalesce(F.json_object_keys(methods), none))
    )


def normalize_params(parameters: Column) -> tuple[Column, Column]:
    """Property names and the required names among them, from a JSON-schema text."""
    none = F.array().cast("array<string>")
    properties = F.coalesce(F.json_object_keys(F.get_json_object(parameters, "$.properties")), none)
    listed = F.from_json(F.get_json_object(parameters, "$.required"), "array<string>")
    required = F.filter(F.coalesce(listed, none), lambda r: F.array_contains(properties, tx.strip(r)))
    return properties, required


def argument_schemas(tools: DataFrame, env: str, parameters: str) -> DataFrame:
    """``(env, tool, required, defaults, types)`` from JSON-schema texts, as argument matching takes them.

    ``tools(env, name, parameters)``; ``required`` are names that are also properties, ``defaults`` maps a
    property to its comparable default value, ``types`` to its type.
    """
    properties, required = normalize_params(F.col(parameters))
    opened = F.try_variant_get(F.try_parse_json(parameters), "$.properties", "map<string,variant>")
    fields = F.coalesce(opened, F.create_map().cast("map<string,variant>"))
    has_default = F.map_filter(fields, lambda _, v: F.array_contains(F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>")), "default"))
    defaults = F.transform_values(has_default, lambda _, v: canonical_value(F.try_variant_get(v, "$.default", "variant")))
    types = F.transform_values(fields, lambda _, v: F.try_variant_get(v, "$.type", "string"))
    return tools.select(env, F.col("name").alias("tool"), required.alias("required"), defaults.alias("defaults"), types.alias("types"))


def normalize_tools(raw: DataFrame, env: str, order: str, tool_json: str) -> DataFrame:
    """Tool rows from raw JSON: unwrapped, named, first name per environment kept."""
    wrapped = F.get_json_object(tool_json, "$.function")
    is_object = F.startswith(wrapped, F.lit("{"))
    body = F.when(wrapped.isNull(), F.col(tool_json)).when(is_object, wrapped)
    opened = raw.select(env, order, body.alias("_b")).filter("_b IS NOT NULL")
    fields = opened.select(
        env,
        order,
        tx.collapse(F.get_json_object("_b", "$.name")).alias("name"),
        tx.collapse(F.get_json_object("_b", "$.description")).alias("description"),
        F.get_json_object("_b", "$.parameters").alias("_p"),
    ).filter("name <> ''")
    properties, required = normalize_params(F.col("_p"))
    return first_per_key(fields, [env, "name"], [order]).select(
        env, order, "name", "description", properties.alias("properties"), required.alias("required")
    )


def append_standard_tools(tools: DataFrame, env: str, order: str) -> DataFrame:
    """Add the four browse tools to every environment unless it has one of that name.

    They come with their descriptions and, where ``tools`` has a column ``parameters``, with their schemas as JSON.
    """
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"), F.lit(tool["name"]).alias("name"), F.lit(tool["description"]).alias("description"),
                texts(tool["parameters"]["properties"]).alias("properties"), texts(tool["parameters"]["required"]).alias("required"),
                F.lit(json.dumps(tool["parameters"])).alias("parameters"),
            )
            for i, tool in enumerate(fixed.STANDARD_TOOLS)
        ]
    )
    kept = ["name", "description", "properties", "required", *(["parameters"] if "parameters" in tools.columns else [])]
    standard = tools.select(env).distinct().select(env, F.explode(listed).alias("_t"))
    standard = standard.select(env, (F.lit(1 << 62) + F.col("_t.i")).alias(order), *[f"_t.{c}" for c in kept])
    return tools.unionByName(standard.join(tools.select(env, "name"), [env, "name"], "left_anti"))


def tool_summary(tools: DataFrame) -> DataFrame:
    """One summary line per tool: sorted parameters, required ones starred."""
    names = F.array_sort("properties")
    starred = F.transform(names, lambda p: F.when(F.array_contains("required", p), F.concat(p, F.lit("*"))).otherwise(p))
    text = F.when(F.size("properties") > 0, F.array_join(starred, ", ")).otherwise("(none)")
    line = F.concat(F.lit("- "), "name", F.lit("("), text, F.lit("): "), F.coalesce("description", F.lit("")))
    return tools.withColumn("parameter_count", F.size("properties")).withColumn("summary_line", line)


COMPLEXITY = ["tool_count", "state_container_count", "method_count", "code_length"]


def env_complexity(envs: DataFrame, tools: DataFrame, env: str) -> DataFrame:
    """Size counters per environment; environments without tools count 0."""
    counts = tools.groupBy(env).agg(F.count(F.lit(1)).alias("tool_count"))
    return envs.join(counts, env, "left").fillna(0, ["tool_count"]).select(
        env,
        "tool_count",
        F.size("state_container_names").alias("state_container_count"),
        F.size("method_names").alias("method_count"),
        F.length(F.coalesce("env_class_code", F.lit(""))).alias("code_length"),
        F.length(F.coalesce("environment_introduction", F.lit(""))).alias("intro_length"),
        F.size("constraints_rules_list").alias("constraint_count"),
    )


def catalogue_stats(complexity: DataFrame, measures: Sequence[str] = COMPLEXITY) -> DataFrame:
    """Minimum, mean (2 decimals) and maximum per measure from one aggregate row."""
    aggs = [F.count(F.lit(1)).alias("env_count")]
    for m in measures:
        aggs += [F.min(m).cast("long").alias(f"{m}_min"), F.bround(F.avg(m), 2).alias(f"{m}_avg"), F.max(m).cast("long").alias(f"{m}_max")]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), zero(f"{m}_min").alias("min"), zero(f"{m}_avg").cast("double").alias("avg"), zero(f"{m}_max").alias("max"))
            for m in measures
        ]
    )
    return complexity.agg(*aggs).select("env_count", F.explode(rows).alias("_r")).select("_r.*", "env_count")


def resolve_env_id(env: str, source_key: str) -> Column:
    return F.coalesce(tx.clean(env), F.concat(F.lit("missing_env_id__"), F.col(source_key).cast("string")))


def dedupe_env_id(records: DataFrame, env: str, source_key: str, order: str) -> DataFrame:
    """Mark every record after the first of its environment id as a duplicate."""
    named = records.withColumn("resolved_env_id", resolve_env_id(env, source_key))
    first = named.groupBy("resolved_env_id").agg(F.min(order).alias("_first"))
    marked = named.join(first, "resolved_env_id")
    return marked.withColumn("reason", F.when(F.col(order) > F.col("_first"), "duplicate env_id")).drop("_first")


def normalize_status(status: Column | str, passed: Column | str) -> Column:
    """pass / warning / fail from the status text, else from the older boolean."""
    text = F.lower(tx.strip(status))
    known = text.isin("pass", "warning", "fail")
    return F.when(known, text).when(tx.col(passed), "pass").otherwise("fail")


def _counters(status: Column, case: Column) -> list[Column]:
    out = [F.count(F.lit(1)).alias("total_count")]
    out += [F.count_if(status == s).alias(f"{s}_count") for s in ("pass", "warning", "fail")]
    for c in ("positive", "negative"):
        out.append(F.count_if(case == c).alias(f"{c}_count"))
        out += [F.count_if((case == c) & (status == s)).alias(f"{c}_{s}_count") for s in ("pass", "warning", "fail")]
    return out


def func_test_rollup(log: DataFrame, env: str, tool: str) -> DataFrame:
    """Twelve counters per environment (``tool`` null) and per (environment, tool).

    The tool level is aggregated first, so the environment totals add up a few rows per tool.
    """
    per_tool = log.groupBy(env, tool).agg(*_counters(normalize_status("status", "passed"), F.lower(tx.strip("case_type"))))
    names = [c for c in per_tool.columns if c not in (env, tool)]
    per_env = per_tool.groupBy(env).agg(*[F.sum(c).alias(c) for c in names])
    return per_tool.unionByName(per_env.withColumn(tool, F.lit(None).cast(dict(log.dtypes)[tool])))


def tool_stats_table(tools: DataFrame, log: DataFrame, tool: str) -> DataFrame:
    """Call statistics per listed tool; tools never called stay with zeros."""
    case, result = F.lower(tx.strip("case_type")), F.lower(tx.strip("status"))
    counts = log.groupBy(tool).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(case == "positive").alias("positive"),
        F.count_if(case == "negative").alias("negative"),
        *[F.count_if(result == s).alias(s) for s in ("pass", "warning", "fail")],
    )
    return tools.select(tool).distinct().join(counts, tool, "left").fillna(0)


def drop_env_on_fail(envs: DataFrame, log: DataFrame, env: str) -> DataFrame:
    """Environments without any failing step."""
    failing = log.filter(normalize_status("status", "passed") == "fail").select(env).distinct()
    return envs.join(failing, env, "left_anti")


def pass_rates(rollup: DataFrame) -> DataFrame:
    """Rounded and exact rates; null when nothing was run."""
    c = F.col
    rates = {
        "not_fail": F.try_divide(c("pass_count") + c("warning_count"), c("total_count")),
        "positive_not_fail": F.try_divide(c("positive_pass_count") + c("positive_warning_count"), c("positive_count")),
        "pass_rate": F.try_divide(c("pass_count"), c("total_count")),
    }
    out = rollup
    for name, rate in rates.items():
        out = out.withColumn(f"{name}_exact", rate).withColumn(name, F.bround(rate, 2))
    return out


def select_env(rated: DataFrame, field: str, threshold: float) -> DataFrame:
    """Environments whose exact rate reaches the threshold."""
    if field not in ("not_fail", "pass"):
        raise ValueError(f"unknown select_field: {field}")
    return rated.filter(F.col("not_fail_exact" if field == "not_fail" else "pass_rate_exact") >= threshold)


def item_key(summary: Column | str, class_name: Column | str) -> Column:
    return F.concat(tx.clean(summary, ""), F.lit("|||"), tx.clean(class_name, ""))


def merge_keep_first(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Existing items, then new items with an unseen key; the first of a key wins."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    # Keys may be long texts: they are compared by hash.
    marked = both.withColumn("_key", F.sha2(F.col(key), 256))
    return first_per_key(marked, ["_key"], ["_new", order]).drop("_key").withColumnRenamed("_new", "is_new")


def assign_env_ids(items: DataFrame, existing: DataFrame, key: str, order: str, block: Column) -> DataFrame:
    """Known keys keep their id; new keys get ``env_<max + n>`` in order of first appearance."""
    short = F.sha2(F.col(key), 256).alias("_key")  # keys may be long texts: they are compared by hash
    known = first_per_key(existing.select(short, "env_id", "existing_order"), ["_key"], ["existing_order"]).select(
        "_key", F.col("env_id").alias("_known")
    )
    items = items.withColumn("_key", short)
    suffix = F.regexp_extract("env_id", r"^env_(?:.*_)?(\d+)$", 1).try_cast("long")
    top = existing.agg(F.coalesce(F.max(suffix), F.lit(0)).cast("long")).scalar()
    fresh = items.join(known, "_key", "left_anti").groupBy("_key").agg(F.min(order).alias(order))
    numbered_keys = with_position(fresh, [], [order], block, "_n").select("_key", "_n")
    joined = items.join(known, "_key", "left").join(numbered_keys, "_key", "left")
    made = F.concat(F.lit("env_"), (top + F.col("_n")).cast("string"))
    return joined.withColumn("env_id", F.coalesce("_known", made)).drop("_known", "_n", "_key")


def drop_detail_fields(df: DataFrame, fields: Mapping[str, Sequence[str]], columns: Sequence[str] = ()) -> DataFrame:
    """Remove whole columns and nested fields that only a detailed report needs."""
    out = df.drop(*columns)
    for column, nested in fields.items():
        if column in out.columns:
            out = out.withColumn(column, F.col(column).dropFields(*nested))
    return out


def merge_nested_progress(children: DataFrame, finished: DataFrame, parent: str, child: str, value: str, order: Sequence[str]) -> DataFrame:
    """Copy finished child results into a new parent list by (parent key, child key)."""
    done = first_per_key(finished.select(parent, child, value, *order), [parent, child], order, last=True)
    done = done.select(parent, child, F.col(value).alias("_done"))
    merged = children.join(done, [parent, child], "left")
    return merged.withColumn("is_finished", F.col("_done").isNotNull()).withColumn(value, F.coalesce("_done", value)).drop("_done")


def stage_gate(envs: DataFrame, configs_per_env: int, min_blueprints: int, policy: str = "lenient") -> DataFrame:
    """Accept or drop each environment, with the first failed stage and its reasons.

    Needs ``env_id, state_count, state_failures, coverage_passed, blueprint_count,
    task_failures``.
    """
    strict = F.lit(policy == "strict")
    note = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    keep = lambda *items: F.filter(F.array(*items), lambda x: x.isNotNull())
    states, blueprints = F.col("state_count"), F.col("blueprint_count")
    stage1 = keep(
        F.when(states < configs_per_env, note("state_bank size ", states, f" < configs_per_env {configs_per_env}")),
        F.when(strict & (F.col("state_failures") > 0), note("state_generation_failures=", F.col("state_failures"))),
    )
    stage2 = keep(
        F.when(~F.coalesce("coverage_passed", F.lit(False)), "env_coverage_summary.coverage_passed is false"),
        F.when(
            F.lit(min_blueprints > 0) & (blueprints < min_blueprints),
            note("blueprint_count ", blueprints, f" < min_blueprints_per_env {min_blueprints}"),
        ),
        F.when(strict & (F.col("task_failures") > 0), note("task_generation_failures=", F.col("task_failures"))),
    )
    none = F.array().cast("array<string>")
    out = envs.withColumn("_1", stage1).withColumn("_2", stage2)
    blank = F.coalesce(tx.clean("env_id"), F.lit("")) == ""
    failed = F.when(blank, "stage0").when(F.size("_1") > 0, "stage1").when(F.size("_2") > 0, "stage2")
    out = out.withColumn("failed_stage", failed).withColumn("accepted", F.col("failed_stage").isNull())
    reasons = (
        F.when(F.col("failed_stage") == "stage0", F.array(F.lit("stage0 output missing env_id")))
        .when(F.col("failed_stage") == "stage1", F.col("_1"))
        .when(F.col("failed_stage") == "stage2", F.col("_2"))
        .otherwise(none)
    )
    return out.withColumn("failure_reasons", reasons).drop("_1", "_2")


def gate_report(gated: DataFrame) -> DataFrame:
    """Accepted and dropped counts per failed stage; the environments themselves stay rows."""
    return gated.groupBy("accepted", F.coalesce("failed_stage", F.lit("")).alias("failed_stage")).agg(
        F.count(F.lit(1)).alias("env_count")
    )


def keep_accepted(source: DataFrame, gated: DataFrame, key: str, order: str) -> DataFrame:
    """Source records whose environment was accepted, in the original order."""
    return source.join(gated.filter("accepted").select(key), key, "left_semi").orderBy(order)
