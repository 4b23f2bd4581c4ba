"""Task blueprints, gold traces and dialogues as projections of the order tables and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.running import with_position
from tracemill.sources.tables import Tables

STEP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def step_block() -> Column:
    """Monotone in the step order; cuts long orders into small pieces."""
    return F.struct("l_linenumber", F.floor(F.col("l_partkey") / 65536).alias("p"))


def tasks(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.select(
        F.col("o_orderkey").alias("task_id"),
        F.col("o_orderpriority").alias("env_id"),
        F.col("o_custkey").alias("config_id"),
        F.when(F.col("o_orderstatus") == "P", "multi_turn").otherwise("single_turn").alias("dialogue_mode"),
        F.when(price < 150000, "easy").when(price < 350000, "medium").otherwise("hard").alias("difficulty_bucket"),
        F.when(price < 300000, "execute").when(price < 400000, "clarify_then_execute").otherwise("refuse_or_scope").alias("task_type"),
        F.col("o_orderstatus").alias("status"),
        price.alias("price"),
    )


def trace(t: Tables) -> DataFrame:
    """Gold trace: the line items of an order, numbered 1..n."""
    placed = with_position(t.lineitem, ["l_orderkey"], STEP_ORDER, step_block(), "step_index")
    return placed.select(
        F.col("l_orderkey").alias("task_id"),
        "step_index",
        F.concat(F.lit("tool_"), F.col("l_linenumber").cast("string")).alias("tool_name"),
        (F.col("l_linestatus") == "F").alias("has_diff"),
        ((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.065)).alias("failed"),
        (F.col("l_discount") > 0.095).alias("ended"),
    )


def step_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count(F.lit(1)).alias("step_count"))


def turns(t: Tables) -> DataFrame:
    """User turns of recorded conversations, numbered from 1."""
    users = t.conversations.filter("role = 'user'")
    placed = with_position(users, ["conv_id"], ["turn"], F.floor(F.col("turn") / 4096), "turn_id")
    return placed.select(
        F.col("conv_id").alias("task_id"), F.col("turn_id").cast("int").alias("turn_id"), F.col("text").alias("user_message")
    )


def plan_steps(t: Tables) -> DataFrame:
    """Proposed tool calls of every blueprint, one row each."""
    steps = trace(t).select("task_id", F.col("step_index").alias("step"), "tool_name", F.lit("{}").alias("arguments"))
    return steps.join(tasks(t).select("task_id", "env_id"), "task_id")


def known_tools(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(f"tool_{i}") for i in range(1, 7)])
    return tasks(t).select("env_id").distinct().select("env_id", F.explode(names).alias("tool_name"))


def candidates(t: Tables) -> DataFrame:
    """Generated blueprint proposals, some of them broken; their steps are in :func:`plan_steps`."""
    base = tasks(t)
    ident = F.concat(F.lit("ORD-"), F.col("task_id").cast("string"))
    none = F.array().cast("array<string>")
    turn = F.struct(
        F.lit("look up the order").alias("task_summary"), F.lit("order found").alias("expected_outcome"),
        F.lit("execute").alias("task_type"), none.alias("required_entities"),
    )
    env = F.col("env_id")
    return base.select(
        "task_id", "env_id", "dialogue_mode", "difficulty_bucket", "task_type",
        F.when(F.col("price") < 5000, " ").otherwise(F.concat(F.lit("Goal "), ident)).alias("goal_summary"),
        F.when(F.col("status") == "F", F.concat(F.lit("Please handle my order "), F.lower(ident))).otherwise("Please handle my order").alias("user_request"),
        F.lit("order handled").alias("expected_final_outcome"),
        F.when(env == "2-HIGH", "4").when(env == "3-MEDIUM", "7").when(env == "4-NOT SPECIFIED", "many").otherwise("6").alias("tool_call_budget"),
        F.lit(50).alias("agent_action_budget"),
        F.array(F.lit("plan")).alias("expected_phases"),
        F.array(ident).alias("relevant_entities"),
        F.when(env == "1-URGENT", F.array(F.lit("ask for the date"), F.lit(" "))).otherwise(none).alias("clarification_requirements"),
        F.when(env == "2-HIGH", F.array(F.lit("decline refunds"))).otherwise(none).alias("refusal_requirements"),
        F.when(F.col("status") == "P", F.when(F.col("price") > 100000, F.array(turn, turn)).otherwise(F.array(turn))).alias("multi_turn_tasks"),
        F.array(*[F.lit(f"tool_{i}") for i in range(1, 7)]).alias("known_tools"),
    )
