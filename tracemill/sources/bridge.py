"""Projections that give the driver tables the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.sources.tables import Tables

CUTOFF = "1998-01-01"
WRITE_TOOLS = ["signup", "purchase"]


def actions(t: Tables) -> DataFrame:
    """Recorded tool calls: one run per user, arrival order by event id."""
    return t.events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("tool"),
        F.when(F.col("event_type") == "view", "respond").otherwise("tool").alias("kind"),
        F.col("event_type").isin(WRITE_TOOLS).alias("is_write"),
        F.get_json_object("props", "$.k").cast("int").alias("arg_k"),
        "value",
    )


def _order_leaves(orders: DataFrame, status) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    fields = F.array(
        F.struct(F.lit("status").alias("f"), F.lit("string").alias("kind"), status.alias("value")),
        F.struct(F.lit("priority").alias("f"), F.lit("string").alias("kind"), F.col("o_orderpriority").alias("value")),
        F.struct(F.lit("total").alias("f"), F.lit("number").alias("kind"), F.col("o_totalprice").cast("string").alias("value")),
    )
    rows = orders.select(F.col("o_custkey").alias("run_id"), key.alias("_k"), F.explode(fields).alias("_f"))
    return rows.select("run_id", F.array(F.lit("orders"), "_k", "_f.f").alias("path"), "_f.kind", "_f.value")


def state_before(t: Tables) -> DataFrame:
    """Open orders placed before the cutoff."""
    return _order_leaves(t.orders.filter(F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp")), F.lit("O"))


def state_after(t: Tables) -> DataFrame:
    """Orders still held after finished ones were archived, with their present status."""
    return _order_leaves(t.orders.filter(F.col("o_orderstatus") != "F"), F.col("o_orderstatus"))


def update_log(t: Tables) -> DataFrame:
    """State updates: each event type is one update operation on a path."""
    op = (
        F.when(F.col("event_type") == "signup", "set")
        .when(F.col("event_type") == "error", "delete")
        .when(F.col("event_type") == "click", "append")
        .otherwise("increment")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("slot_"), F.floor(k / 10).cast("string")).alias("path"),
        op.alias("op"),
        "value",
    )
