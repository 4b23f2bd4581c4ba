"""Gold requirements and sample attributes for the recorded runs in the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.sources import bridge
from tracemill.sources.tables import Tables

# step, role, tool, arguments
GOLD_STEPS = [
    (1, "write", "signup", "{}"),
    (2, "read", "click", "{}"),
    (3, "write", "purchase", '{"k": 42}'),
    (4, "read", "click", "{}"),
    (5, "write", "purchase", "{}"),
]
FORBIDDEN_RULES = ["Purchase on 7", "signup on 42", "click", "refund everything"]
SEGMENT_BEHAVIOR = {
    "AUTOMOBILE": "underspecification",
    "BUILDING": "information_overload",
    "FURNITURE": "goal_switching",
    "HOUSEHOLD": "contradictory_constraints",
    "MACHINERY": "impatience_and_hostility",
}


def calls(t: Tables) -> DataFrame:
    """Recorded calls with their arguments as JSON text."""
    return t.events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("tool"),
        F.when(F.col("event_type") == "view", "respond").otherwise("tool").alias("kind"),
        F.col("event_type").isin(bridge.WRITE_TOOLS).alias("is_write"),
        F.col("props").alias("arguments"),
    )


def _per_run(t: Tables, items) -> DataFrame:
    return t.events.select(F.col("user_id").alias("run_id")).distinct().select("run_id", F.explode(items).alias("_i"))


def nodes(t: Tables) -> DataFrame:
    steps = F.array(
        *[
            F.struct(
                F.lit(s).alias("node"), F.lit(s).alias("step_index"), F.lit(r).alias("role"), F.lit(n).alias("tool"), F.lit(a).alias("arguments")
            )
            for s, r, n, a in GOLD_STEPS
        ]
    )
    return _per_run(t, steps).select("run_id", "_i.*")


def edges(t: Tables) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(a[0]).alias("before_step"), F.lit(b[0]).alias("after_step"))
            for a, b in zip(GOLD_STEPS, GOLD_STEPS[1:])
        ]
    )
    return _per_run(t, pairs).select("run_id", "_i.*")


def rules(t: Tables) -> DataFrame:
    return _per_run(t, F.array(*[F.lit(r) for r in FORBIDDEN_RULES])).select("run_id", F.col("_i").alias("rule"))


def samples(t: Tables) -> DataFrame:
    """One sample per customer; most have no recorded run."""
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    unstable = F.col("c_nationkey") >= 13
    behavior = F.create_map(*[F.lit(x) for p in SEGMENT_BEHAVIOR.items() for x in p])[F.col("c_mktsegment")]
    none = F.array().cast("array<string>")
    # Customers in debt repeat their behaviour label.
    labels = F.when(F.col("c_acctbal") < 0, F.array(behavior, behavior)).otherwise(F.array(behavior))
    payload = F.to_json(
        F.struct(
            F.round(F.col("c_acctbal") / 2000, 2).alias("faithfulness_score"),
            F.col("c_nationkey").cast("string").alias("clarification_score"),
            (F.col("c_mktsegment") == "BUILDING").alias("tool_discipline_score"),
        )
    )
    return t.customer.join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("run_id"),
        F.col("n_name").alias("env_id"),
        F.when(unstable, "noncollab").otherwise("collab").alias("variant"),
        F.when(F.col("c_acctbal") < 2000, "easy").when(F.col("c_acctbal") < 6000, "medium").otherwise("hard").alias("difficulty_bucket"),
        F.when(F.col("c_mktsegment") == "FURNITURE", " ").otherwise("execute").alias("task_type"),
        F.floor(F.col("c_acctbal") / 500).cast("int").alias("given_turns"),
        F.when(unstable, labels).otherwise(none).alias("behavior_bundle"),
        F.when(unstable, F.array(F.lit("unstable_taxonomy_v1"))).otherwise(none).alias("profile_bundle"),
        F.when(unstable, behavior).otherwise("").alias("unstable_behavior"),
        unstable.alias("clarify"),
        (F.col("c_mktsegment") == "BUILDING").alias("refuse"),
        payload.alias("payload"),
    )


def _cutoff():
    return F.lit(bridge.CUTOFF).cast("timestamp")


def assertions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Final-state assertions over the orders of each run, and their expected leaves."""
    old, price, status = F.col("o_orderdate") < _cutoff(), F.col("o_totalprice"), F.col("o_orderstatus")
    kind = (
        F.when(old & ((status == "P") | ((status == "O") & (price > 450000))), "changed")
        .when(old & (status == "F"), "removed")
        .when(~old & (price > 400000), "added")
    )
    key = F.concat(F.lit("orders."), F.col("o_orderkey").cast("string"))
    base = t.orders.withColumn("assertion_type", kind).filter("assertion_type IS NOT NULL").select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("assertion"),
        F.when(F.col("assertion_type") == "changed", F.concat(key, F.lit(".status"))).otherwise(key).alias("path"),
        "assertion_type",
        "o_orderpriority",
    )

    def leaf(path, value, old_value=None):
        return F.struct(
            path.cast("array<string>").alias("rel_path"),
            F.lit("string").alias("kind"),
            value.alias("value"),
            F.lit("string").alias("old_kind"),
            (F.lit(None).cast("string") if old_value is None else old_value).alias("old_value"),
        )

    here, at = F.array(), lambda name: F.array(F.lit(name))
    leaves = (
        F.when(F.col("assertion_type") == "changed", F.array(leaf(here, F.lit("P"), F.lit("O"))))
        .when(F.col("assertion_type") == "removed", F.array(leaf(at("status"), F.lit("O"))))
        .otherwise(F.array(leaf(at("status"), F.lit("O")), leaf(at("priority"), F.col("o_orderpriority"))))
    )
    expected = base.select("assertion", F.explode(leaves).alias("_l")).select("assertion", "_l.*")
    return base.drop("o_orderpriority"), expected


def expected_diff(t: Tables) -> DataFrame:
    """Status changes every run is expected to have made, as leaves of a diff."""
    status = F.col("o_orderstatus")
    due = (F.col("o_orderdate") < _cutoff()) & ((status == "P") | ((status == "O") & (F.col("o_totalprice") > 480000)))
    return t.orders.filter(due).select(
        F.col("o_custkey").alias("run_id"),
        F.array(F.lit("orders"), F.col("o_orderkey").cast("string"), F.lit("status")).alias("path"),
        F.lit("string").alias("kind"),
        F.lit("P").alias("value"),
    )
