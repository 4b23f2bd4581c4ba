"""Plans that the driver can hold, tasks that do not grow with the tables, and steps that give their disk back."""

import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tracemill.operators import packaging as pk
from tracemill.operators import state
from tracemill.plans.catalog import PLANS
from tracemill.sources.stages import stored
from tracemill.sources.tables import Tables


@pytest.mark.parametrize("name", ["r10_diff_against_itself", "r19_relaxed_success", "r24_scorecard"])
def test_wide_queries_run_in_steps(spark, name):
    plan = PLANS[name](Tables(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 20


def test_tasks_do_not_grow_with_the_table(spark, tables):
    """More data than fits the default number of parts comes as more parts."""
    assert tables.nation.count() == 25
    rows = spark.range(8_000_000).select("id", F.rand(1).alias("x"), F.rand(2).alias("y")).repartition("id")
    parts = rows.select(F.spark_partition_id().alias("p"), "x", "y").groupBy("p").agg(F.max("x"), F.max("y")).collect()
    assert len(parts) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    names = (blocks.apply(i).name() for i in range(blocks.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_stored_steps_leave_no_shuffle_files(spark):
    """A step's shuffle files go when it is written, not when the driver happens to collect its garbage."""
    before = shuffle_files(spark)
    rows = stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    for _ in range(50):  # removed in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert {r["count"] for r in rows.collect()} == {100} and rows.count() == 10


def test_packaged_graph_takes_few_shuffles(spark):
    """Samples, traces and the steps of samples without a graph are stored; what is left is the edges."""
    plan = PLANS["q2_packaged_graph"](Tables(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6


def test_packaged_graph_keeps_repeats(spark):
    """Tasks and samples that come twice, a sample with a graph of its own, one without steps, and ids that are missing."""
    samples = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("b", "t2"), ("c", None), (None, "t1")], "sample_id string, base_task_id string")
    trace = spark.createDataFrame(
        [("a", 1, "x", True), ("b", 2, "z", False), ("b", 1, "y", True), (None, 1, "w", True), ("gone", 1, "v", True)],
        "sample_id string, step_index long, tool_name string, has_diff boolean",
    ).withColumn("arguments", F.lit("{}"))
    nodes = spark.createDataFrame([("t1", 1, "read", "n", "{}"), ("t1", 1, "read", "n", "{}")], "task_id string, step_index long, node_kind string, tool_name string, arguments string")
    edges = spark.createDataFrame([], "task_id string, before_step long, after_step long")
    none = spark.createDataFrame([], "sample_id string")
    dialogue = {"turns": none, "stable_turns": none, "alignment": none, "trace": trace}
    diff = "path array<string>, op string, old_value string, new_value string"
    dialogue["state_diff"] = spark.createDataFrame([], f"sample_id string, {diff}")
    other = spark.createDataFrame([], "task_id string, path string, assertion_type string, old_value string, new_value string, value string, is_hard boolean")
    blueprint = {"nodes": nodes, "edges": edges, "assertions": other, "state_diff": spark.createDataFrame([], f"task_id string, {diff}"), "rules": spark.createDataFrame([], "task_id string, rule string")}
    parts = pk.packaged_children(samples, dialogue, blueprint, ("nodes", "edges"))
    assert list(parts) == ["nodes", "edges"]
    found = sorted((r.sample_id or "", r.step_index, r.node_kind, r.tool_name) for r in parts["nodes"].collect())
    assert found == [("", 1, "read", "n")] * 2 + [("a", 1, "read", "n")] * 2 + [("b", 1, "write", "y"), ("b", 2, "read", "z")]
    assert [(r.sample_id, r.before_step, r.after_step) for r in parts["edges"].collect()] == [("b", 1, 2)]
    assert list(pk.packaged_children(samples, dialogue, blueprint)) == list(pk.PARTS)


def test_diff_joins_leaves_once(spark):
    """What differs is stored: leaves and the objects above them are joined while the step is made, not for each use of it."""
    rows = spark.createDataFrame([(1, ["a", "b"], "string", "x")], "run_id long, path array<string>, kind string, value string")
    plan = state.diff_leaves(rows, rows.withColumn("value", F.lit("y")), ["run_id"])._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "FullOuter" not in plan
