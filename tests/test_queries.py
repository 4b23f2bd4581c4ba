"""Every registered query against its SQL twin, and plan checks."""

import decimal
import math
import re

import duckdb
import pytest

from tests.conftest import SMALL
from tracemill.plans.catalog import PLANS, SQL
from tracemill.sources.tables import Tables

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def tidy(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return float(v) if isinstance(v, decimal.Decimal) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = PLANS[name](Tables(spark, SMALL))
    result = duck.execute(SQL[name])
    expected = table([d[0] for d in result.description], result.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == expected


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_runs_without_twin(spark, name):
    assert PLANS[name](Tables(spark, SMALL)).count() > 0


HEAVY = [
    "c20_sample_exact", "s2_state_diff", "s12_list_entities", "b2_detect_leaks", "b5_running_coverage_target", "r7_greedy_assign",
    "r8_ordered_name_match", "r10_check_assertions", "d9_plan_behaviors", "d13_expand_variants", "q2_package", "e17_assign_env_ids",
    "t2_arm_then_fire",
]


@pytest.mark.parametrize("name", HEAVY)
def test_plan_shape(spark, name):
    plan = PLANS[name](Tables(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    # Without a partition key the first entry of a window spec is a sort order.  Such a window
    # may only scan block totals (``_t_`` columns), never rows.
    for line in plan.splitlines():
        if any(" ASC" in first or " DESC" in first for first in re.findall(r"windowspecdefinition\(([^,]*)", line)):
            assert "_t_" in line


def test_scan_is_pruned(spark):
    plan = PLANS["r17_turn_bands"](Tables(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<conv_id:bigint,role:string>" in plan
    pushed = PLANS["c13_keep_judged"](Tables(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in pushed and "EqualTo(quality,1)" in pushed


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
