"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracemill.plans.catalog import PLANS  # noqa: E402
from tracemill.session import local_session  # noqa: E402
from tracemill.sources.tables import Tables  # noqa: E402

HEADLINE = [
    "c7_curate_tasks", "c9_dedupe_keep_first", "c14_conflict_codes", "e10_func_test_rollup", "s2_state_diff", "s16_fold_updates",
    "b2_detect_leaks", "b5_running_coverage_target", "d1_allocate_steps", "d9_plan_behaviors", "q2_package", "q4_validate_sample",
    "r7_greedy_assign", "r8_ordered_name_match", "r10_check_assertions", "r24_scorecard", "x5_extract_tool_calls", "t2_arm_then_fire",
    "q11_global_gate", "q13_qc_rollup", "e17_assign_env_ids", "d4_validate_dialogue", "x4_extract_json",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "16g")
    tables = Tables(spark, folder)
    tables.region.count()  # start the executors before timing
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        PLANS[name](tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
