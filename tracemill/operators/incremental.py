"""Batch forms of the incremental jobs: resume finished work, rules that arm and fire."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.operators.matching import argument_map
from tracemill.operators.running import running_before, with_position


def resume(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work without a finished result; each key once."""
    return work.dropDuplicates(list(keys)).join(done.select(*keys), list(keys), "left_anti")


def _hits(tools: Column, want: Column, tool: Column, have: Column) -> Column:
    """Does a call meet a rule's tool list (empty means any tool) and argument subset?"""
    named = (F.size(tools) == 0) | F.array_contains(tools, tool)
    subset = F.forall(F.map_keys(want), lambda k: F.try_element_at(have, k).eqNullSafe(F.try_element_at(want, k)))
    return named & subset


def arm_then_fire(rules: DataFrame, calls: DataFrame, block: Column) -> DataFrame:
    """When each rule armed and fired in each run.

    ``rules(run_id, event_id, activation_tools, activation_args, fire_tools, fire_args, delay)``
    are the few rules configured for a run; ``calls(run_id, pos, tool, arguments)``.  A rule
    without activation tools is armed from the start.  It arms at the first activation call and
    fires once, at the first matching call after at least ``delay`` further calls.  The rules of
    a run travel as one array, so calls are only multiplied by the rules they actually meet.
    """
    none = F.array().cast("array<string>")
    tidy = rules.select(
        "run_id",
        "event_id",
        F.coalesce("activation_tools", none).alias("on"),
        argument_map("activation_args").alias("on_args"),
        F.coalesce("fire_tools", none).alias("fire"),
        argument_map("fire_args").alias("fire_args"),
        F.greatest(F.coalesce("delay", F.lit(0)), F.lit(0)).alias("delay"),
    )
    packed = F.collect_list(F.struct("event_id", "on", "on_args", "fire", "fire_args", "delay"))
    placed = with_position(calls, ["run_id"], ["pos"], block, "index").select(
        "run_id", "index", "tool", argument_map("arguments").alias("have")
    )
    waiting = tidy.filter(F.size("on") > 0).groupBy("run_id").agg(packed.alias("_rules"))
    arming = F.filter("_rules", lambda r: _hits(r["on"], r["on_args"], F.col("tool"), F.col("have")))
    armed = (
        placed.join(waiting, "run_id")
        .select("run_id", "index", F.explode(F.transform(arming, lambda r: r["event_id"])).alias("event_id"))
        .groupBy("run_id", "event_id")
        .agg(F.min("index").alias("armed_at"))
    )
    ready = tidy.filter(F.size("on") == 0).select("run_id", "event_id", F.lit(0).cast("long").alias("armed_at"))
    armed = armed.unionByName(ready)
    live = armed.join(tidy, ["run_id", "event_id"]).groupBy("run_id").agg(
        F.collect_list(F.struct("event_id", "fire", "fire_args", "delay", "armed_at")).alias("_live")
    )
    due = F.filter(
        "_live",
        lambda r: (F.col("index") > r["armed_at"] + r["delay"])
        & _hits(r["fire"], r["fire_args"], F.col("tool"), F.col("have")),
    )
    fired = (
        placed.join(live, "run_id")
        .select("run_id", "index", F.explode(F.transform(due, lambda r: r["event_id"])).alias("event_id"))
        .groupBy("run_id", "event_id")
        .agg(F.min("index").alias("fired_at"))
    )
    return armed.join(fired, ["run_id", "event_id"], "left").select("run_id", "event_id", "armed_at", "fired_at")


def replay_rules(rules: DataFrame, calls: DataFrame, block: Column) -> DataFrame:
    """When each rule armed and fired in each run, where rules act on one another.

    ``rules`` are those of :func:`arm_then_fire` with their order ``place`` and an ``effect_type``; ``calls`` may say that
    a call ``raised``.  Before a call its run's rules are tried in order.  A rule of the error type (also the
    default) ends the call: later rules are not tried, the call arms nothing, but it counts.  Other
    rules let the call go on.  A call that raises, unless a rule ended it, arms nothing and does not
    count.  ``delay`` is measured in counted calls; ``armed_at`` and ``fired_at`` are positions among all calls.

    A rule fires once, so a run has at most as many ended calls as error rules.  Their first is right if no
    call is taken to be ended, the first two if that one is, and so on: each round takes one more ended call
    per run as known, and finds for every rule the first call that arms it and the first that fires
    it, as minima over the calls that the rule meets.  No run is replayed row by row, and rounds are as many as the
    error rules of a run.
    """
    none = F.array().cast("array<string>")
    tidy = rules.select(
        "run_id",
        "event_id",
        "place",
        F.coalesce("activation_tools", none).alias("on"),
        argument_map("activation_args").alias("on_args"),
        F.coalesce("fire_tools", none).alias("fire"),
        argument_map("fire_args").alias("fire_args"),
        F.greatest(F.coalesce("delay", F.lit(0)), F.lit(0)).alias("delay"),
        (F.coalesce("effect_type", F.lit(fixed.ERROR_EFFECT)) == fixed.ERROR_EFFECT).alias("ends"),
    )
    raised = F.coalesce("raised", F.lit(False)) if "raised" in calls.columns else F.lit(False)
    calls = calls.select("run_id", "pos", "tool", argument_map("arguments").alias("have"), raised.alias("raised"))
    sums = {"earlier": F.lit(1), "counted": F.when(F.col("raised"), 0).otherwise(1)}
    placed = running_before(calls, ["run_id"], ["pos"], block, sums).withColumn("index", (F.col("earlier") + 1).cast("long"))
    packed = tidy.groupBy("run_id").agg(F.collect_list(F.struct(*[c for c in tidy.columns if c != "run_id"])).alias("_rules"))
    seen = F.transform(
        "_rules",
        lambda r: F.struct(
            *[r[c].alias(c) for c in ("event_id", "place", "delay", "ends")],
            ((F.size(r["on"]) > 0) & ~F.col("raised") & _hits(r["on"], r["on_args"], F.col("tool"), F.col("have"))).alias("arms"),
            _hits(r["fire"], r["fire_args"], F.col("tool"), F.col("have")).alias("fires"),
        ),
    )
    met = placed.join(packed, "run_id").select("run_id", "index", "counted", "raised", F.explode(F.filter(seen, lambda m: m["arms"] | m["fires"])).alias("_m"))
    met = met.select("run_id", "index", "counted", "raised", "_m.*")
    most = tidy.groupBy("run_id").agg(F.count_if("ends").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    ended = None
    for known in range(1, most + 1):
        _, fired = _first_matches(tidy, met, ended)
        calls_ended = F.array_sort(F.collect_list(F.struct("fired.index", "fired.place", "fired.raised")))
        ended = fired.filter("fired.ends").groupBy("run_id").agg(F.slice(calls_ended, 1, known).alias("ended"))
    armed, fired = _first_matches(tidy, met, ended)
    out = armed.join(fired, ["run_id", "event_id"], "left")
    return out.select("run_id", "event_id", F.col("armed.index").alias("armed_at"), F.col("fired.index").alias("fired_at"))


def _first_matches(tidy: DataFrame, met: DataFrame, ended: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The call that arms each rule and the one that fires it, if just the calls ``ended`` end early."""
    if ended is None:
        rows = met.select("*", F.col("counted").alias("history"), F.lit(None).cast("int").alias("end"))
    else:
        before = F.filter("ended", lambda e: (e["index"] < F.col("index")) & e["raised"])
        here = F.transform(F.filter("ended", lambda e: e["index"] == F.col("index")), lambda e: e["place"])
        counted = F.col("counted") + F.greatest(F.size(before), F.lit(0))
        rows = met.join(ended, "run_id", "left").select(*met.columns, counted.alias("history"), F.array_min(here).alias("end"))
    keys = ["run_id", "event_id"]
    after = F.struct("index", (F.col("history") + 1).cast("long").alias("history"))
    first = rows.filter("arms AND end IS NULL").groupBy(*keys).agg(F.min(after).alias("armed"))
    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("long").alias("history"))
    armed = first.unionByName(tidy.filter(F.size("on") == 0).select(*keys, start.alias("armed")))
    due = (F.col("index") > F.col("armed.index")) & (F.col("history") - F.col("armed.history") >= F.col("delay"))
    tried = rows.filter("fires AND (end IS NULL OR place <= end)").join(armed, keys).filter(due)
    return armed, tried.groupBy(*keys).agg(F.min(F.struct("index", "place", "raised", "ends")).alias("fired"))
