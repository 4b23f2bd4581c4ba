"""Matching recorded tool calls and final states against gold requirements.

Positions are any increasing per-run number (arrival order); they need not be dense.
Gold graphs are small (bounded by the tool budget); recorded runs may be arbitrarily long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.functions import text as tx
from tracemill.operators.running import BLOCK_ROWS, block_of, first_per_key, with_position
from tracemill.operators.state import _nodes, is_soft_path, path_parts
from tracemill.sources.stages import stored


#: Block results that one row composes.
FAN = 1024


def _strings() -> Column:
    return F.array().cast("array<string>")


def canonical_value(v: Column) -> Column:
    """Comparable text of a variant: numbers by value, everything else by sorted JSON."""
    text = F.coalesce(F.to_json(v), F.lit("null"))
    number = text.rlike(r"^-?\d")
    return F.when(number, F.concat(F.lit("#"), F.try_variant_get(v, "$", "double").cast("string"))).otherwise(text)


def values_equivalent(a: Column | str, b: Column | str) -> Column:
    """Equality of two JSON texts: numbers numerically, the rest structurally."""
    return canonical_value(F.try_parse_json(tx.col(a))).eqNullSafe(canonical_value(F.try_parse_json(tx.col(b))))


def argument_map(json_text: Column | str) -> Column:
    """JSON object to map of comparable values; empty when it is not an object."""
    opened = F.try_variant_get(F.try_parse_json(tx.col(json_text)), "$", "map<string,variant>")
    return F.coalesce(
        F.transform_values(opened, lambda _, v: canonical_value(v)), F.create_map().cast("map<string,string>")
    )


def arguments_match(expected: Column, actual: Column, required: Column, defaults: Column) -> Column:
    """Argument rule on maps from :func:`argument_map`.

    Required keys must agree; dynamic ones only need to be present.  Optional keys may be
    ignored, or left out when empty or equal to their default.
    """

    def same(k: Column) -> Column:
        return F.try_element_at(expected, k).eqNullSafe(F.try_element_at(actual, k))

    has = F.map_contains_key
    required_ok = F.forall(
        required,
        lambda k: has(expected, k) & has(actual, k) & (k.isin(fixed.DYNAMIC_ARGUMENTS) | same(k)),
    )

    def optional_ok(k: Column) -> Column:
        value = F.try_element_at(expected, k)
        omissible = value.isin("null", "[]") | (has(defaults, k) & F.try_element_at(defaults, k).eqNullSafe(value))
        return (
            F.when(k.isin(fixed.IGNORED_ARGUMENTS), True)
            .when(k.isin(fixed.DYNAMIC_ARGUMENTS), has(actual, k))
            .when(has(actual, k), same(k))
            .otherwise(omissible)
        )

    optional = F.filter(F.map_keys(expected), lambda k: ~F.array_contains(required, k))
    return required_ok & F.forall(optional, optional_ok)


def skips_leaf(path: Column) -> Column:
    """Leaves whose value never has to match: a soft part anywhere, or a soft first part."""
    soft = F.exists(path, lambda p: p.isin(fixed.SOFT_FIELDS)) | F.get(path, F.lit(0)).isin(fixed.SOFT_PREFIXES)
    return F.coalesce(soft, F.lit(False))


def contained(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str], empty_objects: bool = True
) -> DataFrame:
    """Per key: are all expected leaves present with the same value in the actual leaves?

    An expected empty object only needs an object there.  Soft leaves are skipped.  Pass
    ``empty_objects=False`` when no expected leaf is an empty object, which saves listing the
    inner nodes of the actual side.
    """
    keys = list(keys)
    needed = expected.withColumn("_skip", skips_leaf(F.col("path")))
    leaf = actual.select(*keys, "path", F.col("kind").alias("a_kind"), F.col("value").alias("a_value"))
    nodes = leaf
    if empty_objects:
        objects = _nodes(actual, keys).filter("is_object").select(
            *keys, F.col("node").alias("path"), F.lit("object").alias("a_kind"), F.lit("{}").alias("a_value")
        )
        nodes = leaf.filter("a_kind <> 'object'").unionByName(objects)
    hit = (F.col("kind") == F.col("a_kind")) & F.col("value").eqNullSafe(F.col("a_value"))
    judged = needed.join(nodes, [*keys, "path"], "left").withColumn(
        "_ok", F.col("_skip") | F.coalesce(hit, F.lit(False))
    )
    return judged.groupBy(*keys).agg(F.bool_and("_ok").alias("contained"))


def one_schema(schemas: DataFrame) -> DataFrame:
    """``schemas`` with one row per key; two rows for one tool of a run raise an error."""
    keys = [c for c in ("run_id", "tool") if c in schemas.columns]
    counted = schemas.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    clash = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two schemas for tool "), "tool")).cast("boolean"))
    return counted.filter(F.coalesce(clash, F.lit(True))).select(*keys, "required", "defaults")


def diff_facts(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaf-level diff as comparable facts ``(keys, path, kind, value)``: the operation leads the path.

    A changed leaf gives its old and its new value, so a diff holds another (:func:`contained`) only
    if operations, old and new values and the leaves of added and removed subtrees agree.
    """
    fact = lambda path, value: F.struct(path.alias("path"), F.lit("leaf").alias("kind"), value.alias("value"))
    under = lambda *after: F.concat(F.array("op"), F.col("path"), F.array(*[F.lit(x) for x in after]).cast("array<string>"))
    facts = (
        F.when(F.col("op") == "changed", F.array(fact(under("old"), F.col("old_value")), fact(under("new"), F.col("new_value"))))
        .when(F.col("op") == "added", F.array(fact(under(), F.col("new_value"))))
        .otherwise(F.array(fact(under(), F.col("old_value"))))
    )
    return diff.select(*keys, F.explode(facts).alias("_f")).select(*keys, "_f.*")


def candidate_matches(
    nodes: DataFrame,
    calls: DataFrame,
    schemas: DataFrame | None = None,
    expected_facts: DataFrame | None = None,
    step_facts: DataFrame | None = None,
) -> DataFrame:
    """(node, position) pairs agreeing on tool, arguments and state diff.

    ``nodes(run_id, node, step_index, role, tool, arguments)``, ``calls(run_id, pos, tool,
    arguments)``; arguments are JSON text.  Several rows of one node are alternatives, any of which may
    match.  ``schemas(run_id, tool, required, defaults)`` holds each run's own tools; without
    ``run_id`` all runs share them.  ``expected_facts(run_id, node, path, kind, value)`` and
    ``step_facts(run_id, pos, path, kind, value)`` are :func:`diff_facts`; a node with expected facts
    only matches a call that shows them all.
    """
    wanted = nodes.withColumn("_exp", argument_map("arguments")).drop("arguments")
    if schemas is not None:
        given = one_schema(schemas)
        wanted = wanted.join(given, [c for c in ("run_id", "tool") if c in given.columns], "left")
        required = F.coalesce("required", _strings())
        defaults = F.coalesce("defaults", F.create_map().cast("map<string,string>"))
    else:
        required, defaults = _strings(), F.create_map().cast("map<string,string>")
    made = calls.select("run_id", "tool", "pos", argument_map("arguments").alias("_act"))
    pairs = wanted.join(made, ["run_id", "tool"])
    pairs = pairs.filter(arguments_match(F.col("_exp"), F.col("_act"), required, defaults)).select(
        "run_id", "node", "step_index", "role", "tool", "pos"
    )
    if expected_facts is None:
        return pairs
    # Only the facts of candidate pairs meet: expected ones by node, shown ones by position.
    shown = step_facts.select("run_id", "pos", "path", F.col("kind").alias("_k"), F.col("value").alias("_v"))
    hit = F.col("kind").eqNullSafe(F.col("_k")) & F.col("value").eqNullSafe(F.col("_v"))
    needed = pairs.select("run_id", "node", "pos").distinct().join(expected_facts, ["run_id", "node"])
    judged = needed.join(shown, ["run_id", "pos", "path"], "left").filter(~(skips_leaf(F.col("path")) | hit))
    return pairs.join(judged.select("run_id", "node", "pos").distinct(), ["run_id", "node", "pos"], "left_anti").select(*pairs.columns)


def greedy_assign(nodes: DataFrame, candidates: DataFrame, width: int = BLOCK_ROWS) -> DataFrame:
    """Give each gold node the earliest unused matching position, reads before writes.

    With K nodes in a run at most K - 1 positions are taken before any node chooses, so the
    first K candidates of a node always contain its choice.  Only those are gathered, which
    bounds the fold by K * K whatever the length of the run.  Rows that share a node are alternatives:
    they give one result, under the tool of the first row by tool name.
    """
    nodes = first_per_key(nodes.select("run_id", "node", "step_index", "role", "tool"), ["run_id", "node"], ["tool"])
    sizes = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("_k"))
    early = with_position(
        candidates.select("run_id", "node", "pos").distinct(), ["run_id", "node"], ["pos"], block_of("pos", width), "_rank"
    )
    early = early.join(sizes, "run_id").filter(F.col("_rank") <= F.col("_k"))
    options = early.groupBy("run_id", "node").agg(F.collect_list("pos").alias("_options"))
    plan = (
        nodes.select("run_id", "node", "step_index", "role", "tool")
        .join(options, ["run_id", "node"], "left")
        .groupBy("run_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.when(F.col("role") == "read", 0).otherwise(1).alias("turn"),
                        "node",
                        "step_index",
                        "role",
                        "tool",
                        F.coalesce("_options", F.array().cast("array<bigint>")).alias("options"),
                    )
                )
            ).alias("_nodes")
        )
    )
    empty = F.array().cast("array<bigint>")

    def choose(taken: Column, n: Column) -> Column:
        return F.concat(taken, F.array(F.array_min(F.array_except(n["options"], taken))))

    chosen = plan.withColumn("_taken", F.aggregate("_nodes", empty, choose))
    return chosen.select("run_id", F.posexplode("_nodes").alias("_i", "_n"), "_taken").select(
        "run_id",
        F.col("_n.node").alias("node"),
        F.col("_n.step_index").alias("step_index"),
        F.col("_n.role").alias("role"),
        F.col("_n.tool").alias("tool"),
        F.get("_taken", F.col("_i")).alias("position"),
    )


def _composed(blocks: DataFrame, width: int) -> DataFrame:
    """One function per run from those of its blocks ``(run_id, _b, _step)``.

    A block's function takes a pointer to the pointer after it and its hits.  Composition is associative, so
    ``FAN`` neighbouring block numbers meet in one row, then as many of those, until all of a run are one; no row holds more.
    """
    bits = FAN.bit_length() - 1
    levels = max(1, -(-(64 - (width.bit_length() - 1)) // bits))

    def follow(acc: Column, block: Column) -> Column:
        def on(a: Column) -> Column:
            after = F.get(block["_step"], a["p"])
            return F.struct(after["p"].alias("p"), F.concat(a["hits"], after["hits"]).alias("hits"))

        return F.transform(acc, on)

    for level in range(levels):
        above = F.shiftright("_b", bits) if level < levels - 1 else F.lit(0).cast("bigint")
        parts = blocks.groupBy("run_id", above.alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_b", "_step"))).alias("_parts"))
        rest = F.slice("_parts", F.lit(2), F.size("_parts"))
        blocks = parts.select("run_id", "_b", F.aggregate(rest, F.col("_parts")[0]["_step"], follow).alias("_step"))
    return blocks.select("run_id", "_step")


def ordered_name_match(nodes: DataFrame, calls: DataFrame, width: int = BLOCK_ROWS) -> DataFrame:
    """Match gold tool names in order, each to the first later call of that name.

    A name with no later call is skipped.  Knowing each name's last position makes this a
    left-to-right scan with one pointer, so a run is cut into blocks, every block is folded
    for each possible pointer, and the block results are composed in a tree.
    """
    calls = calls.select("run_id", "pos", "tool")
    tools = nodes.select("run_id", "tool").distinct()
    used = calls.join(tools, ["run_id", "tool"], "left_semi")
    last = used.groupBy("run_id", "tool").agg(F.max("pos").alias("last"))
    gold = (
        nodes.select("run_id", "node", "step_index", "tool")
        .join(last, ["run_id", "tool"], "left")
        .groupBy("run_id")
        .agg(F.array_sort(F.collect_list(F.struct("node", "step_index", "tool", "last"))).alias("_gold"))
    )
    size = F.size("_gold")

    def next_open(start: Column, after: Column) -> Column:
        later = F.transform(
            F.col("_gold"), lambda n, i: F.when((i >= start) & (n["last"] > after), i).otherwise(F.lit(None).cast("int"))
        )
        return F.coalesce(F.array_min(later), size)

    hits_type = "array<struct<node:int,pos:bigint>>"

    def state(pointer: Column, hits: Column) -> Column:
        return F.struct(pointer.cast("int").alias("p"), hits.alias("hits"))

    def scan(acc: Column, call: Column) -> Column:
        here = F.get("_gold", acc["p"])["tool"] == call["tool"]
        hit = F.array(F.struct(acc["p"].alias("node"), call["pos"].alias("pos"))).cast(hits_type)
        return F.when(
            F.coalesce(here, F.lit(False)), state(next_open(acc["p"] + 1, call["pos"]), F.concat(acc["hits"], hit))
        ).otherwise(acc)

    none = F.array().cast(hits_type)
    blocks = (
        used.groupBy("run_id", block_of("pos", width).alias("_b"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "tool"))).alias("_calls"))
        .join(gold, "run_id")
        .select(
            "run_id",
            "_b",
            F.transform(F.sequence(F.lit(0), size), lambda s: F.aggregate("_calls", state(s, none), scan)).alias("_step"),
        )
    )
    whole = _composed(blocks, width).withColumnRenamed("_step", "_whole")
    start = next_open(F.lit(0), F.lit(-1).cast("bigint"))
    done = gold.join(whole, "run_id", "left").withColumn(
        "_hits", F.when(F.col("_whole").isNull(), none).otherwise(F.get("_whole", start)["hits"])
    )
    return done.select("run_id", F.posexplode("_gold").alias("_i", "_n"), "_hits").select(
        "run_id",
        F.col("_n.node").alias("node"),
        F.col("_n.step_index").alias("step_index"),
        F.col("_n.tool").alias("tool"),
        F.get(F.filter("_hits", lambda h: h["node"] == F.col("_i")), F.lit(0))["pos"].alias("position"),
    )


def check_precedence(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Both ends matched and in order."""
    found = assigned.filter(F.col("position").isNotNull() & (F.col("step_index") > 0)).select(
        "run_id", "step_index", "position"
    )
    first = found.select("run_id", F.col("step_index").alias("before_step"), F.col("position").alias("before_position"))
    second = found.select("run_id", F.col("step_index").alias("after_step"), F.col("position").alias("after_position"))
    joined = edges.join(first, ["run_id", "before_step"], "left").join(second, ["run_id", "after_step"], "left")
    return joined.withColumn(
        "satisfied", F.coalesce(F.col("before_position") < F.col("after_position"), F.lit(False))
    )


def reply_rules(calls: DataFrame, clarify: Column, refuse: Column, writes_required: Column) -> DataFrame:
    """Per run: a reply before the first write, and the refusal rule.

    ``calls(run_id, pos, kind, is_write)``; ``kind`` is 'respond' or 'tool'.
    """
    respond = F.col("kind") == "respond"
    write = (F.col("kind") == "tool") & F.col("is_write")
    seen = calls.groupBy("run_id").agg(
        F.min(F.when(respond, F.col("pos"))).alias("first_reply"),
        F.min(F.when(write, F.col("pos"))).alias("first_write"),
    )
    replied, wrote = F.col("first_reply").isNotNull(), F.col("first_write").isNotNull()
    before = replied & (~wrote | F.coalesce(F.col("first_reply") < F.col("first_write"), F.lit(False)))
    return seen.withColumn("clarification_satisfied", ~clarify | before).withColumn(
        "refusal_satisfied", ~refuse | (replied & (writes_required | ~wrote))
    )


def write_verb(tool: Column | str) -> Column:
    """First known write verb among the underscore parts of a tool name, or ''."""
    parts = F.split(F.lower(tx.strip(tool)), "_")
    return F.coalesce(F.get(F.filter(parts, lambda p: p.isin(fixed.WRITE_VERBS)), F.lit(0)), F.lit(""))


def forbidden_hits(rules: DataFrame, calls: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """Rules broken by at least one executed write: ``(run_id, rule, tool)``, the tool of the first such call as spelled there.

    ``rules(run_id, rule)``, ``calls(run_id, pos, tool, is_write, arguments)``.  A rule names a
    tool (underscored or spaced), optionally followed by ``on <target>``, by ``with an inactive
    medication`` or by ``at a conflicting scheduled_time`` (the last two look into ``leaves``).
    Rules meet the distinct tool names of a run first, so rules never multiply calls.
    """
    writes = calls.filter("is_write").withColumn("_tool", F.lower(tx.strip("tool")))
    seen = [F.min("pos").alias("pos"), F.min_by(tx.strip("tool"), "pos").alias("tool")]
    names = writes.groupBy("run_id", "_tool").agg(*seen)
    text = rules.select("run_id", "rule", F.lower(tx.strip("rule")).alias("_text")).filter("_text <> ''").distinct()
    readable = F.replace("_tool", F.lit("_"), F.lit(" "))
    prefix = F.when(F.startswith("_text", F.col("_tool")), F.col("_tool")).when(
        F.startswith("_text", readable), readable
    )
    named = (
        text.join(names, "run_id")
        .withColumn("_p", prefix)
        .filter("_p IS NOT NULL")
        .withColumn("_rest", tx.strip(F.substr("_text", F.length("_p") + 1)))
    )
    target = tx.strip(F.substr("_rest", F.lit(4)))
    anywhere = named.filter((F.col("_rest") == "") | (F.startswith("_rest", F.lit("on ")) & (target == "")))
    found = ["run_id", "rule", "pos", "tool"]
    hits = anywhere.select(*found)
    opened = F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string,variant>")

    def plain(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))

    values = (
        writes.select("run_id", "_tool", "pos", "tool", F.explode(F.map_values(opened)).alias("_v"))
        .groupBy("run_id", "_tool", F.lower(tx.strip(plain(F.col("_v")))).alias("_target"))
        .agg(*seen)
    )
    named = named.drop("pos", "tool")
    aimed = named.filter(F.startswith("_rest", F.lit("on ")) & (target != "")).withColumn("_target", target)
    hits = hits.unionByName(
        aimed.join(values, ["run_id", "_tool", "_target"]).select(*found)
    )
    if leaves is not None:
        args = F.from_json("arguments", "map<string,string>")
        used = writes.select(
            "run_id",
            "_tool",
            "pos",
            "tool",
            tx.clean(F.try_element_at(args, F.lit("medication_id"))).alias("medication_id"),
            tx.clean(F.try_element_at(args, F.lit("user_id"))).alias("user_id"),
            F.try_element_at(args, F.lit("scheduled_time")).alias("scheduled_time"),
        )
        part = lambda i: F.get("path", F.lit(i))
        inactive = leaves.filter(
            (part(0) == "medications") & (part(2) == "active_status") & (F.col("kind") == "boolean") & (F.col("value") == "false")
        ).select("run_id", part(1).alias("medication_id"))
        booked = (
            leaves.filter((part(0) == "reminders") & (F.size("path") == 3))
            .groupBy("run_id", part(1).alias("_r"))
            .agg(
                *[
                    F.max(F.when(part(2) == f, F.col("value"))).alias(f)
                    for f in ("user_id", "medication_id", "status", "scheduled_time")
                ]
            )
            .filter("status = 'scheduled'")
        )
        idle = used.join(inactive, ["run_id", "medication_id"], "left_semi").groupBy("run_id", "_tool").agg(*seen)
        clash = (
            used.join(booked, ["run_id", "user_id", "medication_id", "scheduled_time"], "left_semi")
            .groupBy("run_id", "_tool")
            .agg(*seen)
        )
        for suffix, calls_ in (("with an inactive medication", idle), ("at a conflicting scheduled_time", clash)):
            broken = named.filter(F.col("_rest") == suffix).join(calls_, ["run_id", "_tool"])
            hits = hits.unionByName(broken.select(*found))
    return hits.groupBy("run_id", "rule").agg(F.min_by("tool", "pos").alias("tool"))


def _node_facts(leaves: DataFrame) -> DataFrame:
    """Every path that exists in a run: whether it is an object, and the number of leaves at or below it."""
    steps = leaves.filter("kind <> 'length'").select("run_id", "path", "kind", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("_d"))
    is_object = (F.col("_d") < F.size("path")) | (F.col("kind") == "object")
    node = F.slice("path", F.lit(1), F.col("_d")).alias("node")
    return steps.groupBy("run_id", node).agg(F.bool_or(is_object).alias("is_object"), F.count(F.lit(1)).alias("leaves"))


def _objects(leaves: DataFrame) -> DataFrame:
    """``(run_id, path)`` of everything that is an object; leaves are no part of the shuffle."""
    steps = leaves.filter("kind <> 'length'").select("run_id", "path", "kind", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("_d"))
    inner = steps.filter((F.col("_d") < F.size("path")) | (F.col("kind") == "object"))
    return inner.select("run_id", F.slice("path", F.lit(1), F.col("_d")).alias("path")).distinct()


def check_assertions(
    assertions: DataFrame, expected: DataFrame, before: DataFrame, after: DataFrame, empty_objects: bool = True
) -> DataFrame:
    """Judge changed / added / removed assertions on two leaf tables.

    ``assertions(run_id, assertion, path, assertion_type)`` has dotted paths;
    ``expected(run_id, assertion, rel_path, kind, value, old_kind, old_value)`` holds the leaves of
    the asserted value below that path (an empty ``rel_path`` for the path itself); without ``run_id``
    assertions are unique over all runs.  A hard change compares whole values: all old and new leaves and
    no others.  An expected empty object only needs an object there; ``empty_objects=False`` saves looking
    for those where none is expected.  Leaves met and entities renamed are stored steps with plans of their own.
    """
    base = assertions.withColumn("parts", path_parts("path")).withColumn("is_hard", ~is_soft_path(F.col("parts")))
    own = [c for c in ("run_id", "assertion") if c in expected.columns]
    wanted = base.select("run_id", "assertion", "assertion_type", "parts").join(expected, own).withColumn(
        "path", F.concat("parts", "rel_path")
    )
    placed = wanted.withColumn("_skip", skips_leaf(F.col("path")))

    def side(leaves: DataFrame, name: str) -> DataFrame:
        return leaves.select(
            "run_id", "path", F.col("kind").alias(f"{name}_kind"), F.col("value").alias(f"{name}_value")
        )

    def equal(kind: str, value: str, name: str) -> Column:
        same = (F.col(kind) == F.col(f"{name}_kind")) & F.col(value).eqNullSafe(F.col(f"{name}_value"))
        return F.coalesce(same, F.lit(False))

    own_id = (
        (F.size("rel_path") == 1)
        & F.coalesce(F.get("rel_path", F.lit(0)).endswith("_id"), F.lit(False))
        & (F.col("kind") == "string")
        & (F.col("value") == F.try_element_at("parts", F.lit(-1)))
    )
    # Only what is compared travels to the leaves; the parts of a path stay behind.
    compared = placed.select("run_id", "assertion", "path", "_skip", own_id.alias("_own"), "kind", "value", "old_kind", "old_value")
    joined = compared.join(side(before, "b"), ["run_id", "path"], "left").join(side(after, "a"), ["run_id", "path"], "left")
    nodes_before, nodes_after = _node_facts(before), _node_facts(after)
    open_after = F.lit(False)
    if empty_objects:
        objects = _objects(after).withColumn("_object", F.lit(True))
        joined = joined.join(objects, ["run_id", "path"], "left")
        open_after = (F.col("kind") == "object") & F.coalesce("_object", F.lit(False))
    met = F.col("kind").isNull() | equal("kind", "value", "a")
    was = F.col("old_kind").isNull() | equal("old_kind", "old_value", "b")
    facts = joined.groupBy("run_id", "assertion").agg(
        F.bool_and(F.col("_skip") | F.col("_own") | open_after | met).alias("in_after"),
        F.bool_and(F.col("_skip") | equal("kind", "value", "b")).alias("in_before"),
        F.bool_and(was & met).alias("exact_change"),
        F.count("kind").alias("new_leaves"),
        F.count("old_kind").alias("old_leaves"),
        F.bool_or(~(F.col("b_kind").eqNullSafe(F.col("a_kind")) & F.col("b_value").eqNullSafe(F.col("a_value")))).alias("differs"),
    )
    facts = stored(facts, "facts")
    renamed = stored(_renamed(placed.filter(~own_id), before, after), "renamed")

    def held(nodes: DataFrame, name: str) -> DataFrame:
        return nodes.select("run_id", F.col("node").alias("parts"), F.col("leaves").alias(name))

    located = (
        base.join(held(nodes_before, "initial_leaves"), ["run_id", "parts"], "left")
        .join(held(nodes_after, "final_leaves"), ["run_id", "parts"], "left")
        .fillna(0, ["initial_leaves", "final_leaves"])
        .join(facts, ["run_id", "assertion"], "left")
        .join(renamed, ["run_id", "assertion"], "left")
    )
    start, end = F.col("initial_leaves") > 0, F.col("final_leaves") > 0
    yes = lambda c: F.coalesce(F.col(c), F.lit(True))  # noqa: E731  no expected leaves: nothing to miss
    whole = yes("exact_change") & F.coalesce(F.col("new_leaves") == F.col("final_leaves"), F.lit(True))
    whole = whole & F.coalesce(F.col("old_leaves") == F.col("initial_leaves"), F.lit(True))
    passed = (
        F.when(
            F.col("assertion_type") == "changed",
            start & end & F.when(F.col("is_hard"), whole).otherwise(F.coalesce("differs", F.lit(False))),
        )
        .when(
            F.col("assertion_type") == "added",
            (~start & end & yes("in_after")) | F.coalesce("renamed", F.lit(False)),
        )
        .when(F.col("assertion_type") == "removed", start & ~end & yes("in_before"))
        .otherwise(False)
    )
    return located.select("run_id", "assertion", "path", "assertion_type", "is_hard", passed.alias("passed"))


def _renamed(placed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Added assertions met by a new sibling under another key.

    Assertions are reduced to a shape (the set of relative paths) and a fingerprint of the
    values.  Each new entity is fingerprinted once per shape asked for under its parent, and the
    two meet in an equi-join: linear in entities and assertions, never sibling by assertion.
    """
    wanted = (
        placed.filter((F.col("assertion_type") == "added") & (F.size("rel_path") > 0) & ~F.col("_skip"))
        .groupBy("run_id", "assertion", "parts")
        .agg(F.array_sort(F.collect_list(F.struct("rel_path", "kind", "value"))).alias("_leaves"))
        .filter(F.size("parts") >= 2)
        .select(
            "run_id",
            "assertion",
            F.slice("parts", F.lit(1), F.size("parts") - 1).alias("parent"),
            F.transform("_leaves", lambda x: x["rel_path"]).alias("_paths"),
            F.xxhash64(F.transform("_leaves", lambda x: x["rel_path"])).alias("shape"),
            F.sha2(F.to_json("_leaves"), 256).alias("print"),
        )
    )
    shapes = wanted.select("run_id", "parent", "shape", "_paths").distinct()
    parents = shapes.select("run_id", "parent").distinct()
    below = after.filter(F.size("path") >= 3).select(
        "run_id", "path", "kind", "value", F.explode(F.sequence(F.lit(1), F.size("path") - 2)).alias("_d")
    )
    held = below.select(
        "run_id",
        F.slice("path", F.lit(1), F.col("_d")).alias("parent"),
        F.get("path", F.col("_d")).alias("entity"),
        F.slice("path", F.col("_d") + 2, F.size("path")).alias("rel_path"),
        "kind",
        "value",
    ).join(parents, ["run_id", "parent"], "left_semi")
    # Distinct by what the join asks for, so both take one shuffle.
    steps = before.filter((F.col("kind") != "length") & (F.size("path") >= 2)).select("run_id", "path", F.explode(F.sequence(F.lit(2), F.size("path"))).alias("_d"))
    old = steps.select("run_id", F.slice("path", F.lit(1), F.col("_d") - 1).alias("parent"), F.get("path", F.col("_d") - 1).alias("entity")).distinct()
    fresh = held.join(old, ["run_id", "parent", "entity"], "left_anti")
    asked = shapes.select("run_id", "parent", "shape", F.size("_paths").alias("_n"), F.explode("_paths").alias("rel_path"))
    prints = (
        fresh.join(asked, ["run_id", "parent", "rel_path"])
        .groupBy("run_id", "parent", "entity", "shape", "_n")
        .agg(F.array_sort(F.collect_list(F.struct("rel_path", "kind", "value"))).alias("_leaves"))
        .filter(F.size("_leaves") == F.col("_n"))
        .select("run_id", "parent", "shape", F.sha2(F.to_json("_leaves"), 256).alias("print"))
        .distinct()
    )
    return wanted.join(prints, ["run_id", "parent", "shape", "print"], "left_semi").select(
        "run_id", "assertion", F.lit(True).alias("renamed")
    )
