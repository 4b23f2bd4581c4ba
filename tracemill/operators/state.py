"""Nested JSON states as leaf tables, and the diff, lookup and browse operators over them.

A leaf table has one row per terminal value: ``(*keys, path ARRAY<STRING>, kind, value)``.
``kind`` is string, number, boolean, null, array or object (an empty object); arrays are
single leaves, values are canonical text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.functions import text as tx
from tracemill.operators.running import first_per_key, with_position, with_previous
from tracemill.sources.stages import stored


def canonical_json(c: Column | str) -> Column:
    """Sorted-key, minified JSON text; null when the input does not parse."""
    return F.to_json(F.try_parse_json(tx.col(c)))


def fingerprint(c: Column | str) -> Column:
    return F.sha2(canonical_json(c), 256)


def _kind(json_text: Column) -> Column:
    head = F.substring(json_text, 1, 1)
    return (
        F.when(head == "{", "object")
        .when(head == "[", "array")
        .when(head == '"', "string")
        .when(head.isin("t", "f"), "boolean")
        .when(head == "n", "null")
        .otherwise("number")
    )


def _children(v: Column, expand_arrays: bool) -> Column:
    """(key, value) entries of an object, and of an array when those are opened too.

    An opened array adds its length under ``[#]``, so containment can compare lengths.
    """
    entry = lambda k, x: F.struct(k.alias("key"), x.alias("value"))
    fields = F.transform(
        F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: entry(e["key"], e["value"])
    )
    if not expand_arrays:
        return fields
    items = F.try_variant_get(v, "$", "array<variant>")
    numbered = F.transform(items, lambda x, i: entry(F.concat(F.lit("["), i.cast("string"), F.lit("]")), x))
    length = F.array(entry(F.lit("[#]"), F.parse_json(F.size(items).cast("string"))))
    return F.coalesce(fields, F.concat(numbered, F.when(items.isNotNull(), length)))


#: Levels that are opened one by one; what lies deeper is read off its text in one pass.
OPENED = 4


def _deep_leaves(json_text: Column, expand_arrays: bool) -> Column:
    """``array<struct<path, text>>``: leaves of an object (or opened array) in minified JSON, at any depth.

    One fold over the pieces of the text.  ``path`` holds a key, or ``[i]``, for each container that is open; an
    array that is not opened is put together again from its pieces.
    """
    pieces = F.regexp_extract_all(json_text, F.lit(r'("(?:[^"\\]|\\.)*+"|[{}\[\]:,]|[^{}\[\]:,"\s]++)'), 1)
    none = F.array().cast("array<string>")
    start = F.struct(
        none.alias("path"), F.lit("").alias("open"), F.lit(False).alias("key"), F.lit(False).alias("fresh"), F.lit(0).alias("inner"), none.alias("held"),
        F.array().cast("array<struct<path:array<string>,text:string>>").alias("out"),
    )

    def step(acc: Column, piece: Column) -> Column:
        path, opened, inner = acc["path"], acc["open"], acc["inner"]
        last = F.size(path)
        above = F.slice(path, F.lit(1), F.greatest(last - 1, F.lit(0)))
        here = F.try_element_at(path, F.lit(-1))
        in_array = opened.endswith("[")
        index = F.regexp_extract(here, r"^\[(\d+)\]$", 1).cast("int")
        starts, ends = piece.isin("{", "["), piece.isin("}", "]")
        closed = piece.isin("[") if not expand_arrays else F.lit(False)
        # Pieces of an array that stays whole.
        deeper = inner + F.when(piece == "[", 1).when(piece == "]", -1).otherwise(0)
        whole = F.concat(acc["held"], F.array(piece))
        held = F.when((inner > 0) & (deeper == 0), none).when((inner > 0) | closed, whole).otherwise(none)
        opens, shuts = starts & (inner == 0) & ~closed, ends & (inner == 0)
        names, scalar = acc["key"] & piece.startswith('"'), ~piece.isin("{", "}", "[", "]", ":", ",")
        leaf = (
            F.when((inner > 0) & (deeper == 0), F.struct(path.alias("path"), F.array_join(whole, "").alias("text")))
            .when(inner > 0, None)
            .when(shuts & in_array, F.struct(F.concat(above, F.array(F.lit("[#]"))).alias("path"), F.when(acc["fresh"], 0).otherwise(index + 1).cast("string").alias("text")))
            .when(shuts & acc["fresh"], F.struct(above.alias("path"), F.lit("{}").alias("text")))
            .when(scalar & ~names, F.struct(path.alias("path"), piece.alias("text")))
        )
        name = F.when(names, F.try_variant_get(F.try_parse_json(piece), "$", "string")).when((piece == ",") & in_array, F.format_string("[%d]", index + 1))
        moved = (
            F.when(inner > 0, path)
            .when(opens, F.concat(path, F.array(F.when(piece == "[", "[0]").otherwise(""))))
            .when(shuts, above)
            .when(name.isNotNull(), F.concat(above, F.array(name)))
            .otherwise(path)
        )
        kinds = F.when(opens, F.concat(opened, piece)).when(shuts, opened.substr(F.lit(1), F.length(opened) - 1)).otherwise(opened)
        key = F.when(inner > 0, False).when((piece == "{") | ((piece == ",") & ~in_array), True).otherwise(False)
        return F.struct(
            moved.alias("path"), kinds.alias("open"), key.alias("key"), opens.alias("fresh"), F.when(closed & (inner == 0), 1).when(inner > 0, deeper).otherwise(0).alias("inner"),
            held.alias("held"), F.when(leaf.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(leaf))).alias("out"),
        )

    return F.aggregate(pieces, start, step)["out"]


def flatten_state(df: DataFrame, keys: Sequence[str], json_col: str, expand_arrays: bool = False) -> DataFrame:
    """Leaf table of a JSON object column, in one narrow pass without a shuffle.

    The first ``OPENED`` levels open the objects found at the level above, one by one; rows that are already leaves pass
    through.  What is nested deeper is read off its text by a fold, so the plan is the same for any
    depth and nothing is computed while it is built.  Documents nested more than 1000 deep do not parse in
    Spark and give no leaf, like any text that is no JSON.
    """
    rows = df.select(
        *keys, F.array().cast("array<string>").alias("path"), F.try_parse_json(json_col).alias("_v")
    ).filter(F.col("_v").isNotNull())
    for _ in range(OPENED):
        opened = rows.select(*keys, "path", "_v", F.explode_outer(_children(F.col("_v"), expand_arrays)).alias("_e"))
        leaf = F.col("_e").isNull()
        rows = opened.select(
            *keys,
            F.when(leaf, F.col("path")).otherwise(F.concat("path", F.array("_e.key"))).alias("path"),
            F.when(leaf, F.col("_v")).otherwise(F.col("_e.value")).alias("_v"),
        )
    rows = rows.select("*", F.to_json("_v").alias("_t"))
    nested = F.col("_t").startswith("{") & (F.col("_t") != "{}")
    nested = nested | F.col("_t").startswith("[") if expand_arrays else nested
    deep = rows.select(*keys, "path", "_v", F.explode_outer(F.when(nested, _deep_leaves(F.col("_t"), expand_arrays))).alias("_e"))
    leaf = F.col("_e").isNull()
    rows = deep.select(
        *keys,
        F.when(leaf, F.col("path")).otherwise(F.concat("path", "_e.path")).alias("path"),
        F.when(leaf, F.col("_v")).otherwise(F.try_parse_json("_e.text")).alias("_v"),
    )
    text = F.to_json("_v")
    leaves = rows.select(*keys, "path", "_v", F.coalesce(text, F.lit("null")).alias("_t"))
    value = (
        F.when(_kind(F.col("_t")) == "string", F.try_variant_get("_v", "$", "string"))
        .when(_kind(F.col("_t")) == "number", F.try_variant_get("_v", "$", "double").cast("string"))
        .otherwise(F.col("_t"))
    )
    is_length = F.try_element_at("path", F.lit(-1)).eqNullSafe(F.lit("[#]"))
    kind = F.when(is_length, "length").otherwise(_kind(F.col("_t")))
    return leaves.select(*keys, "path", kind.alias("kind"), value.alias("value")).filter(F.size("path") > 0)


def _nodes(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every path that exists, with whether it is an object; list lengths are no paths."""
    depth = F.explode(F.sequence(F.lit(1), F.size("path")))
    steps = leaves.filter("kind <> 'length'").select(*keys, "path", "kind", depth.alias("_d"))
    is_object = (F.col("_d") < F.size("path")) | (F.col("kind") == "object")
    return (
        steps.select(*keys, F.slice("path", F.lit(1), F.col("_d")).alias("node"), is_object.alias("is_object"))
        .groupBy(*keys, "node")
        .agg(F.bool_or("is_object").alias("is_object"))
    )


def _with_inner(leaves: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Leaves of one side and, as rows of kind ``inner``, the distinct objects above them."""
    named = lambda rows: rows.select(*keys, "path", F.col("kind").alias(f"{side}_kind"), F.col("value").alias(f"{side}_value"))
    above = leaves.filter(F.size("path") > 1).select(*keys, "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("_d"))
    inner = above.select(*keys, F.slice("path", F.lit(1), F.col("_d")).alias("path")).distinct()
    inner = inner.select("*", F.lit("inner").alias("kind"), F.lit(None).cast("string").alias("value"))
    return named(leaves).unionByName(named(inner))


def diff_leaves(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every differing leaf with the highest differing key (``diff_path``) it belongs to.

    Leaves and the objects above them meet their like on the other side in one join.  Below an object that the other side
    does not hold as one, nothing can agree; only those objects are looked up again, for the highest of them.  What differs
    is a stored step, so the join is done once, here.
    """
    keys = list(keys)
    before, after = before.filter("kind <> 'length'"), after.filter("kind <> 'length'")
    same = (F.col("b_kind") == F.col("a_kind")) & F.col("b_value").eqNullSafe(F.col("a_value"))
    joined = _with_inner(before, keys, "b").join(_with_inner(after, keys, "a"), [*keys, "path"], "full")
    moved = joined.filter(~F.coalesce(same, F.lit(False)))
    inner = F.coalesce(F.col("b_kind") == "inner", F.lit(False)), F.coalesce(F.col("a_kind") == "inner", F.lit(False))
    # One row for two leaves that differ, without ``gained``; else one per side that has something here: its own kind and
    # value, and the kind it meets.
    facing = lambda own, other, gained: F.struct(
        gained.alias("gained"), F.col(f"{own}_kind").alias("kind"), F.col(f"{own}_value").alias("value"),
        F.col(f"{other}_kind").alias("met"), F.col(f"{other}_value").alias("met_value"),
    )
    side = lambda own, other, gained: F.when(F.col(f"{own}_kind").isNotNull(), facing(own, other, F.lit(gained)))
    leaf = F.col("b_kind").isNotNull() & F.col("a_kind").isNotNull() & ~inner[0] & ~inner[1]
    both = F.array(facing("b", "a", F.lit(None).cast("boolean")))
    sides = F.filter(F.array(side("b", "a", False), side("a", "b", True)), lambda x: x.isNotNull())
    faced = moved.select(*keys, "path", F.explode(F.when(leaf, both).otherwise(sides)).alias("_f")).select(*keys, "path", "_f.*")
    faced = stored(faced, "faced")  # read four times below
    changed = faced.filter("gained IS NULL").select(
        *keys, F.col("path").alias("diff_path"), F.lit("changed").alias("op"), "path", F.col("value").alias("old_value"),
        F.col("met_value").alias("new_value"), F.col("kind").alias("old_kind"), F.col("met").alias("new_kind"),
    )
    faced = faced.filter("gained IS NOT NULL").drop("met_value")
    # A struct is compared as a whole, so rows without a key find their own objects too.
    at = lambda node: F.struct(*keys, "gained", node.alias("node")).alias("_at")
    missing = F.when(F.col("gained"), "added").otherwise("removed")
    bad = faced.filter((F.col("kind") == "inner") & (F.col("met").isNull() | ~F.col("met").isin("inner", "object")))
    bad = bad.select(*keys, "gained", "path", F.when(F.col("met").isNull(), missing).otherwise("changed").alias("op"))
    tops = bad.select(at(F.col("path")).alias("_up"), F.struct(F.size("path").alias("d"), "op").alias("_s"))
    chain = bad.select(at(F.col("path")), *keys, "gained", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("_d"))
    chain = chain.select("_at", at(F.slice("path", F.lit(1), F.col("_d"))).alias("_up"))
    lift = chain.join(tops, "_up").groupBy("_at").agg(F.min("_s").alias("_s"))
    # An empty object that meets a filled one is reported by the other side; any other leaf that meets an object was changed.
    own = faced.filter((F.col("kind") != "inner") & ~((F.col("kind") == "object") & F.col("met").eqNullSafe(F.lit("inner"))))
    parent = F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))
    placed = own.select(at(parent), F.slice("path", F.size("path"), F.lit(1)).alias("_last"), "kind", "value", F.col("met").isNull().alias("alone")).join(lift, "_at", "left")
    placed = placed.groupBy("_at", "_last", "kind", "value", "alone").agg(F.min("_s").alias("_s"))
    placed = placed.select("_at.*", F.concat("_at.node", "_last").alias("path"), "kind", "value", "alone", "_s")
    op = F.coalesce("_s.op", F.when(F.col("alone"), missing).otherwise("changed"))
    old, new = (lambda c: F.when(~F.col("gained"), F.col(c))), (lambda c: F.when(F.col("gained"), F.col(c)))
    lifted = placed.select(
        *keys, F.slice("path", F.lit(1), F.coalesce("_s.d", F.size("path"))).alias("diff_path"), op.alias("op"), "path",
        old("value").alias("old_value"), new("value").alias("new_value"), old("kind").alias("old_kind"), new("kind").alias("new_kind"),
    )
    return changed.unionByName(lifted)


def state_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per highest differing key: op, old and new value, number of leaves below.

    Values are given where the key itself is a leaf; the content of an added or removed
    subtree stays in :func:`diff_leaves`, so no subtree is gathered into one row.
    """
    whole = F.col("path") == F.col("diff_path")
    return (
        diff_leaves(before, after, keys)
        .groupBy(*keys, "diff_path", "op")
        .agg(
            F.max(F.when(whole, F.col("old_value"))).alias("old_value"),
            F.max(F.when(whole, F.col("new_value"))).alias("new_value"),
            F.count(F.lit(1)).alias("leaf_count"),
        )
        .withColumnRenamed("diff_path", "path")
    )


def apply_diff(before: DataFrame, diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replay a leaf-level diff on a leaf table (``kind`` is not tracked)."""
    gone = diff.filter(F.col("old_value").isNotNull()).select(*keys, "path")
    kept = before.select(*keys, "path", "value").join(gone, [*keys, "path"], "left_anti")
    fresh = diff.filter(F.col("new_value").isNotNull()).select(*keys, "path", F.col("new_value").alias("value"))
    return kept.unionByName(fresh)


def snapshot_diffs(snapshots: DataFrame, run: str, step: str) -> DataFrame:
    """Each snapshot against the one before it: ``(run, step, path, op, old_value, new_value)``.

    Works per path, so a long run is never ordered as a whole.  Steps are consecutive.
    """
    last = snapshots.groupBy(run).agg(F.max(step).alias("_last"), F.min(step).alias("_first"))
    seen = with_previous(snapshots, [run, "path"], step, ["value"])
    adjacent = F.col(f"prev.{step}") == F.col(step) - 1
    old = F.when(adjacent, F.col("prev.value"))
    arrived = (
        seen.join(last, run)
        .filter(F.col(step) > F.col("_first"))
        .filter(~F.coalesce(adjacent, F.lit(False)) | (F.col("prev.value") != F.col("value")))
        .select(
            run,
            step,
            "path",
            F.when(F.coalesce(adjacent, F.lit(False)), "changed").otherwise("added").alias("op"),
            old.alias("old_value"),
            F.col("value").alias("new_value"),
        )
    )
    # A path missing from the next snapshot was removed there.
    following = snapshots.select(run, (F.col(step) - 1).alias(step), "path")
    removed = (
        snapshots.join(following, [run, step, "path"], "left_anti")
        .join(last, run)
        .filter(F.col(step) < F.col("_last"))
        .select(
            run,
            (F.col(step) + 1).alias(step),
            "path",
            F.lit("removed").alias("op"),
            F.col("value").alias("old_value"),
            F.lit(None).cast("string").alias("new_value"),
        )
    )
    return arrived.unionByName(removed)


def _differing_parts(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, _top)``: top-level keys whose subtrees are not equal, by digests of their leaves."""
    leaf = F.xxhash64("path", "kind", "value")
    again = F.xxhash64("value", "kind", "path", F.lit(1))

    def digests(leaves: DataFrame, name: str) -> DataFrame:
        sums = F.struct(F.count(F.lit(1)), F.bit_xor(leaf), F.bit_xor(again))
        return leaves.groupBy(*keys, F.col("path")[0].alias("_top")).agg(sums.alias(name))

    both = digests(before, "_b").join(digests(after, "_a"), [*keys, "_top"], "full")
    return both.filter(~F.col("_b").eqNullSafe(F.col("_a"))).select(*keys, "_top")


def step_diffs(snapshots: DataFrame, run: str, step: str, json_col: str) -> DataFrame:
    """Each state of a run against the one before it, lifted: the rows of :func:`state_diff` per ``(run, step)``.

    ``snapshots(run, step, json)`` holds one JSON state per step; steps are any increasing numbers.  Digests decide
    what is opened: states equal to the one before are not flattened, and of the others only top-level
    subtrees whose digests differ are compared.  A state that is no JSON object counts as an empty one; the first
    of a run has no row.
    """
    keys = [run, step]
    seen = with_previous(snapshots.select(run, step, F.coalesce(fingerprint(json_col), F.lit("")).alias("_d")), [run], step, ["_d"])
    moved = seen.filter(F.col("prev._d") != F.col("_d")).select(run, step, F.col(f"prev.{step}").alias("_prev"))
    now = snapshots.join(moved.select(*keys), keys)
    last = snapshots.withColumnRenamed(step, "_prev").join(moved, [run, "_prev"]).select(run, step, json_col)
    before, after = flatten_state(last, keys, json_col), flatten_state(now, keys, json_col)
    parts = _differing_parts(before, after, keys)

    def pruned(leaves: DataFrame) -> DataFrame:
        return leaves.withColumn("_top", F.col("path")[0]).join(parts, [*keys, "_top"], "left_semi").drop("_top")

    return state_diff(pruned(before), pruned(after), keys)


def update_diffs(updates: DataFrame, run: str, step: str, path: str, value: str) -> DataFrame:
    """Diff each single-path update makes: added, changed, or no row when nothing changed."""
    seen = with_previous(updates, [run, path], step, [value])
    return seen.filter(F.col("prev").isNull() | (F.col(f"prev.{value}") != F.col(value))).select(
        run,
        step,
        path,
        F.when(F.col("prev").isNull(), "added").otherwise("changed").alias("op"),
        F.col(f"prev.{value}").alias("old_value"),
        F.col(value).alias("new_value"),
    )


def mark_writes(steps: DataFrame, diffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A step is a write when its diff is not empty."""
    changed = diffs.select(*keys).distinct().withColumn("_w", F.lit(True))
    return steps.join(changed, list(keys), "left").withColumn("is_write", F.coalesce("_w", F.lit(False))).drop("_w")


def is_soft_path(path: Column) -> Column:
    """Paths whose exact value is not required."""
    head, tail = F.get(path, F.lit(0)), F.try_element_at(path, F.lit(-1))
    soft = head.isin(fixed.SOFT_PREFIXES) | tail.isin(fixed.SOFT_FIELDS)
    return F.coalesce(soft, F.lit(False))


def diff_to_assertions(diff: DataFrame) -> DataFrame:
    """Final-state assertions, one per terminal diff row."""
    return diff.select(
        *[c for c in diff.columns if c not in ("path", "op", "old_value", "new_value", "leaf_count")],
        F.array_join("path", ".").alias("path"),
        F.col("op").alias("assertion_type"),
        F.when(F.col("op") == "changed", F.col("old_value")).alias("old_value"),
        F.when(F.col("op") == "changed", F.col("new_value")).alias("new_value"),
        F.when(F.col("op") == "added", F.col("new_value"))
        .when(F.col("op") == "removed", F.col("old_value"))
        .alias("value"),
        (~is_soft_path(F.col("path"))).alias("is_hard"),
    )


def assertion_tables(leaves: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Assertions of a diff and the leaves they expect, in the shape ``matching.check_assertions`` takes.

    ``leaves`` are :func:`diff_leaves`.  The header has one row per highest differing key; the second table
    holds what it expects below that key: new leaves of added and changed values, old leaves of removed and
    changed ones.  No subtree is gathered into one row.
    """
    name = F.array_join("diff_path", ".").alias("assertion")
    # An object that became a plain value, or the reverse, is one changed key with leaves of both sides.
    header = leaves.select(*keys, name, F.col("op").alias("assertion_type"))
    header = header.distinct().withColumn("path", F.col("assertion"))
    expected = leaves.select(
        *keys,
        name,
        F.slice("path", F.size("diff_path") + 1, F.greatest(F.size("path") - F.size("diff_path"), F.lit(0))).alias("rel_path"),
        F.when(F.col("op") == "removed", F.col("old_kind")).otherwise(F.col("new_kind")).alias("kind"),
        F.when(F.col("op") == "removed", F.col("old_value")).otherwise(F.col("new_value")).alias("value"),
        "old_kind",
        "old_value",
    )
    return header, expected


def path_parts(c: Column | str) -> Column:
    """Dotted path to parts, empty parts dropped."""
    return F.filter(F.split(tx.col(c), r"\."), lambda p: p != "")


def lookup_path(lookups: DataFrame, leaves: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Add ``found`` and ``value`` (null for objects) for each dotted path."""
    keys = list(keys)
    wanted = lookups.withColumn("node", path_parts(path))
    hits = _nodes(leaves, keys).join(
        leaves.select(*keys, F.col("path").alias("node"), "value"), [*keys, "node"], "left"
    )
    hits = hits.withColumn("_found", F.lit(True)).drop("is_object")
    return (
        wanted.join(hits, [*keys, "node"], "left")
        .withColumn("found", F.coalesce("_found", F.size("node") == 0))
        .drop("_found", "node")
    )


def container_sizes(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per top-level container: type, number of items, whether it is a non-blank scalar."""
    container, item = F.get("path", F.lit(0)), F.get("path", F.lit(1))
    # Distinct items first, so one huge container is counted in parallel.
    items = leaves.groupBy(*keys, container.alias("container"), item.alias("item")).agg(
        F.max(F.when(F.size("path") == 1, F.col("kind"))).alias("kind"),
        F.max(F.when(F.size("path") == 1, F.col("value"))).alias("value"),
    )
    return items.groupBy(*keys, "container").agg(
        F.coalesce(F.max("kind"), F.lit("object")).alias("kind"),
        F.coalesce(
            F.max(F.when(F.col("kind") == "array", F.json_array_length("value"))).cast("long"), F.count("item")
        ).alias("size"),
        F.coalesce(F.max(F.col("value")), F.lit("")).alias("value"),
    )


def container_stats(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    structured = F.col("kind").isin("object", "array")
    size = F.when(structured, F.col("size")).otherwise(0)
    scalar = ~structured & (F.col("kind") != "null") & (F.col("value") != "")
    stats = sizes.groupBy(*keys).agg(
        F.count_if(structured).alias("structured_container_count"),
        F.count_if(size > 0).alias("populated_container_count"),
        F.sum(size).alias("total_structured_items"),
        F.max(size).alias("max_container_size"),
        F.count_if(scalar).alias("scalar_field_count"),
    )
    total = F.col("total_structured_items")
    return stats.withColumn(
        "state_profile", F.when(total <= 4, "sparse").when(total <= 15, "balanced").otherwise("crowded")
    )


def state_validity(stats: DataFrame, tool_count: Column | str) -> DataFrame:
    """First reason a state is unusable, or 'ok', with a warning for single-container states."""
    total, biggest = F.col("total_structured_items"), F.col("max_container_size")
    populated, tools = F.col("populated_container_count"), tx.col(tool_count)
    rich = (tools >= 5) & (biggest >= 3)
    reason = (
        F.when((total < 3) & (biggest < 2), "state is too sparse to support non-trivial tasks")
        .when(populated < 1, "no populated structured containers found")
        .when((populated < 2) & ~rich, "fewer than two populated structured containers")
        .otherwise("ok")
    )
    warning = F.when(
        (F.col("reason") == "ok") & (populated < 2),
        "only one populated structured container; accepted because the state is still rich enough",
    )
    checked = stats.withColumn("reason", reason)
    return checked.withColumn("warning", warning).withColumn("is_valid", F.col("reason") == "ok")


def dedupe_states(states: DataFrame, keys: Sequence[str], json_col: str, order: str) -> DataFrame:
    """Last record per canonical state."""
    marked = states.withColumn("fingerprint", fingerprint(json_col))
    return first_per_key(marked, [*keys, "fingerprint"], [order], last=True)


def list_containers(entities: DataFrame, keys: Sequence[str], container: str, entity: str, order: str) -> DataFrame:
    """Item count and first five keys of every container."""
    groups = [*keys, container]
    counts = entities.groupBy(*groups).agg(F.count(F.lit(1)).alias("item_count"))
    # rank <= 5 becomes a per-task group limit before the shuffle.
    ranked = entities.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(order)))
    sample = (
        ranked.filter(F.col("_r") <= 5)
        .groupBy(*groups)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", entity))), lambda x: x[entity].cast("string")), ",").alias("sample_keys"))
    )
    return counts.join(sample, groups)


def page_limit(limit: int | None, default: int, maximum: int) -> int:
    return default if limit is None or limit <= 0 else min(limit, maximum)


def list_entities(
    entities: DataFrame, keys: Sequence[str], order: str, block: Column, limit: int | None = 50, offset: int = 0
) -> DataFrame:
    """One page of entities per container with the container's total."""
    size, start = page_limit(limit, 50, 200), max(offset, 0)
    totals = entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_count"))
    placed = with_position(entities, keys, [order], block, "position")
    page = placed.filter((F.col("position") > start) & (F.col("position") <= start + size))
    return page.join(totals, list(keys))


def search_entities(
    fields: DataFrame,
    query: str,
    container: str = "container",
    entity: str = "entity_key",
    field: str = "field_name",
    value: str = "field_value",
    only_container: str | None = None,
    only_fields: Sequence[str] | None = None,
    exact: bool = False,
    limit: int | None = 20,
) -> DataFrame:
    """Top entities whose key or scalar fields match, exact hits first.

    ``fields`` has one row per (entity, scalar field), including ``entity_key`` itself.
    """
    if not query.strip():
        raise ValueError("query must be a non-empty text")
    needle, top = query.strip().lower(), page_limit(limit, 20, 100)
    rows = fields if only_container is None else fields.filter(F.col(container) == only_container)
    if only_fields is not None:
        rows = rows.filter(F.col(field).isin(list(only_fields)))
    candidate = F.lower(tx.strip(value))
    hit = (candidate == needle) if exact else F.contains(candidate, F.lit(needle))
    score = F.when(candidate == needle, 0).otherwise(1)
    return (
        rows.filter((candidate != "") & hit)
        .groupBy(container, entity)
        .agg(F.min(score).alias("score"), F.count(F.lit(1)).alias("matched_fields"))
        .orderBy("score", container, entity)
        .limit(top)
    )


def single_entities(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, container, single_key)`` of containers that hold one record instead of records by key.

    Such a container has an id-like field of its own; its key is the first of these with a value.
    """
    name, plain = F.get("path", F.lit(1)), F.col("kind").isin("string", "number", "boolean")
    listed = F.array_position(F.array(*[F.lit(f) for f in fixed.ENTITY_ID_FIELDS]), name)
    rank = F.when(listed > 0, listed).when(name.endswith("_id"), F.lit(len(fixed.ENTITY_ID_FIELDS) + 1))
    usable = plain & (F.size("path") == 2) & (F.col("value") != "")
    marked = leaves.select(*keys, F.get("path", F.lit(0)).alias("container"), rank.alias("_rank"), name.alias("_name"), usable.alias("_ok"), "value")
    best = F.min_by(F.when(F.col("_ok"), F.col("value")), F.when(F.col("_ok"), F.struct("_rank", "_name")))
    return marked.filter("_rank IS NOT NULL").groupBy(*keys, "container").agg(F.coalesce(best, F.lit("singleton")).alias("single_key"))


def searchable_fields(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows for :func:`search_entities`: scalar fields at most two levels deep, plus the key.

    Values inside lists are found in leaves flattened with ``expand_arrays``; the list lengths among
    those are no fields.  A container that is one record is one entity.
    """
    keys = list(keys)
    values = leaves.filter((F.size("path") >= 2) & ~F.try_element_at("path", F.lit(-1)).eqNullSafe(F.lit("[#]")))
    leaves = values.withColumn("container", F.get("path", F.lit(0))).join(single_entities(values, keys), [*keys, "container"], "left")
    container, one = F.col("container"), F.col("single_key").isNotNull()
    entity = F.coalesce("single_key", F.get("path", F.lit(1)))
    before = F.when(one, 1).otherwise(2)  # path parts that name the entity
    inner = F.slice("path", before + 1, F.greatest(F.size("path") - before, F.lit(1)))
    scalar = F.col("kind").isin("string", "number", "boolean") & (F.col("value") != "")
    own = leaves.filter(scalar & (F.size("path") - before <= 2)).select(
        *keys,
        container.alias("container"),
        entity.alias("entity_key"),
        F.coalesce(F.nullif(F.array_join(inner, "."), F.lit("")), F.lit("value")).alias("field_name"),
        F.col("value").alias("field_value"),
    )
    key_rows = (
        leaves.select(*keys, container.alias("container"), entity.alias("entity_key"))
        .distinct()
        .select("*", F.lit("entity_key").alias("field_name"), F.col("entity_key").alias("field_value"))
    )
    return own.unionByName(key_rows)


def get_entity(leaves: DataFrame, container: str, entity_key: Column | str) -> DataFrame:
    """Leaves of one entity."""
    key = F.lit(entity_key.strip()) if isinstance(entity_key, str) else entity_key
    return leaves.filter((F.get("path", F.lit(0)) == container) & (F.get("path", F.lit(1)) == key))


def is_single_entity(record: Column | str) -> Column:
    keys = F.coalesce(F.json_object_keys(tx.col(record)), F.array().cast("array<string>"))
    return F.exists(keys, lambda k: k.isin(fixed.ENTITY_ID_FIELDS) | k.endswith("_id"))


def entity_key(record: Column | str) -> Column:
    """Preferred id-like field of a JSON record, else any ``*_id`` field, else 'singleton'."""
    fields = F.from_json(tx.col(record), "map<string,string>")
    preferred = [F.nullif(F.try_element_at(fields, F.lit(f)), F.lit("")) for f in fixed.ENTITY_ID_FIELDS]
    ids = F.filter(F.map_entries(fields), lambda e: e["key"].endswith("_id") & (F.coalesce(e["value"], F.lit("")) != ""))
    return F.coalesce(*preferred, F.get(ids, F.lit(0))["value"], F.lit("singleton"))


def _prefixes(path: Column, proper: bool = False) -> Column:
    """Dotted prefixes of a dotted path, the path itself included unless ``proper``."""
    parts = path_parts(path)
    last = F.size(parts) - (1 if proper else 0)
    cuts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(cuts, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def _last_resets(paths: DataFrame, log: DataFrame, run: str, path: str, seq: str) -> DataFrame:
    """Per ``(run, path)`` the last set or delete of the path or of anything above it."""
    marks = log.filter(F.col("op").isin("set", "delete")).groupBy(run, path)
    marks = marks.agg(F.max(F.struct(seq, "op", "value")).alias("_m")).withColumnRenamed(path, "_q")
    spread = paths.select(run, path).distinct().withColumn("_q", F.explode(_prefixes(F.col(path))))
    entry = F.struct(F.col(f"_m.{seq}").alias(seq), (F.col("_q") == F.col(path)).alias("own"), F.col("_m.op").alias("op"), F.col("_m.value").alias("value"))
    return spread.join(marks, [run, "_q"]).groupBy(run, path).agg(F.max(entry).alias("_reset"))


def _since_reset(log: DataFrame, run: str, path: str, seq: str) -> DataFrame:
    """Updates that still count: from the last set or delete of a path, or of anything above it, on.

    A set makes the objects above its path; other updates below an object that is not there are dropped.
    """
    joined = log.join(_last_resets(log, log, run, path, seq), [run, path], "left")
    live = joined.filter(F.col("_reset").isNull() | (F.col(seq) >= F.col(f"_reset.{seq}")))
    above = F.try_element_at(_prefixes(F.col(path), proper=True), F.lit(-1))
    made = log.filter("op = 'set'").select(run, F.explode(_prefixes(F.col(path), proper=True)).alias("_above"), F.col(seq).alias("_at"))
    parents = live.select(run, above.alias("_above")).filter("_above IS NOT NULL").distinct()
    gone = _last_resets(parents.withColumnRenamed("_above", path), log, run, path, seq)
    gone = gone.select(run, F.col(path).alias("_above"), F.col(f"_reset.{seq}").alias("_gone"))
    born = made.join(gone, [run, "_above"], "left").filter(F.col("_gone").isNull() | (F.col("_at") > F.col("_gone")))
    born = born.groupBy(run, "_above").agg(F.min("_at").alias("_born"))
    placed = live.withColumn("_above", above).join(born, [run, "_above"], "left")
    there = F.col("_above").isNull() | (F.col("op") == "set") | F.coalesce(F.col(seq) > F.col("_born"), F.lit(False))
    return placed.filter(there).drop("_above", "_born")


def fold_updates(log: DataFrame, run: str, path: str, seq: str) -> DataFrame:
    """Final value of every path after set / delete / append / increment in order.

    Paths are dotted; a set or delete of a path ends what was below it.  ``kind`` is number, text (for a string
    ``value`` column) or list; the items of a list come from :func:`folded_items`, so a long list is never held
    in one row.  An append turns a plain value into a new list; increments of a text have no meaning.
    """
    live = _since_reset(log, run, path, seq)
    typed = dict(log.dtypes)["value"] == "string"
    number = (lambda c: c.try_cast("double")) if typed else (lambda c: c)
    folded = live.groupBy(run, path).agg(
        F.max("_reset").alias("_reset"),
        F.count_if(F.col("op") == "append").alias("item_count"),
        F.count_if(F.col("op") == "increment").alias("_incs"),
        F.sum(F.when(F.col("op") == "increment", number(F.col("value")))).alias("_sum"),
    )
    was_set = F.coalesce((F.col("_reset.op") == "set") & F.col("_reset.own"), F.lit(False))
    alive = was_set | (F.col("item_count") + F.col("_incs") > 0)
    given = F.when(was_set, F.col("_reset.value"))
    base = F.coalesce(number(given), F.lit(0.0)) + F.coalesce("_sum", F.lit(0.0))
    text = given.isNotNull() & number(given).isNull() if typed else F.lit(False)
    value = F.when(text, given).otherwise(base.cast("string")) if typed else base
    return folded.filter(alive).select(
        run,
        path,
        F.when(F.col("item_count") > 0, "list").when(text, "text").otherwise("number").alias("kind"),
        F.when(F.col("item_count") == 0, value).alias("value"),
        "item_count",
    )


def folded_items(log: DataFrame, run: str, path: str, seq: str, block: Column) -> DataFrame:
    """Items of every list-valued path with their 1-based index."""
    appended = _since_reset(log, run, path, seq).filter(F.col("op") == "append").drop("_reset")
    return with_position(appended, [run, path], [seq], block, "index").select(run, path, "index", "value")
