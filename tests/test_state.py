"""State tables on nested JSON."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill.operators import state


def leaves(spark, docs, **kw):
    df = spark.createDataFrame([(str(k), json.dumps(v)) for k, v in docs.items()], "run_id string, doc string")
    return state.flatten_state(df, ["run_id"], "doc", **kw)


def rows(df, *names):
    return {tuple(tuple(v) if isinstance(v, list) else v for v in (r[n] for n in names)) for r in df.collect()}


def test_flatten_kinds(spark):
    doc = {"a": {"b": 1, "c": {}, "d": [1, {"x": 2}]}, "n": None, "t": True, "s": "x", "f": 1.0}
    got = rows(leaves(spark, {"r": doc}), "path", "kind", "value")
    assert got == {
        (("a", "b"), "number", "1.0"), (("a", "c"), "object", "{}"), (("a", "d"), "array", '[1,{"x":2}]'),
        (("n",), "null", "null"), (("t",), "boolean", "true"), (("s",), "string", "x"), (("f",), "number", "1.0"),
    }


def test_flatten_expands_arrays(spark):
    got = rows(leaves(spark, {"r": {"d": [1, {"x": 2}], "e": []}}, expand_arrays=True), "path", "value")
    assert got == {(("d", "[0]"), "1.0"), (("d", "[1]", "x"), "2.0"), (("d", "[#]"), "2.0"), (("e", "[#]"), "0.0")}


def test_any_depth_is_opened(spark):
    deep = '{"a":' * 40 + '{"x}]":"{[\\\\\\""}' + "}" * 40
    df = spark.createDataFrame([("r", deep), ("s", '{"b":1}'), ("t", "broken")], "run_id string, doc string")
    got = {(r.run_id, len(r.path), r.path[-1], r.value) for r in state.flatten_state(df, ["run_id"], "doc").collect()}
    assert got == {("r", 41, "x}]", '{[\\"'), ("s", 1, "b", "1.0")}


def flat(value, path=(), expand=False):
    """Leaves by the definition: ``path -> value``."""
    if isinstance(value, dict) and value or isinstance(value, dict) and not path:
        return {k: v for key, x in value.items() for k, v in flat(x, (*path, key), expand).items()}
    if expand and isinstance(value, list):
        out = {(*path, "[#]"): len(value)}
        for i, x in enumerate(value):
            out |= flat(x, (*path, f"[{i}]"), expand)
        return out
    return {path: value}


@pytest.mark.parametrize("expand", [False, True])
def test_deep_documents_match_the_definition(spark, expand):
    rnd = random.Random(31)

    def grow(depth):
        kind = rnd.random()
        if depth == 0 or kind < 0.25:
            return rnd.choice([1, -2.5, "x", 'q"}]{[,:\\', "", None, True, {}, [], "é☃"])
        if kind < 0.7:
            return {rnd.choice(["a", "b", "c.d", 'k"]', "[0]x", " "]): grow(depth - 1) for _ in range(rnd.randint(0, 3))}
        return [grow(depth - 1) for _ in range(rnd.randint(0, 3))]

    docs = {i: {"r": grow(12), "s": grow(8)} for i in range(150)}
    got = {}
    for r in leaves(spark, docs, expand_arrays=expand).collect():
        got.setdefault(r["run_id"], {})[tuple(r["path"])] = (r["kind"], r["value"])
    assert max(len(p) for own in got.values() for p in own) > 8
    for key, doc in docs.items():
        want = flat(doc, expand=expand)
        assert set(got[str(key)]) == set(want)
        for path, value in want.items():
            kind, text = got[str(key)][path]
            if kind in ("object", "array"):
                assert json.loads(text) == value
            elif kind in ("number", "length"):
                assert float(text) == value
            else:
                assert text == (json.dumps(value) if value is None or isinstance(value, bool) else value)


@pytest.mark.parametrize("depth", [40, 300, 900])
def test_very_deep_documents(spark, depth):
    """The plan does not grow with the depth, and a deep document does not end the job."""
    deep = '{"a":' * depth + '{"b":[1,{"c":2}]}' + "}" * depth
    df = spark.createDataFrame([("r", deep), ("s", '{"b":1}'), ("t", '{"a":' * 5000 + "1" + "}" * 5000)], "run_id string, doc string")
    flat_ = state.flatten_state(df, ["run_id"], "doc")
    assert {(r.run_id, len(r.path), r.value) for r in flat_.collect()} == {("r", depth + 1, '[1,{"c":2}]'), ("s", 1, "1.0")}


def reference_diff(old, new, path=()):
    out = {}
    for key in old.keys() | new.keys():
        here = (*path, key)
        if key not in old:
            out[here] = "added"
        elif key not in new:
            out[here] = "removed"
        elif isinstance(old[key], dict) and isinstance(new[key], dict):
            out.update(reference_diff(old[key], new[key], here))
        elif old[key] != new[key]:
            out[here] = "changed"
    return out


def random_state(rnd, depth=0):
    if depth == 3 or rnd.random() < 0.35:
        return rnd.choice([1, 2, "x", "y", None, [1], [1, 2], {}])
    return {k: random_state(rnd, depth + 1) for k in rnd.sample("abcd", rnd.randint(0, 3))}


def test_diff_matches_recursive_definition(spark):
    rnd = random.Random(5)
    before, after = {}, {}
    for i in range(120):
        before[f"r{i}"] = {"c": random_state(rnd), "d": random_state(rnd)}
        after[f"r{i}"] = {"c": random_state(rnd), "e": random_state(rnd), "d": before[f"r{i}"]["d"]}
    got = rows(state.state_diff(leaves(spark, before), leaves(spark, after), ["run_id"]), "run_id", "path", "op")
    want = {(r, p, op) for r in before for p, op in reference_diff(before[r], after[r]).items()}
    assert got == want


def test_apply_diff_round_trip(spark):
    before = {"r": {"c": {"a": 1, "b": "x"}, "k": {"z": [1]}}}
    after = {"r": {"c": {"a": 2}, "m": {"n": {"o": "new"}}}}
    b, a = leaves(spark, before), leaves(spark, after)
    replayed = state.apply_diff(b, state.diff_leaves(b, a, ["run_id"]), ["run_id"])
    assert rows(replayed, "path", "value") == rows(a, "path", "value")


def test_lookup_only_opens_objects(spark):
    held = leaves(spark, {"r": {"a": {"b": [1], "c": "v"}, "s": "x"}})
    wanted = spark.createDataFrame(
        [("r", p) for p in ["a.c", "a", "a.b.0", "s.t", "..a...c", ""]], "run_id string, path string"
    )
    got = {r.path: (r.found, r.value) for r in state.lookup_path(wanted, held, ["run_id"], "path").collect()}
    assert got == {
        "a.c": (True, "v"), "a": (True, None), "a.b.0": (False, None), "s.t": (False, None), "..a...c": (True, "v"), "": (True, None),
    }


def test_container_stats_and_validity(spark):
    docs = {
        "rich": {"users": {str(i): {"n": i} for i in range(3)}, "tags": ["a", "b"], "mode": "on"},
        "thin": {"users": {"1": {}}, "note": ""},
    }
    stats = state.container_stats(state.container_sizes(leaves(spark, docs), ["run_id"]), ["run_id"])
    got = {r.run_id: r for r in state.state_validity(stats, F.lit(1)).collect()}
    rich, thin = got["rich"], got["thin"]
    assert (rich.structured_container_count, rich.total_structured_items, rich.max_container_size, rich.scalar_field_count) == (2, 5, 3, 1)
    assert rich.reason == "ok" and rich.state_profile == "balanced"
    assert thin.reason.startswith("state is too sparse") and thin.scalar_field_count == 0


def test_entity_keys(spark):
    docs = [
        ('{"title":"T","user_id":"u1"}', "T", True), ('{"user_id":"u1","x":1}', "u1", True), ('{"x":1}', "singleton", False),
        ('{"id":"","order_id":"o9"}', "o9", True),
    ]
    df = spark.createDataFrame([(d,) for d, _, _ in docs], "doc string")
    got = df.select("doc", state.entity_key("doc").alias("k"), state.is_single_entity("doc").alias("s")).collect()
    assert [(r.doc, r.k, r.s) for r in got] == docs


def test_search_ranks_exact_first(spark):
    held = leaves(spark, {"r": {"users": {"u1": {"name": "Ann"}, "ann": {"name": "Bob", "home": {"city": "Annecy"}}}}})
    fields = state.searchable_fields(held, [])
    got = [(r.entity_key, r.score) for r in state.search_entities(fields, "ann").collect()]
    assert got == [("ann", 0), ("u1", 0)]
    partial = [(r.entity_key, r.score) for r in state.search_entities(fields, "anne").collect()]
    assert partial == [("ann", 1)]
    assert state.search_entities(fields, "anne", exact=True).count() == 0
    assert state.search_entities(fields, "ann", only_fields=["home.city"]).count() == 1


def test_search_lists_and_single_records(spark):
    doc = {"r": {"profile": {"id": "u7", "name": "Ann"}, "notes": {"n1": {"tags": ["red", "Anneke"]}, "n2": {"tags": []}}}}
    fields = state.searchable_fields(leaves(spark, doc, expand_arrays=True), [])
    hits = lambda query: {(r.container, r.entity_key) for r in state.search_entities(fields, query).collect()}
    assert hits("anneke") == {("notes", "n1")} and hits("ann") == {("profile", "u7"), ("notes", "n1")}
    assert hits("2.0") == set()  # the length of a list is no value
    with pytest.raises(ValueError, match="non-empty"):
        state.search_entities(fields, "  ")


def test_fold_updates(spark):
    log = [
        ("r", "a", 1, "increment", 2.0), ("r", "a", 2, "set", 5.0), ("r", "a", 3, "increment", 1.0),
        ("r", "b", 1, "set", 1.0), ("r", "b", 2, "append", 7.0), ("r", "b", 3, "append", 8.0),
        ("r", "c", 1, "set", 1.0), ("r", "c", 2, "delete", None), ("r", "d", 1, "delete", None), ("r", "d", 2, "increment", 4.0),
    ]
    df = spark.createDataFrame(log, "run_id string, path string, seq long, op string, value double")
    got = {r.path: (r.kind, r.value, r.item_count) for r in state.fold_updates(df, "run_id", "path", "seq").collect()}
    assert got == {"a": ("number", 6.0, 0), "b": ("list", None, 2), "d": ("number", 4.0, 0)}


def test_fold_updates_of_overlapping_paths(spark):
    rows = [
        (1, "a.b", "set", "1"), (2, "a", "delete", None), (3, "a.b", "append", "x"),  # nothing above it any more
        (4, "z.q", "increment", "5"),  # there never was a z
        (5, "c.d", "set", "2"), (6, "c.d", "increment", "3"), (7, "c.e", "append", "y"), (8, "c.e", "append", "z"),
        (9, "t", "set", "some text"), (10, "u.v.w", "set", "7"), (11, "u.v", "set", "9"), (12, "k", "increment", "2"),
        (13, "m.n", "set", "1"), (14, "m", "delete", None), (15, "m.o", "set", "4"), (16, "m.p", "increment", "6"),
    ]
    df = spark.createDataFrame([("r", *r) for r in rows], "run_id string, seq long, path string, op string, value string")
    got = {r.path: (r.kind, r.value, r.item_count) for r in state.fold_updates(df, "run_id", "path", "seq").collect()}
    assert got == {
        "c.d": ("number", "5.0", 0), "c.e": ("list", None, 2), "t": ("text", "some text", 0), "u.v": ("number", "9.0", 0),
        "k": ("number", "2.0", 0), "m.o": ("number", "4.0", 0), "m.p": ("number", "6.0", 0),
    }


def test_step_diffs_match_the_definition(spark):
    """Random states at uneven steps, some equal to the one before, one of them broken: topmost differing keys."""
    rnd = random.Random(12)
    rows, want = [], set()
    for run in range(40):
        last = None
        for step in sorted(rnd.sample(range(100), rnd.randint(1, 8))):
            doc = last if last is not None and rnd.random() < 0.4 else {k: random_state(rnd) for k in rnd.sample("pqrs", rnd.randint(0, 4))}
            rows.append((run, step, json.dumps(doc, sort_keys=rnd.random() < 0.5)))
            if last is not None:
                want |= {(run, step, path, op) for path, op in reference_diff(last, doc).items()}
            last = doc
    rows += [(99, 1, '{"a":1}'), (99, 5, "broken"), (99, 9, '{"b":{"c":2}}')]
    want |= {(99, 5, ("a",), "removed"), (99, 9, ("b",), "added")}
    df = spark.createDataFrame(rows, "run long, step long, doc string")
    got = state.step_diffs(df, "run", "step", "doc")
    assert {(r.run, r.step, tuple(r.path), r.op) for r in got.collect()} == want and len(want) > 200


def test_equal_states_are_not_opened(spark):
    same = spark.range(50).selectExpr("id % 5 AS run", "id AS step", """'{"a":{"b":1},"c":2}' AS doc""")
    assert state.step_diffs(same, "run", "step", "doc").count() == 0


def test_diff_keeps_repeats_and_rows_without_key(spark):
    """Objects that meet plain values or nothing, keys that repeat, and a run without a number."""
    docs = [
        (1, '{"a": {"b": {"c": 1, "d": 2}}, "e": {}, "f": 5}', '{"a": {"b": 7}, "e": {"x": 1}, "g": {"h": {"i": 1}}}'),
        (2, '{"a": {"b": 1}}', '{"a": {"b": 2}}'),
        (None, '{"a": {"b": 1}}', '{"a": {"b": 1}}'),
    ]
    df = spark.createDataFrame(docs, "run_id long, b string, a string")
    before, after = state.flatten_state(df, ["run_id"], "b"), state.flatten_state(df, ["run_id"], "a")
    twice = before.unionByName(before.filter("run_id = 2"))
    leaves = state.diff_leaves(twice, after, ["run_id"])
    found = sorted(((r.run_id or 0, ".".join(r.diff_path), r.op, ".".join(r.path), r.old_value, r.new_value) for r in leaves.collect()), key=repr)
    assert found == sorted([
        (1, "a.b", "changed", "a.b", None, "7.0"), (1, "a.b", "changed", "a.b.c", "1.0", None), (1, "a.b", "changed", "a.b.d", "2.0", None),
        (1, "e.x", "added", "e.x", None, "1.0"), (1, "f", "removed", "f", "5.0", None), (1, "g", "added", "g.h.i", None, "1.0"),
        (2, "a.b", "changed", "a.b", "1.0", "2.0"), (2, "a.b", "changed", "a.b", "1.0", "2.0"),
        (0, "a", "added", "a.b", None, "1.0"), (0, "a", "removed", "a.b", "1.0", None),
    ], key=repr)
    # Paths go through few shuffles: two of objects above leaves, two of both sides, and those of objects that are missing.
    plan = leaves._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\(.*path#", plan)) <= 8
