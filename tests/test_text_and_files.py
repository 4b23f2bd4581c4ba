"""Text parsing, readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions import text as tx
from tracemill.operators import corpus, textcols
from tracemill.sources import files, sinks


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("  'hi'  ", "hi"), ("\"'a b'\"", "a b"), ('"one" and "two"', 'one" and "two'), ("**`x`**", "x"), ('""', None),
        ("  word ", "word"), ("' deep '", "deep"), ("'", None), (None, None), ("\"''x''\"", "x"),
    ],
)
def test_clean_task_text(spark, raw, want):
    assert one(spark, raw, tx.clean_task_text("t")) == want


def test_extract_task_layouts(spark):
    talk = spark.createDataFrame([([("user", " 'do it' ")],), ([("bot", "no")],)], "conversations array<struct<`from`:string,value:string>>")
    assert [r.task for r in corpus.extract_task(talk, "conversations").collect()] == ["do it", None]
    prompt = spark.createDataFrame(
        [("x\nUser: book a table\nAI: sure\nGenerate API Request: z",), ("User: go TIME: now",), ("nothing",)], "input string"
    )
    assert [r.task for r in corpus.extract_task(prompt, "prompt").collect()] == ["book a table", "go", None]
    chat = spark.createDataFrame(
        [([("system", "s"), ("user", " "), ("user", "real")],)], "messages array<struct<role:string,content:string>>"
    )
    assert corpus.extract_task(chat, "messages").first().task == "real"
    with pytest.raises(ValueError):
        corpus.extract_task(chat, "other")


def test_reject_reasons(spark):
    cases = {"book a table": None, "café": "charset", "Play a Video": "media", "pay 5 USD": "blocked_term", "  ": "empty"}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: r.reject_reason for r in corpus.curate_tasks(df, "t").collect()} == cases


def test_conflict_codes(spark):
    assert one(spark, "T1, X9 , ST3", tx.conflict_codes("t")) == ["T1", "ST3"]
    assert one(spark, " None ", tx.conflict_codes("t")) == []


def test_sample_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    first = {r.k for r in corpus.sample_exact(df, "k", 37, seed=1).collect()}
    assert len(first) == 37
    assert first == {r.k for r in corpus.sample_exact(df.repartition(5), "k", 37, seed=1).collect()}
    assert first != {r.k for r in corpus.sample_exact(df, "k", 37, seed=2).collect()}
    with pytest.raises(Exception, match="cannot sample"):
        corpus.sample_exact(df, "k", 1001, seed=1).collect()


def test_limit_groups_keeps_blank(spark):
    df = spark.createDataFrame([(1, "b"), (2, ""), (3, "a"), (4, "b"), (5, "c")], "o int, env string")
    assert {r.o for r in corpus.limit_groups(df, "env", "o", 2).collect()} == {1, 3, 4}
    assert {r.o for r in corpus.limit_groups(df, "env", "o", 2, keep_blank=True).collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize(
    "text,want",
    [
        ('x {"a": 1} y {"b": 2}', {"a": 1}),
        ('```json\n{"a": [1, 2,],}\n``` {"z": 0}', {"a": [1, 2]}),
        ("{'a': 'b'} tail", {"a": "b"}),
        ('s {"a": "}{", "c": {"d": 1}} }', {"a": "}{", "c": {"d": 1}}),
        ("[1, 2] then", [1, 2]),
        ("{broken", None),
        ("", None),
        ('{bad [1]', [1]),
    ],
)
def test_extract_json(spark, text, want):
    got = one(spark, text, textcols.extract_json("t"))
    assert (json.loads(got) if got else None) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"init_config": {"a": 1}}', {"a": 1}), ('{"config": 3, "data": {"b": 2}}', {"b": 2}), ('{"c": 1}', {"c": 1}),
        ('[1]', None), ("none", None),
    ],
)
def test_extract_config(spark, text, want):
    got = one(spark, text, textcols.extract_config("t"))
    assert (json.loads(got) if got else None) == want


@pytest.mark.parametrize(
    "text,kind,names,rest",
    [
        ('a<tool_call>{"name":"x"}</tool_call>b', "tagged", ["x"], "ab"),
        ('<|python_tag|>{"name":"p","parameters":{"q":1}}', "python_tag", ["p"], ""),
        (' {"name":"j","arguments":{}} ', "json", ["j"], ""),
        ('[{"name":"l"},{"name":""},{"name":"m","arguments":[1]}]', "json_list", ["l"], ""),
        ('{"name":"j","arguments":"text"}', "none", [], '{"name":"j","arguments":"text"}'),
        ("<tool_call>oops</tool_call>", "none", [], "<tool_call>oops</tool_call>"),
    ],
)
def test_extract_tool_calls(spark, text, kind, names, rest):
    df = spark.createDataFrame([(text,)], "t string")
    row = textcols.extract_tool_calls(df, "t").first()
    assert (row.call_format, [c.name for c in row.tool_calls], row.remaining_text) == (kind, names, rest)


def test_constraint_bullets(spark):
    assert one(spark, "Rules\n- one\n-  \n- two ", textcols.constraint_bullets("t")) == ["one", "two"]


def test_read_jsonl_keeps_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    rows = files.read_jsonl(spark, str(tmp_path), "a int").collect()
    assert sorted((r.a, r["_corrupt"]) for r in rows if r.a) == [(1, None), (2, None)]
    assert [r["_corrupt"] for r in rows if r.a is None] == ["{broken"]


def test_read_items_shapes(spark, tmp_path):
    shapes = {"list": [{"a": 1}, 5], "map": {"k1": {"a": 2}, "k2": "skip"}, "items": {"items": [{"a": 3}], "meta": 1}}
    for name, doc in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    got = {
        (r.source_file.rsplit("/", 1)[1].split(".")[0], r.source_key): (r.record, r.is_object)
        for r in files.read_items(spark, str(tmp_path)).collect()
    }
    assert got == {
        ("list", "0"): ('{"a":1}', True), ("list", "1"): ("5", False), ("map", "k1"): ('{"a":2}', True),
        ("map", "k2"): ('"skip"', False), ("items", "0"): ('{"a":3}', True),
    }


def test_read_dialogues_falls_back(spark, tmp_path):
    def load(doc):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        (folder / "d.json").write_text(json.dumps(doc))
        items = files.read_items(spark, str(folder))
        return [json.loads(r.dialogue)["t"] for r in files.read_dialogues(items, "now", "old").orderBy("source_index", "position").collect()]

    assert load([{"env_id": "e", "now": [{"t": 1}, 3], "old": [{"t": 9}]}, {"old": [{"t": 8}]}]) == [1]
    assert load([{"env_id": "e", "now": [], "old": [{"t": 9}]}, {"old": [{"t": 8}]}]) == [9, 8]


def test_read_dialogues_falls_back_by_item(spark, tmp_path):
    doc = [{"now": [{"t": 1}, 3], "old": [{"t": 9}]}, {"old": [{"t": 8}, "x"]}, {"now": [], "old": [{"t": 7}]}, {"now": "odd", "old": [{"t": 6}]}, {"now": [5], "old": [{"t": 4}]}, {}]
    (tmp_path / "d.json").write_text(json.dumps(doc))
    rows = files.read_dialogues(files.read_items(spark, str(tmp_path)), "now", "old", per_item=True).orderBy("source_index", "position").collect()
    assert [json.loads(r.dialogue)["t"] for r in rows] == [1, 8, 7, 6]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("stable", "a", 1), ("unstable", "b", 2)], "variant string, dimension string, n int")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.split_write(df, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"variant=stable", "variant=unstable"}
    assert spark.read.parquet(str(tmp_path / "s")).filter("variant = 'stable'").count() == 1
    sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).filter(F.col("dimension") == "b").first().n == 2


def test_packaged_samples_feed_the_matchers(spark, tmp_path):
    """Written in one job, a folder per part; graph, diff and assertions are derived where a blueprint has none."""
    from tracemill.operators import matching as m
    from tracemill.operators import packaging as pk
    from tracemill.sources.files import read_packaged
    from tracemill.sources.sinks import write_packaged

    samples = spark.createDataFrame([("s1", "t1", "stable"), ("u1", "t1", "unstable"), ("s2", "t2", "stable"), ("s3", "t3", "stable")], "sample_id string, base_task_id string, variant string")
    steps = [("look", False), ("write", True), ("look", False)]
    trace = spark.createDataFrame(
        [(s, i + 1, tool, '{"i":%d}' % i, has) for s in ("s1", "u1", "s2", "gone") for i, (tool, has) in enumerate(steps)],
        "sample_id string, step_index int, tool_name string, arguments string, has_diff boolean",
    )
    turns = spark.createDataFrame([(s, 1, f"say {s}") for s in ("s1", "u1", "s2", "s3")], "sample_id string, turn int, text string")
    none = lambda ddl: spark.createDataFrame([], ddl)
    diff = "path array<string>, op string, old_value string, new_value string"
    dialogue = {
        "turns": turns, "stable_turns": turns.filter("sample_id = 'u1'").withColumn("text", F.lit("stable words")), "alignment": none("sample_id string, step_index int, turn int"),
        "trace": trace, "state_diff": spark.createDataFrame([("s1", ["a", "b"], "changed", "1", "2")], f"sample_id string, {diff}"),
    }
    blueprint = {
        "nodes": spark.createDataFrame([("t2", 1, "write", "write", "{}")], "task_id string, step_index int, node_kind string, tool_name string, arguments string"),
        "edges": none("task_id string, before_step int, after_step int"),
        "assertions": spark.createDataFrame([("t3", "x", "removed", None, None, "1", True)], "task_id string, path string, assertion_type string, old_value string, new_value string, value string, is_hard boolean"),
        "state_diff": spark.createDataFrame([("t1", ["c"], "added", None, "9"), ("t3", ["d"], "added", None, "8")], f"task_id string, {diff}"),
        "rules": spark.createDataFrame([("t1", "never delete")], "task_id string, rule string"),
    }
    parts = pk.packaged_children(samples, dialogue, blueprint)
    assert set(parts) == set(pk.PARTS)
    write_packaged(pk.packaged_rows(samples, parts), str(tmp_path / "out"))
    read = lambda part, schema: read_packaged(spark, str(tmp_path / "out"), part, schema)
    assert {tuple(r) for r in read("stable_turns", "turn int, text string").collect()} == {("s1", 1, "say s1"), ("u1", 1, "stable words"), ("s2", 1, "say s2"), ("s3", 1, "say s3")}
    assert {(r.sample_id, tuple(r.path)) for r in read("state_diff", diff).collect()} == {("s1", ("a", "b")), ("u1", ("c",)), ("s3", ("d",))}
    kept = read("assertions", "path string, assertion_type string, old_value string, new_value string, value string, is_hard boolean")
    assert {(r.sample_id, r.path, r.assertion_type) for r in kept.collect()} == {("s1", "a.b", "changed"), ("u1", "c", "added"), ("s3", "x", "removed")}
    nodes = read("nodes", "step_index int, node_kind string, tool_name string, arguments string")
    assert {r.sample_id: r["count"] for r in nodes.groupBy("sample_id").count().collect()} == {"s1": 3, "u1": 3, "s2": 1}
    # A run that does what the packaged trace says meets every node and every edge.
    gold = nodes.select(F.col("sample_id").alias("run_id"), F.col("step_index").alias("node"), "step_index", F.col("node_kind").alias("role"), F.col("tool_name").alias("tool"), "arguments")
    calls = read("trace", "step_index int, tool_name string, arguments string, has_diff boolean").filter("sample_id <> 's2'")
    calls = calls.select(F.col("sample_id").alias("run_id"), F.col("step_index").cast("long").alias("pos"), F.col("tool_name").alias("tool"), "arguments")
    given = m.greedy_assign(gold.filter("run_id <> 's2'"), m.candidate_matches(gold.filter("run_id <> 's2'"), calls))
    assert {(r.run_id, r.step_index): r.position for r in given.collect()} == {(s, i): i for s in ("s1", "u1") for i in (1, 2, 3)}
    edges = read("edges", "before_step int, after_step int").withColumnRenamed("sample_id", "run_id")
    assert {tuple(r) for r in edges.collect()} == {(s, i, i + 1) for s in ("s1", "u1") for i in (1, 2)}
    assert all(r.satisfied for r in m.check_precedence(edges, given).collect())
    assert {tuple(r) for r in read("rules", "rule string").collect()} == {("s1", "never delete"), ("u1", "never delete")}
    assert pk.packaged_children(samples.limit(0), dialogue, blueprint)["assertions"].count() == 0
