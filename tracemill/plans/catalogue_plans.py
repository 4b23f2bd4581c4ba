"""Catalogue queries: suppliers as environments, supplied parts as tools, events as test logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import fixed_values as fixed
from tracemill.operators import catalogue as cat
from tracemill.operators.running import block_of
from tracemill.plans import sqltext as q
from tracemill.plans.registry import plan
from tracemill.sources.tables import Tables

# Suppliers describe themselves untidily; supplied parts are their raw tools.
LOG = """log AS (SELECT user_id AS env_id, event_type AS tool, CASE WHEN value < 25 THEN 'positive' WHEN value < 100 THEN 'negative' ELSE '' END AS case_type,
  CASE WHEN k < 50 THEN 'pass' WHEN k < 70 THEN 'warning' WHEN k < 80 THEN 'fail' ELSE '' END AS raw_status,
  CASE WHEN k < 50 THEN 'pass' WHEN k < 70 THEN 'warning' WHEN k < 80 THEN 'fail' WHEN value < 40 THEN 'pass' ELSE 'fail' END AS status, event_id, value, k
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events))"""
COUNTERS = """count(*) AS total_count, count(*) FILTER (status = 'pass') AS pass_count, count(*) FILTER (status = 'warning') AS warning_count, count(*) FILTER (status = 'fail') AS fail_count,
  count(*) FILTER (case_type = 'positive') AS positive_count, count(*) FILTER (case_type = 'positive' AND status = 'pass') AS positive_pass_count,
  count(*) FILTER (case_type = 'positive' AND status = 'warning') AS positive_warning_count, count(*) FILTER (case_type = 'positive' AND status = 'fail') AS positive_fail_count,
  count(*) FILTER (case_type = 'negative') AS negative_count, count(*) FILTER (case_type = 'negative' AND status = 'pass') AS negative_pass_count,
  count(*) FILTER (case_type = 'negative' AND status = 'warning') AS negative_warning_count, count(*) FILTER (case_type = 'negative' AND status = 'fail') AS negative_fail_count"""
TOOLS = """raw AS (SELECT DISTINCT l_suppkey AS env_id, l_partkey AS ord FROM lineitem),
named AS (SELECT env_id, ord, p_name AS name, p_brand AS brand, p_size AS size FROM raw JOIN part ON ord = p_partkey),
tools AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY env_id, name ORDER BY ord) = 1)"""


def test_log(t: Tables) -> DataFrame:
    k, value = F.get_json_object("props", "$.k").cast("int"), F.col("value")
    return t.events.select(
        F.col("user_id").alias("env_id"),
        F.col("event_type").alias("tool"),
        F.when(value < 25, "Positive ").when(value < 100, "negative").alias("case_type"),
        F.when(k < 50, " PASS").when(k < 70, "warning").when(k < 80, "fail").alias("status"),
        F.when(k >= 80, value < 40).alias("passed"),
        "event_id",
    )


def raw_tools(t: Tables) -> DataFrame:
    supplied = t.lineitem.select(F.col("l_suppkey").alias("env_id"), F.col("l_partkey").alias("ord")).distinct()
    schema = F.concat(
        F.lit('{"properties": {"size": {"type": "integer"}, "brand": {"type": "string"}}, "required": ["size", "ghost"]}')
    )
    body = F.concat(
        F.lit('{"name": "  '), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit('", "description": "'), "p_brand",
        F.lit('", "parameters": '), schema, F.lit("}"),
    )
    wrapped = F.when(F.col("p_size") > 25, F.concat(F.lit('{"type": "function", "function": '), body, F.lit("}"))).otherwise(body)
    parts = t.part.select(F.col("p_partkey").alias("ord"), wrapped.alias("tool"))
    return supplied.join(parts, "ord")


def tools(t: Tables) -> DataFrame:
    return cat.normalize_tools(raw_tools(t), "env_id", "ord", "tool")


def envs(t: Tables) -> DataFrame:
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    raw = t.supplier.join(nation, "s_nationkey").select(
        F.col("s_suppkey").alias("env_key"),
        F.concat(F.lit("  env_"), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("env_id"),
        F.concat(F.col("s_name"), F.lit("  \n in   "), F.col("n_name")).alias("environment_summary"),
        F.concat(F.lit("Stock of "), "s_name").alias("environment_introduction"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit(" keep balance \n\nkeep balance\n ship from "), "n_name")).alias("constraints_rules"),
        F.when(F.col("s_acctbal") > 5000, '{"orders": {}, "parts": {}}').otherwise('{"orders": {}}').alias("states"),
        F.lit('{"ship": {}, "count": {}}').alias("methods"),
        F.concat(F.lit("class "), "n_name").alias("env_class_code"),
    )
    return cat.normalize_env(raw)


ENVS = f"""envs AS (SELECT s_suppkey AS env_key, 'env_' || s_suppkey AS env_id, s_name || ' in ' || n_name AS environment_summary, 'Stock of ' || s_name AS intro,
  CASE WHEN s_acctbal > 0 THEN ['keep balance', 'ship from ' || n_name] ELSE ['{fixed.NO_CONSTRAINTS}'] END AS rules,
  CASE WHEN s_acctbal > 5000 THEN 2 ELSE 1 END AS containers, length('class ' || n_name) AS code_length FROM supplier JOIN nation ON s_nationkey = n_nationkey),
cx AS (SELECT env_key, (SELECT count(*) FROM tools WHERE tools.env_id = env_key) AS tool_count, containers AS state_container_count, 2 AS method_count, code_length,
  length(intro) AS intro_length, len(rules) AS constraint_count FROM envs)"""


@plan(
    "e1_normalize_env",
    f"""WITH {TOOLS}, {ENVS} SELECT env_id, environment_summary, CASE WHEN len(rules) = 1 THEN '1. ' || rules[1] ELSE '1. ' || rules[1] || chr(10) || '2. ' || rules[2] END AS constraints_rules_text,
    CASE WHEN containers = 2 THEN 'orders,parts' ELSE 'orders' END AS containers, 'ship,count' AS methods FROM envs""",
)
def _(t: Tables) -> DataFrame:
    return envs(t).select(
        "env_id", "environment_summary", "constraints_rules_text",
        F.array_join("state_container_names", ",").alias("containers"), F.array_join("method_names", ",").alias("methods"),
    )


@plan(
    "e2_normalize_constraints",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    s AS (SELECT doc_id, {q.strip('line')} AS line, min(i) AS i FROM l WHERE {q.strip('line')} <> '' GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM s),
    j AS (SELECT doc_id, count(*) AS constraint_count, string_agg(r || '. ' || line, chr(10) ORDER BY r) AS constraints_text FROM n GROUP BY doc_id)
    SELECT doc_id, coalesce(constraint_count, 1) AS constraint_count, coalesce(constraints_text, '1. {fixed.NO_CONSTRAINTS}') AS constraints_text FROM documents LEFT JOIN j USING (doc_id)""",
)
def _(t: Tables) -> DataFrame:
    rules = t.documents.select("doc_id", cat.normalize_constraints("text").alias("rules"))
    return rules.select("doc_id", F.size("rules").alias("constraint_count"), cat.numbered("rules").alias("constraints_text"))


@plan("e3_normalize_tools", f"WITH {TOOLS} SELECT env_id, ord, name, brand AS description FROM tools")
def _(t: Tables) -> DataFrame:
    return tools(t).select("env_id", "ord", "name", "description")


@plan("e4_normalize_params", f"WITH {TOOLS} SELECT env_id, name, 'size,brand' AS properties, 'size' AS required FROM tools")
def _(t: Tables) -> DataFrame:
    return tools(t).select(
        "env_id", "name", F.array_join("properties", ",").alias("properties"), F.array_join("required", ",").alias("required")
    )


@plan(
    "e4_argument_schemas",
    """SELECT o_orderkey, 'book' AS tool, CASE WHEN o_orderstatus = 'O' THEN 'day' ELSE '' END AS required,
    'note=null;seats=#' || CAST(1 + o_shippriority AS DOUBLE) AS defaults, 'day=string;note=string;seats=integer' AS types
    FROM (SELECT *, o_orderkey % 7 AS o_shippriority FROM orders)""",
)
def _(t: Tables) -> DataFrame:
    # A required name that is no property does not count; a default may be null.
    schema = F.concat(
        F.lit('{"type": "object", "properties": {"day": {"type": "string"}, "note": {"type": "string", "default": null}, "seats": {"type": "integer", "default": '),
        (1 + F.col("o_orderkey") % 7).cast("string"), F.lit('}}, "required": ["'), F.when(F.col("o_orderstatus") == "O", "day").otherwise("gone"), F.lit('"]}'),
    )
    rows = t.orders.select("o_orderkey", F.lit("book").alias("name"), schema.alias("parameters"))
    out = cat.argument_schemas(rows, "o_orderkey", "parameters")
    pairs = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("o_orderkey", "tool", F.array_join("required", ",").alias("required"), pairs("defaults").alias("defaults"), pairs("types").alias("types"))


STANDARD = ", ".join(f"('{tool['name']}', {len(tool['parameters']['properties'])})" for tool in fixed.STANDARD_TOOLS)
STANDARD_CONTENT = ", ".join(f"({q.quote(tool['name'])}, {q.quote(tool['description'])}, {q.quote(json.dumps(tool['parameters']))})" for tool in fixed.STANDARD_TOOLS)


@plan(
    "e5_append_standard_tools",
    f"""WITH {TOOLS} SELECT env_id, name, 2 AS parameter_count FROM tools
    UNION ALL SELECT env_id, n, c FROM (SELECT DISTINCT env_id FROM tools), (VALUES {STANDARD}) v(n, c)""",
)
def _(t: Tables) -> DataFrame:
    both = cat.append_standard_tools(tools(t), "env_id", "ord")
    return both.select("env_id", "name", F.size("properties").alias("parameter_count"))


@plan(
    "e5_standard_tool_content",
    f"""WITH {TOOLS} SELECT env_id, n AS name, d AS description, json_extract_string(p, '$.required[0]') AS first_required, json_extract_string(p, '$.type') AS kind,
    array_to_string(json_keys(p, '$.properties'), ',') AS properties FROM (SELECT DISTINCT env_id FROM tools), (VALUES {STANDARD_CONTENT}) v(n, d, p)""",
)
def _(t: Tables) -> DataFrame:
    """Descriptions and schemas of the added tools."""
    both = cat.append_standard_tools(tools(t).withColumn("parameters", F.lit("{}")), "env_id", "ord").filter(F.col("ord") >= 1 << 62)
    return both.select(
        "env_id", "name", "description", F.get_json_object("parameters", "$.required[0]").alias("first_required"), F.get_json_object("parameters", "$.type").alias("kind"),
        F.array_join("properties", ",").alias("properties"),
    )


@plan(
    "e6_tool_summary",
    f"WITH {TOOLS} SELECT env_id, ord, 2 AS parameter_count, '- ' || name || '(brand, size*): ' || brand AS summary_line FROM tools",
)
def _(t: Tables) -> DataFrame:
    return cat.tool_summary(tools(t)).select("env_id", "ord", "parameter_count", "summary_line")


def complexity(t: Tables) -> DataFrame:
    owned = tools(t).select(F.col("env_id").alias("env_key"), "name")
    return cat.env_complexity(envs(t), owned, "env_key")


@plan("e7_env_complexity", f"WITH {TOOLS}, {ENVS} SELECT * FROM cx")
def _(t: Tables) -> DataFrame:
    return complexity(t)


@plan(
    "e8_catalogue_stats",
    f"""WITH {TOOLS}, {ENVS}, m AS (SELECT unnest([{{'m': 'tool_count', 'v': tool_count}}, {{'m': 'state_container_count', 'v': state_container_count}},
      {{'m': 'method_count', 'v': method_count}}, {{'m': 'code_length', 'v': code_length}}]) AS r FROM cx)
    SELECT r.m AS measure, min(r.v) AS min, round_even(avg(r.v), 2) AS avg, max(r.v) AS max, count(*) AS env_count FROM m GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return cat.catalogue_stats(complexity(t))


@plan(
    "e9_dedupe_env_id",
    """WITH r AS (SELECT doc_id, CASE WHEN lang = 'en' THEN source WHEN lang = 'fr' THEN 'missing_env_id__' || doc_id ELSE lang END AS env_id FROM documents)
    SELECT doc_id, env_id AS resolved_env_id, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY env_id) THEN 'duplicate env_id' END AS reason FROM r""",
)
def _(t: Tables) -> DataFrame:
    env = F.when(F.col("lang") == "en", F.col("source")).when(F.col("lang") == "fr", " ").otherwise(F.col("lang"))
    records = t.documents.select("doc_id", env.alias("env_id"))
    return cat.dedupe_env_id(records, "env_id", "doc_id", "doc_id").select("doc_id", "resolved_env_id", "reason")


@plan("e10_func_test_rollup", f"WITH {LOG} SELECT env_id, tool, {COUNTERS} FROM log GROUP BY GROUPING SETS ((env_id), (env_id, tool))")
def _(t: Tables) -> DataFrame:
    return cat.func_test_rollup(test_log(t), "env_id", "tool")


@plan("e11_normalize_status", f"WITH {LOG} SELECT event_id, status FROM log")
def _(t: Tables) -> DataFrame:
    return test_log(t).select("event_id", cat.normalize_status("status", "passed").alias("status"))


@plan(
    "e12_tool_stats_table",
    f"""WITH {LOG}, listed AS (SELECT DISTINCT event_type AS tool FROM events UNION SELECT DISTINCT p_type FROM part)
    SELECT tool, count(env_id) AS total, count(*) FILTER (case_type = 'positive') AS positive, count(*) FILTER (case_type = 'negative') AS negative,
      count(*) FILTER (raw_status = 'pass') AS pass, count(*) FILTER (raw_status = 'warning') AS warning, count(*) FILTER (raw_status = 'fail') AS fail
    FROM listed LEFT JOIN log USING (tool) GROUP BY tool""",
)
def _(t: Tables) -> DataFrame:
    listed = t.events.select(F.col("event_type").alias("tool")).unionByName(t.part.select(F.col("p_type").alias("tool")))
    return cat.tool_stats_table(listed, test_log(t), "tool")


@plan(
    "e13_drop_env_on_fail",
    f"""WITH {LOG} SELECT c_custkey AS env_id FROM customer WHERE c_custkey NOT IN (SELECT env_id FROM log WHERE status = 'fail')""",
)
def _(t: Tables) -> DataFrame:
    return cat.drop_env_on_fail(t.customer.select(F.col("c_custkey").alias("env_id")), test_log(t), "env_id")


RATES = f"""{LOG}, roll AS (SELECT env_id, {COUNTERS} FROM log GROUP BY env_id),
rated AS (SELECT env_id, (pass_count + warning_count)::DOUBLE / total_count AS not_fail, (positive_pass_count + positive_warning_count)::DOUBLE / nullif(positive_count, 0) AS positive_not_fail,
  pass_count::DOUBLE / total_count AS pass_rate FROM roll)"""


def rated(t: Tables) -> DataFrame:
    return cat.pass_rates(cat.func_test_rollup(test_log(t), "env_id", "tool").filter("tool IS NULL"))


@plan(
    "e14_pass_rates",
    f"WITH {RATES} SELECT env_id, round(not_fail, 6) AS not_fail, round(positive_not_fail, 6) AS positive_not_fail, round(pass_rate, 6) AS pass_rate FROM rated",
)
def _(t: Tables) -> DataFrame:
    names = ["not_fail", "positive_not_fail", "pass_rate"]
    return rated(t).select("env_id", *[F.round(f"{n}_exact", 6).alias(n) for n in names])


@plan("e15_select_env", f"WITH {RATES} SELECT env_id FROM rated WHERE not_fail >= 0.8")
def _(t: Tables) -> DataFrame:
    return cat.select_env(rated(t), "not_fail", 0.8).select("env_id")


MERGE = f"""items AS (SELECT d.doc_id, {q.strip('text')} || '|||' || lang AS key, l.quality IS NOT NULL AND l.quality = 0 AS existing FROM documents d LEFT JOIN labels l USING (doc_id))"""


def keyed(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", cat.item_key("text", "lang").alias("key"))
    return docs.join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@plan(
    "e16_merge_keep_first",
    f"""WITH {MERGE} SELECT doc_id, CASE WHEN existing THEN 0 ELSE 1 END AS is_new FROM items QUALIFY row_number() OVER (PARTITION BY key ORDER BY existing DESC, doc_id) = 1""",
)
def _(t: Tables) -> DataFrame:
    rows = keyed(t)
    old = F.coalesce(F.col("quality") == 0, F.lit(False))
    merged = cat.merge_keep_first(rows.filter(old).drop("quality"), rows.filter(~old).drop("quality"), "key", "doc_id")
    return merged.select("doc_id", "is_new")


@plan(
    "e17_assign_env_ids",
    f"""WITH {MERGE}, known AS (SELECT key, 'env_' || min(doc_id) AS known_id FROM items WHERE existing GROUP BY key),
    top AS (SELECT coalesce(max(doc_id), 0) AS m FROM items WHERE existing),
    fresh AS (SELECT key, row_number() OVER (ORDER BY min(doc_id)) AS n FROM items WHERE NOT existing AND key NOT IN (SELECT key FROM known) GROUP BY key)
    SELECT doc_id, coalesce(known_id, 'env_' || ((SELECT m FROM top) + n)) AS env_id FROM items LEFT JOIN known USING (key) LEFT JOIN fresh USING (key) WHERE NOT existing""",
)
def _(t: Tables) -> DataFrame:
    rows = keyed(t)
    old = F.coalesce(F.col("quality") == 0, F.lit(False))
    existing = rows.filter(old).select(
        "key", F.concat(F.lit("env_"), F.col("doc_id").cast("string")).alias("env_id"), F.col("doc_id").alias("existing_order")
    )
    out = cat.assign_env_ids(rows.filter(~old).select("doc_id", "key"), existing, "key", "doc_id", block_of("doc_id"))
    return out.select("doc_id", "env_id")


@plan(
    "e18_drop_detail_fields",
    "SELECT o_orderkey, '{\"status\":\"' || o_orderstatus || '\"}' AS summary FROM orders",
)
def _(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("details")).alias("result"), "o_orderpriority"
    )
    brief = cat.drop_detail_fields(rows, {"result": ["details"]}, ["o_orderpriority"])
    return brief.select("o_orderkey", F.to_json("result").alias("summary"))


@plan(
    "e19_merge_nested_progress",
    """WITH done AS (SELECT l_orderkey AS p, l_linenumber AS c, arg_max(l_extendedprice, l_partkey * 1000000 + l_suppkey) AS result FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
    kids AS (SELECT DISTINCT l_orderkey AS p, l_linenumber AS c FROM lineitem)
    SELECT p AS parent, c AS child, result, result IS NOT NULL AS is_finished FROM kids LEFT JOIN done USING (p, c)""",
)
def _(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnsRenamed({"l_orderkey": "parent", "l_linenumber": "child"})
    kids = lines.select("parent", "child").distinct().withColumn("result", F.lit(None).cast("double"))
    done = lines.filter("l_linestatus = 'F'").withColumn("result", F.col("l_extendedprice"))
    return cat.merge_nested_progress(kids, done, "parent", "child", "result", ["l_partkey", "l_suppkey"])


GATED = """g AS (SELECT o_custkey AS env_id, count(DISTINCT o_orderpriority) AS state_count, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 480000) AS state_failures,
  count(DISTINCT o_orderstatus) = 3 AS coverage_passed, count(*) AS blueprint_count, count(*) FILTER (o_totalprice < 5000) AS task_failures FROM orders GROUP BY 1),
r AS (SELECT *, list_filter([CASE WHEN state_count < 4 THEN 'state_bank size ' || state_count || ' < configs_per_env 4' END, CASE WHEN state_failures > 0 THEN 'state_generation_failures=' || state_failures END], lambda x: x IS NOT NULL) AS s1,
  list_filter([CASE WHEN NOT coverage_passed THEN 'env_coverage_summary.coverage_passed is false' END, CASE WHEN blueprint_count < 8 THEN 'blueprint_count ' || blueprint_count || ' < min_blueprints_per_env 8' END,
    CASE WHEN task_failures > 0 THEN 'task_generation_failures=' || task_failures END], lambda x: x IS NOT NULL) AS s2 FROM g),
gated AS (SELECT env_id, CASE WHEN len(s1) > 0 THEN 'stage1' WHEN len(s2) > 0 THEN 'stage2' END AS failed_stage, array_to_string(CASE WHEN len(s1) > 0 THEN s1 ELSE s2 END, '; ') AS reasons FROM r)"""


def gated(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    facts = t.orders.groupBy(F.col("o_custkey").alias("env_id")).agg(
        F.count_distinct("o_orderpriority").alias("state_count"),
        F.count_if((F.col("o_orderstatus") == "F") & (price > 480000)).alias("state_failures"),
        (F.count_distinct("o_orderstatus") == 3).alias("coverage_passed"),
        F.count(F.lit(1)).alias("blueprint_count"),
        F.count_if(price < 5000).alias("task_failures"),
    )
    return cat.stage_gate(facts.withColumn("env_id", F.col("env_id").cast("string")), 4, 8, policy="strict")


@plan(
    "e20_stage_gate",
    f"WITH {GATED} SELECT env_id::VARCHAR AS env_id, failed_stage IS NULL AS accepted, failed_stage, reasons AS failure_reasons FROM gated",
)
def _(t: Tables) -> DataFrame:
    return gated(t).select("env_id", "accepted", "failed_stage", F.array_join("failure_reasons", "; ").alias("failure_reasons"))


@plan(
    "e21_gate_report",
    f"WITH {GATED} SELECT failed_stage IS NULL AS accepted, coalesce(failed_stage, '') AS failed_stage, count(*) AS env_count FROM gated GROUP BY 1, 2",
)
def _(t: Tables) -> DataFrame:
    return cat.gate_report(gated(t))


@plan(
    "io7_keep_accepted",
    f"WITH {GATED} SELECT c_custkey::VARCHAR AS env_id, c_name FROM customer WHERE c_custkey IN (SELECT env_id FROM gated WHERE failed_stage IS NULL) ORDER BY c_custkey",
)
def _(t: Tables) -> DataFrame:
    source = t.customer.select(F.col("c_custkey").cast("string").alias("env_id"), "c_name", "c_custkey")
    return cat.keep_accepted(source, gated(t), "env_id", "c_custkey").drop("c_custkey")
