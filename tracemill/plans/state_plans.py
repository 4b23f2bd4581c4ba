"""State queries: orders as nested state, events as updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import state
from tracemill.operators.running import block_of
from tracemill.plans.registry import plan
from tracemill.sources import bridge
from tracemill.sources.tables import Tables

ORDERS_CTE = f"""ob AS (SELECT o_custkey AS run_id, o_orderkey AS k, 'O' AS status, o_orderpriority AS priority,
  o_totalprice AS total FROM orders WHERE o_orderdate < TIMESTAMP '{bridge.CUTOFF}'),
oa AS (SELECT o_custkey AS run_id, o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority,
  o_totalprice AS total FROM orders WHERE o_orderstatus <> 'F')"""
DIFF_CTE = f"""{ORDERS_CTE},
rb AS (SELECT DISTINCT run_id FROM ob), ra AS (SELECT DISTINCT run_id FROM oa),
diff AS (
  SELECT run_id, CASE WHEN run_id IN (SELECT run_id FROM rb) THEN 'orders.' || k ELSE 'orders' END AS path,
    'added' AS op, NULL AS old_value, NULL AS new_value, 3 * count(*) AS leaf_count
  FROM oa ANTI JOIN ob USING (run_id, k) GROUP BY ALL
  UNION ALL
  SELECT run_id, CASE WHEN run_id IN (SELECT run_id FROM ra) THEN 'orders.' || k ELSE 'orders' END,
    'removed', NULL, NULL, 3 * count(*) FROM ob ANTI JOIN oa USING (run_id, k) GROUP BY ALL
  UNION ALL
  SELECT run_id, 'orders.' || k || '.status', 'changed', ob.status, oa.status, 1
  FROM ob JOIN oa USING (run_id, k) WHERE ob.status <> oa.status)"""
LOG_CTE = """log AS (SELECT user_id AS run_id, event_id AS seq,
  'slot_' || CAST(json_extract(props, '$.k') AS INT) // 10 AS path,
  CASE event_type WHEN 'signup' THEN 'set' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'append' ELSE 'increment' END AS op,
  value FROM events),
resets AS (SELECT run_id, path, max(seq) AS rseq, arg_max(op, seq) AS rop, arg_max(value, seq) AS rval
  FROM log WHERE op IN ('set', 'delete') GROUP BY run_id, path),
live AS (SELECT log.*, rop, rval FROM log LEFT JOIN resets USING (run_id, path) WHERE rseq IS NULL OR seq >= rseq)"""


def order_diff(t: Tables) -> DataFrame:
    return state.state_diff(bridge.state_before(t), bridge.state_after(t), ["run_id"])


@plan(
    "s1_flatten_state",
    """SELECT o_custkey AS run_id, 'orders.' || o_orderkey || '.status' AS path, 'string' AS kind, o_orderstatus AS value FROM orders
    UNION ALL SELECT o_custkey, 'orders.' || o_orderkey || '.tags', 'array', '["' || o_orderpriority || '"]' FROM orders
    UNION ALL SELECT o_custkey, 'orders.' || o_orderkey || '.links', 'object', '{}' FROM orders
    UNION ALL SELECT o_custkey, 'orders.' || o_orderkey || '.pay.open', 'boolean',
      CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END FROM orders""",
)
def _(t: Tables) -> DataFrame:
    record = F.struct(
        F.col("o_orderstatus").alias("status"),
        F.array("o_orderpriority").alias("tags"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("links"),
        F.struct((F.col("o_orderstatus") == "O").alias("open")).alias("pay"),
    )
    doc = F.to_json(F.create_map(F.lit("orders"), F.create_map(F.col("o_orderkey").cast("string"), record)))
    docs = t.orders.select(F.col("o_custkey").alias("run_id"), doc.alias("doc"))
    return state.flatten_state(docs, ["run_id"], "doc").withColumn("path", F.array_join("path", "."))


@plan("s2_state_diff", f"WITH {DIFF_CTE} SELECT run_id, path, op, old_value, new_value, leaf_count FROM diff")
def _(t: Tables) -> DataFrame:
    return order_diff(t).withColumn("path", F.array_join("path", "."))


@plan(
    "s3_step_diffs",
    """WITH snap AS (SELECT conv_id, turn, role AS path, text AS value FROM conversations),
    span AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM snap GROUP BY conv_id),
    pairs AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn + 1) AS turn,
      coalesce(a.path, b.path) AS path, b.value AS old_value, a.value AS new_value
      FROM snap a FULL JOIN snap b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.path = b.path)
    SELECT conv_id, turn, path, CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'changed' END AS op,
      old_value, new_value FROM pairs JOIN span USING (conv_id)
    WHERE turn > lo AND turn <= hi AND old_value IS DISTINCT FROM new_value""",
)
def _(t: Tables) -> DataFrame:
    snaps = t.conversations.select("conv_id", "turn", F.col("role").alias("path"), F.col("text").alias("value"))
    return state.snapshot_diffs(snaps, "conv_id", "turn")


@plan(
    "s3_lifted_step_diffs",
    """WITH c AS (SELECT conv_id, turn, role, left(text, 12) AS head, length(text) // 40 AS size, turn % 3 AS kind FROM conversations WHERE turn % 5 <> 3),
    p AS (SELECT *, lag(turn) OVER w AS p_turn, lag(role) OVER w AS p_role, lag(head) OVER w AS p_head, lag(size) OVER w AS p_size, lag(kind) OVER w AS p_kind
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    x AS (SELECT * FROM p WHERE p_turn IS NOT NULL),
    d AS (SELECT conv_id, turn, 'who.' || role AS path, 'added' AS op, NULL AS old_value, NULL AS new_value, 2 AS leaf_count FROM x WHERE role <> p_role
      UNION ALL SELECT conv_id, turn, 'who.' || p_role, 'removed', NULL, NULL, 2 FROM x WHERE role <> p_role
      UNION ALL SELECT conv_id, turn, 'who.' || role || '.head', 'changed', p_head, head, 1 FROM x WHERE role = p_role AND head <> p_head
      UNION ALL SELECT conv_id, turn, 'who.' || role || '.size', 'changed', CAST(CAST(p_size AS DOUBLE) AS VARCHAR), CAST(CAST(size AS DOUBLE) AS VARCHAR), 1
        FROM x WHERE role = p_role AND size <> p_size
      UNION ALL SELECT conv_id, turn, 'extra.at', 'changed', CAST(CAST(p_turn AS DOUBLE) AS VARCHAR), CAST(CAST(turn AS DOUBLE) AS VARCHAR), 1 FROM x WHERE kind = 0 AND p_kind = 0
      UNION ALL SELECT conv_id, turn, 'extra', CASE WHEN p_kind = 2 THEN 'added' WHEN kind = 2 THEN 'removed' ELSE 'changed' END,
        CASE WHEN p_kind = 1 THEN 'x' END, CASE WHEN kind = 1 THEN 'x' END, CASE WHEN kind = 2 OR p_kind = 2 THEN 1 ELSE 2 END FROM x WHERE kind <> p_kind)
    SELECT * FROM d""",
)
def _(t: Tables) -> DataFrame:
    """States that hold the speaker, a part that never changes, and a part that is an object, a value or missing."""
    turns = t.conversations.filter("turn % 5 <> 3")
    speaker = F.create_map("role", F.struct(F.substring("text", 1, 12).alias("head"), F.floor(F.length("text") / 40).alias("size")))
    base = F.concat(F.lit('{"fixed":{"a":{"b":[1,2]},"c":"same"},"who":'), F.to_json(speaker))
    extra = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(',"extra":{"at":'), F.col("turn").cast("string"), F.lit("}"))).when(F.col("turn") % 3 == 1, ',"extra":"x"').otherwise("")
    states = turns.select("conv_id", "turn", F.concat(base, extra, F.lit("}")).alias("state"))
    return state.step_diffs(states, "conv_id", "turn", "state").withColumn("path", F.array_join("path", "."))


@plan(
    "s4_is_write",
    """WITH e AS (SELECT user_id AS run_id, event_id AS pos, event_type AS tool, CAST(json_extract(props, '$.k') AS INT) AS arg_k FROM events)
    SELECT run_id, pos, coalesce(arg_k <> lag(arg_k) OVER (PARTITION BY run_id, tool ORDER BY pos), true) AS is_write FROM e""",
)
def _(t: Tables) -> DataFrame:
    acts = bridge.actions(t).select("run_id", "pos", "tool", "arg_k")
    diffs = state.update_diffs(acts, "run_id", "pos", "tool", "arg_k")
    return state.mark_writes(acts.select("run_id", "pos"), diffs, ["run_id", "pos"])


@plan(
    "s5_diff_to_assertions",
    f"""WITH {DIFF_CTE} SELECT run_id, path, op AS assertion_type, old_value, new_value, CAST(NULL AS VARCHAR) AS value,
    true AS is_hard FROM diff""",
)
def _(t: Tables) -> DataFrame:
    return state.diff_to_assertions(order_diff(t))


@plan(
    "s5_assertion_leaves",
    f"""WITH {ORDERS_CTE}, f AS (SELECT * FROM (VALUES ('status'), ('priority'), ('total')) v(f)),
    rb AS (SELECT DISTINCT run_id FROM ob), ra AS (SELECT DISTINCT run_id FROM oa), p AS (SELECT o_orderkey AS k, o_orderpriority AS pr, o_totalprice AS tp FROM orders),
    gained AS (SELECT oa.run_id, CASE WHEN oa.run_id IN (SELECT run_id FROM rb) THEN 'orders.' || k ELSE 'orders' END AS assertion,
      CASE WHEN oa.run_id IN (SELECT run_id FROM rb) THEN f ELSE k || '.' || f END AS rel, f, k, oa.status AS s FROM oa ANTI JOIN ob USING (run_id, k), f),
    lost AS (SELECT ob.run_id, CASE WHEN ob.run_id IN (SELECT run_id FROM ra) THEN 'orders.' || k ELSE 'orders' END AS assertion,
      CASE WHEN ob.run_id IN (SELECT run_id FROM ra) THEN f ELSE k || '.' || f END AS rel, f, k, ob.status AS s FROM ob ANTI JOIN oa USING (run_id, k), f),
    v AS (SELECT *, false AS gone FROM gained UNION ALL SELECT *, true FROM lost)
    SELECT run_id, assertion, rel AS rel_path, CASE f WHEN 'total' THEN 'number' ELSE 'string' END AS kind,
      CASE f WHEN 'status' THEN s WHEN 'priority' THEN pr END AS value, CASE WHEN gone THEN CASE f WHEN 'total' THEN 'number' ELSE 'string' END END AS old_kind FROM v JOIN p USING (k)
    UNION ALL SELECT run_id, 'orders.' || k || '.status', '', 'string', oa.status, 'string' FROM ob JOIN oa USING (run_id, k) WHERE ob.status <> oa.status""",
)
def _(t: Tables) -> DataFrame:
    leaves = state.diff_leaves(bridge.state_before(t), bridge.state_after(t), ["run_id"])
    _, expected = state.assertion_tables(leaves, ["run_id"])
    # Prices are compared by kind only: both engines print doubles in their own way.
    value = F.when(F.col("kind") == "string", F.col("value"))
    return expected.select("run_id", "assertion", F.array_join("rel_path", ".").alias("rel_path"), "kind", value.alias("value"), "old_kind")


@plan(
    "s6_lookup_path",
    f"""WITH {ORDERS_CTE}, wanted AS (SELECT run_id, k, 'orders.' || k || '.status' AS path FROM ob
      UNION ALL SELECT run_id, k, 'orders.' || k FROM ob)
    SELECT w.run_id, w.path, oa.k IS NOT NULL AS found, CASE WHEN w.path LIKE '%.status' THEN oa.status END AS value
    FROM wanted w LEFT JOIN oa USING (run_id, k)""",
)
def _(t: Tables) -> DataFrame:
    paths = F.array(F.array_join(F.slice("path", 1, 2), "."), F.array_join("path", "."))
    wanted = (
        bridge.state_before(t)
        .filter(F.get("path", F.lit(2)) == "status")
        .select("run_id", F.explode(paths).alias("path"))
    )
    return state.lookup_path(wanted, bridge.state_after(t), ["run_id"], "path")


STATS_SQL = """sizes AS (
  SELECT c_custkey AS run_id, 'acctbal' AS container, 'number' AS kind, 0 AS size FROM customer
  UNION ALL SELECT o_custkey, o_orderpriority, 'object', count(*) FROM orders GROUP BY ALL),
stats AS (SELECT run_id, count(*) FILTER (kind = 'object') AS structured_container_count,
  count(*) FILTER (kind = 'object' AND size > 0) AS populated_container_count,
  CAST(sum(size) AS BIGINT) AS total_structured_items, max(size) AS max_container_size,
  count(*) FILTER (kind = 'number') AS scalar_field_count,
  CASE WHEN sum(size) <= 4 THEN 'sparse' WHEN sum(size) <= 15 THEN 'balanced' ELSE 'crowded' END AS state_profile
  FROM sizes GROUP BY run_id)"""


def customer_state(t: Tables) -> DataFrame:
    """Leaves: a scalar balance, and one container per priority holding that customer's orders."""
    scalar = t.customer.select(
        F.col("c_custkey").alias("run_id"),
        F.array(F.lit("acctbal")).alias("path"),
        F.lit("number").alias("kind"),
        F.col("c_acctbal").cast("string").alias("value"),
    )
    held = t.orders.select(
        F.col("o_custkey").alias("run_id"),
        F.array("o_orderpriority", F.col("o_orderkey").cast("string"), F.lit("status")).alias("path"),
        F.lit("string").alias("kind"),
        F.col("o_orderstatus").alias("value"),
    )
    return scalar.unionByName(held)


def customer_stats(t: Tables) -> DataFrame:
    return state.container_stats(state.container_sizes(customer_state(t), ["run_id"]), ["run_id"])


@plan("s7_container_stats", f"WITH {STATS_SQL} SELECT * FROM stats")
def _(t: Tables) -> DataFrame:
    return customer_stats(t)


@plan(
    "s8_state_validity",
    f"""WITH {STATS_SQL}, c AS (SELECT *, CASE WHEN total_structured_items < 3 AND max_container_size < 2
        THEN 'state is too sparse to support non-trivial tasks'
      WHEN populated_container_count < 1 THEN 'no populated structured containers found'
      WHEN populated_container_count < 2 AND max_container_size < 3 THEN 'fewer than two populated structured containers'
      ELSE 'ok' END AS reason FROM stats)
    SELECT run_id, reason, reason = 'ok' AS is_valid, CASE WHEN reason = 'ok' AND populated_container_count < 2
      THEN 'only one populated structured container; accepted because the state is still rich enough' END AS warning FROM c""",
)
def _(t: Tables) -> DataFrame:
    return state.state_validity(customer_stats(t), F.lit(6)).select("run_id", "reason", "is_valid", "warning")


@plan(
    "s9_canonical_json",
    """SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS INT) || ',"t":"' || event_type || '"}' AS canonical,
    sha256('{"k":' || CAST(json_extract(props, '$.k') AS INT) || ',"t":"' || event_type || '"}') AS fingerprint FROM events""",
)
def _(t: Tables) -> DataFrame:
    loose = F.concat(
        F.lit('{ "t" : "'), "event_type", F.lit('" ,  "k": '), F.get_json_object("props", "$.k"), F.lit("}")
    )
    docs = t.events.select("event_id", loose.alias("doc"))
    return docs.select(
        "event_id", state.canonical_json("doc").alias("canonical"), state.fingerprint("doc").alias("fingerprint")
    )


@plan(
    "s10_dedupe_states",
    """SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id, json_extract(props, '$.k')""",
)
def _(t: Tables) -> DataFrame:
    states = t.events.select("user_id", "event_id", "props")
    return state.dedupe_states(states, ["user_id"], "props", "event_id").select("user_id", "event_id")


def entities(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderpriority").alias("container"),
        F.col("o_orderkey").alias("entity_key"),
    )


@plan(
    "s11_list_containers",
    """SELECT o_custkey AS run_id, o_orderpriority AS container, count(*) AS item_count,
    array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:5], ',') AS sample_keys FROM orders GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return state.list_containers(entities(t), ["run_id"], "container", "entity_key", "entity_key")


@plan(
    "s12_list_entities",
    """SELECT o_orderpriority AS container, o_orderkey AS entity_key, position, total_count FROM
    (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS position,
      count(*) OVER (PARTITION BY o_orderpriority) AS total_count FROM orders) WHERE position > 20 AND position <= 70""",
)
def _(t: Tables) -> DataFrame:
    rows = entities(t).drop("run_id")
    return state.list_entities(rows, ["container"], "entity_key", block_of("entity_key"), limit=50, offset=20)


@plan(
    "s13_search_entities",
    f"""WITH {ORDERS_CTE}, f AS (SELECT k, 'entity_key' AS n, CAST(k AS VARCHAR) AS v FROM oa UNION ALL SELECT k, 'status', status FROM oa
      UNION ALL SELECT k, 'priority', priority FROM oa UNION ALL SELECT k, 'total', CAST(total AS VARCHAR) FROM oa)
    SELECT 'orders' AS container, CAST(k AS VARCHAR) AS entity_key, min(CASE WHEN lower(v) = '12' THEN 0 ELSE 1 END) AS score,
      count(*) AS matched_fields FROM f WHERE contains(lower(v), '12') GROUP BY k ORDER BY score, 1, 2 LIMIT 40""",
)
def _(t: Tables) -> DataFrame:
    fields = state.searchable_fields(bridge.state_after(t).drop("run_id"), [])
    return state.search_entities(fields, " 12 ", limit=40)


@plan(
    "s14_get_entity",
    f"""WITH {ORDERS_CTE}, c AS (SELECT max(k) AS k FROM oa), e AS (SELECT oa.* FROM oa JOIN c USING (k))
    SELECT run_id, 'orders.' || k || '.status' AS path, status AS value FROM e
    UNION ALL SELECT run_id, 'orders.' || k || '.priority', priority FROM e
    UNION ALL SELECT run_id, 'orders.' || k || '.total', CAST(total AS VARCHAR) FROM e""",
)
def _(t: Tables) -> DataFrame:
    leaves = bridge.state_after(t)
    newest = t.orders.filter("o_orderstatus <> 'F'").agg(F.max("o_orderkey").cast("string")).scalar()
    found = state.get_entity(leaves, "orders", newest)
    return found.select("run_id", F.array_join("path", ".").alias("path"), "value")


@plan(
    "s15_entity_key",
    """SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 25 THEN p_name ELSE '' END, ''), CAST(p_partkey AS VARCHAR)) AS entity_key,
    true AS single FROM part""",
)
def _(t: Tables) -> DataFrame:
    record = F.to_json(
        F.struct(
            F.col("p_brand").alias("brand"),
            F.col("p_partkey").alias("part_id"),
            F.when(F.col("p_size") > 25, F.col("p_name")).otherwise("").alias("name"),
        )
    )
    return t.part.select(
        "p_partkey", state.entity_key(record).alias("entity_key"), state.is_single_entity(record).alias("single")
    )


@plan(
    "s16_fold_updates",
    f"""WITH {LOG_CTE}, g AS (SELECT run_id, path, max(rop) AS rop, max(rval) AS rval,
      count(*) FILTER (op = 'append') AS item_count, count(*) FILTER (op = 'increment') AS incs,
      sum(value) FILTER (op = 'increment') AS s FROM live GROUP BY run_id, path)
    SELECT run_id, path, CASE WHEN item_count > 0 THEN 'list' ELSE 'number' END AS kind, item_count,
      CASE WHEN item_count = 0 THEN round(CASE WHEN rop = 'set' THEN rval ELSE 0 END + coalesce(s, 0), 6) END AS value
    FROM g WHERE rop = 'set' OR item_count + incs > 0""",
)
def _(t: Tables) -> DataFrame:
    folded = state.fold_updates(bridge.update_log(t), "run_id", "path", "seq")
    return folded.withColumn("value", F.round("value", 6))


@plan(
    "s16_fold_update_items",
    f"""WITH {LOG_CTE} SELECT run_id, path, row_number() OVER (PARTITION BY run_id, path ORDER BY seq) AS index, value
    FROM live WHERE op = 'append'""",
)
def _(t: Tables) -> DataFrame:
    return state.folded_items(bridge.update_log(t), "run_id", "path", "seq", block_of("seq"))
