"""Corpus queries: documents and conversations as task sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as tx
from tracemill.operators import corpus
from tracemill.plans import sqltext as q
from tracemill.plans.registry import plan
from tracemill.sources import files
from tracemill.sources.tables import Tables

CURATED_CTE = f"""cleaned AS (SELECT doc_id, source, {q.clean_task('text')} AS task FROM documents),
curated AS (SELECT doc_id, source, task, {q.REJECT} AS reject_reason FROM cleaned)"""


def curated(t: Tables) -> DataFrame:
    return corpus.curate_tasks(t.documents.select("doc_id", "source", "text"), "text").drop("text")


def accepted(t: Tables) -> DataFrame:
    return curated(t).filter(F.col("reject_reason").isNull())


@plan(
    "c1_first_user_message",
    f"""SELECT conv_id, arg_min({q.strip('text')}, turn) AS task FROM conversations
    WHERE role = 'user' AND {q.strip('text')} <> '' GROUP BY conv_id""",
)
def _(t: Tables) -> DataFrame:
    return corpus.first_user_message(t.conversations, "conv_id", "turn", "role", "text")


@plan(
    "c2_extract_task",
    f"""WITH prompts AS (SELECT doc_id, 'Context: ' || lang || chr(10) || 'User:' || text || chr(10)
        || 'API-Request: [' || source || ']' AS input FROM documents),
    bodies AS (SELECT doc_id, {q.strip("split_part(split_part(split_part(split_part(input, 'User:', 2), chr(10) || 'Generate API Request: ', 1), chr(10) || 'API-Request: ', 1), 'TIME: ', 1)")} AS body FROM prompts)
    SELECT doc_id, {q.clean_task("split_part(body, chr(10) || 'AI: ', 1)")} AS task FROM bodies""",
)
def _(t: Tables) -> DataFrame:
    prompt = F.concat(
        F.lit("Context: "), "lang", F.lit("\nUser:"), "text", F.lit("\nAPI-Request: ["), "source", F.lit("]")
    )
    return corpus.extract_task(t.documents.select("doc_id", prompt.alias("input")), "prompt").select("doc_id", "task")


@plan("c3_clean_task_text", f"SELECT doc_id, {q.clean_task('text')} AS task FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.clean_task_text("text").alias("task"))


@plan(
    "c4_is_allowed_charset",
    f"""SELECT doc_id, {q.CHARSET} AS allowed FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, ' ', chr(160))
    WHEN 1 THEN replace(text, ' ', chr(12288)) ELSE text END AS task FROM documents)""",
)
def _(t: Tables) -> DataFrame:
    # No-break and ideographic spaces are white space too.
    wide = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("\u00a0")))
    wide = wide.when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit(" "), F.lit("\u3000"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", tx.is_allowed_charset(wide).alias("allowed"))


@plan(
    "c5_mentions_media",
    f"SELECT page_id, ({q.MEDIA}) AS media FROM (SELECT page_id, html AS task FROM pages)",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.mentions_media("html").alias("media"))


@plan(
    "c6_has_blocked_term",
    f"SELECT doc_id, ({q.BLOCKED}) AS blocked FROM (SELECT doc_id, text AS task FROM documents)",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.has_blocked_term("text").alias("blocked"))


@plan("c7_curate_tasks", f"WITH {CURATED_CTE} SELECT doc_id, source, task, reject_reason FROM curated")
def _(t: Tables) -> DataFrame:
    return curated(t)


@plan(
    "c8_dedupe_per_source",
    f"WITH {CURATED_CTE} SELECT DISTINCT task, source AS task_from FROM curated WHERE reject_reason IS NULL",
)
def _(t: Tables) -> DataFrame:
    return corpus.dedupe_per_source(accepted(t).withColumnRenamed("source", "task_from"))


@plan(
    "c9_dedupe_keep_first",
    f"""SELECT {q.strip('text')} AS task, min(doc_id) AS doc_id FROM documents
    WHERE {q.strip('text')} <> '' GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return corpus.dedupe_keep_first(t.documents.select("doc_id", F.col("text").alias("task")), "doc_id")


@plan(
    "c10_union_sources",
    f"""WITH {CURATED_CTE}, spoken AS (SELECT {q.clean_task(f"arg_min({q.strip('text')}, turn)")} AS task
      FROM conversations WHERE role = 'user' AND {q.strip('text')} <> '' GROUP BY conv_id),
    listed AS (SELECT {q.clean_task('text')} AS task FROM benchmark),
    u AS (SELECT DISTINCT task, 'documents' AS task_from FROM curated WHERE reject_reason IS NULL
      UNION ALL SELECT DISTINCT task, 'conversations' FROM (SELECT task, {q.REJECT} AS r FROM spoken) WHERE r IS NULL
      UNION ALL SELECT DISTINCT task, 'benchmark' FROM (SELECT task, {q.REJECT} AS r FROM listed) WHERE r IS NULL)
    SELECT task, task_from FROM u""",
)
def _(t: Tables) -> DataFrame:
    spoken = corpus.first_user_message(t.conversations, "conv_id", "turn", "role", "text")
    parts = {
        "documents": t.documents.select("text"),
        "conversations": spoken.select(F.col("task").alias("text")),
        "benchmark": t.benchmark.select("text"),
    }
    return corpus.union_sources(
        *[
            corpus.dedupe_per_source(
                corpus.curate_tasks(df, "text").filter("reject_reason IS NULL").withColumn("task_from", F.lit(name))
            )
            for name, df in parts.items()
        ]
    )


@plan(
    "c11_pending_work",
    f"""SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x JOIN labels USING (doc_id)
    WHERE {q.strip('x.text')} <> '' AND {q.strip('x.text')} = {q.strip('d.text')})""",
)
def _(t: Tables) -> DataFrame:
    tasks = t.documents.select("doc_id", F.col("text").alias("task"))
    done = tasks.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return corpus.pending_work(tasks, done).select("doc_id")


@plan(
    "c12_merge_results",
    """WITH results AS (SELECT doc_id, 0 AS batch, quality AS verdict FROM labels
      UNION ALL SELECT doc_id, 1, CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END FROM documents WHERE lang <> 'en')
    SELECT doc_id, arg_max(verdict, batch) AS verdict, max(batch) AS batch FROM results
    WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY doc_id""",
)
def _(t: Tables) -> DataFrame:
    base = t.labels.select("doc_id", F.lit(0).alias("batch"), F.col("quality").alias("verdict"))
    new = t.documents.filter("lang <> 'en'").select(
        "doc_id", F.lit(1).alias("batch"), F.when(F.col("n_chars") >= 1500, 1).otherwise(0).alias("verdict")
    )
    return corpus.merge_results(base.unionByName(new), t.documents, "doc_id", "batch")


@plan("c13_keep_judged", "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def _(t: Tables) -> DataFrame:
    judged = t.labels.select(
        "doc_id", (F.col("quality") == 1).alias("judge_result"), (F.col("toxic") == 0).alias("st_judge_result")
    )
    return judged.filter(F.col("judge_result") & F.col("st_judge_result")).select("doc_id")


@plan(
    "c14_conflict_codes",
    f"""WITH answers AS (SELECT unnest(string_split('T' || l_linenumber || ', ST' || l_linenumber || ' ,S' || l_linenumber
      || ',' || l_returnflag, ',')) AS code FROM lineitem)
    SELECT {q.strip('code')} AS code, count(*) AS n FROM answers WHERE {q.strip('code')} IN ({q.CODES}) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    line = F.col("l_linenumber").cast("string")
    answer = F.concat(F.lit("T"), line, F.lit(", ST"), line, F.lit(" ,S"), line, F.lit(","), "l_returnflag")
    codes = t.lineitem.select(F.explode(tx.conflict_codes(answer)).alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


SCORED_SQL = """scored AS (SELECT d.doc_id, d.source, CAST(l.quality AS VARCHAR) AS modelability,
  CASE WHEN d.lang = 'en' THEN CAST(d.n_chars AS VARCHAR) ELSE 'n/a' END AS usefulness
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
SAFE = "coalesce(try_cast({} AS DOUBLE), 0)"


def scored(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        "source",
        F.col("quality").cast("string").alias("modelability"),
        F.when(F.col("lang") == "en", F.col("n_chars").cast("string")).otherwise("n/a").alias("usefulness"),
    )


@plan(
    "c15_best_per_key",
    f"""WITH {SCORED_SQL} SELECT doc_id, source, modelability, usefulness FROM scored QUALIFY row_number() OVER
    (PARTITION BY source ORDER BY {SAFE.format('modelability')} DESC, {SAFE.format('usefulness')} DESC, doc_id) = 1""",
)
def _(t: Tables) -> DataFrame:
    return corpus.best_per_key(scored(t), "source", "modelability", "usefulness", "doc_id")


@plan(
    "c16_score_threshold",
    f"""WITH {SCORED_SQL} SELECT doc_id FROM scored WHERE {SAFE.format('modelability')} >= 1
    AND {SAFE.format('usefulness')} >= 1500""",
)
def _(t: Tables) -> DataFrame:
    return corpus.score_threshold(scored(t), "modelability", "usefulness", 1, 1500).select("doc_id")


@plan("c17_cluster_dedupe")
def _(t: Tables) -> DataFrame:
    return corpus.cluster_dedupe(t.embeddings, "embedding", "vec_id", k=10)


@plan(
    "c18_medoid_per_group",
    """WITH dims AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    centre AS (SELECT label, i, avg(x) AS m FROM dims GROUP BY label, i),
    near AS (SELECT d.label, d.vec_id, sqrt(sum((x - m) * (x - m))) AS distance FROM dims d JOIN centre c
      ON d.label = c.label AND d.i = c.i GROUP BY d.label, d.vec_id)
    SELECT label, arg_min(vec_id, distance) AS vec_id, round(min(distance), 6) AS distance FROM near GROUP BY label""",
)
def _(t: Tables) -> DataFrame:
    best = corpus.medoid_per_group(t.embeddings, "embedding", "label", "vec_id", dim=64)
    return best.withColumn("distance", F.round("distance", 6))


@plan("c19_concat_fields", "SELECT doc_id, '**' || source || '**: ' || text AS joined FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat(F.lit("**"), "source", F.lit("**: "), "text").alias("joined"))


@plan(
    "c20_sample_exact",
    "SELECT doc_id, source FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 100",
)
def _(t: Tables) -> DataFrame:
    return corpus.sample_exact(t.documents.select("doc_id", "source"), "doc_id", 100, seed=42)


@plan(
    "c21_limit_groups",
    """WITH f AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source ORDER BY first LIMIT 5)
    SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM f)""",
)
def _(t: Tables) -> DataFrame:
    return corpus.limit_groups(t.documents.select("doc_id", "source"), "source", "doc_id", 5)


@plan("io3_read_parquet_tree", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t: Tables) -> DataFrame:
    return files.read_parquet_tree(t.spark, f"{t.folder}/orders.parquet").select("o_orderkey", "o_orderstatus")
