"""Task-corpus curation: extraction, cleaning, dedupe, resume, selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as tx
from tracemill.operators.running import first_per_key, with_position


def first_user_message(messages: DataFrame, run: str, pos: str, role: str, content: str) -> DataFrame:
    """First non-blank user message of every conversation."""
    body = tx.strip(content)
    return (
        messages.filter((F.col(role) == "user") & (body != ""))
        .groupBy(run)
        .agg(F.min_by(body, F.col(pos)).alias("task"))
    )


def first_user_in_array(messages: Column) -> Column:
    """First non-blank user content inside an array of (role, content)."""
    users = F.filter(messages, lambda m: (m["role"] == "user") & (tx.strip(m["content"]) != ""))
    return tx.strip(F.get(users, F.lit(0))["content"])


def task_from_prompt(raw: Column | str) -> Column:
    """User request embedded in an API-style prompt."""
    body = tx.part_after(tx.col(raw), "User:")
    for mark in ("\nGenerate API Request: ", "\nAPI-Request: ", "TIME: "):
        body = tx.before(body, mark)
    return tx.before(tx.strip(body), "\nAI: ")


def extract_task(df: DataFrame, layout: str) -> DataFrame:
    """Add ``task`` from one of the three record layouts."""
    if layout == "conversations":
        head = F.get("conversations", F.lit(0))
        raw = F.when(head["from"] == "user", head["value"])
    elif layout == "prompt":
        raw = task_from_prompt("input")
    elif layout == "messages":
        raw = first_user_in_array(F.col("messages"))
    else:
        raise ValueError(f"unknown layout {layout}")
    return df.withColumn("task", tx.clean_task_text(raw))


def curate_tasks(df: DataFrame, text: str) -> DataFrame:
    """Clean ``text`` into ``task`` and label the first broken rule as ``reject_reason``."""
    cleaned = df.withColumn("task", tx.clean_task_text(text))
    return cleaned.withColumn("reject_reason", tx.reject_reason("task"))


def dedupe_per_source(tasks: DataFrame) -> DataFrame:
    return tasks.select("task", "task_from").distinct()


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def text_key(text: Column | str) -> Column:
    """Short key of a long text: joins and dedupes shuffle 64 characters instead of the text."""
    return F.sha2(tx.col(text), 256)


def dedupe_keep_first(tasks: DataFrame, order: str) -> DataFrame:
    """One row per trimmed task text, the earliest in input order."""
    trimmed = tasks.withColumn("task", tx.strip("task")).filter(F.col("task") != "")
    return first_per_key(trimmed.withColumn("_key", text_key("task")), ["_key"], [order]).drop("_key")


def pending_work(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks whose trimmed text has no finished result yet."""
    finished = done.select(tx.strip("task").alias("_text")).filter(F.col("_text") != "").select(text_key("_text").alias("_key"))
    return tasks.join(finished, text_key(tx.strip(tasks["task"])) == finished["_key"], "left_anti")


def merge_results(batches: DataFrame, inputs: DataFrame, key: str, batch: str) -> DataFrame:
    """Latest result per key, limited to keys still in the input."""
    latest = first_per_key(batches, [key], [batch], last=True)
    return latest.join(inputs.select(key).distinct(), key, "left_semi")


def best_per_key(df: DataFrame, key: str, modelability: str, usefulness: str, order: str) -> DataFrame:
    """Highest (modelability, usefulness) row per key; the first wins ties."""
    scored = df.withColumn("_m", tx.safe_score(modelability)).withColumn("_u", tx.safe_score(usefulness))
    ranked = scored.withColumn("_o", -F.col(order))
    return first_per_key(ranked, [key], ["_m", "_u", "_o"], last=True).drop("_m", "_u", "_o")


def score_threshold(df: DataFrame, modelability: str, usefulness: str, m_min: float, u_min: float) -> DataFrame:
    return df.filter((tx.safe_score(modelability) >= m_min) & (tx.safe_score(usefulness) >= u_min))


def sample_exact(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows, the same for the same seed; raises at run time when n > total.

    Rows are ranked by the SHA-256 of seed and key.  Ranks come from block counts over the hash
    range, so no task ever sorts more than one 65536th of the input.
    """
    hashed = df.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    block = F.conv(F.substring("_h", 1, 4), 16, 10).cast("long")  # uniform and monotone in the hash
    ranked = with_position(hashed, [], ["_h", key], block, "_rank")
    short = df.agg((F.count(F.lit(1)) < n).alias("short"))
    guard = F.when(short.scalar(), F.raise_error(F.lit(f"cannot sample {n} rows")).cast("boolean"))
    return ranked.filter(F.coalesce(guard, F.col("_rank") <= n)).drop("_h", "_rank")


def limit_groups(df: DataFrame, env: str, order: str, n: int, keep_blank: bool = False) -> DataFrame:
    """Rows of the first ``n`` distinct environments in order of first appearance."""
    if n <= 0:
        return df
    named = df.filter(tx.strip(env) != "")
    chosen = named.groupBy(tx.strip(env).alias("_env")).agg(F.min(order).alias("_first")).orderBy("_first").limit(n)
    kept = df.join(chosen, tx.strip(df[env]) == chosen["_env"], "left_semi")
    if keep_blank:
        kept = kept.unionByName(df.filter(F.coalesce(tx.strip(env), F.lit("")) == ""))
    return kept


def group_centres(df: DataFrame, vec: str, label: str, dim: int) -> DataFrame:
    """Mean vector per label from ``dim`` partially aggregated averages (no explode)."""
    sums = [F.avg(F.get(vec, F.lit(i)).cast("double")).alias(f"_d{i}") for i in range(dim)]
    means = df.groupBy(label).agg(*sums)
    return means.select(label, F.array(*[f"_d{i}" for i in range(dim)]).alias("centre"))


def squared_distance(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def medoid_per_group(df: DataFrame, vec: str, label: str, key: str, dim: int) -> DataFrame:
    """Row nearest to its group's mean; the smallest key wins ties."""
    near = df.join(group_centres(df, vec, label, dim), label).select(
        label, key, F.sqrt(squared_distance(F.col(vec), F.col("centre"))).alias("distance")
    )
    best = near.groupBy(label).agg(F.min(F.struct("distance", key)).alias("_b"))
    return best.select(label, F.col(f"_b.{key}").alias(key), F.col("_b.distance").alias("distance"))


def cluster_dedupe(df: DataFrame, vec: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """K-means over the vectors, keeping the row nearest each centre; all rows when n <= k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if df.limit(k + 1).count() <= k:
        return df.select(key, F.lit(None).cast("int").alias("cluster"), F.lit(0.0).alias("distance"))
    points = df.select(key, vec, array_to_vector(F.col(vec)).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(points)
    # k centres of fixed width: k is the caller's small parameter.
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    near = model.transform(points).select(
        key, "cluster", F.sqrt(squared_distance(F.col(vec), F.get(centres, F.col("cluster")))).alias("distance")
    )
    best = near.groupBy("cluster").agg(F.min(F.struct("distance", key)).alias("_b"))
    return best.select(F.col(f"_b.{key}").alias(key), "cluster", F.col("_b.distance").alias("distance"))
