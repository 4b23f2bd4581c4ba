"""Intermediate tables, so that a long query runs as several short plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of an execution when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir``; a local master may do without and gets a temporary folder, a cluster has none then."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local["):
        folder = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/") if folder else None


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: what follows is planned without what came before.

    The driver holds the plan of one step at a time, and no step is computed twice.  The shuffle files of a step go once
    it is written, so the disk holds those of one step.  Without a shared folder ``df`` stays as it is.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        return df
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)
