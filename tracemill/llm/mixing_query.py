"""Query of the mixing operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.llm.mixing import cycle_weights, mix
from tracemill.llm.queries import query, read


@query("op2_source_mixing")
def op2(spark, folder):
    """Words taken of each document when sources weigh 1, 2, 3 in turn."""
    mixed = mix(read(spark, folder, "documents"), cycle_weights)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
