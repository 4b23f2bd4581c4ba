"""Query of the whitening operator."""

from __future__ import annotations

from tracemill.llm.queries import query, read
from tracemill.llm.whitening import whiten


@query("op11_spectral_whitening")
def op11(spark, folder):
    """All vectors on the 32 leading components of their covariance, whitened."""
    return whiten(read(spark, folder, "embeddings"), 32).withColumnRenamed("id", "vec_id")
