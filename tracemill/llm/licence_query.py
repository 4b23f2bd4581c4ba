"""Query of the licence scan."""

from __future__ import annotations

from tracemill.llm.licences import scan, train
from tracemill.llm.queries import query, read


@query("op5_licence_scan")
def op5(spark, folder):
    """Licence families of every document."""
    docs = read(spark, folder, "documents")
    return scan(docs, train(docs)).withColumnRenamed("id", "doc_id")
