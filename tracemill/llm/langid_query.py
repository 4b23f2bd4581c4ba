"""Queries of the language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.llm.langid import identify_documents, identify_pages
from tracemill.llm.queries import query, read


@query("op8_language_id")
def op8(spark, folder):
    """Language of every document, and whether it is certain enough to keep."""
    return identify_documents(read(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("pages_language_id")
def pages_language(spark, folder):
    """Language of every page from its text, declared language, address suffix and host."""
    labelled = read(spark, folder, "documents").select(F.lower("lang").alias("label"), "text")
    return identify_pages(read(spark, folder, "pages"), labelled).withColumnRenamed("id", "page_id")
