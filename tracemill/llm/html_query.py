"""Query of the main text extraction."""

from __future__ import annotations

from tracemill.llm.queries import query, read
from tracemill.llm.wrapper import extract


@query("op3_wrapper_induction")
def op3(spark, folder):
    """Main text of every page."""
    return extract(read(spark, folder, "pages")).withColumnRenamed("id", "page_id")
