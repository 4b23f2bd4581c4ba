"""Query of the quality rules."""

from __future__ import annotations

from tracemill.llm.quality import judge
from tracemill.llm.queries import query, read


@query("op7_adaptive_quality")
def op7(spark, folder):
    """Base measures of every document, and whether it passes the fences of its language and source."""
    out = judge(read(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")
