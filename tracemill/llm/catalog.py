"""Importing the query modules fills the registry."""

from tracemill.llm import embedding_query, html_query, langid_query, lexical_query, licence_query, mixing_query, near_dup_query, packing_query, piece_query, quality_query, url_query, warc_query, whitening_query  # noqa: F401
from tracemill.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
