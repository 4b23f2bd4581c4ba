"""Query of the archives."""

from __future__ import annotations

from tracemill.llm.queries import query, read
from tracemill.llm.warc import round_trip

SQL_RECORDS = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex FROM p),
d AS (SELECT page_id, n, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(hex, 1 + 5 * g, 5))::BIGINT >> (15 - 5 * i)) & 31) + 1 AS BIGINT), 1)), '')), '') AS digest FROM h),
k AS (SELECT digest, max(page_id) AS keeper FROM d GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN d.page_id = k.keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN d.page_id <> k.keeper THEN k.keeper END AS refers_to
FROM d JOIN k USING (digest)
"""


@query("op9_warc_index", SQL_RECORDS)
def op9(spark, folder):
    """Every page written to an archive and read back through the index."""
    return round_trip(read(spark, folder, "pages")).withColumnRenamed("id", "page_id")
