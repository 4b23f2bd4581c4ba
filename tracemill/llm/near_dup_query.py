"""Query of the SetSketch near-duplicate operator."""

from __future__ import annotations

from tracemill.llm.queries import query, read
from tracemill.llm.setsketch import near_duplicates

SQL_LINKS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingles FROM w
), n AS (SELECT doc_id, len(shingles) AS n FROM s),
x AS (SELECT doc_id, hash(unnest(shingles)) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.m) AS component_id, n.doc_id = min(r.m) AS kept
FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n
"""


@query("op4_setsketch_near_dup", SQL_LINKS)
def op4(spark, folder):
    """Components of documents whose 3-word shingle sets have a similarity of 0.85 or more."""
    return near_duplicates(read(spark, folder, "documents"), shingle=3, percent=85).withColumnRenamed("id", "doc_id")
