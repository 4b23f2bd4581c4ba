"""Query of the near-duplicate vectors."""

from __future__ import annotations

from tracemill.llm.forest import near_vectors
from tracemill.llm.queries import query, read

SQL_COSINE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS v, vec_id AS m FROM v UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v),
c AS (SELECT v, min(m) AS m FROM r GROUP BY v)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.m AS component_id, v.vec_id = c.m AS kept FROM v JOIN c ON c.v = v.vec_id
"""


@query("op6_forest_near_dup", SQL_COSINE)
def op6(spark, folder):
    """Links between vectors with a cosine of 0.9 or more."""
    return near_vectors(read(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")
