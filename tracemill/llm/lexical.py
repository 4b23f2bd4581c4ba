"""Ranked lexical search, term at a time with a limit on accumulators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import Emitter, materialize, rows_of

#: Terms held by up to this many documents are the first class; each further class reaches ``STEP`` times as far.
RARE, STEP = 640, 4
#: Bytes of query terms up to which tasks receive them; beyond, documents emit all terms and a join keeps those asked for.
VOCABULARY = 32 << 20

#: What ends a term: ASCII other than letters and digits.  Only A-Z are lower-cased.
_SPLIT = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text in UTF-8; none for a null text."""
    return (text or "").encode().translate(_SPLIT).split()


def count_terms(table: DataFrame, id_col: str, text_col: str, only: DataFrame | None = None) -> DataFrame:
    """``(id, n, terms, counts)`` per row with at least one term: how many it has, and its distinct ones.

    ``only(term)`` keeps the terms asked for; ``n`` counts all.
    """
    wanted = None
    if only is not None:
        spark = table.sparkSession
        size = only.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
        if size <= VOCABULARY:
            wanted = spark.sparkContext.broadcast({r["term"].encode() for r in only.collect()})
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]):
        out = Emitter(schema)
        for key, text in rows_of(batches, "id", "text"):
            words = terms_of(text)
            if words:
                counts = Counter(words if wanted is None else filter(wanted.value.__contains__, words))
                yield from out.add((key, len(words), [w.decode() for w in counts], list(counts.values())), 16 * len(counts))
        yield from out.flush()

    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms array<string>, counts array<long>")


def _postings(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per document and distinct term."""
    flat = rows.select(*columns, F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("tf"))).alias("_p"))
    return flat.select(*columns, F.col("_p.term").alias("term"), F.col("_p.tf").alias("tf"))


def _best(scores: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows per query; only ``k`` rows a query leave each task."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(*order))
    return scores.withColumn("rank", place).filter(F.col("rank") <= k)


def search(queries: DataFrame, docs: DataFrame, k: int = 10, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(query, rank, id, score)``: the ``k`` documents of each query with the highest score above 0.

    With N documents that have a term, L terms in them, n terms of a document, df documents that hold a term
    and tf occurrences: a term weighs ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``, a document's length counts as
    ``m = 25 + 75 n N div L``, and the score sums ``w (10^9 tf div (1000 tf + 8 m))`` over the terms of the query,
    repeats included.  Equal scores rank by ascending id, null ids last.

    Terms fall into classes by df.  Classes are worked off from the rarest on for all queries at once: the
    postings of a class are joined with the query terms of that class and added to the accumulators, one per
    query and document.  After a class, a query whose k-th highest partial score exceeds the sum of the largest
    contributions of its terms in later classes needs no new accumulator: it is closed.  Accumulators of a closed
    query that could still reach that partial score survive, and all their other terms are added exactly from
    the rows of their documents.  Nothing is estimated, and no number of accumulators is fixed.

    What travels: per document its counts of query terms, written twice (by document, and as postings in a
    folder per class, so that a class is read alone); accumulators by (query, document).  The driver sees N, L,
    and one number per class.

    A null or empty text has no term: such a document is not counted and not found, such a query has no row.
    Each repeated row is a document or a query of its own.  Empty tables give no row; other columns are ignored.
    """
    asked = count_terms(queries, query_id, query_text).withColumn("q", F.monotonically_increasing_id())
    asked = materialize(asked, "queries")
    wanted = _postings(asked, "q").withColumnRenamed("tf", "times")
    only = wanted.select("term").distinct()
    rows = materialize(count_terms(docs, id_col, text_col, only).withColumn("key", F.monotonically_increasing_id()), "counts")
    total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], max(1, total["terms"] or 0)

    # The product is taken in decimals: it may leave the range of longs, its quotient does not.
    length = F.expr(f"25 + CAST((CAST(n AS DECIMAL(19,0)) * {75 * n_docs}BD) DIV {n_terms}BD AS LONG)")
    shares = F.transform(F.arrays_zip("terms", "counts"), lambda x: F.struct(x["terms"].alias("term"), _share(x["counts"], F.col("m")).alias("share")))
    index = materialize(rows.withColumn("m", length).select("key", "id", shares.alias("shares")), "index")
    flat = index.select("key", F.explode("shares").alias("_s")).select("key", "_s.term", "_s.share")
    # The semi-join matters only where the vocabulary was too large to send to the tasks.
    flat = flat.join(only, "term", "left_semi")
    stats = flat.groupBy("term").agg(F.count("*").alias("df"), F.max("share").alias("most"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    above = F.log(F.col("df") / RARE) / F.log(F.lit(float(STEP)))
    level = F.greatest(F.lit(0), F.ceil(F.coalesce(above, F.lit(0.0)))).cast("int")
    stats = materialize(stats.withColumn("w", weight).withColumn("class", level), "terms")
    need = stats.join(wanted, "term").select("q", "class", "term", (F.col("times") * F.col("w")).alias("weight"), (F.col("times") * F.col("w") * F.col("most")).alias("bound"))
    need = materialize(need, "needs")
    # What the terms of later classes can still add, per query and class; every query has a row for each class.
    classes = [r["class"] for r in stats.select("class").distinct().orderBy("class").collect()]
    bounds = need.groupBy("q", "class").agg(F.sum("bound").alias("bound"))
    by_class = materialize(flat.join(stats.select("term", "class"), "term").select("class", "term", "key", "share"), "postings", "class")

    empty = docs.sparkSession.createDataFrame([], "q long, key long, score long")
    open_, sums, settled = need.select("q").distinct(), empty, []
    for c in classes:
        now = need.filter(F.col("class") == c).join(open_, "q", "left_semi")
        gained = by_class.filter(F.col("class") == c).join(now, "term").select("q", "key", (F.col("weight") * F.col("share")).alias("score"))
        sums = materialize(sums.union(gained).groupBy("q", "key").agg(F.sum("score").alias("score")), "sums")
        kth = _best(sums, k, F.desc("score")).filter(F.col("rank") == k).select("q", F.col("score").alias("kth"))
        rest = bounds.filter(F.col("class") > c).groupBy("q").agg(F.sum("bound").alias("rest"))
        state = open_.join(kth, "q", "left").join(rest, "q", "left")
        state = materialize(state.select("q", F.coalesce("kth", F.lit(0)).alias("kth"), F.coalesce("rest", F.lit(0)).alias("rest")), "state")
        ends = F.col("kth") > F.col("rest") if c != classes[-1] else F.lit(True)
        closed = sums.join(state.filter(ends), "q").filter(F.col("score") + F.col("rest") >= F.col("kth"))
        settled.append(closed.select("q", "key", "score", F.lit(c).alias("class")))
        open_ = state.filter(~ends).select("q")
        sums = sums.join(open_, "q", "left_semi")
        if c != classes[-1] and open_.isEmpty():
            break
    if not settled:
        return empty.select(F.col("q").alias("query"), F.lit(0).alias("rank"), F.col("key").alias("id"), "score")

    found = settled[0]
    for other in settled[1:]:
        found = found.union(other)
    found = materialize(found, "survivors")
    # The other terms of survivors, from the rows of their documents.
    told = found.join(index, "key").select("q", "key", F.col("class").alias("done"), F.explode("shares").alias("_s"))
    told = told.select("q", "key", "done", "_s.term", "_s.share").join(need.select("q", "term", "class", "weight"), ["q", "term"])
    more = told.filter(F.col("class") > F.col("done")).select("q", "key", (F.col("weight") * F.col("share")).alias("score"))
    final = found.select("q", "key", "score").union(more).groupBy("q", "key").agg(F.sum("score").alias("score")).filter("score > 0")
    final = final.join(index.select("key", "id"), "key")
    best = _best(final, k, F.desc("score"), F.asc_nulls_last("id"), F.asc("key"))
    return best.join(asked.select("q", F.col("id").alias("query")), "q").select("query", "rank", "id", "score")


def _share(tf, m):
    """``10^9 tf div (1000 tf + 8 m)``."""
    return F.call_function("div", tf * F.lit(1_000_000_000), tf * 1000 + m * 8)
