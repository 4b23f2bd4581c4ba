"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import Emitter, materialize, rows_of

#: Labelled rows per language that the text model is fitted on (those with the smallest seeded hash).
TRAIN_ROWS = 1_500
#: Hashed byte trigrams.
BINS = 1 << 15
#: Byte trigrams overlap and repeat, so their log likelihood counts as this share of independent evidence, and as
#: that of so many trigrams at most.
TEMPER, MOST_EVIDENCE = 0.25, 400
#: Smoothing: pseudo-rows that a host borrows from its suffix, a suffix from all rows, and a declaration from chance.
HOST_PRIOR, SUFFIX_PRIOR, DECLARED_PRIOR = 20.0, 50.0, 10.0
#: A row is rejected if the posterior of its best language is lower, or if its text is less likely per trigram than the
#: training rows' median by so many of their deviations (and at least ``LEAST_DROP`` nats).
LEAST_POSTERIOR, MOST_DEVIATIONS, LEAST_DROP = 0.5, 8.0, 5.0


def trigrams(text: bytes) -> np.ndarray:
    """Bins of the byte trigrams of a text, ASCII letters lower-cased, digits as one, white space as one blank."""
    x = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    x = np.where((x >= 48) & (x <= 57), np.uint32(48), x)
    if len(x) < 4:
        return np.empty(0, np.int64)
    key = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    key ^= key >> np.uint32(15)
    return (key % np.uint32(BINS)).astype(np.int64)


def fit_text_model(rows: DataFrame) -> dict:
    """Trigram model of each language from ``rows(label, text)``: a sample bounded per language, counted in the tasks.

    Returns the languages in order, log likelihoods (language x bin), and median and deviation of the
    training rows' log likelihood per trigram.  Every label is a language, however many there are.
    """
    many = rows.filter("label IS NOT NULL").groupBy("label").count()
    # A hash threshold thins out first, then the smallest hashes of each language are kept: the sample is the same in any partitioning.
    share = F.least(F.lit(1.0), F.lit(2.0 * TRAIN_ROWS) / F.col("count"))
    limit = F.when(share < 1.0, (share * 2.0**64 - 2.0**63).cast("long")).otherwise(F.lit(2**63 - 1))  # a cast holds at the ends
    many = materialize(many.withColumn("_limit", limit), "languages")
    names = sorted(r["label"] for r in many.select("label").collect())
    if not names:
        return {"names": [], "table": np.zeros((0, BINS), np.float32), "mean": np.zeros(0), "spread": np.zeros(0)}
    thinned = rows.join(many, "label").withColumn("_h", F.xxhash64(F.lit("train"), "text")).filter("_h <= _limit")
    thinned = materialize(thinned.select("label", "_h", F.col("text").cast("binary").alias("text")), "thinned")
    number = F.row_number().over(Window.partitionBy("label").orderBy("_h", "text"))
    picks = materialize(thinned.withColumn("_n", number).filter(F.col("_n") <= TRAIN_ROWS).select("label", "text"), "training")
    place = {n: i for i, n in enumerate(names)}
    schema = pa.schema([("label", pa.string()), ("bins", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]):
        totals: dict = {}
        for label, text in rows_of(batches, "label", "text"):
            own = totals.setdefault(label, np.zeros(BINS, np.int64))
            own += np.bincount(trigrams(text or b""), minlength=BINS)
        out = Emitter(schema)
        for label, own in totals.items():
            some = np.flatnonzero(own)
            yield from out.add((label, some, own[some]))
        yield from out.flush()

    counted = picks.mapInArrow(count, "label string, bins array<long>, n array<long>")
    counted = counted.select("label", F.explode(F.arrays_zip("bins", "n")).alias("z")).groupBy("label", "z.bins").agg(F.sum("z.n").alias("n"))
    lists = materialize(counted.groupBy("label").agg(F.collect_list("bins").alias("bins"), F.collect_list("n").alias("n")), "trigrams")
    table = np.full((len(names), BINS), -np.log(BINS), np.float32)
    for r in lists.toLocalIterator():  # one language at a time, at most BINS numbers
        own = np.full(BINS, 0.1)
        own[np.array(r["bins"], np.int64)] += np.array(r["n"], np.float64)
        table[place[r["label"]]] = np.log(own / own.sum())
    model = {"names": names, "table": table}

    def fit(batches: Iterator[pa.RecordBatch]):
        out = Emitter(pa.schema([("label", pa.string()), ("x", pa.float64())]))
        for label, text in rows_of(batches, "label", "text"):
            bins = trigrams(text or b"")
            if len(bins) >= 30:
                yield from out.add((label, float(model["table"][place[label]][bins].mean())))
        yield from out.flush()

    fits = picks.mapInArrow(fit, "label string, x double").groupBy("label").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()
    # Median and quartiles: texts that bear a wrong label do not stretch the spread.
    found = {r["label"]: (r["q"][1], (r["q"][2] - r["q"][0]) / 1.349) for r in fits}
    model["mean"] = np.array([found.get(n, (-99.0, 0.0))[0] for n in names])
    model["spread"] = np.array([found.get(n, (-99.0, 0.0))[1] for n in names])
    return model


def text_evidence(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` with ``text_log`` (tempered log likelihood per language) and ``drop`` (how much less likely than training text).

    The text itself does not leave; both are null for texts without a trigram.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # languages x BINS numbers
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        kinds = pa.list_(pa.float64())
        for batch in batches:
            logs, drops = [], []
            for (text,) in rows_of(iter([batch]), "text"):
                bins = trigrams(text or b"")
                if not len(bins) or not m["names"]:
                    logs.append(None)
                    drops.append(None)
                    continue
                mean = np.array([row[bins].mean() for row in m["table"]], np.float64)
                logs.append((mean - mean.max()) * TEMPER * min(len(bins), MOST_EVIDENCE))
                best = int(mean.argmax())
                reach = max(LEAST_DROP, MOST_DEVIATIONS * m["spread"][best])
                # Short texts scatter: their mean varies with one over the root of their length.
                drops.append(float((m["mean"][best] - mean[best]) / (reach * max(1.0, (60 / len(bins)) ** 0.5))))
            columns = [batch.column(c) for c in others] + [pa.array(logs, kinds), pa.array(drops, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "text_log", "drop"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c != "text")
    return rows.mapInArrow(run, f"{kinds}, text_log array<double>, `drop` double")


def _softmax(logs):
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, keys: list[str], n: int, weights: str) -> DataFrame:
    """Per key the summed language weights as an array; rows add up in tasks first, so a hot key is one row per task."""
    own = [F.sum(F.col(weights)[i]).alias(f"_{i}") for i in range(n)]
    return rows.groupBy(*keys).agg(*own).select(*keys, F.array(*(F.col(f"_{i}") for i in range(n))).alias("sums"))


def identify(rows: DataFrame, model: dict) -> DataFrame:
    """Fuse evidence of ``rows(id, text, declared, suffix, host)``: ``id, language, posterior, text_language, drop, kept``.

    Text posteriors (with equal priors) are summed per host, per suffix and over all rows; a host's prior is
    smoothed by its suffix's, and that by the overall one.  Summed per declared value they give how often a
    declaration goes with a language, so a wrong habit of declaring loses weight by itself.  The posterior
    is the product of tempered text likelihood, declaration likelihood and host prior.

    Null or empty text: decided by the other evidence alone and not kept.  Null declared, suffix or host: values of
    their own.  Rows repeat as they are.  Without any labelled row nothing is known and nothing kept.
    """
    names = model["names"]
    n = len(names)
    if not n:
        none = F.lit(None)
        return rows.select("id", none.cast("string").alias("language"), none.cast("double").alias("posterior"), none.cast("string").alias("text_language"), none.cast("double").alias("drop"), F.lit(False).alias("kept"))
    scored = materialize(text_evidence(rows, model), "evidence")
    even = F.array(*(F.lit(1.0 / n) for _ in names))
    scored = scored.withColumn("soft", F.when(F.col("text_log").isNotNull(), _softmax(F.col("text_log"))))
    with_text = scored.filter("soft IS NOT NULL")
    whole = _sums(with_text, [], n, "soft").first()["sums"]
    total = sum(x or 0.0 for x in whole)
    base = [((x or 0.0) + 1.0) / (total + n) for x in whole]
    everywhere = F.array(*(F.lit(x) for x in base))

    def smooth(sums, prior, weight):
        all_ = F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(sums, prior, lambda s, p: (s + F.lit(weight) * p) / (all_ + F.lit(weight)))

    suffix = _sums(with_text, ["suffix"], n, "soft").select(F.col("suffix").alias("_suffix"), smooth(F.col("sums"), everywhere, SUFFIX_PRIOR).alias("p_suffix"))
    host = _sums(with_text, ["suffix", "host"], n, "soft").join(suffix, F.col("suffix").eqNullSafe(F.col("_suffix")), "left")
    host = host.select(F.col("suffix").alias("_s"), F.col("host").alias("_h"), smooth(F.col("sums"), F.coalesce("p_suffix", everywhere), HOST_PRIOR).alias("p_host"))
    declared = _sums(with_text, ["declared"], n, "soft")
    # P(declared | language) up to a constant per declared value: share of the language among its rows over the overall share.
    declared = declared.select(F.col("declared").alias("_d"), F.zip_with(smooth(F.col("sums"), everywhere, DECLARED_PRIOR), everywhere, lambda x, b: x / b).alias("p_declared"))
    host, declared = materialize(host, "hosts"), materialize(declared, "declared")
    out = scored.join(host, F.col("suffix").eqNullSafe(F.col("_s")) & F.col("host").eqNullSafe(F.col("_h")), "left")
    out = out.join(declared, F.col("declared").eqNullSafe(F.col("_d")), "left")
    zero = F.array(*(F.lit(0.0) for _ in names))
    logs = F.zip_with(F.coalesce("text_log", zero), F.coalesce("p_host", everywhere), lambda a, p: a + F.log(p))
    logs = F.zip_with(logs, F.coalesce("p_declared", F.transform(even, lambda _: F.lit(1.0))), lambda a, p: a + F.log(p))
    out = out.withColumn("_post", _softmax(logs)).withColumn("posterior", F.array_max("_post"))
    known = F.array(*(F.lit(x) for x in names))
    language = F.element_at(known, F.array_position("_post", F.col("posterior")).cast("int"))
    text_language = F.element_at(known, F.array_position("soft", F.array_max("soft")).cast("int"))
    kept = F.coalesce((F.col("posterior") >= LEAST_POSTERIOR) & (F.col("drop") <= 1.0), F.lit(False))
    return out.select("id", language.alias("language"), "posterior", text_language.alias("text_language"), "drop", kept.alias("kept"))


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """``identify`` over documents, the declared language being ``declared_col`` and the host ``host_col``.

    The text model is fitted on a bounded sample of the documents with their declared language as label.  A
    host with a dot has its last label as suffix.
    """
    host = F.lower(F.col(host_col).cast("string"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("binary").alias("text"),
        F.lower(F.col(declared_col).cast("string")).alias("declared"),
        F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).alias("suffix"),
        host.alias("host"),
    )
    model = fit_text_model(docs.select(F.lower(F.col(declared_col).cast("string")).alias("label"), F.col(text_col).alias("text")))
    return identify(rows, model)


def identify_pages(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``identify`` over web pages: declared in ``<html lang>``, suffix and host from the address; ``labelled(label, text)`` trains the text model."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#:]*)", 1))
    html = F.coalesce(F.col(html_col), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>|&#?\w+;", " ")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        bare.cast("binary").alias("text"),
        F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)), F.lit("")).alias("declared"),
        F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).alias("suffix"),
        F.nullif(host, F.lit("")).alias("host"),
    )
    return identify(rows, fit_text_model(labelled))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """The rows of ``docs`` whose id ``identify_documents`` keeps in every row, all columns; rows with a null id go."""
    verdict = identify_documents(docs, id_col, **columns).groupBy("id").agg(F.min("kept").alias("kept")).filter("kept AND id IS NOT NULL")
    return docs.join(verdict, docs[id_col].cast("long") == verdict["id"], "left_semi")
