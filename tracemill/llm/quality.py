"""Quality rules with thresholds adapted to each language and source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Emitter, hash_words, materialize, rows_of, windows

#: Fixed rules of the base: fewest words, and the largest share (percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Signals per document as whole numbers: (name, numerator, denominator, scale).  Each is ``scale * numerator div denominator``.
SIGNALS = (
    ("word_length", "word_chars", "n_words", 100),
    ("symbol_share", "n_symbols", "word_chars", 1000),
    ("line_share", "n_dup_lines", "n_lines", 1000),
    ("repeat_share", "n_repeat_words", "n_words", 1000),
)
#: A document fails a signal beyond ``quartile + FENCE * (interquartile range)``, and only if it is also at least this far
#: from the quartile: narrow groups shall not lose documents over small differences.
FENCE = 3
LEAST_DISTANCE = {"word_length": 300, "symbol_share": 30, "line_share": 400, "repeat_share": 280}
#: Signals that also have a lower fence.
TWO_SIDED = ("word_length",)
#: A group with fewer documents borrows the sketch of its language, and a small language that of all documents.
LEAST_ROWS = 200
#: Bits of precision of a sketch bin: values below 2^BITS are exact, others keep so many leading bits.
BITS = 8

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_SPACES = re.compile(rb"[\x20\x09-\x0d]")


def measure(text: bytes | None) -> tuple[int, ...]:
    """``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of a UTF-8 text; null has none."""
    text = text or b""
    words = text.split()
    n = len(words)
    bytes_ = np.frombuffer(text, np.uint8)
    points = int(((bytes_ & 0xC0) != 0x80).sum())
    chars = points - int(((bytes_ == 0x20) | ((bytes_ >= 0x09) & (bytes_ <= 0x0D))).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > WINDOW:
        keys = windows(hash_words(words), WINDOW)
        _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[at] > 1)
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + WINDOW, -1)
        repeated = int((np.cumsum(marks[:n]) > 0).sum())
    return n, chars, len(_SYMBOLS.findall(text)), len(lines), len(lines) - len(set(lines)), repeated


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, id_col: str, text_col: str, keys: list[str]) -> DataFrame:
    """``measure`` of every row, with its id and group keys."""
    slots = [f"_k{i}" for i in range(len(keys))]
    schema = pa.schema([("id", pa.int64()), *((s, pa.string()) for s in slots), *((m, pa.int64()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]):
        out = Emitter(schema)
        for key, text, *own in rows_of(batches, "id", "text", *slots):
            yield from out.add((key, *own, *measure(text)))
        yield from out.flush()

    named = [F.col(k).cast("string").alias(s) for k, s in zip(keys, slots, strict=True)]
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *named)
    kinds = ["id long", *(f"{s} string" for s in slots), *(f"{m} long" for m in MEASURES)]
    return slim.mapInArrow(run, ", ".join(kinds))


def bin_of(name: str):
    """Sketch bin of a whole number: its leading ``BITS`` bits; bins of any two sketches line up, so sketches add."""
    return F.expr(f"{name} - pmod({name}, cast(pow(2, greatest(length(bin({name})) - {BITS}, 0)) as bigint))")


def sketches(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable quantile sketches ``(level, keys, signal, bin, n)`` of every group, and merged of its parents.

    A sketch is a histogram with bins of bounded relative width; merging is adding counts, in any order with
    the same result.  Level ``len(keys)`` is the finest; level 0 holds all rows.
    """
    pairs = F.array(*(F.struct(F.lit(s[0]).alias("signal"), bin_of(s[0]).alias("bin")) for s in SIGNALS))
    finest = signals.select(*keys, F.explode(pairs).alias("_p")).groupBy(*keys, "_p.signal", "_p.bin").agg(F.count("*").alias("n"))
    finest = materialize(finest, "sketches")
    out = finest.withColumn("level", F.lit(len(keys)))
    for level in range(len(keys)):
        merged = finest.groupBy(*keys[:level], "signal", "bin").agg(F.sum("n").alias("n")).withColumn("level", F.lit(level))
        out = out.unionByName(merged, allowMissingColumns=True)
    return out


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per level, group and signal: rows, and the lower and upper fence from the quartiles of the sketch."""
    sorted_bins = F.array_sort(F.collect_list(F.struct("bin", "n")))  # at most (64 - BITS) * 2^BITS bins
    grouped = sketch.groupBy("level", *keys, "signal").agg(sorted_bins.alias("bins"), F.sum("n").alias("rows"))

    def quantile(share: float):
        wanted = F.col("rows") * share
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value"))
        step = lambda acc, b: F.struct(
            (acc["seen"] + b["n"]).alias("seen"),
            F.when(acc["value"].isNull() & (acc["seen"] + b["n"] >= wanted), b["bin"]).otherwise(acc["value"]).alias("value"),
        )
        return F.aggregate("bins", start, step)["value"]

    least = F.coalesce(*(F.when(F.col("signal") == s, d) for s, d in LEAST_DISTANCE.items()))
    quartiles = grouped.select("level", *keys, "signal", "rows", quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
    reach = F.greatest(FENCE * (F.col("q3") - F.col("q1")), least)
    low = F.when(F.col("signal").isin(*TWO_SIDED), F.col("q1") - reach)
    return quartiles.select("level", *keys, "signal", "rows", low.alias("low"), (F.col("q3") + reach).alias("high"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per row of ``docs``: id, base measures, ``base_failed``, ``reasons`` and ``kept``.

    The base fails texts of fewer than ``LEAST_WORDS`` words and those with more than ``MOST_REPEATED`` percent of
    their words in ``WINDOW``-word windows that occur twice or more.  The other documents make up the sketches of
    their language and source; one fails where a signal lies beyond the fences of its group.  Groups below
    ``LEAST_ROWS`` documents use the fences of their language, small languages those of all documents.

    A null text has no words; null keys are groups of their own; rows repeat as they are; an empty table gives
    no row.  Other columns are ignored.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    rows = measures(docs, id_col, text_col, list(keys))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    signals = [F.floor(scale * F.col(top) / F.greatest(F.col(of), F.lit(1))).cast("long").alias(name) for name, top, of, scale in SIGNALS]
    rows = materialize(rows.select("*", failed.alias("base_failed"), *signals), "measures")
    limits = fences(sketches(rows.filter("NOT base_failed"), own), own)
    kinds = {s[0]: F.max(F.when(F.col("signal") == s[0], F.struct("low", "high"))).alias(f"_{s[0]}") for s in SIGNALS}
    limits = limits.groupBy("level", *own).agg(F.first("rows").alias("rows"), *kinds.values())
    limits = materialize(limits.select("level", *own, "rows", F.struct(*(f"_{s[0]}" for s in SIGNALS)).alias("_fence")), "fences")
    # Each finest group gets its own fence or, if small, that of the nearest parent with enough rows.
    groups = limits.filter(F.col("level") == len(own)).drop("level")
    groups = groups.withColumn("_fence", F.when(F.col("rows") >= LEAST_ROWS, F.col("_fence")))
    for level in range(len(own) - 1, 0, -1):
        part = limits.filter((F.col("level") == level) & (F.col("rows") >= LEAST_ROWS))
        part = part.select(*(F.col(k).alias(f"{k}_up") for k in own[:level]), F.col("_fence").alias("_up"))
        on = [F.col(k).eqNullSafe(F.col(f"{k}_up")) for k in own[:level]]
        groups = groups.join(part, on, "left").withColumn("_fence", F.coalesce("_fence", "_up")).drop("_up", *(f"{k}_up" for k in own[:level]))
    everywhere = limits.filter("level = 0").select("_fence").first()  # one row
    if everywhere:
        fence = F.struct(*(F.struct(*(F.lit(x).cast("long").alias(n) for n, x in (("low", f.low), ("high", f.high)))).alias(n) for n, f in everywhere["_fence"].asDict().items()))
        groups = groups.withColumn("_fence", F.coalesce("_fence", fence))
    groups = materialize(groups.select(*(F.col(k).alias(f"{k}_g") for k in own), "_fence"), "groups")
    out = rows.join(groups, [F.col(k).eqNullSafe(F.col(f"{k}_g")) for k in own], "left")
    beyond = []
    for name, *_ in SIGNALS:
        low, high = F.col(f"_fence._{name}.low"), F.col(f"_fence._{name}.high")
        beyond.append(F.when((F.col(name) > high) | F.coalesce(F.col(name) < low, F.lit(False)), F.lit(name)))
    reasons = F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.array_compact(F.array(*beyond)))
    return out.select("id", *MEASURES, "base_failed", reasons.alias("reasons"), *(s[0] for s in SIGNALS)).withColumn("kept", F.size("reasons") == 0)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` whose id ``judge`` keeps in every row, all columns; rows with a null id go."""
    verdict = judge(docs, id_col, text_col, keys).groupBy("id").agg(F.min("kept").alias("kept")).filter("kept AND id IS NOT NULL").select("id")
    return docs.join(verdict, docs[id_col].cast("long") == verdict["id"], "left_semi")
