"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import WORD, Emitter, components, materialize, rows_of

#: Words per copy cost these amounts: each further copy of a document costs more than the one before.
COPY_COST = (0, 1, 3)
#: Connected groups of patterns are dealt to at most so many tasks, which solve each group for itself.
BUCKETS = 1 << 10
#: Documents of a pattern are split into so many hash ranges when the share of one more copy is chosen.
RANGES = 1 << 12
SEED = 20_240_601
#: A gap is filled in seeded order with documents that are smaller by this factor, the rest of it by size.
SMALL = 64


def targets(sizes: dict, weights: dict, most: float = len(COPY_COST)) -> dict:
    """Share the sum of ``sizes`` by weight; no share passes ``most`` times its size, the excess goes to the others by weight."""
    total, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        rest, weight = total - sum(out.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] > most * sizes[s] * weight}
        if not over:
            return out | {s: rest * weights[s] / weight for s in open_}
        out |= {s: most * float(sizes[s]) for s in over}
        open_ -= over
    return out


def flow(patterns: dict[tuple, int], quotas: dict, costs: tuple[int, ...] = COPY_COST) -> dict[tuple, float]:
    """Words that each pattern gives: most words first, least repetition cost among these.

    ``patterns`` maps a tuple of source names to the words of its documents.  A pattern has one layer of that
    capacity per copy, dearer from layer to layer (convex); a source takes its quota at most.  Patterns and
    sources that are not connected are solved apart, each by successive shortest paths.
    """
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for p in patterns:
        for s in p[1:]:
            root[find(s)] = find(p[0])
    groups: dict = {}
    for p in filter(None, patterns):
        groups.setdefault(find(p[0]), []).append(p)
    out: dict[tuple, float] = {}
    for own in groups.values():
        out |= _flow(sorted(own, key=repr), patterns, quotas, costs)
    return out


def _flow(names: list[tuple], patterns: dict[tuple, int], quotas: dict, costs: tuple[int, ...]) -> dict[tuple, float]:
    """Successive shortest paths within one connected group.

    A path starts at a pattern's next free layer, whose cost is the path's cost, and may pass a full source by
    moving another pattern's words from it to one of that pattern's other sources.
    """
    sources = sorted({s for p in names for s in p}, key=repr)
    room = {s: float(quotas[s]) for s in sources}
    used = dict.fromkeys(names, 0.0)
    sent: dict[tuple, float] = {}
    holders: dict = {s: {} for s in sources}  # patterns that a source has words of, in the order they came
    eps = 1e-9 * max([1.0, *room.values()])

    def layer(p):
        """Cost of a pattern's next layer and what it still holds."""
        for c, cost in enumerate(costs):
            free = (c + 1) * float(patterns[p]) - used[p]
            if free > eps:
                return cost, free
        return None, 0.0

    while True:
        back: dict = {}
        starts = sorted((x[0], i) for i, p in enumerate(names) if (x := layer(p))[0] is not None)
        queue = [("p", names[i]) for _, i in starts]  # in the order of cost: a breadth-first tree from each start in turn
        goal = None
        for start in queue:
            if start in back:
                continue
            back[start] = None
            tree = deque([start])
            while tree and goal is None:
                node = tree.popleft()
                kind, key = node
                if kind == "s" and room[key] > eps:
                    goal = node
                    break
                ways = [("s", s) for s in key] if kind == "p" else [("p", p) for p in holders[key]]
                for way in ways:
                    if way not in back:
                        back[way] = node
                        tree.append(way)
            if goal:
                break
        if goal is None:
            return used
        path = [goal]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        moves = list(zip(path, path[1:], strict=False))
        amount = min([layer(path[0][1])[1], room[goal[1]], *(sent[b, a] for (kind, a), (_, b) in moves if kind == "s")])
        for (kind, a), (_, b) in moves:
            if kind == "p":
                sent[a, b] = sent.get((a, b), 0.0) + amount
                if sent[a, b] > eps:
                    holders[b][a] = None
            else:
                sent[b, a] -= amount
                if sent[b, a] <= eps:
                    holders[a].pop(b, None)
        used[path[0][1]] += amount
        room[goal[1]] -= amount


def shares(sizes: DataFrame, weights) -> DataFrame:
    """``(name, size, target)`` of ``sizes(name, size)``: ``targets`` for any number of sources.

    If ``weights`` has a ``column`` form (weight by the rank of a name), no name reaches the driver: the level that
    the targets of uncapped sources share per weight is raised until no further source is above its most.
    """
    most, last = float(len(COPY_COST)), F.col("name").asc_nulls_last()
    if not hasattr(weights, "column"):
        rows = sizes.collect()
        own = {r["name"]: r["size"] for r in sorted(rows, key=lambda r: (r["name"] is None, r["name"] or ""))}
        goal = targets(own, weights(list(own))) if own else {}
        return sizes.sparkSession.createDataFrame([(s, n, float(goal[s])) for s, n in own.items()], "name string, size long, target double")
    parts = materialize(sizes.repartitionByRange(last).withColumn("_part", F.spark_partition_id()), "names")
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(last)) - 1
    weighed = parts.join(before, "_part").select("name", "size", weights.column(rank).cast("double").alias("weight"))
    weighed = materialize(weighed, "weights")
    total, level = float(weighed.agg(F.sum("size")).first()[0] or 0), 0.0
    while True:
        over = F.lit(level) * F.col("weight") > most * F.col("size")
        row = weighed.agg(F.sum(F.when(over, F.col("size"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        higher = (total - most * (row["full"] or 0)) / row["open"] if row["open"] else level
        if higher <= level:
            break
        level = higher
    return weighed.select("name", "size", F.least(most * F.col("size"), level * F.col("weight")).alias("target"))


def _same(left, right):
    return F.col(left).eqNullSafe(F.col(right))


def _prefix(docs: DataFrame, want: str) -> DataFrame:
    """``docs`` with ``extra``: 1 for documents in the order of ``_draw`` while their running sum fits the pattern's ``want``.

    Only the hash range in which it ends is put in order.
    """
    ranges = docs.groupBy("sources", "_range").agg(F.sum("unit").alias("words"), F.first(want).alias("want"))
    upto = Window.partitionBy("sources").orderBy("_range")
    ranges = ranges.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    edge = ranges.filter("before <= want").groupBy("sources").agg(F.max(F.struct("_range", "before")).alias("edge"))
    edge = edge.select(F.col("sources").alias("_s"), F.col("edge._range").alias("_edge"), F.col("edge.before").alias("_before"))
    edge = materialize(edge, "edges")  # one row per pattern
    docs = docs.join(edge, _same("sources", "_s")).drop("_s")
    running = F.sum("unit").over(Window.partitionBy("sources").orderBy("_draw", "id", "size")) + F.col("_before")
    inner = docs.filter("_range = _edge").withColumn("extra", (running <= F.col(want)).cast("int"))
    outer = docs.filter("_range <> _edge").withColumn("extra", (F.col("_range") < F.col("_edge")).cast("int"))
    return outer.unionByName(inner).drop("_edge", "_before")


def _gaps(docs: DataFrame, want: str) -> DataFrame:
    """What the chosen of ``docs`` leave of each pattern's ``want``."""
    gap = F.first(want) - F.sum(F.col("extra") * F.col("unit"))
    return materialize(docs.groupBy("sources").agg(gap.alias("gap")).withColumnRenamed("sources", "_s"), "gaps")


def fill(gap: int, counts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``(size, how many)`` that fill ``gap`` from ``counts(size, how many there are)``, largest first: nothing left out fits."""
    out = []
    for size, n in sorted(counts, reverse=True):
        take = min(n, gap // size)
        if take:
            out.append((size, take))
            gap -= take * size
    return out


def _fills(left: DataFrame) -> DataFrame:
    """``(_s, _unit, take)``: ``fill`` of each pattern.  Distinct sizes are few: at most the root of twice the pattern's words."""
    counts = left.filter("unit > 0 AND unit <= gap").groupBy("sources", "unit").agg(F.count("*").alias("n"), F.first("gap").alias("gap"))
    lists = counts.groupBy("sources").agg(F.first("gap").alias("gap"), F.collect_list("unit").alias("units"), F.collect_list("n").alias("counts"))
    schema = pa.schema([("_s", pa.list_(pa.string())), ("_unit", pa.int64()), ("take", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        out = Emitter(schema)
        for names, gap, units, many in rows_of(batches, "sources", "gap", "units", "counts"):
            for unit, take in fill(gap, list(zip(units, many, strict=True))):
                yield from out.add((names, unit, take))
        yield from out.flush()

    return materialize(lists.mapInArrow(run, "_s array<string>, _unit long, take long"), "fills")


def select(sizes: DataFrame, plans: DataFrame, seed: int = SEED) -> DataFrame:
    """Copies per document so that each pattern gives its amount of words; ``sizes(id, sources, size)`` plus ``copies``.

    ``plans(sources, whole, rest, ...)`` has one row per pattern.  Every document of a pattern gets ``whole``
    copies.  One more goes to documents in the order of a seeded hash while they fit the rest.  What a document too
    large leaves open is filled in the same order with documents that are small beside the gap, and the last of it
    with the largest that fit, until none does.
    """
    docs = sizes.groupBy("sources", "id", "size").agg(F.count("*").alias("n")).withColumn("unit", F.col("n") * F.col("size"))
    docs = docs.withColumn("_draw", F.xxhash64(F.lit(seed), "id", "size")).withColumn("_range", F.shiftrightunsigned("_draw", 52).cast("int"))
    docs = docs.join(plans.withColumnRenamed("sources", "_s"), _same("sources", "_s")).drop("_s")
    first = materialize(_prefix(docs, "rest"), "chosen")
    left = first.filter("extra = 0").join(_gaps(first, "rest"), _same("sources", "_s")).drop("_s")
    small = (F.col("unit") > 0) & (F.col("unit") * SMALL <= F.col("gap"))
    second = _prefix(left.filter(small).drop("extra"), "gap").unionByName(left.filter(~small))
    second = materialize(second, "chosen")
    left = second.filter("extra = 0").drop("gap").join(_gaps(second, "gap"), _same("sources", "_s")).drop("_s")
    third = left.join(_fills(left), _same("sources", "_s") & (F.col("unit") == F.col("_unit")), "left").drop("_s", "_unit")
    third = materialize(third, "chosen")

    # Of documents of one size the first by hash; ranks are counts of the ranges before and row numbers within.
    own = third.filter("take IS NOT NULL")
    upto = Window.partitionBy("sources", "unit").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = own.groupBy("sources", "unit", "_range").count().withColumn("_before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    before = before.select(F.col("sources").alias("_s"), F.col("unit").alias("_u"), F.col("_range").alias("_r"), "_before")
    own = own.join(before, _same("sources", "_s") & (F.col("unit") == F.col("_u")) & (F.col("_range") == F.col("_r"))).drop("_s", "_u", "_r")
    number = F.row_number().over(Window.partitionBy("sources", "unit", "_range").orderBy("_draw", "id", "size"))
    own = own.withColumn("extra", (number + F.col("_before") <= F.col("take")).cast("int"))
    columns = [*plans.columns, "id", "size", "n", "extra"]
    out = [first.filter("extra = 1"), second.filter("extra = 1"), third.filter("take IS NULL"), own]
    out = reduce(DataFrame.unionByName, (x.select(*columns) for x in out))
    out = out.withColumn("copies", F.least(F.col("whole") + F.col("extra"), F.lit(len(COPY_COST))).cast("int"))
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("whole", "rest", "n", "extra", "_n")


def flown(patterns: DataFrame, quota: DataFrame, overlapping: bool) -> DataFrame:
    """``(sources, words, source_size, target, amount)``: the words that ``flow`` takes from each of ``patterns(sources, words)``.

    Patterns that share sources, directly or through others, are one group and meet in one task; a pattern of a
    source of its own is a group.  Size and target are those of the source, null for patterns of several or of none.
    """
    named = patterns.select("sources", "words", F.explode("sources").alias("_n")).join(quota, _same("_n", "name"))
    quotas = F.collect_list(F.struct("name", F.col("target").alias("quota"))).alias("quotas")
    single = [F.when(F.size("sources") == 1, F.max(c)).alias(c) for c in ("source_size", "target")]
    rows = named.groupBy("sources", "words").agg(quotas, *single).withColumn("_key", F.xxhash64("sources"))
    if overlapping:
        links = named.select(F.xxhash64("sources").alias("a"), F.xxhash64(F.lit("source"), "name").alias("b"))
        rows = rows.join(components(links), F.col("_key") == F.col("id")).withColumn("_key", F.col("component"))
    rows = rows.select("sources", "words", "quotas", "source_size", "target", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).alias("bucket"))

    def solve(pdf):
        names = [tuple(s) for s in pdf["sources"]]
        goals = {q["name"]: q["quota"] for own in pdf["quotas"] for q in own}
        given = flow(dict(zip(names, pdf["words"].tolist(), strict=True)), goals)
        return pdf.assign(amount=[given[n] for n in names])[["sources", "words", "source_size", "target", "amount"]]

    schema = "sources array<string>, words long, source_size long, target double, amount double"
    solved = rows.groupBy("bucket").applyInPandas(solve, schema)
    return solved.unionByName(patterns.filter("size(sources) = 0").withColumn("amount", F.lit(0.0)), allowMissingColumns=True)


def mix(docs: DataFrame, weights, id_col: str = "doc_id", text_col: str = "text", sources: str | None = "source", seed: int = SEED) -> DataFrame:
    """``(id, sources, size, copies)`` of every row; ``weights(names)`` gives the weight of each source, names in code point order, null last.

    ``sources`` names a string column (one source each, null being a source of its own) or an array column
    (overlapping sources; null or empty: no source, never taken).  A document's size is its number of words, a
    null text has none.  The sum over all documents is shared by weight, no source above three times its
    size; documents are repeated three times at most.  The same rows give the same result in any order;
    rows with equal id and size draw the same number and are told apart by nothing, so both are taken or
    left.  An empty table gives no row.
    """
    many = isinstance(docs.schema[sources].dataType, T.ArrayType)
    own = F.array_sort(F.array_distinct(F.coalesce(F.col(sources), F.array().cast("array<string>")))) if many else F.array(F.col(sources).cast("string"))
    sizes = docs.select(
        F.col(id_col).cast("long").alias("id"), own.cast("array<string>").alias("sources"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )
    sizes = materialize(sizes, "sizes")
    patterns = materialize(sizes.groupBy("sources").agg(F.sum("size").alias("words")), "patterns")
    members = patterns.select(F.explode("sources").alias("name"), "words").groupBy("name").agg(F.sum("words").alias("size"))
    quota = shares(members, weights).withColumnRenamed("size", "source_size")
    if many:  # overlapping sources: the documents' own words are shared
        words, total = patterns.filter("size(sources) > 0").agg(F.sum("words")).first()[0], quota.agg(F.sum("source_size")).first()[0]
        quota = quota.withColumn("target", F.col("target") * F.lit(words / total if total else 1.0))
    quota = materialize(quota, "quotas")
    plans = materialize(flown(patterns, quota, many), "flow")
    whole = F.coalesce(F.floor(F.col("amount") / F.nullif(F.col("words"), F.lit(0))), F.lit(0)).cast("int")
    rest = F.rint(F.col("amount") - F.col("whole") * F.col("words")).cast("long")
    plans = plans.withColumn("whole", whole).withColumn("rest", rest)
    plans = materialize(plans.select("sources", "source_size", "target", "whole", "rest"), "plans")
    return select(sizes, plans, seed).select("id", "sources", "size", "copies", "source_size", "target")


def cycle_weights(names: list) -> dict:
    """Weights 1, 2, 3 and again, in the order of ``names``."""
    return {s: i % 3 + 1 for i, s in enumerate(names)}


cycle_weights.column = lambda rank: rank % 3 + 1


def mix_documents(docs: DataFrame, weights, id_col: str = "doc_id", text_col: str = "text", sources: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as many times as ``mix`` takes it, with all columns; rows with a null id go.

    A repeated id counts once per size: its rows are all taken alike.
    """
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]  # no name of a column can clash with these
    taken = mix(docs, weights, id_col, text_col, sources, seed).filter("id IS NOT NULL").groupBy("id").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *own).join(taken.filter("copies > 0"), "id")
    rows = rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
