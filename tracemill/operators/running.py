"""Prefix computations that stay safe when one key holds most of the rows.

A plain ``Window.partitionBy(run).orderBy(pos)`` sends a whole run to one task.  These
operators cut each key into blocks that are monotone in the ordering column, compute the
block totals with a partially aggregated ``groupBy``, scan the (few) block totals per key,
and run the row-level window inside a block only.  With a unique integral ordering column
and ``block = pos div width`` a block never holds more than ``width`` rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 18


def block_of(order_col: str, width: int = BLOCK_ROWS) -> Column:
    """Monotone block number of an integral ordering column."""
    return F.floor(F.col(order_col) / F.lit(width)).cast("long")


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add, per row, sums and maxima over the rows of the same key that come before it.

    ``sums`` start at 0 and ``maxes`` at null for the first row.  ``block`` must be
    non-decreasing in ``order`` within a key.  Keys must be non-null.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    keys, kept = list(keys), df.columns
    inputs = {f"_in_{n}": c for n, c in {**sums, **maxes}.items()}
    rows = df.select("*", block.alias("_block"), *[c.alias(n) for n, c in inputs.items()])
    totals = rows.groupBy(*keys, "_block").agg(
        *[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_t_{n}") for n in maxes],
    )
    before_block = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_block",
        *[F.sum(f"_t_{n}").over(before_block).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before_block).alias(f"_c_{n}") for n in maxes],
    )
    in_block = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        *kept,
        "_block",
        *[F.sum(f"_in_{n}").over(in_block).alias(f"_l_{n}") for n in sums],
        *[F.max(f"_in_{n}").over(in_block).alias(f"_l_{n}") for n in maxes],
    )
    return local.join(carried, [*keys, "_block"]).select(
        *kept,
        *[(F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in maxes],
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "position"
) -> DataFrame:
    """Dense 1-based position of each row within its key (``row_number`` for hot keys)."""
    return running_before(df, keys, order, block, sums={name: F.lit(1)}).withColumn(
        name, (F.col(name) + 1).cast("long")
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    values: Sequence[str],
    where: Column | None = None,
    width: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``prev`` = struct(order_col, *values) of the nearest earlier row (``lag`` for hot keys).

    Rows where ``where`` is false are skipped as sources but still receive a ``prev``.
    """
    item = F.struct(order_col, *values)
    if where is not None:
        item = F.when(where, item)
    return running_before(df, keys, [order_col], block_of(order_col, width), maxes={"prev": item})


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """Keep the first (or last) row of each key.

    ``row_number() <= 1`` is cut in every task before the shuffle (a window group limit), so a hot key
    sends one row per task and no whole row goes through an aggregate.
    """
    wanted = [F.col(c).desc() if last else F.col(c) for c in order]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*wanted))
    return df.withColumn("_first", number).filter("_first <= 1").drop("_first")
