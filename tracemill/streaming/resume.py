"""Exactly-once work queue on Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def resume_stream(
    work: DataFrame, keys: Sequence[str], time_col: str | None = None, delay: str = "1 day", unbounded_state: bool = False
) -> DataFrame:
    """Each key once; seen keys expire ``delay`` behind the watermark of ``time_col``.

    Without a time column every key is remembered for ever, which a caller must ask for by name.
    """
    if time_col is None:
        if not unbounded_state:
            raise ValueError("give a time column, or ask for unbounded_state")
        return work.dropDuplicates(list(keys))
    return work.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def append_results(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to a folder; the checkpoint makes restarts pick up where they stopped."""
    return (
        results.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
