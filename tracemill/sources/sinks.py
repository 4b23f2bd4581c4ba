"""Writers.  All of them write distributed files; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Long report table ``(dimension, key, measures...)``, one folder per dimension."""
    writer = df.write.mode(mode)
    (writer.partitionBy("dimension") if "dimension" in df.columns else writer).parquet(path)


def split_write(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Stable and unstable samples in one pass; reading the folder whole gives the full set."""
    samples.write.mode(mode).partitionBy("variant").parquet(path)


def write_packaged(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Packaged samples and their child tables in one job, a folder per part; ``rows`` from ``packaging.packaged_rows``."""
    rows.write.mode(mode).partitionBy("part").parquet(path)
