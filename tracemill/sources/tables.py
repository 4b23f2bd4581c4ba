"""The driver tables, read lazily so each query scans only the columns it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.session import tune


class Tables:
    """``Tables(spark, folder).orders`` reads ``folder/orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        # Keep the handle: opening a folder lists files and reads a footer every time.
        frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        self.__dict__[name] = frame
        return frame
