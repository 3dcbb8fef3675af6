"""Tables kept as one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` under ``folder``; column pruning and filters of the
    caller reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
