"""Parquet table access for a directory of ``<name>.parquet`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table; Catalyst prunes columns and pushes filters into this scan."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
