"""Readers of the tables in one folder; each table is one parquet file or directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; parquet keeps projections and filters in the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
