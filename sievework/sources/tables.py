"""Readers of the Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``name``.parquet of ``sf_dir``; a file or a folder of part files. Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
