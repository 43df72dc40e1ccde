"""Problem 5: copies of records in resolutions and gsm_phase_results that differ in writing only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import strip
from sievework.llm.dedup import duplicates
from sievework.sources.tables import table


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    values = table(spark, sf_dir, "gsm_phase_results").filter(strip("p1_value") != "")
    return {
        "resolutions": duplicates(table(spark, sf_dir, "resolutions"), id_col="res_id", exact=["col", "created_at"], text="input_label"),
        "gsm_phase_results": duplicates(values, id_col="pr_id", exact=["gsm", "field"], text="p1_value"),
    }


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (copies.select(F.lit(src).alias("src"), "first_id", "copy_id") for src, (_, copies) in _sources(spark, sf_dir).items())
    return a.union(b).distinct()


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, first_id, n_copies): one row for each record."""
    a, b = (records.select(F.lit(src).alias("src"), "first_id", "n_copies") for src, (records, _) in _sources(spark, sf_dir).items())
    return a.union(b)


QUERIES = {"p5_found": p5_found, "p5_records": p5_records}
