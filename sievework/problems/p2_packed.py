"""Problem 2: packed characteristics and identifier lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.packed import CHARACTERISTICS, IDENTIFIERS, split_packed
from sievework.sources.tables import table

#: (table, its record's id, its packed field, the field's dialect)
FIELDS = [("gsm_context", "gsm", "characteristics", CHARACTERISTICS), ("t5_shard1_judge", "item", "assigned_id", IDENTIFIERS), ("sex_vs_condition_flagged", "gsm", "final_condition_id", IDENTIFIERS)]


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rec, pos, val, n_values, error): every value of the three fields, single ones too."""
    parts = [split_packed(table(spark, sf_dir, name).select(F.col(rec).cast("string").alias("rec"), field).filter(F.col(field).isNotNull()).distinct(), field, ["rec"], dialect).select(F.lit(name).alias("src"), "rec", "pos", "val", "n_values", "error") for name, rec, field, dialect in FIELDS]
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_values(spark, sf_dir).filter("n_values > 1").select("src", "rec", "pos", "val").distinct()


QUERIES = {"p2_found": p2_found, "p2_values": p2_values}
