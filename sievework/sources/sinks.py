"""Writers: exports by platform, the assembled corpus with its checks, stage tables, decisions, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.labels import line_safe, safe_name
from sievework.functions.missing import is_present
from sievework.operators.dictionary import first_in_order


def export_csv(df: DataFrame, path: str, platform: str = "gpl") -> None:
    """Gzipped CSV by platform (a safe directory name), text columns free of line breaks and tabs."""
    text = [c for c, t in df.dtypes if t == "string"]
    clean = df.withColumns({c: line_safe(F.col(c)) for c in text if c != platform}).withColumn("platform", safe_name(F.coalesce(platform, F.lit("none"))))
    clean.write.mode("overwrite").partitionBy("platform").option("header", True).option("compression", "gzip").csv(path)


def assemble(parts: list[DataFrame], key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The union of the platforms' tables and a one-row manifest. Different columns fail at once; a repeated key fails at run time (in the manifest's pass)."""
    head = parts[0].columns
    for i, p in enumerate(parts):
        if p.columns != head:
            raise ValueError(f"table {i} has the columns {p.columns}, not {head}")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    per = whole.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(is_present(F.col(f), age=f.lower().endswith("age")), 1).otherwise(0)).alias(f) for f in fields])
    guard = F.when(F.max("n") > 1, F.raise_error(F.lit(f"repeated {key}"))).otherwise(F.count(F.lit(1)))
    return whole, per.agg(guard.cast("long").alias("n_rows"), *[F.sum(f).alias(f) for f in fields])


def append_stage(df: DataFrame, path: str) -> None:
    """Finished rows appended; Parquet's commit makes it all or nothing."""
    df.write.mode("append").parquet(path)


def read_stage(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    """The last row of each key in a stage table."""
    return first_in_order(spark.read.parquet(path), key, [F.desc_nulls_last(order)])


def unfinished(df: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't done yet."""
    return df.join(done.select(*key).distinct(), key, "left_anti")


def write_decisions(df: DataFrame, path: str, stages: list[str]) -> None:
    """Only answers of the stages that can't be worked out again."""
    df.filter(F.col("stage").isin(stages)).write.mode("overwrite").parquet(path)


def decide(df: DataFrame, decisions: DataFrame, key: list[str], fallback, answer: str = "answer") -> DataFrame:
    """``df`` with ``answer``: the recorded decision of its key, else the fallback expression. Decisions have one row per key."""
    return df.join(decisions.select(*key, F.col(answer).alias("_told")), key, "left").withColumn(answer, F.coalesce("_told", fallback)).drop("_told")


def write_report(df: DataFrame, path: str) -> None:
    """A report as tab-separated text in one file (reports are small by nature)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
