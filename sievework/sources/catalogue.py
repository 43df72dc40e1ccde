"""Sample catalogues: tables with optional columns, JSON shards, accession lists, text records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_COLUMNS = ["gsm", "gpl", "series_id", "title", "source_name_ch1", "source_name_ch2", "characteristics_ch1", "characteristics_ch2", "treatment_protocol_ch1", "treatment_protocol_ch2", "description"]


def scan_samples(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """The known columns that ``df`` has, and ``extra`` ones, which must be there."""
    absent = [c for c in extra if c not in df.columns]
    if absent:
        raise ValueError(f"no such columns: {', '.join(absent)}")
    return df.select(*dict.fromkeys([c for c in SAMPLE_COLUMNS if c in df.columns] + list(extra)))


def scan_studies(df: DataFrame) -> DataFrame:
    """(gse, gse_title, gse_summary, gse_design); the design stands in overall_design or design."""
    designs = [F.nullif(F.col(c), F.lit("")) for c in ("overall_design", "design") if c in df.columns]
    return df.select("gse", F.col("title").alias("gse_title"), F.col("summary").alias("gse_summary"), (F.coalesce(*designs) if designs else F.lit(None).cast("string")).alias("gse_design"))


def select_samples(samples: DataFrame, *, platforms: DataFrame | None = None, accessions: DataFrame | None = None, gpl: DataFrame | None = None, technology: str | None = None, organism: str | None = None) -> DataFrame:
    """Samples of the listed platforms or accessions (gpl / gsm columns), on platforms that fit the text filters."""
    out = samples
    if platforms is not None and accessions is not None:
        out = samples.join(platforms.select("gpl").distinct(), "gpl", "left_semi").unionByName(samples.join(accessions.select("gsm").distinct(), "gsm", "left_semi")).distinct()
    elif platforms is not None:
        out = samples.join(platforms.select("gpl").distinct(), "gpl", "left_semi")
    elif accessions is not None:
        out = samples.join(accessions.select("gsm").distinct(), "gsm", "left_semi")
    if gpl is not None and (technology or organism):
        fit = gpl
        for col, want in (("technology", technology), ("organism", organism)):
            if want:
                fit = fit.filter(F.lower(col).contains(want.lower()))
        out = out.join(fit.select("gpl").distinct(), "gpl", "left_semi")
    return out


def read_manifest(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(id): the accessions (prefix and digits) in the first field of each line of a list."""
    first = F.upper(F.trim(F.regexp_replace(F.split("value", "[,\t]")[0], "^﻿|\"", "")))
    return spark.read.text(path).select(first.alias("id")).filter(F.col("id").rlike(rf"^{prefix}\d+\z")).distinct()


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Samples of JSON shards, each a list of samples or an object with a list ``samples``; unfinished files (.partial, .tmp, .ckpt) are left out.

    schema: DDL of one sample. Both forms are read in one pass: the shard is text, its form told by its first character."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json*").text(path).filter(~F.input_file_name().rlike(r"\.(partial|tmp|ckpt)(\.|$)"))
    text = F.trim("value")
    samples = F.when(text.startswith("["), F.from_json(text, f"array<struct<{schema}>>")).otherwise(F.from_json(text, f"struct<samples: array<struct<{schema}>>>")["samples"])
    return files.select(F.inline(samples))


def soft_fields(record: Column) -> Column:
    """struct(title, summary, design) of a SOFT text; several lines of a field joined by a blank."""
    lines = lambda key: F.array_join(F.regexp_extract_all(record, F.lit(rf"(?m)^!Series_{key}\s*=\s*(.*?)\s*$"), F.lit(1)), " ")
    return F.struct(lines("title").alias("title"), lines("summary").alias("summary"), lines("overall_design").alias("design"))


def populated_stage(df: DataFrame, stages: list[str], rows: int = 500) -> str | None:
    """The first of ``stages`` (struct or string columns) with a value in a look at the first ``rows`` rows."""
    have = [s for s in stages if s in df.columns]
    if not have:
        return None
    look = df.limit(rows).agg(*[F.count(s).alias(s) for s in have]).first()
    return next((s for s in have if look[s]), None)
