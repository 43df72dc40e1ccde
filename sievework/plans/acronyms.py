"""Short forms resolved by the text that defines them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.acronyms import definition, definitions, study_summary
from sievework.functions.guards import supports_acronym
from sievework.sources.tables import table


def definition_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms with a target, defined by a text made of both, in either order: how many definitions are found, by field."""
    a = table(spark, sf_dir, "acronym_all").filter("target is not null").select("col", F.upper(F.trim("acronym")).alias("short"), "target").distinct()
    text = F.concat(F.lit("Samples of "), F.col("target"), F.lit(" ("), F.col("short"), F.lit("; n=3) were taken."))
    found = a.withColumn("found", definition(F.col("short"), text))
    return found.groupBy("col").agg(F.count(F.lit(1)).alias("acronyms"), F.count("found").alias("defined"), F.count_if(F.col("found") == F.col("target")).alias("whole"))


def document_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All definitions in the documents, with how many documents give them."""
    d = definitions(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return d.groupBy("short", "expansion").agg(F.count_distinct("doc_id").alias("documents"))


def supported_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronym targets by field that some name of the concept supports (a word beginning with the acronym's first letter)."""
    names = table(spark, sf_dir, "vocab").filter("term is not null").groupBy(F.col("mesh_id").alias("id")).agg(F.collect_set("term").alias("forms"))
    a = table(spark, sf_dir, "acronym_all").filter("id is not null").select("col", F.trim("acronym").alias("acronym"), "id").distinct()
    return a.join(names, "id").groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.count_if(supports_acronym(F.col("acronym"), F.col("forms"))).alias("supported"))


def study_summary_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per study its first sample's title, protocol and description, compressed to 512 characters."""
    ctx = table(spark, sf_dir, "gsm_context").filter("gse is not null").groupBy("gse").agg(F.min_by(F.struct("title", "treatment_protocol", "description"), F.struct("gsm", "title", "treatment_protocol", "description")).alias("c"))
    return ctx.select("gse", study_summary(F.col("c.title"), F.col("c.treatment_protocol"), F.col("c.description")).alias("summary"))


QUERIES = {f.__name__: f for f in (definition_finder, document_definitions, supported_acronyms, study_summary_512)}
