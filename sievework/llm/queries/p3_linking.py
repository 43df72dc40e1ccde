"""Problem 3: pending labels of resolutions against vocab and cell_lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import strip
from sievework.llm.linking import learn_wording, link_labels
from sievework.runtime import cut
from sievework.sources.tables import table


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, grp, ref_id, weight): concepts by the column their category belongs to, cell lines under Tissue; weight is the entry's use in resolved rows."""
    grp = F.when(F.col("category") == "A", "Tissue").when(F.col("category").isin("C", "F"), "Condition").when(F.col("category").isin("D", "E"), "Treatment")
    terms = table(spark, sf_dir, "vocab").select(F.col("term").alias("name"), grp.alias("grp"), F.col("mesh_id").alias("ref_id"))
    lines = table(spark, sf_dir, "cell_lines").select("name", F.lit("Tissue").alias("grp"), F.col("cvcl").alias("ref_id"))
    used = table(spark, sf_dir, "resolutions").select(F.upper(strip("output_id")).alias("used")).filter("used <> ''").groupBy("used").agg(F.count(F.lit(1)).alias("weight"))
    return terms.union(lines).join(used, F.upper("ref_id") == F.col("used"), "left").select("name", "grp", "ref_id", F.coalesce("weight", F.lit(0)).alias("weight"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(res_id, ref_id, distance) of every pending label; wording and abbreviations are those of the resolved ones."""
    rows, names = table(spark, sf_dir, "resolutions"), cut(reference(spark, sf_dir))
    given = strip(F.coalesce("output_id", F.lit("")))
    resolved = rows.filter(given != "").select(F.col("input_label").alias("label"), F.col("col").alias("grp"), given.alias("ref_id"))
    pending = rows.filter(given == "").select("res_id", "input_label", "col")
    return link_labels(pending, names, label="input_label", group="col", keep=["res_id"], wording=learn_wording(resolved, names))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_links(spark, sf_dir).select("res_id", "ref_id").distinct()


QUERIES = {"p3_found": p3_found, "p3_links": p3_links}
