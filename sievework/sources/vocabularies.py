"""Readers of vocabulary files: descriptor and supplementary XML, cell-line flat files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.labels import ascii_form

_TERM = "struct<String: string>"
_CONCEPT = f"struct<TermList: struct<Term: array<{_TERM}>>>"
DESCRIPTOR = f"DescriptorUI string, DescriptorName struct<String: string>, TreeNumberList struct<TreeNumber: array<string>>, ConceptList struct<Concept: array<{_CONCEPT}>>"
SUPPLEMENTAL = f"SupplementalRecordUI string, SupplementalRecordName struct<String: string>, ConceptList struct<Concept: array<{_CONCEPT}>>"


def _terms(concepts: Column) -> Column:
    return F.array_distinct(F.filter(F.flatten(F.transform(concepts, lambda c: F.transform(c["TermList"]["Term"], lambda t: F.trim(t["String"])))), lambda s: s.isNotNull() & (s != "")))


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, terms, tree_numbers) of descriptor records; the XML source splits large files by record."""
    df = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(DESCRIPTOR).load(path)
    return df.select(F.trim("DescriptorUI").alias("id"), F.trim("DescriptorName.String").alias("name"), F.coalesce(_terms(F.col("ConceptList.Concept")), F.array().cast("array<string>")).alias("terms"), F.coalesce("TreeNumberList.TreeNumber", F.array().cast("array<string>")).alias("tree_numbers"))


def read_supplemental(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, terms) of supplementary records."""
    df = spark.read.format("xml").option("rowTag", "SupplementalRecord").schema(SUPPLEMENTAL).load(path)
    return df.select(F.trim("SupplementalRecordUI").alias("id"), F.trim("SupplementalRecordName.String").alias("name"), F.coalesce(_terms(F.col("ConceptList.Concept")), F.array().cast("array<string>")).alias("terms"))


def tree_tables(descriptors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mesh_tree (tree_number, mesh_id) and mesh_parent (parent_id, child_id), the latter by the numbers' prefixes."""
    tree = descriptors.select(F.explode("tree_numbers").alias("tree_number"), F.col("id").alias("mesh_id")).distinct()
    below = tree.filter("tree_number like '%.%'").select(F.regexp_extract("tree_number", r"^(.*)\.[^.]*\z", 1).alias("tree_number"), F.col("mesh_id").alias("child_id"))
    return tree, below.join(tree.withColumnRenamed("mesh_id", "parent_id"), "tree_number").select("parent_id", "child_id").distinct()


def flat_vocabulary(descriptors: DataFrame, supplemental: DataFrame | None = None, at_least: int = 0) -> DataFrame:
    """(term, term_norm, mesh_id, preferred, kind, category): every name of every record; the category is the first letter of the shallowest tree number, ``SCR`` where there is none. Fewer than ``at_least`` rows fail."""
    first = F.array_sort(F.transform("tree_numbers", lambda t: F.struct(F.size(F.split(t, r"\.")).alias("d"), t.alias("t"))))
    category = F.when(F.size("tree_numbers") > 0, F.substring(F.try_element_at(first, F.lit(1))["t"], 1, 1)).otherwise("SCR")
    d = descriptors.select("id", "name", "terms", category.alias("category"), F.lit("").alias("mark"))
    if supplemental is not None:
        d = d.unionByName(supplemental.select("id", "name", "terms", F.lit("SCR").alias("category"), F.lit("scr").alias("mark")))
    rows = d.select("id", "name", "category", "mark", F.explode(F.array_union(F.array("name"), "terms")).alias("term")).filter("term is not null")
    own = F.col("term") == F.col("name")
    kind = F.when(F.col("mark") == "scr", F.when(own, "scr").otherwise("scr_entry")).otherwise(F.when(own, "descriptor").otherwise("entry"))
    out = rows.select("term", ascii_form(F.col("term")).alias("term_norm"), F.col("id").alias("mesh_id"), F.col("name").alias("preferred"), kind.alias("kind"), "category").distinct()
    if at_least and (n := out.count()) < at_least:
        raise ValueError(f"a vocabulary of {n} rows; at least {at_least} are expected")
    return out


def read_cell_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, cvcl, primary_name, organism, donor_sex) of a tagged flat file with records ended by ``//``; synonyms give rows of their own, several species are joined by ``;``."""
    raw = spark.read.option("lineSep", "//\n").text(path)
    tag = lambda t: F.regexp_extract_all("value", F.lit(rf"(?m)^{t}   (.*?)\s*$"), F.lit(1))
    rows = raw.select(tag("ID").alias("id"), tag("AC").alias("ac"), F.flatten(F.transform(tag("SY"), lambda s: F.split(s, r";\s*"))).alias("sy"), tag("OX").alias("ox"), tag("SX").alias("sx")).filter(F.size("id") > 0)
    species = F.array_join(F.transform("ox", lambda o: F.trim(F.regexp_replace(o, r"^.*!\s*", ""))), ";")
    names = F.array_union(F.array(F.col("id")[0]), F.filter("sy", lambda s: s != ""))
    return rows.select(F.explode(names).alias("name"), F.try_element_at("ac", F.lit(1)).alias("cvcl"), F.col("id")[0].alias("primary_name"), species.alias("organism"), F.try_element_at("sx", F.lit(1)).alias("donor_sex"))
