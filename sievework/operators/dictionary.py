"""The value dictionary: distinct values decided once, joined back to every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.labels import canonicalize, fold_key, is_junk, mint_id, short_form
from sievework.operators.skew import hot_join


def value_spans(df: DataFrame, keep: list[str], fields: dict[str, Column]) -> DataFrame:
    """``keep`` columns, col, pos, raw: one row for each value of each field's cell (fields: name -> array of values)."""
    cells = F.array(*[F.struct(F.lit(n).alias("col"), c.alias("vals")) for n, c in fields.items()])
    rows = df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.col", F.posexplode("cell.vals").alias("pos", "raw"))
    return rows.filter("raw is not null and raw <> ''")


def build_dictionary(values: DataFrame) -> DataFrame:
    """(col, raw, n): distinct values with their instances, summed before they are shuffled."""
    return values.groupBy("col", "raw").agg(F.count(F.lit(1)).alias("n"))


def short_form_slots(values: DataFrame, context: str, order: str) -> DataFrame:
    """(col, raw, gse, n, text): short forms by study with the first context text in ``order``."""
    return values.filter(short_form(F.col("raw"))).groupBy("col", "raw", "gse").agg(F.count(F.lit(1)).alias("n"), F.min_by(context, order).alias("text"))


def stage(dictionary: DataFrame, exact: DataFrame) -> DataFrame:
    """``dictionary`` with canon, stage (junk, pending-short, exact, pending) and ref_id. exact: (col, canon, ref_id), one row per key."""
    d = dictionary.withColumn("canon", canonicalize(F.col("raw")))
    junk, short = is_junk(F.col("raw")), short_form(F.col("raw"))
    d = d.join(exact, ["col", "canon"], "left")
    name = F.when(junk, "junk").when(short, "pending-short").when(F.col("ref_id").isNotNull(), "exact").otherwise("pending")
    return d.withColumn("stage", name).withColumn("ref_id", F.when(F.col("stage") == "exact", F.col("ref_id")))


def mint(dictionary: DataFrame) -> DataFrame:
    """Pending values get a minted id and stage ``minted``."""
    pending = F.col("stage") == "pending"
    return dictionary.withColumn("ref_id", F.when(pending, mint_id(F.col("col"), F.col("raw"))).otherwise(F.col("ref_id"))).withColumn("stage", F.when(pending, "minted").otherwise(F.col("stage")))


def apply_dictionary(values: DataFrame, dictionary: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``values`` with ref_id: of the study's own meaning of a short form (overrides: col, raw, gse, ref_id), else of the dictionary; a miss keeps null.

    dictionary: (col, raw, n, ref_id) with the instances n of each value, which tell the values to be joined by broadcast.
    """
    total = values.count()
    out = hot_join(values, dictionary.select("col", "raw", "n", F.col("ref_id").alias("general")), ["col", "raw"], "n", total, how="left")
    if overrides is not None:
        out = out.join(overrides.select("col", "raw", "gse", F.col("ref_id").alias("own")), ["col", "raw", "gse"], "left")
        return out.withColumn("ref_id", F.coalesce("own", "general")).drop("own", "general")
    return out.withColumnRenamed("general", "ref_id")


def assert_one_answer(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df``, failing at run time if a key has several values."""
    bad = df.groupBy(*keys).agg(F.count_distinct(value).alias("_n"))
    checked = bad.select(*keys, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several answers for "), F.to_json(F.struct(*keys))))).otherwise(F.lit(True)).cast("boolean").alias("_ok"))
    return df.join(checked, keys).filter("_ok is null or _ok").drop("_ok")


def fold_canon(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """(col, k, ref_id, label): for each fold key the id and, apart from it, the label met most; ties to the smaller."""
    w = F.sum(weight if weight is not None else F.lit(1))
    keyed = df.withColumn("k", fold_key(F.col("label")))
    best = lambda c: keyed.groupBy("col", "k", c).agg(w.alias("n")).groupBy("col", "k").agg(F.min(F.struct((-F.col("n")).alias("n"), c))[c].alias(c))
    return best("ref_id").join(best("label"), ["col", "k"])


def first_in_order(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in ``order`` (keep-last with descending order)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
