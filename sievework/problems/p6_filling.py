"""Problem 6: gaps of gsm_phase_results.p1b_value and gse_field_aggregate.n_ns, value_dist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import blank_to_null, strip
from sievework.operators.imputation import fill_from_similar
from sievework.sources.tables import table

# What says that nothing is known, letters and digits only.
NOTHING = [
    "na", "nan", "none", "null", "nil", "unknown", "unkown", "unk", "notspecified", "unspecified", "notavailable", "unavailable", "notcollected", "missing", "notapplicable", "notreported", "unreported", "notprovided",
    "notdetermined", "undetermined", "nd", "ns", "notknown", "notgiven", "notstated", "notrecorded", "noinformation", "nodata", "nodataavailable", "unclear", "tbd", "blank", "empty", "novalue", "noinfo",
]


def known(col: str) -> Column:
    """The value in lower case without surrounding white space; null if it only says that nothing is known."""
    value = strip(F.lower(col))
    letters = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    return F.when((letters != "") & ~letters.isin(NOTHING), value)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gsm_phase_results").select("pr_id", "gse", "gsm", "field", known("p1b_value").alias("p1b"), known("p1_value").alias("p1"), known("p2_value").alias("p2"))


def _by_sample(rows: DataFrame) -> DataFrame:
    """Fills of p1b from rows of the same study, field and cluster (what the other phases said), or of the study and field."""
    return fill_from_similar(rows, id_col="pr_id", target="p1b", group=["gse", "field"], sample="gsm", categorical=["field", "p1", "p2"])


def _aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with n_ns and value_dist null where missing, and in ``told`` the counts of value_dist added up."""
    rows = table(spark, sf_dir, "gse_field_aggregate").select("agg_id", "gse", "field", "n_total", "n_ns", "value_dist")
    empty = F.col("value_dist").rlike(r"^\s*\{\s*\}\s*$") & ~F.coalesce(F.col("n_ns") == F.col("n_total"), F.lit(False))
    text = strip("value_dist")
    dist = F.when(~((text == "") | (F.lower(text) == "null") | empty), F.col("value_dist"))
    counts = F.map_values(F.from_json("dist", "map<string,bigint>"))
    told = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    ns = F.when((F.col("n_ns") >= 0) & (F.col("n_ns") <= F.col("n_total")), F.col("n_ns"))
    return rows.select("agg_id", "gse", "field", "n_total", ns.alias("ns"), dist.alias("dist")).withColumn("told", told)


def _by_study(rows: DataFrame) -> DataFrame:
    """Fills of ns (agg_id, value, exact, method): what the row's own counts leave of n_total, corrected by what similar rows
    show of the difference between the two, in the median."""
    rows = rows.withColumn("left", F.col("n_total") - F.col("told")).filter("left is not null")
    fills = fill_from_similar(rows.withColumn("off", F.col("ns") - F.col("left")), id_col="agg_id", target="off", group=["gse", "field"], numeric=["n_total", "left"], categorical=["field"], median=True)
    return rows.select("agg_id", "left").join(fills, "agg_id").select("agg_id", (F.col("left") + F.round("value").cast("long")).alias("value"), F.col("left").alias("exact"), "method")


def p6_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rec, fill, method, settled) of every gap that similar rows could fill. settled: an exact check of the stated case holds:
    at least 3 samples of the study and field have a value and 80 in 100 agree on this one; the counts and n_ns make up n_total;
    a row of the same study, field, n_total and n_ns has this text. Where the cluster's value fails the first check, the
    group's is taken (``group_mode``) if it passes."""
    v = _by_sample(_rows(spark, sf_dir))
    # whole numbers, so that a share of exactly 80 in 100 passes
    agreed = (F.col("group_samples") >= 3) & (F.col("group_agree") * 100 >= F.col("group_samples") * 80)
    same = F.col("value") == F.col("group_value")
    values = v.select(F.lit("p1b_value").alias("src"), F.col("pr_id").alias("rec"), F.when(agreed, F.col("group_value")).otherwise(F.col("value")).alias("fill"), F.when(agreed & ~same, "group_mode").otherwise(F.col("method")).alias("method"), agreed.alias("settled"))
    rows = _aggregates(spark, sf_dir)
    ns = _by_study(rows).select(F.lit("n_ns").alias("src"), F.col("agg_id").alias("rec"), F.col("value").cast("string").alias("fill"), "method", (F.col("value") == F.col("exact")).alias("settled"))
    dist = fill_from_similar(rows.filter("ns is not null"), id_col="agg_id", target="dist", group=["gse", "field", "n_total", "ns"], numeric=["n_total", "ns"], categorical=["gse", "field"])
    return values.union(ns).union(dist.select(F.lit("value_dist").alias("src"), F.col("agg_id").alias("rec"), F.col("value").alias("fill"), "method", F.lit(True).alias("settled")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_fills(spark, sf_dir).filter("settled").select("src", "rec", "fill").distinct()


def p6_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, method, hidden, right): a tenth of the known values, drawn by a hash of their rows' ids, is hidden and filled again by what is left."""
    held = lambda c: F.pmod(F.xxhash64(c), F.lit(10)) == 0
    rows = _rows(spark, sf_dir)
    fills = _by_sample(rows.withColumn("p1b", F.when(~held("pr_id"), F.col("p1b")))).select("pr_id", "value", "method")
    a = rows.filter(held("pr_id") & F.col("p1b").isNotNull()).join(fills, "pr_id", "left").select(F.lit("p1b_value").alias("src"), F.coalesce("method", F.lit("none")).alias("method"), (F.col("value") == F.col("p1b")).alias("ok"))
    aggs = _aggregates(spark, sf_dir)
    again = _by_study(aggs.withColumn("ns", F.when(~held("agg_id"), F.col("ns")))).select("agg_id", "value", "method")
    b = aggs.filter(held("agg_id") & F.col("ns").isNotNull() & F.col("told").isNotNull()).join(again, "agg_id", "left").select(F.lit("n_ns"), F.coalesce("method", F.lit("none")), F.col("value") == F.col("ns"))
    return a.union(b).groupBy("src", "method").agg(F.count(F.lit(1)).alias("hidden"), F.count_if("ok").alias("right"))


_NOTHING = ", ".join(f"'{x}'" for x in NOTHING)
_KNOWN = r"""case when regexp_replace(lower(X), '[^\p{L}\p{N}]', '', 'g') not in ('', NOTHING) then regexp_replace(lower(X), '^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g') end""".replace("NOTHING", _NOTHING)
ORACLES = {
    "p6_found": f"""
with v as (select pr_id, gse, field, gsm, {_KNOWN.replace("X", "p1b_value")} v from gsm_phase_results),
n as (select gse, field, count(distinct gsm) n from v where v is not null group by 1, 2),
m as (select gse, field, v, count(distinct gsm) m from v where v is not null group by 1, 2, 3),
s as (select gse, field, v from m join n using (gse, field) where n >= 3 and m * 100 >= n * 80 qualify row_number() over (partition by gse, field order by m desc, v) = 1),
a as (select agg_id, gse, field, n_total, case when n_ns between 0 and n_total then n_ns end ns,
  case when trim(value_dist) = '' or lower(trim(value_dist)) = 'null' or regexp_matches(value_dist, '^\\s*\\{{\\s*\\}}\\s*$') and n_ns is distinct from n_total then null else value_dist end dist from gse_field_aggregate),
b as (select *, list_sum(list_transform(json_keys(dist), lambda k: cast(json_extract_string(dist, '$."' || k || '"') as bigint))) told from a),
d as (select gse, field, n_total, ns, dist from b where ns is not null and dist is not null group by 1, 2, 3, 4, 5 qualify row_number() over (partition by gse, field, n_total, ns order by count(*) desc, dist) = 1)
select 'p1b_value' src, pr_id rec, s.v fill from v join s using (gse, field) where v.v is null
union all select 'n_ns', agg_id, cast(n_total - cast(coalesce(told, 0) as bigint) as varchar) from b where ns is null and dist is not null and n_total is not null
union all select 'value_dist', agg_id, d.dist from b join d using (gse, field, n_total, ns) where b.dist is null
""",
}
QUERIES = {"p6_found": p6_found, "p6_fills": p6_fills, "p6_accuracy": p6_accuracy}
