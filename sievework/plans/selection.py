"""Selection, joins and assembly over the star schema and the corpus tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions.guards import dedup_cell
from sievework.functions.missing import NS, is_missing
from sievework.operators.dictionary import assert_one_answer, first_in_order
from sievework.runtime import broadcast_if_small
from sievework.sources.tables import table


def catalogue_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a list of accounts or of a list of nations, of a region found by text: semi joins, a list broadcast if it is small."""
    c = table(spark, sf_dir, "customer")
    keys = broadcast_if_small(table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct())
    nations = F.broadcast(table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")))
    either = c.join(keys, "c_custkey", "left_semi").unionByName(c.join(nations, "c_nationkey", "left_semi")).distinct()
    return either.select("c_custkey", "c_name", "c_nationkey")


def platform_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name has a word and whose type doesn't exclude it, ten by line items, with their counts."""
    p = table(spark, sf_dir, "part").filter(F.lower("p_name").contains("ring") & F.lower("p_type").like("%e%"))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n_rows"))
    return p.join(n, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows")).orderBy(F.desc("n_rows"), "p_partkey").limit(10)


def catalogue_token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that hold all tokens of a query in name, brand and type together."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    hit = reduce(lambda a, b: a & b, [text.contains(t) for t in "red brand".split()])
    return table(spark, sf_dir, "part").filter(hit).select("p_partkey", "p_name", "p_brand", "p_type")


def accessions_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered references in descriptions and protocols, distinct and sorted per sample."""
    found = F.regexp_extract_all(F.concat_ws(" ", "title", "description", "treatment_protocol"), F.lit(r"\b\d+\b"), F.lit(0))
    rows = table(spark, sf_dir, "gsm_context").filter("gsm is not null").select("gsm", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("numbers"))
    return rows.filter("numbers <> ''").distinct()


def channel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, source and description of a sample as one text: distinct ones that aren't empty, in order."""
    parts = F.array_distinct(F.filter(F.array("title", "source_name", "description"), lambda x: F.trim(x) != ""))
    return table(spark, sf_dir, "gsm_context").filter("gsm is not null").select("gsm", F.array_join(parts, " | ").alias("text")).distinct()


def two_pass_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phase's value, else the second's, else the third's, by field and origin."""
    got = lambda c: ~is_missing(F.col(c), "driver")
    origin = F.when(got("p1_value"), "p1").when(got("p1b_value"), "p1b").when(got("p1c_value"), "p1c").otherwise("none")
    return table(spark, sf_dir, "gsm_phase_results").groupBy("field", origin.alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def stage_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which phases are populated, by share of rows, over all rows."""
    cols = ["p1_value", "p1b_value", "p1c_value", "p2_value"]
    one = table(spark, sf_dir, "gsm_phase_results").agg(*[F.round(F.avg(F.when(is_missing(F.col(c), "cache"), 0.0).otherwise(1.0)), 6).alias(c) for c in cols])
    return one.unpivot([], cols, "phase", "share")


def shard_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each of eight shards by CRC-32 of the label."""
    rows = table(spark, sf_dir, "resolutions").filter("input_label is not null")
    return rows.groupBy((F.crc32("input_label") % 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("input_label").alias("labels"))


def demographic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sex and age of each sample side by side, one row each, failing if a key comes twice."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter("gsm is not null")
    last = first_in_order(rows.filter("field in ('Sex', 'Age')"), ["gsm", "field"], [F.desc_nulls_last("updated_at"), F.desc("pr_id")])
    side = lambda f, n: assert_one_answer(last.filter(F.col("field") == f).select("gsm", F.coalesce("p1_value", F.lit(NS)).alias(n)), ["gsm"], n)
    return side("Sex", "sex").join(side("Age", "age"), "gsm", "full_outer").select("gsm", F.coalesce("sex", F.lit(NS)).alias("sex"), F.coalesce("age", F.lit(NS)).alias("age"))


def corpus_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders patched: a second corpus replaces whole rows, a third one only the priority of rows the second doesn't have; changes counted."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    b = o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("s"), F.lower("o_orderpriority").alias("p"), F.lit(True).alias("in_b"))
    a = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("PATCHED").alias("q"))
    out = o.join(b, "o_orderkey", "left").join(a, "o_orderkey", "left")
    whole = F.col("in_b").isNotNull()
    out = out.select(F.when(whole, F.col("s")).otherwise(F.col("o_orderstatus")).alias("status"), F.when(whole, F.col("p")).otherwise(F.coalesce("q", "o_orderpriority")).alias("priority"))
    return out.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"))


def dictionary_patch_unanimous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose non-blank answers agree, as patch for their pending rows: how many rows they would settle."""
    rows = table(spark, sf_dir, "resolutions").select("col", F.lower(F.trim("input_label")).alias("k"), F.upper(F.trim("output_id")).alias("id")).filter("k is not null")
    votes = rows.filter("id <> ''").groupBy("col", "k").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")
    return rows.filter("coalesce(id, '') = ''").groupBy("col", "k").agg(F.count(F.lit(1)).alias("pending")).join(votes, ["col", "k"])


def assemble_union_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the main languages' parts put together again, with the manifest's counts."""
    d = table(spark, sf_dir, "documents").withColumn("code", F.lower(F.substring(F.coalesce("lang", F.lit("none")), 1, 2)))
    parts = [d.filter(F.col("code") == c) for c in ("en", "fr", "de")] + [d.filter(~F.col("code").isin("en", "fr", "de"))]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("code").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.expr("text is null or trim(text) = ''")).alias("blank"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"))


def cell_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and id lists of the flagged screen without repeated pairs."""
    rows = table(spark, sf_dir, "sex_vs_condition_flagged").filter("final_condition is not null and final_condition_id is not null").select("final_condition", "final_condition_id").distinct()
    return rows.select("final_condition", "final_condition_id", dedup_cell(F.col("final_condition"), F.col("final_condition_id")).alias("d")).select("final_condition", "final_condition_id", F.col("d.labels").alias("labels"), F.col("d.ids").alias("ids"))


def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in the context, the phases and the screen: in how many of the three each is."""
    s = lambda t, n: table(spark, sf_dir, t).filter("gsm is not null").select("gsm").distinct().withColumn(n, F.lit(1))
    out = s("gsm_context", "c").join(s("gsm_phase_results", "p"), "gsm", "full_outer").join(s("sex_vs_condition_flagged", "f"), "gsm", "full_outer").fillna(0)
    return out.groupBy("c", "p", "f").agg(F.count(F.lit(1)).alias("samples"))


_DRV = "('', 'not specified', 'n/a', 'na', 'none', 'null', 'unknown')"
_LASTSA = "(select * from gsm_phase_results where gsm is not null and field = '{0}' qualify row_number() over (partition by gsm order by updated_at desc nulls last, pr_id desc) = 1)"
QUERIES = {f.__name__: f for f in (
    catalogue_selection, platform_search, catalogue_token_search, accessions_in_text, channel_merge, two_pass_input, stage_detection, shard_by_hash, demographic_merge, corpus_patch, dictionary_patch_unanimous, assemble_union_manifest,
    cell_dedup, set_differences,
)}
ORACLES = {
    "catalogue_selection": "select c_custkey, c_name, c_nationkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000) or c_nationkey in (select n_nationkey from nation where n_regionkey = 1)",
    "platform_search": "select p_partkey, p_name, coalesce(n_rows, 0) n_rows from part left join (select l_partkey, count(*) n_rows from lineitem group by 1) on l_partkey = p_partkey where contains(lower(p_name), 'ring') and lower(p_type) like '%e%' order by n_rows desc, p_partkey limit 10",
    "catalogue_token_search": "select p_partkey, p_name, p_brand, p_type from part where contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'red') and contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand')",
    "accessions_in_text": r"select distinct gsm, array_to_string(list_sort(list_distinct(regexp_extract_all(concat_ws(' ', title, description, treatment_protocol), '\b\d+\b'))), ',') numbers from gsm_context where gsm is not null and regexp_matches(concat_ws(' ', title, description, treatment_protocol), '\b\d+\b')",
    "channel_merge": "select distinct gsm, concat_ws(' | ', case when trim(title, ' ') <> '' then title end, case when trim(source_name, ' ') <> '' and source_name is distinct from title then source_name end, case when trim(description, ' ') <> '' and description is distinct from title and description is distinct from source_name then description end) as text from gsm_context where gsm is not null",
    "two_pass_input": "select field, case when " + " when ".join(f"lower(trim(coalesce({c}, ''), ' ')) not in {_DRV} then '{n}'" for c, n in (("p1_value", "p1"), ("p1b_value", "p1b"), ("p1c_value", "p1c"))) + " else 'none' end origin, count(*) n from gsm_phase_results group by 1, 2",
    "stage_detection": " union all ".join(f"select '{c}' phase, round(avg(case when lower(trim(coalesce({c}, ''), ' ')) in ('', 'not specified', 'none', 'n/a', 'na') then 0.0 else 1.0 end), 6) share from gsm_phase_results" for c in ("p1_value", "p1b_value", "p1c_value", "p2_value")),
    "demographic_merge": f"select coalesce(s.gsm, a.gsm) gsm, case when s.gsm is null then 'Not Specified' else coalesce(s.p1_value, 'Not Specified') end sex, case when a.gsm is null then 'Not Specified' else coalesce(a.p1_value, 'Not Specified') end age from {_LASTSA.format('Sex')} s full outer join {_LASTSA.format('Age')} a on s.gsm = a.gsm",
    "corpus_patch": "select case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end status, case when o_orderkey % 5 = 0 then lower(o_orderpriority) when o_orderkey % 3 = 0 then 'PATCHED' else o_orderpriority end priority, count(*) n from orders group by 1, 2",
    "dictionary_patch_unanimous": "with r as (select col, lower(trim(input_label, ' ')) k, upper(trim(output_id, ' ')) id from resolutions where input_label is not null), v as (select col, k, min(id) id from r where id <> '' group by 1, 2 having count(distinct id) = 1) select p.col, p.k, pending, v.id from (select col, k, count(*) pending from r where coalesce(id, '') = '' group by 1, 2) p join v on p.col = v.col and p.k = v.k",
    "assemble_union_manifest": "select lower(substr(coalesce(lang, 'none'), 1, 2)) code, count(*) documents, count(*) filter (where text is null or trim(text, ' ') = '') blank, cast(sum(n_chars) as bigint) chars, count(distinct source) sources from documents group by 1",
    "set_differences": "with c as (select distinct gsm, 1 c from gsm_context where gsm is not null), p as (select distinct gsm, 1 p from gsm_phase_results where gsm is not null), f as (select distinct gsm, 1 f from sex_vs_condition_flagged where gsm is not null), a as (select gsm from c union select gsm from p union select gsm from f) select coalesce(c, 0) c, coalesce(p, 0) p, coalesce(f, 0) f, count(*) samples from a left join c using (gsm) left join p using (gsm) left join f using (gsm) group by 1, 2, 3",
}
