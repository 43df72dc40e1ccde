"""Study-level plans: sibling distributions, consensus, aggregates, promotion, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions.labels import char_keys, sample_context
from sievework.functions.missing import NS, is_missing
from sievework.operators.dictionary import first_in_order
from sievework.operators.skew import hot_join
from sievework.runtime import cut
from sievework.sources.tables import table


def _present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row per (gsm, field) with a value: gse, gsm, field, v (lower case), raw."""
    rows = table(spark, sf_dir, "gsm_phase_results").select("pr_id", "gse", "gsm", "field", "p1_value", "updated_at")
    rows = first_in_order(rows, ["gsm", "field"], [F.desc_nulls_last("updated_at"), F.desc("pr_id")])
    return rows.filter(~is_missing(F.col("p1_value"), "cache")).select("gse", "gsm", "field", F.trim("p1_value").alias("raw"), F.lower(F.trim("p1_value")).alias("v"))


def sibling_distribution_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution of each sample's field over its siblings, itself left out: siblings with a value, those that share its own,
    how many values they have, and the commonest of these (ties by value) with its count.

    A study's distribution is kept once, by its two commonest values; each sample takes itself out of it. A study may hold a
    large part of the rows, so both joins spread hot keys."""
    rows = _present(spark, sf_dir).filter("gse is not null and field is not null")
    n = cut(rows.groupBy("gse", "field", "v").agg(F.count(F.lit(1)).alias("n")))
    first = F.min(F.struct((-F.col("n")).alias("m"), "v"))
    top = n.groupBy("gse", "field").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"), first.alias("top"))
    second = n.join(top.select("gse", "field", F.col("top.v").alias("tv")), ["gse", "field"]).filter("v <> tv").groupBy("gse", "field").agg(first.alias("next"))
    whole = cut(top.join(second, ["gse", "field"], "left"))
    total = n.agg(F.sum("n")).first()[0] or 0
    rows = hot_join(rows.select("gse", "gsm", "field", "v"), n.withColumn("own", F.col("n")), ["gse", "field", "v"], "n", total)
    rows = hot_join(rows, whole.withColumn("n", F.col("all")), ["gse", "field"], "n", total)
    left = F.array_sort(F.filter(F.array(F.struct((F.col("top.m") + F.when(F.col("v") == F.col("top.v"), 1).otherwise(0)).alias("m"), F.col("top.v").alias("v")), "next"), lambda x: x.isNotNull() & (x["m"] < 0)))
    # the own value, if it was second and the two were level, stays behind
    most = F.try_element_at(F.transform(left, lambda x: F.struct(F.when((x["v"] == F.col("v")) & (F.col("v") != F.col("top.v")), x["m"] + 1).otherwise(x["m"]).alias("m"), x["v"].alias("v"))), F.lit(1))
    return rows.select("gsm", "field", "v", (F.col("own") - 1).alias("siblings"), (F.col("all") - 1).alias("others"), (F.col("kinds") - F.when(F.col("own") == 1, 1).otherwise(0)).alias("kinds"), most["v"].alias("majority"), (-most["m"]).alias("majority_n"))


def sibling_top5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent values of a study's field as text, ties by value."""
    n = _present(spark, sf_dir).groupBy("gse", "field", "v").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("rn", F.row_number().over(Window.partitionBy("gse", "field").orderBy(F.desc("n"), "v"))).filter("rn <= 5")
    text = F.transform(F.array_sort(F.collect_list(F.struct("rn", "v", "n"))), lambda x: F.concat(x["v"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    return top.groupBy("gse", "field").agg(F.array_join(text, "; ").alias("summary"))


def study_field_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_total, n_ns and the number of values and of rows of the commonest value, values merged without regard to case under their commonest spelling."""
    rows = table(spark, sf_dir, "gsm_phase_results").select("gse", "field", F.trim("p1_value").alias("raw"), is_missing(F.col("p1_value"), "cache").alias("ns"))
    totals = rows.groupBy("gse", "field").agg(F.count(F.lit(1)).alias("n_total"), F.count_if("ns").alias("n_ns"))
    spelt = rows.filter("not ns").groupBy("gse", "field", F.lower("raw").alias("low"), "raw").agg(F.count(F.lit(1)).alias("n"))
    merged = spelt.groupBy("gse", "field", "low").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("c"), "raw"))["raw"].alias("raw"))
    top = merged.groupBy("gse", "field").agg(F.count(F.lit(1)).alias("n_values"), F.min(F.struct((-F.col("n")).alias("n"), "low", "raw")).alias("t"))
    return totals.join(top, ["gse", "field"], "left").select("gse", "field", "n_total", "n_ns", F.coalesce("n_values", F.lit(0)).alias("n_values"), F.col("t.raw").alias("top_value"), (-F.col("t.n")).alias("top_n"))


def consensus_verdict(spark: SparkSession, sf_dir: str, threshold: float = 0.8) -> DataFrame:
    """Verdicts on the samples' values against their siblings, by field and verdict: no_data for fewer than three siblings; a value
    that its own record doesn't hold while the threshold of siblings have none is demote_to_NS; a missing one while the threshold agree
    on a value is promote_to_majority; else keep. Shares are of all siblings, with and without a value."""
    rows = table(spark, sf_dir, "gsm_phase_results")
    rows = first_in_order(rows, ["gsm", "field"], [F.desc_nulls_last("updated_at"), F.desc("pr_id")]).select("gse", "gsm", "field", is_missing(F.col("p1_value"), "cache").alias("ns"), F.lower(F.trim("p1_value")).alias("v"))
    rows = cut(rows.filter("gse is not null and field is not null"))
    n = rows.groupBy("gse", "field", F.when(~F.col("ns"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    each = n.groupBy("gse", "field").agg(F.sum("n").alias("all"), F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_ns"), F.coalesce(F.max(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("most"))
    total = rows.count()
    texts = ["title", "source_name", "characteristics", "treatment_protocol", "description"]
    context = first_in_order(table(spark, sf_dir, "gsm_context").filter("gse is not null and gsm is not null"), ["gse", "gsm"], [F.desc_nulls_last("updated_at"), *[F.asc_nulls_first(c) for c in texts]])
    blob = F.lower(F.concat_ws(" | ", *[F.when(F.col(c) != "", F.col(c)) for c in texts]))
    rows = hot_join(rows, each.withColumn("n", F.col("all")), ["gse", "field"], "n", total).join(context.select("gse", "gsm", blob.alias("record")), ["gse", "gsm"], "left")
    grounded = F.coalesce(F.col("record").contains(F.col("v")), F.lit(False))
    enough = lambda c: F.col(c) >= threshold * F.col("all")
    verdict = F.when(F.col("all") < 3, "no_data").when(~F.col("ns") & enough("n_ns") & ~grounded, "demote_to_NS").when(F.col("ns") & enough("most"), "promote_to_majority").otherwise("keep")
    return rows.groupBy("field", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("samples"))


def unanimous_promotion(spark: SparkSession, sf_dir: str, min_studies: int = 3) -> DataFrame:
    """Raw values that have the same p2 form in at least ``min_studies`` studies and no other form anywhere."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter(~is_missing(F.col("p2_value"), "cache") & ~is_missing(F.col("p1c_value"), "cache"))
    per = rows.groupBy("field", F.lower(F.trim("p1c_value")).alias("raw")).agg(F.count_distinct(F.trim("p2_value")).alias("forms"), F.min(F.trim("p2_value")).alias("canon"), F.count_distinct("gse").alias("studies"), F.count(F.lit(1)).alias("uses"))
    return per.filter((F.col("forms") == 1) & (F.col("studies") >= min_studies)).drop("forms")


def study_canon_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (gse, field, raw) the latest canonical form and its number of uses."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter("p2_value is not null and p1c_value is not null").select("gse", "field", F.lower(F.trim("p1c_value")).alias("raw"), "p2_value", "updated_at", "pr_id")
    last = F.max_by("p2_value", F.struct(F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp_ntz")), "pr_id"))
    return rows.groupBy("gse", "field", "raw").agg(F.count(F.lit(1)).alias("n_uses"), last.alias("canon"))


def context_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest context row of each (gse, gsm) with its characteristic keys."""
    rows = table(spark, sf_dir, "gsm_context").filter("gsm is not null and gse is not null")
    order = [F.desc_nulls_last("updated_at"), *[F.asc_nulls_first(c) for c in ("characteristics", "title", "source_name", "treatment_protocol", "description")]]
    out = first_in_order(rows, ["gse", "gsm"], order)
    return out.select("gse", "gsm", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("source_name", F.lit("")).alias("source_name"))


def phase_value_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gse, gsm, field) with one column per phase, the latest value of each phase that isn't null."""
    rows = table(spark, sf_dir, "gsm_phase_results")
    stamp = F.struct(F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp_ntz")), "pr_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), stamp)).alias(c)
    out = rows.groupBy("gse", "gsm", "field").agg(*[last(c) for c in ("p1_value", "p1b_value", "p1c_value", "p2_value")])
    return out.select("gse", "gsm", "field", *[F.coalesce(c, F.lit(NS)).alias(c) for c in ("p1_value", "p1b_value", "p1c_value", "p2_value")])


def phase_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase rows by field with and without a context row of their sample."""
    has = table(spark, sf_dir, "gsm_context").select("gse", "gsm").distinct().withColumn("has", F.lit(True))
    return table(spark, sf_dir, "gsm_phase_results").join(has, ["gse", "gsm"], "left").groupBy("field").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("has").isNotNull()).alias("with_context"))


def characteristic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples use each characteristic key."""
    rows = table(spark, sf_dir, "gsm_context").select("gsm", F.explode(char_keys(F.col("characteristics"))).alias("k"))
    return rows.groupBy("k").agg(F.count_distinct("gsm").alias("samples"))


def sample_context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gsm_context").select("gse", "gsm", sample_context({"title": F.col("title"), "source": F.col("source_name"), "treatment": F.col("treatment_protocol")}).alias("context"))
    return rows.distinct()


def resume_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the context that no phase row has finished (p2 present), as the resume filter sees them."""
    done = table(spark, sf_dir, "gsm_phase_results").filter("p2_value is not null").select("gsm").distinct()
    return table(spark, sf_dir, "gsm_context").filter("gsm is not null").select("gse", "gsm").distinct().join(done, "gsm", "left_anti").select("gse", "gsm")


def proportional_allocation(spark: SparkSession, sf_dir: str, n: int = 100) -> DataFrame:
    """``n`` audit places per field allotted to values in proportion, the remainder to the commonest value."""
    d = _present(spark, sf_dir).groupBy("field", "v").agg(F.count(F.lit(1)).alias("c"))
    # one row for each value; a field's sums are joined back, so no task gathers a field's values
    one = d.groupBy("field").agg(F.sum("c").alias("all"), F.min(F.struct((-F.col("c")).alias("c"), "v"))["v"].alias("top"))
    d = cut(d.join(F.broadcast(one), "field").withColumn("share", F.floor(F.col("c") * n / F.col("all"))))
    given = d.groupBy("field").agg(F.sum("share").alias("given"))
    places = F.when(F.col("v") == F.col("top"), F.col("share") + n - F.col("given")).otherwise(F.col("share"))
    return d.join(F.broadcast(given), "field").withColumn("places", places).filter("places > 0").select("field", "v", "c", "places")


_LAST = "(select * from gsm_phase_results qualify row_number() over (partition by gsm, field order by updated_at desc nulls last, pr_id desc) = 1)"
_NS = "lower(trim(coalesce(p1_value, ''), ' ')) in ('', 'not specified', 'none', 'n/a', 'na')"
_P = f"(select gse, gsm, field, lower(trim(p1_value, ' ')) v from {_LAST} where not {_NS})"
QUERIES = {f.__name__: f for f in (
    sibling_distribution_loo, sibling_top5_text, study_field_aggregate, consensus_verdict, unanimous_promotion, study_canon_upsert, context_upsert, phase_value_upsert, phase_with_context, characteristic_keys, sample_context_text,
    resume_keep_last, proportional_allocation,
)}
ORACLES = {
    "sibling_distribution_loo": f"""with p as (select * from {_P} where gse is not null and field is not null), n as (select gse, field, v, count(*) n from p group by 1, 2, 3),
d as (select a.gse, a.field, a.v, o.v w, o.n - case when o.v = a.v then 1 else 0 end m from n a join n o on a.gse = o.gse and a.field = o.field),
l as (select gse, field, v, cast(sum(m) as bigint) others, count(*) filter (where m > 0) kinds, cast(coalesce(sum(m) filter (where w = v), 0) as bigint) siblings, first(w order by m desc, w) filter (where m > 0) majority, max(m) filter (where m > 0) majority_n from d group by 1, 2, 3)
select gsm, field, v, siblings, others, kinds, majority, majority_n from p join l using (gse, field, v)""",
    "sibling_top5_text": f"select gse, field, string_agg(v || ' (' || n || ')', '; ' order by n desc, v) summary from (select gse, field, v, count(*) n from {_P} group by 1, 2, 3 qualify row_number() over (partition by gse, field order by count(*) desc, v) <= 5) group by 1, 2",
    "study_field_aggregate": f"""with r as (select gse, field, trim(p1_value, ' ') raw, {_NS} ns from gsm_phase_results),
t as (select gse, field, count(*) n_total, count(*) filter (where ns) n_ns from r group by 1, 2),
s as (select gse, field, lower(raw) low, raw, count(*) n from r where not ns group by 1, 2, 3, 4),
m as (select gse, field, low, sum(n) n, first(raw order by n desc, raw) raw from s group by 1, 2, 3),
p as (select gse, field, count(*) n_values, first(raw order by n desc, low) top_value, max(n) top_n from m group by 1, 2)
select t.gse, t.field, n_total, n_ns, coalesce(n_values, 0) n_values, top_value, cast(top_n as bigint) top_n from t left join p on t.gse = p.gse and t.field = p.field""",
    "consensus_verdict": f"""with r as (select gse, gsm, field, {_NS} ns, lower(trim(p1_value, ' ')) v from {_LAST} where gse is not null and field is not null),
g as (select gse, field, count(*) n, count(*) filter (where ns) n_ns from r group by 1, 2), m as (select gse, field, max(c) most from (select gse, field, v, count(*) c from r where not ns group by 1, 2, 3) group by 1, 2),
c as (select gse, gsm, lower(concat_ws(' | ', nullif(title, ''), nullif(source_name, ''), nullif(characteristics, ''), nullif(treatment_protocol, ''), nullif(description, ''))) record from gsm_context where gse is not null and gsm is not null
 qualify row_number() over (partition by gse, gsm order by updated_at desc nulls last, title nulls first, source_name nulls first, characteristics nulls first, treatment_protocol nulls first, description nulls first) = 1)
select field, case when n < 3 then 'no_data' when not ns and n_ns / n >= 0.8 and not coalesce(contains(record, v), false) then 'demote_to_NS' when ns and coalesce(most, 0) / n >= 0.8 then 'promote_to_majority' else 'keep' end verdict, count(*) samples
from r join g using (gse, field) left join m using (gse, field) left join c using (gse, gsm) group by 1, 2""",
    "unanimous_promotion": "select field, lower(trim(p1c_value, ' ')) raw, min(trim(p2_value, ' ')) canon, count(distinct gse) studies, count(*) uses from gsm_phase_results where lower(trim(coalesce(p2_value, ''), ' ')) not in ('', 'not specified', 'none', 'n/a', 'na') and lower(trim(coalesce(p1c_value, ''), ' ')) not in ('', 'not specified', 'none', 'n/a', 'na') group by 1, 2 having count(distinct trim(p2_value, ' ')) = 1 and count(distinct gse) >= 3",
    "study_canon_upsert": "select gse, field, lower(trim(p1c_value, ' ')) raw, count(*) n_uses, first(p2_value order by coalesce(updated_at, timestamp '1900-01-01') desc, pr_id desc) canon from gsm_phase_results where p2_value is not null and p1c_value is not null group by 1, 2, 3",
    "context_upsert": "select gse, gsm, coalesce(title, '') title, coalesce(source_name, '') source_name from gsm_context where gsm is not null and gse is not null qualify row_number() over (partition by gse, gsm order by updated_at desc nulls last, characteristics nulls first, title nulls first, source_name nulls first, treatment_protocol nulls first, description nulls first) = 1",
    "phase_value_upsert": "select gse, gsm, field, " + ", ".join(f"coalesce(first({c} order by coalesce(updated_at, timestamp '1900-01-01') desc, pr_id desc) filter (where {c} is not null), 'Not Specified') {c}" for c in ("p1_value", "p1b_value", "p1c_value", "p2_value")) + " from gsm_phase_results group by 1, 2, 3",
    "phase_with_context": "select field, count(*) n_rows, count(*) filter (where h) with_context from gsm_phase_results p left join (select distinct gse, gsm, true h from gsm_context) c on p.gse = c.gse and p.gsm = c.gsm group by 1",
    "characteristic_keys": "select k, count(distinct gsm) samples from (select gsm, unnest(list_distinct(list_filter(list_transform(list_filter(string_split(replace(characteristics, '|', ';'), ';'), lambda s: contains(s, ':')), lambda s: lower(trim(split_part(s, ':', 1), ' '))), lambda k: k <> ''))) k from gsm_context) group by 1",
    "sample_context_text": "select distinct gse, gsm, substr(concat_ws(' | ', case when trim(title, ' ') <> '' then 'title: ' || trim(title, ' ') end, case when trim(source_name, ' ') <> '' then 'source: ' || trim(source_name, ' ') end, case when trim(treatment_protocol, ' ') <> '' then 'treatment: ' || trim(treatment_protocol, ' ') end), 1, 700) context from gsm_context",
    "resume_keep_last": "select distinct gse, gsm from gsm_context where gsm is not null and not exists (select 1 from gsm_phase_results p where p.gsm = gsm_context.gsm and p2_value is not null)",
    "proportional_allocation": f"""with d as (select field, v, count(*) c from {_P} group by 1, 2), s as (select *, floor(c * 100 / sum(c) over (partition by field)) share, row_number() over (partition by field order by c desc, v) rn from d)
select field, v, c, cast(places as bigint) places from (select *, case when rn = 1 then share + 100 - sum(share) over (partition by field) else share end places from s) where places > 0""",
}
