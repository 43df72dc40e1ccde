"""Audits of the corpus: verdict measures, study and concept averages, screens, grounding, composition, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions.guards import age_class, age_parts, bare_control, control_condition, fast_age, fast_sex, generic_tissue, normalize_sex, pure_qualifier, recover_disease, sex_grounded, verbatim
from sievework.functions.labels import canonicalize, extract_dose, fold_key, id_parts, kv_pairs, line_safe, safe_name, spans, strip_dose, treatment_spans
from sievework.functions.missing import SETS, is_missing, is_present
from sievework.functions.text import plain_space, strip
from sievework.operators.metrics import cluster_bootstrap, prf, wilson
from sievework.sources.tables import table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first extraction (p1) of each sample's field against the final one (p2) as gold: gse, field, v, verdict."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter("field in ('Tissue', 'Condition', 'Treatment')")
    a, g = F.lower(F.trim("p1_value")), F.lower(F.trim("p1b_value"))
    na, ng = is_missing(F.col("p1_value"), "fold"), is_missing(F.col("p1b_value"), "fold")
    verdict = F.when(na & ng, "TN").when(na, "FN").when(ng, "FP").when(a == g, "TP").otherwise("SUB")
    return rows.select("gse", "gsm", "field", a.alias("v"), g.alias("gold"), verdict.alias("verdict"))


def verdict_prf_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and accuracy by field; a wrong value counts as a false alarm and a miss."""
    c = lambda *v: F.count_if(F.col("verdict").isin(*v))
    rows = _scored(spark, sf_dir).groupBy("field").agg(c("TP").alias("tp"), c("FP", "SUB").alias("fp"), c("FN", "SUB").alias("fn"), c("TN").alias("tn"), c("SUB").alias("substituted"))
    return rows.select("*", *prf(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]))


def wilson_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilson intervals of the agreement by field."""
    rows = _scored(spark, sf_dir).groupBy("field").agg(F.count_if(F.col("verdict").isin("TP", "TN")).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return rows.select("field", "k", "n", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


def study_level_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro and macro agreement by field with the studies' sizes: median (upper), largest, share of the ten largest, perfect studies."""
    per = _scored(spark, sf_dir).groupBy("field", "gse").agg(F.count_if(F.col("verdict").isin("TP", "TN")).alias("ok"), F.count(F.lit(1)).alias("n"))
    # sizes are counted, so a field's studies never meet in one task: the upper median and the ten largest come from the counts
    sizes = per.groupBy("field", "n").agg(F.count(F.lit(1)).alias("c"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "c")))
    before = F.aggregate("sizes", F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x["c"]))
    known = sizes.groupBy("field").agg(order.alias("sizes"), F.sum("c").alias("studies")).withColumn("before", before)
    middle = F.floor(F.col("studies") / 2)
    at = F.filter("sizes", lambda x, i: (F.get(F.col("before"), i) <= middle) & (middle < F.get(F.col("before"), i + 1)))[0]["m"]
    ten = F.aggregate(F.transform("sizes", lambda x, i: -x["m"] * F.greatest(F.least(x["c"], F.lit(10) - F.get(F.col("before"), i)), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    sums = per.groupBy("field").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n"), F.round(F.avg(F.col("ok") / F.col("n")), 6).alias("macro"), F.max("n").alias("largest_n"), F.count_if(F.col("ok") == F.col("n")).alias("perfect"))
    out = sums.join(known, "field")
    return out.select("field", "studies", F.round(F.col("ok") / F.col("n"), 6).alias("micro"), "macro", (-at).alias("median_n"), "largest_n", F.round(ten / F.col("n"), 6).alias("top10_share"), "perfect")


def concept_level_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro agreement over gold values by field, for rare (at most 2), middling and common (over 8) ones."""
    per = _scored(spark, sf_dir).filter("verdict <> 'TN' and verdict <> 'FP'").groupBy("field", "gold").agg(F.count_if(F.col("verdict") == "TP").alias("ok"), F.count(F.lit(1)).alias("n"))
    cls = F.when(F.col("n") <= 2, "rare").when(F.col("n") > 8, "common").otherwise("middling")
    return per.groupBy("field", cls.alias("class")).agg(F.count(F.lit(1)).alias("concepts"), F.round(F.avg(F.col("ok") / F.col("n")), 6).alias("macro"))


def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2.5 and 97.5 percentiles of the tissue agreement over 10,000 draws of studies, with the point estimate."""
    per = _scored(spark, sf_dir).filter("field = 'Tissue'").groupBy(F.col("gse").alias("cluster")).agg(F.count_if(F.col("verdict").isin("TP", "TN")).alias("ok"), F.count(F.lit(1)).alias("n"))
    rates = cluster_bootstrap(per, draws=10_000)
    ends = rates.agg(F.percentile("rate", 0.025).alias("low"), F.percentile("rate", 0.975).alias("high"))
    return per.agg((F.sum("ok") / F.sum("n")).alias("rate")).crossJoin(ends)


def error_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by field: substitutions, false alarms, misses, with their shares."""
    rows = _scored(spark, sf_dir).filter("verdict in ('SUB', 'FP', 'FN')").groupBy("field", "verdict").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("field")), 6))


def context_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values missing after the first phase, and how many of them the second one has, by field."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter(is_missing(F.col("p1_value"), "context"))
    out = rows.groupBy("field").agg(F.count(F.lit(1)).alias("missing"), F.count_if(~is_missing(F.col("p1b_value"), "context")).alias("recovered"))
    return out.withColumn("rate", F.round(F.col("recovered") / F.col("missing"), 6))


def missing_value_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of p1b_value that each of the nine vocabularies calls missing."""
    rows = table(spark, sf_dir, "gsm_phase_results").select("p1b_value")
    one = rows.agg(*[F.count_if(is_missing(F.col("p1b_value"), n)).alias(n) for n in SETS])
    return one.unpivot([], list(SETS), "vocabulary", "n")


def populated_rate_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows with a value, by column of the context, one pass."""
    cols = ["title", "source_name", "characteristics", "treatment_protocol", "description"]
    one = table(spark, sf_dir, "gsm_context").agg(*[F.round(F.avg(F.when(is_present(F.col(c)), 1.0).otherwise(0.0)), 6).alias(c) for c in cols])
    return one.unpivot([], cols, "col", "rate")


def judge_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged values by field: share inappropriate by values and by instances, with bounds that count undecided ones either way, and the Wilson interval by values."""
    v = F.lower(strip("verdict"))
    rows = table(spark, sf_dir, "t5_shard1_judge").select("item", "field", "raw_value", "instances", v.alias("v")).distinct().filter("field is not null")
    bad, open_ = F.col("v") == "inappropriate", F.coalesce(F.col("v"), F.lit("indeterminate")) == "indeterminate"
    i = F.coalesce("instances", F.lit(0))
    out = rows.groupBy("field").agg(F.count_if(bad).alias("bad"), F.count_if(~open_).alias("decided"), F.sum(F.when(bad, i).otherwise(0)).alias("bad_i"), F.sum(F.when(bad | open_, i).otherwise(0)).alias("bad_or_open_i"), F.sum(i).alias("all_i"))
    lo, hi = wilson(F.col("bad"), F.col("decided"))
    return out.select("field", "bad", "decided", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"), F.round(F.try_divide("bad_i", "all_i"), 6).alias("lower_bound"), F.round(F.try_divide("bad_or_open_i", "all_i"), 6).alias("upper_bound"))


def multi_label_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the screen by sex: labels, labels that have an id, samples whose labels all have one."""
    rows = table(spark, sf_dir, "sex_vs_condition_flagged").filter("gsm is not null").select("gsm", F.coalesce("final_sex", F.lit("")).alias("sex"), F.size(spans(F.col("final_condition"))).alias("labels"), F.size(id_parts(F.regexp_replace("final_condition_id", r"[|/+&\s]+", ";"))).alias("ids")).distinct()
    return rows.groupBy("sex").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("labels").alias("labels"), F.sum(F.least("labels", "ids")).alias("with_id"), F.count_if(F.col("labels") == F.col("ids")).alias("complete"))


def integrity_screen_sex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sex against the donor sex of the sample's cell line: comparable samples and contradictions."""
    phases = table(spark, sf_dir, "gsm_phase_results")
    sex = phases.filter("field = 'Sex'").select("gsm", normalize_sex(F.col("p1b_value"))["value"].alias("sex")).filter("sex in ('Male', 'Female')").distinct()
    lines = table(spark, sf_dir, "cell_lines").filter("donor_sex in ('Male', 'Female') and name is not null").groupBy(fold_key(F.col("name")).alias("k")).agg(F.min("donor_sex").alias("donor"), F.count_distinct("donor_sex").alias("n")).filter("n = 1")
    tissue = phases.filter("field = 'Tissue'").select("gsm", fold_key(F.col("p1b_value")).alias("k")).distinct()
    return sex.join(tissue, "gsm").join(lines, "k").groupBy("donor").agg(F.count(F.lit(1)).alias("comparable"), F.count_if(F.col("sex") != F.col("donor")).alias("contradictions"))


def sex_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sex values with their normal form and the reason."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter("field = 'Sex'").groupBy(F.coalesce("p1_value", F.lit("")).alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("raw", "n", normalize_sex(F.col("raw")).alias("s")).select("raw", "n", "s.value", "s.reason")


def fast_sex_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sex and age as the characteristics key them, counted; a deferred one is empty."""
    rows = table(spark, sf_dir, "gsm_context").select(F.coalesce(fast_sex(F.col("characteristics")), F.lit("")).alias("sex"), F.coalesce(fast_age(F.col("characteristics")), F.lit("")).alias("age"), sex_grounded(F.col("characteristics")).alias("grounded"))
    return rows.groupBy("sex", "age", "grounded").agg(F.count(F.lit(1)).alias("n"))


def age_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gsm_phase_results").filter("field = 'Age'").groupBy(age_class(F.col("p1b_value")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def age_part_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gsm_phase_results").filter("field = 'Age'").select(F.coalesce("p1_value", F.lit("")).alias("raw")).distinct()
    return rows.select("raw", age_parts(F.col("raw")).alias("p")).select("raw", "p.display", "p.value", "p.unit", F.col("p.min").alias("min_age"), F.col("p.max").alias("max_age"), F.col("p.group").alias("age_group"))


def kv_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value pairs of the characteristics, counted."""
    rows = table(spark, sf_dir, "gsm_context").select("gsm", F.explode(kv_pairs(F.col("characteristics"))).alias("p"))
    return rows.groupBy(F.lower("p.k").alias("k"), F.lower("p.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def dose_extract_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatments with their amounts and times apart."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter("field = 'Treatment' and p1b_value is not null").select(F.trim("p1b_value").alias("raw")).distinct()
    return rows.select("raw", F.coalesce(strip_dose(F.col("raw")), F.lit("")).alias("drug"), extract_dose(F.col("raw")).alias("dose"))


def treatment_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gsm_phase_results").filter("field = 'Treatment'").select(F.explode(treatment_spans(F.col("p2_value"))).alias("v"))
    return rows.groupBy(F.lower("v").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def condition_control_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions whose labels are all control states, some of them, or none."""
    labels = spans(F.lower(F.col("p1b_value")))
    rows = table(spark, sf_dir, "gsm_phase_results").filter("field = 'Condition'").select(F.transform(labels, lambda s: control_condition(s).isNotNull()).alias("c")).filter(F.size("c") > 0)
    kind = F.when(F.forall("c", lambda x: x), "control").when(F.exists("c", lambda x: x), "mixed").otherwise("disease")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def qualifier_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct field values of all phases that only qualify, are bare controls, name a disease or a generic tissue."""
    rows = table(spark, sf_dir, "gsm_phase_results").select("field", F.trim("p1b_value").alias("v")).filter("v is not null and v <> ''").distinct()
    v = F.col("v")
    return rows.groupBy("field").agg(F.count_if(pure_qualifier(v)).alias("qualifiers"), F.count_if(bare_control(v)).alias("controls"), F.count_if(recover_disease(v).isNotNull()).alias("diseases"), F.count_if(generic_tissue(v) != v).alias("generic"), F.count(F.lit(1)).alias("n_values"))


def verbatim_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tissue values kept by their own sample's record, by outcome."""
    ctx = table(spark, sf_dir, "gsm_context").filter("gsm is not null").groupBy("gsm").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "title", "source_name", "characteristics"))), "\n").alias("record"))
    rows = table(spark, sf_dir, "gsm_phase_results").filter("field = 'Tissue'").select("pr_id", "gsm", F.col("p1b_value").alias("v")).join(ctx, "gsm")
    kept = verbatim(F.col("v"), F.col("record"))
    outcome = F.when(is_missing(F.col("v"), "extract"), "missing").when(kept == "Not Specified", "dropped").otherwise("kept")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def grounding_audit_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the tissue stands in the title and in the source, two by two."""
    ctx = table(spark, sf_dir, "gsm_context").filter("gsm is not null").groupBy("gsm").agg(F.min(F.lower("title")).alias("t"), F.min(F.lower("source_name")).alias("s"))
    rows = table(spark, sf_dir, "gsm_phase_results").filter("field = 'Tissue'").select("gsm", F.lower(F.trim("p1b_value")).alias("v")).filter("v <> ''").join(ctx, "gsm")
    has = lambda c: F.coalesce(F.col(c).contains(F.col("v")), F.lit(False))
    return rows.groupBy(has("t").alias("in_title"), has("s").alias("in_source")).agg(F.count(F.lit(1)).alias("n"))


def routing_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How answers came about (source) by field: rows, distinct labels, and of those with an exact vocabulary name; a label without a canonical form has none."""
    names = table(spark, sf_dir, "vocab").select(canonicalize(plain_space("term")).alias("canon")).filter("canon <> ''").distinct()
    return _routing(table(spark, sf_dir, "resolutions").withColumn("canon", canonicalize(plain_space("input_label"))), names)


def _routing(rows: DataFrame, names: DataFrame) -> DataFrame:
    rows, names = rows.select("col", "source", "input_label", "canon"), names.withColumn("hit", F.lit(True))
    out = rows.join(names, "canon", "left").groupBy("col", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("input_label").alias("labels"), F.count_distinct(F.when(F.col("hit"), F.col("input_label"))).alias("exact"))
    return out


def baseline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows resolved by an exact name against rows resolved at all, by field."""
    names = table(spark, sf_dir, "vocab").select(F.lower(F.trim("term")).alias("k")).union(table(spark, sf_dir, "cell_lines").select(F.lower(F.trim("name")))).distinct().withColumn("hit", F.lit(True))
    rows = table(spark, sf_dir, "resolutions").select("col", F.lower(F.trim("input_label")).alias("k"), "output_id").join(names, "k", "left")
    return rows.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit").isNotNull()).alias("exact"), F.count_if(F.trim("output_id") != "").alias("resolved"))


def topk_examples_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three examples of each verdict and field, by instances."""
    rows = table(spark, sf_dir, "t5_shard1_judge").select("field", F.lower(strip("verdict")).alias("v"), "item", "instances").distinct().filter("field is not null and v is not null and instances is not null")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("field", "v").orderBy(F.desc("instances"), "item"))).filter("rn <= 3").select("field", "v", "item", "instances", "rn")


def export_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for folders and lines, of every label whatever its characters."""
    rows = table(spark, sf_dir, "resolutions").filter("input_label is not null").select(F.col("input_label").alias("raw")).distinct()
    return rows.select("raw", safe_name(F.col("raw")).alias("safe"), line_safe(F.col("raw")).alias("line"))


_SC = """(select gse, gsm, field, lower(trim(p1_value, ' ')) v, lower(trim(p1b_value, ' ')) gold, case when na and ng then 'TN' when na then 'FN' when ng then 'FP' when lower(trim(p1_value, ' ')) = lower(trim(p1b_value, ' ')) then 'TP' else 'SUB' end verdict
from (select *, lower(trim(coalesce(p1_value, ''), ' ')) in (NSF) na, lower(trim(coalesce(p1b_value, ''), ' ')) in (NSF) ng from gsm_phase_results where field in ('Tissue', 'Condition', 'Treatment')))""".replace("NSF", ", ".join(f"'{x}'" for x in SETS["fold"]))
_IN = lambda n: ", ".join("'" + x + "'" for x in SETS[n])
_WLO = "round(greatest(0.0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6)"
_WHI = "round(least(1.0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6)"
_FOLDK = r"regexp_replace(lower(trim({0}, ' ')), '[\s\-_.]+', '', 'g')"
_U = lambda roots: rf"(^|[^a-z])({roots})\.?s?([^a-z]|$)"
_JV = r"lower(regexp_replace(verdict, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"
QUERIES = {f.__name__: f for f in (
    verdict_prf_by_field, wilson_by_field, study_level_macro, concept_level_macro, cluster_bootstrap_ci, error_partition, context_recovery, missing_value_census, populated_rate_preflight, judge_rates, multi_label_precision,
    integrity_screen_sex, sex_values, fast_sex_age, age_composition, age_part_columns, kv_characteristics, dose_extract_strip, treatment_span_counts, condition_control_split, qualifier_census, verbatim_guard, grounding_audit_2x2,
    routing_decomposition, baseline_coverage, topk_examples_per_class, export_safe_names,
)}
from sievework.plans.dictionary import canon_sql  # noqa: E402

ORACLES = {
    "verdict_prf_by_field": f"""with c as (select field, count(*) filter (where verdict = 'TP') tp, count(*) filter (where verdict in ('FP', 'SUB')) fp, count(*) filter (where verdict in ('FN', 'SUB')) fn, count(*) filter (where verdict = 'TN') tn, count(*) filter (where verdict = 'SUB') substituted from {_SC} group by 1),
p as (select *, tp / (tp + fp) pr, tp / (tp + fn) re from c) select field, tp, fp, fn, tn, substituted, round(pr, 4) "precision", round(re, 4) recall, round(2 * pr * re / (pr + re), 4) f1, round((tp + tn) / (tp + fp + fn + tn), 4) accuracy from p""",
    "wilson_by_field": f"select field, k, n, {_WLO} low, {_WHI} high from (select field, count(*) filter (where verdict in ('TP', 'TN')) k, count(*) n from {_SC} group by 1)",
    "study_level_macro": f"""with p as (select field, gse, count(*) filter (where verdict in ('TP', 'TN')) ok, count(*) n from {_SC} group by 1, 2), r as (select *, row_number() over (partition by field order by n desc, gse) rn, count(*) over (partition by field) studies from p)
select field, max(studies) studies, round(sum(ok) / sum(n), 6) micro, round(avg(ok / n), 6) macro, max(n) filter (where rn = studies // 2 + 1) median_n, max(n) largest_n, round(sum(n) filter (where rn <= 10) / sum(n), 6) top10_share, count(*) filter (where ok = n) perfect from r group by 1""",
    "concept_level_macro": f"select field, case when n <= 2 then 'rare' when n > 8 then 'common' else 'middling' end \"class\", count(*) concepts, round(avg(ok / n), 6) macro from (select field, gold, count(*) filter (where verdict = 'TP') ok, count(*) n from {_SC} where verdict not in ('TN', 'FP') group by 1, 2) group by 1, 2",
    "error_partition": f"select field, verdict, count(*) n, round(count(*) / sum(count(*)) over (partition by field), 6) share from {_SC} where verdict in ('SUB', 'FP', 'FN') group by 1, 2",
    "context_recovery": f"select field, count(*) missing, count(*) filter (where lower(trim(coalesce(p1b_value, ''), ' ')) not in ({_IN('context')})) recovered, round(count(*) filter (where lower(trim(coalesce(p1b_value, ''), ' ')) not in ({_IN('context')})) / count(*), 6) rate from gsm_phase_results where lower(trim(coalesce(p1_value, ''), ' ')) in ({_IN('context')}) group by 1",
    "missing_value_census": " union all ".join(f"select '{n}' vocabulary, count(*) filter (where lower(trim(coalesce(p1b_value, ''), ' ')) in ({_IN(n)})) n from gsm_phase_results" for n in SETS),
    "populated_rate_preflight": " union all ".join(f"select '{c}' col, round(avg(case when lower(trim(coalesce({c}, ''), ' ')) not in ({_IN('final')}) then 1.0 else 0.0 end), 6) rate from gsm_context" for c in ("title", "source_name", "characteristics", "treatment_protocol", "description")),
    "judge_rates": f"""with r as (select distinct item, field, raw_value, instances, {_JV} v from t5_shard1_judge where field is not null),
c as (select field, count(*) filter (where v = 'inappropriate') k, count(*) filter (where coalesce(v, 'indeterminate') <> 'indeterminate') n, sum(coalesce(instances, 0)) filter (where v = 'inappropriate') b, sum(coalesce(instances, 0)) filter (where coalesce(v, 'indeterminate') in ('inappropriate', 'indeterminate')) o, sum(coalesce(instances, 0)) a from r group by 1)
select field, k bad, n decided, {_WLO} low, {_WHI} high, round(b / a, 6) lower_bound, round(o / a, 6) upper_bound from c""",
    "multi_label_precision": r"""with r as (select distinct gsm, coalesce(final_sex, '') sex, len(list_filter(list_transform(string_split(coalesce(final_condition, ''), ';'), lambda s: trim(s, ' ')), lambda s: s <> '' and s <> 'Not Specified')) labels,
 len(list_filter(list_transform(string_split(replace(regexp_replace(coalesce(final_condition_id, ''), '[|/+&\s]+', ';', 'g'), ',', ';'), ';'), lambda s: trim(s, ' ')), lambda s: s <> '')) ids from sex_vs_condition_flagged where gsm is not null)
select sex, count(*) n_rows, cast(sum(labels) as bigint) labels, cast(sum(least(labels, ids)) as bigint) with_id, count(*) filter (where labels = ids) complete from r group by 1""",
    "age_composition": rf"""with v as (select lower(trim(regexp_replace(coalesce(p1b_value, ''), '(?i)^\s*age\s*:\s*', ''), ' ')) v from gsm_phase_results where field = 'Age'),
c as (select case when v in ({_IN('final')}) then 'not_specified' when not regexp_matches(v, '[0-9]') then 'descriptor'
 when regexp_matches(v, 'passage|\bp\d+\b|time\s*point|timepoint|\bcycle\b|batch|barcode|\bdpi\b|\bhpi\b|post[-\s]?(infection|treatment|transplant|surgery)|\bstage\b|\bgrade\b|\bscore\b|%|\bdose\b|\bgy\b|\bnm\b|\bum\b|\bmg\b|\bml\b')
  or regexp_matches(v, '{_U("hour|hr")}') or regexp_matches(v, '{_U("minute|min")}') then 'non_age'
 when cast(regexp_extract(v, '\d+(\.\d+)?') as double) * case when regexp_matches(v, '{_U("year|yr|y")}') then 1.0 when regexp_matches(v, '{_U("month|mo")}') then 1.0 / 12 when regexp_matches(v, '{_U("week|wk")}') then 1.0 / 52 when regexp_matches(v, '{_U("day")}') then 1.0 / 365 else 1.0 end > 120 then 'implausible'
 else 'chronological' end "class" from v)
select "class", count(*) n, round(count(*) / sum(count(*)) over (), 6) share from c group by 1""",
    "kv_characteristics": r"select lower(trim(split_part(s, ':', 1), ' ')) k, lower(trim(regexp_replace(s, '^[^:]*:', ''), ' ')) v, count(*) n from (select unnest(string_split(replace(replace(characteristics, chr(9), ';'), chr(10), ';'), ';')) s from gsm_context) where contains(s, ':') group by 1, 2",
    "treatment_span_counts": r"select lower(v) v, count(*) n from (select unnest(list_filter(list_transform(regexp_split_to_array(p2_value, ';\s*|\s+\+\s+'), lambda s: trim(s, ' ')), lambda s: s <> '' and s <> 'Not Specified')) v from gsm_phase_results where field = 'Treatment') group by 1",
    "grounding_audit_2x2": "with c as (select gsm, min(lower(title)) t, min(lower(source_name)) s from gsm_context where gsm is not null group by 1) select coalesce(contains(t, v), false) in_title, coalesce(contains(s, v), false) in_source, count(*) n from (select gsm, lower(trim(p1b_value, ' ')) v from gsm_phase_results where field = 'Tissue') join c using (gsm) where v <> '' group by 1, 2",
    "routing_decomposition": f"with v as (select distinct {canon_sql('term', whole=True)} canon from vocab), r as (select col, source, input_label, {canon_sql('input_label', whole=True)} canon from resolutions) select col, source, count(*) n_rows, count(distinct input_label) labels, count(distinct case when v.canon is not null then input_label end) exact from r left join v on r.canon = v.canon and v.canon <> '' group by 1, 2",
    "baseline_coverage": "with v as (select distinct lower(trim(term, ' ')) k from vocab union select lower(trim(name, ' ')) from cell_lines) select col, count(*) n, count(v.k) exact, count(*) filter (where trim(output_id, ' ') <> '') resolved from (select col, lower(trim(input_label, ' ')) k, output_id from resolutions) r left join v on r.k = v.k group by 1",
    "topk_examples_per_class": f"select field, v, item, instances, row_number() over (partition by field, v order by instances desc, item) rn from (select distinct field, {_JV} v, item, instances from t5_shard1_judge) where field is not null and v is not null and instances is not null qualify rn <= 3",
    "export_safe_names": r"select distinct input_label raw, regexp_replace(regexp_replace(input_label, '[^A-Za-z0-9_.-]', '_', 'g'), '^_+|_+$', '', 'g') safe, trim(regexp_replace(input_label, '[\r\n\t]+', ' ', 'g'), ' ') line from resolutions where input_label is not null",
    "sex_values": r"""with r as (select coalesce(p1_value, '') raw, count(*) n from gsm_phase_results where field = 'Sex' group by 1), s as (select *, lower(trim(regexp_replace(trim(raw, ' '), '^(?i)(sex|gender)\s*[:=]\s*', ''), ' ')) s, lower(trim(raw, ' ')) in ('', 'not specified') ns from r),
m as (select *, regexp_matches(s, '\bmale\b|\bman\b|\bm\b|♂') m, regexp_matches(s, '\bfemale\b|\bwoman\b|\bf\b|♀') f from s)
select raw, n, case when ns or s = '' or regexp_matches(s, '^\d+$') then 'Not Specified' when s in ('male', 'm', 'man', '♂') then 'Male' when s in ('female', 'f', 'woman', '♀') then 'Female' when s in ('mixed', 'pooled', 'pool', 'both') then 'Mixed' when s in ('unknown', 'na', 'n/a', 'none', '-', '?') then 'Not Specified' when m and f then 'Mixed' when m then 'Male' when f then 'Female' else 'Not Specified' end "value",
case when ns then 'ns_input' when s = '' then 'empty_after_prefix_strip' when regexp_matches(s, '^\d+$') then 'unresolved_coded_value' when s in ('male', 'm', 'man', '♂', 'female', 'f', 'woman', '♀', 'mixed', 'pooled', 'pool', 'both', 'unknown', 'na', 'n/a', 'none', '-', '?') then 'variant_normalised' when m and f then 'both_sexes_present' when m then 'male_token_present' when f then 'female_token_present' else 'no_sex_token' end reason from m""",
    "integrity_screen_sex": f"""with s as (select distinct gsm, case when lower(trim(p1b_value, ' ')) in ('male', 'm', 'man') then 'Male' when lower(trim(p1b_value, ' ')) in ('female', 'f', 'woman') then 'Female' when regexp_matches(lower(p1b_value), '\\bmale\\b|\\bman\\b|\\bm\\b') and regexp_matches(lower(p1b_value), '\\bfemale\\b|\\bwoman\\b|\\bf\\b') then 'Mixed' when regexp_matches(lower(p1b_value), '\\bmale\\b|\\bman\\b|\\bm\\b') then 'Male' when regexp_matches(lower(p1b_value), '\\bfemale\\b|\\bwoman\\b|\\bf\\b') then 'Female' end sex from gsm_phase_results where field = 'Sex'),
l as (select {_FOLDK.format("name")} k, min(donor_sex) donor from cell_lines where donor_sex in ('Male', 'Female') and name is not null group by 1 having count(distinct donor_sex) = 1), t as (select distinct gsm, {_FOLDK.format("p1b_value")} k from gsm_phase_results where field = 'Tissue')
select donor, count(*) comparable, count(*) filter (where sex <> donor) contradictions from s join t using (gsm) join l using (k) where sex in ('Male', 'Female') group by 1""",
}
