"""Corpus plans: vocabulary closure, lookups of minted concepts, health of the phases, provenance of ages, curation predicates, figures before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions.guards import pure_qualifier
from sievework.functions.missing import MISSING_FINAL, NS, NS_FOLD, is_missing
from sievework.operators.skew import hot_join
from sievework.plans.vocabulary import field_of
from sievework.runtime import cut
from sievework.sources.tables import table

PHASES = ["p1_value", "p1b_value", "p1c_value", "p2_value"]


def _low(col: str) -> Column:
    return F.lower(F.trim(col))


def vocabulary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(col, k, hit_id): names, without regard to case, that mean exactly one descriptor of the categories that the field admits."""
    v = table(spark, sf_dir, "vocab").select(field_of(F.col("category")).alias("col"), _low("term").alias("k"), "mesh_id").filter("col is not null and k <> ''")
    return v.groupBy("col", "k").agg(F.count_distinct("mesh_id").alias("ids"), F.min("mesh_id").alias("hit_id")).filter("ids = 1").drop("ids")


def vocabulary_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minted concepts whose emitted name the vocabulary holds after all: such a name takes the descriptor. A cell of several values, the
    sentinel and a mere qualifier take none. Rows by field and name."""
    name = F.coalesce(F.nullif(F.trim("output_name"), F.lit("")), F.trim("input_label"))
    rows = table(spark, sf_dir, "resolutions").filter(F.col("output_id").rlike("^(OOV|ART)")).select("col", "output_id", name.alias("name"))
    rows = rows.filter((F.col("name") != "") & ~F.col("name").contains(";") & (_low("name") != NS.lower()) & ~pure_qualifier(F.col("name")))
    each = rows.groupBy("col", "output_id", "name").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("k", _low("name"))
    return each.join(vocabulary_hits(spark, sf_dir), ["col", "k"]).select("col", "name", F.col("output_id").alias("minted_id"), "hit_id", "n_rows")


def minted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending labels by the minted concept that bears their name, else by one that a label of that name was given to; ties to the smaller id."""
    rows = table(spark, sf_dir, "resolutions")
    minted = rows.filter(F.col("output_id").rlike("^OOV"))
    by = lambda c, out: minted.select("col", _low(c).alias("k"), "output_id").filter("k <> ''").groupBy("col", "k").agg(F.min("output_id").alias(out))
    pending = rows.filter("coalesce(trim(output_id), '') = ''").select("col", _low("input_label").alias("k")).filter("k <> ''").groupBy("col", "k").agg(F.count(F.lit(1)).alias("n_rows"))
    out = pending.join(by("output_name", "own"), ["col", "k"], "left").join(by("input_label", "other"), ["col", "k"], "left")
    how = F.when(F.col("own").isNotNull(), "name").when(F.col("other").isNotNull(), "synonym").otherwise("none")
    return out.select("col", F.col("k").alias("label"), F.coalesce("own", "other", F.lit("")).alias("minted_id"), how.alias("found_by"), "n_rows")


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by field and class: resolved, minted, unmatched (left open by the vocabulary stage), FAILED (open for any other reason)."""
    ref = F.coalesce(F.trim("output_id"), F.lit(""))
    kind = F.when(ref.rlike("^(OOV|ART)"), "minted").when(ref != "", "resolved").when(F.col("source") == "llm-oov", "unmatched").otherwise("FAILED")
    return table(spark, sf_dir, "resolutions").groupBy("col", kind.alias("class")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("input_label").alias("labels"))


def phase_health(spark: SparkSession, sf_dir: str, most: float = 0.25) -> DataFrame:
    """Rows without any value by phase and field, and whether their share is within ``most``."""
    rows = table(spark, sf_dir, "gsm_phase_results").select("field", F.explode(F.array(*[F.struct(F.lit(c).alias("phase"), F.col(c).alias("v")) for c in PHASES])).alias("x"))
    out = rows.groupBy("field", "x.phase").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x.v").isNull()).alias("errors"))
    return out.withColumn("healthy", F.col("errors") <= F.col("n") * most)


def age_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with an age by the kind of characteristics key that may hold it: a donor's age, a developmental one, or none."""
    keys = F.transform(F.filter(F.split("characteristics", r"[;\t\n]"), lambda s: s.contains(":")), lambda s: F.trim(F.substring_index(s, ":", 1)))
    keys = F.filter(keys, lambda k: (k != "") & (F.length(k) < 60))
    donor, growth = r"(?i)(?<![a-z])age(?![a-z])|^age", r"(?i)gestation|postnatal|embryo|\bpnd\b|\bdpc\b|\bdpf\b|develop\w*\s*stage|dev\s*stage|fetus|larval|post[- ]?conception"
    has = lambda p: F.max(F.coalesce(F.exists(keys, lambda k: k.rlike(p)), F.lit(False)))
    known = table(spark, sf_dir, "gsm_context").filter("gsm is not null").groupBy("gsm").agg(has(donor).alias("donor"), has(growth).alias("growth"))
    age = F.lower(F.trim(F.regexp_replace(F.trim("p1b_value"), r"(?i)^\s*age\s*:\s*", "")))
    rows = table(spark, sf_dir, "gsm_phase_results").filter((F.col("field") == "Age") & ~F.coalesce(age, F.lit("")).isin(MISSING_FINAL)).select("gsm")
    kind = F.when(F.col("donor"), "donor age field").when(F.col("growth"), "developmental field").otherwise("no age field")
    return rows.join(known, "gsm", "left").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def curation_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by field: shaped like an identifier (a digit, or a single word), protected as a cell line's identity, with a target."""
    label = F.trim(F.coalesce(F.nullif(F.col("output_name"), F.lit("")), "input_label"))
    shaped = F.coalesce((label != "") & (label.rlike("[0-9]") | ~label.rlike(r"\s")), F.lit(False))
    cell = F.coalesce(F.col("output_id").startswith("CVCL"), F.lit(False)) & shaped
    target = F.coalesce((F.col("output_name") != "") & (F.col("output_name") != NS), F.lit(False))
    return table(spark, sf_dir, "resolutions").groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.count_if(shaped).alias("shaped"), F.count_if(cell).alias("cell_identities"), F.count_if(target).alias("with_target"))


def study_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study's canonical forms by field, the most used first, then the last used one, then by name: the first ten as text."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter("gse is not null and field is not null and trim(p2_value) <> ''").select("gse", "field", F.trim("p2_value").alias("canon"), "updated_at")
    uses = rows.groupBy("gse", "field", "canon").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("last"))
    # the limit is applied in each task before the shuffle as well, so no task gathers a study
    place = F.row_number().over(Window.partitionBy("gse", "field").orderBy(F.desc("n"), F.desc_nulls_last("last"), "canon"))
    top = uses.withColumn("place", place).filter("place <= 10").groupBy("gse", "field").agg(F.array_sort(F.collect_list(F.struct("place", "canon"))).alias("x"))
    return top.select("gse", "field", F.array_join(F.transform("x", lambda x: x["canon"]), " | ").alias("candidates"))


def aliased_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a sample's title, source and description that isn't empty, tabs as blanks, and its study: the first of a comma list, or one of its own."""
    first = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("title", "source_name", "description")], F.lit(""))
    study = F.nullif(F.trim(F.split_part("gse", F.lit(","), F.lit(1))), F.lit(""))
    rows = table(spark, sf_dir, "gsm_context").filter("gsm is not null")
    return rows.select("gsm", F.trim(F.translate(first, "\t", " ")).alias("value"), F.coalesce(study, F.concat(F.lit("__nogse_"), "gsm")).alias("study")).distinct()


def first_samples(spark: SparkSession, sf_dir: str, n: int = 100) -> DataFrame:
    """The catalogue's first ``n`` samples in their order, as a limited run takes them."""
    return table(spark, sf_dir, "gsm_context").filter("gsm is not null").select("gsm").distinct().orderBy("gsm").limit(n)


def largest_changes(spark: SparkSession, sf_dir: str, n: int = 15) -> DataFrame:
    """The labels whose answer changed between their first and their latest row, the ``n`` with most rows."""
    rows = table(spark, sf_dir, "resolutions").filter("input_label is not null")
    order, ref = F.struct("created_at", "res_id"), F.coalesce(F.trim("output_id"), F.lit(""))
    out = rows.groupBy("col", "input_label").agg(F.count(F.lit(1)).alias("n_rows"), F.min_by(ref, order).alias("before"), F.max_by(ref, order).alias("after"))
    return out.filter("before <> after").orderBy(F.desc("n_rows"), "col", "input_label").limit(n)


def short_form_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms of the sheet by field: how many have the audit's short-form shape (2 to 6 letters, digits and / + - . with two capitals)."""
    a = F.trim("acronym")
    shape = F.length(a).between(2, 6) & a.rlike(r"^[A-Za-z0-9/+\-.]+\z") & (F.length(F.regexp_replace(a, "[^A-Z]", "")) >= 2)
    return table(spark, sf_dir, "acronym_all").filter("acronym is not null").groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.count_if(shape).alias("short"), F.sum(F.when(shape, F.coalesce("samples", F.lit(0))).otherwise(0)).alias("samples"))


def study_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the keyed reads of a study find: its samples, those with a phase result, and the fields that have an aggregate."""
    count = lambda t, c, n: table(spark, sf_dir, t).filter(f"gse is not null and {c} is not null").groupBy("gse").agg(F.count_distinct(c).alias(n))
    out = count("gsm_context", "gsm", "samples").join(count("gsm_phase_results", "gsm", "with_results"), "gse", "full_outer").join(count("gse_field_aggregate", "field", "aggregates"), "gse", "full_outer")
    return out.fillna(0)


def agreement_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement with the final value before (first phase) and after the context phase, by field, and the difference."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter(~is_missing(F.col("p2_value"), "fold"))
    same = lambda c: F.avg(F.when(F.coalesce(_low(c) == _low("p2_value"), F.lit(False)), 1.0).otherwise(0.0))
    out = rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), same("p1_value").alias("b"), same("p1b_value").alias("a"))
    return out.select("field", "n", F.round("b", 6).alias("before"), F.round("a", 6).alias("after"), F.round(F.col("a") - F.col("b"), 6).alias("delta"))


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the parts of the context by study put together again are what the manifest counts: rows, samples and characters."""
    rows = table(spark, sf_dir, "gsm_context").select("gse", "gsm", F.length(F.concat_ws("", "title", "source_name", "characteristics")).alias("chars"))
    counts = [F.count(F.lit(1)).alias("n_rows"), F.count("gsm").alias("ids"), F.sum("chars").alias("chars")]
    parts = rows.groupBy("gse").agg(*counts).agg(*[F.sum(c).alias(f"{c}_parts") for c in ("n_rows", "ids", "chars")])
    both = rows.agg(*counts).withColumn("k", F.lit(1)).join(parts.withColumn("k", F.lit(1)), "k")
    return both.select("n_rows", "ids", "chars", ((F.col("n_rows") == F.col("n_rows_parts")) & (F.col("ids") == F.col("ids_parts")) & (F.col("chars") == F.col("chars_parts"))).alias("same"))


def own_distribution_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by field and by how much of their study shares their value: none but themselves, under half, half or more, all."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter("gse is not null and field is not null and gsm is not null").filter(~is_missing(F.col("p1b_value"), "fold")).select("gse", "gsm", "field", _low("p1b_value").alias("v")).distinct()
    rows = cut(rows)
    n = rows.groupBy("gse", "field", "v").agg(F.count(F.lit(1)).alias("own"))
    all_ = n.groupBy("gse", "field").agg(F.sum("own").alias("all"))
    total = rows.count()
    rows = hot_join(rows, n.withColumn("n", F.col("own")), ["gse", "field", "v"], "n", total)
    rows = hot_join(rows, all_.withColumn("n", F.col("all")), ["gse", "field"], "n", total)
    kind = F.when(F.col("own") == F.col("all"), "all").when(F.col("own") == 1, "alone").when(F.col("own") * 2 >= F.col("all"), "half").otherwise("few")
    return rows.groupBy("field", kind.alias("shared_by")).agg(F.count(F.lit(1)).alias("samples"))


_CAT = "case when category = 'A' then 'Tissue' when category in ('C', 'F') then 'Condition' when category in ('D', 'E') then 'Treatment' end"
_L = lambda c: f"lower(trim({c}, ' '))"
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
QUERIES = {f.__name__: f for f in (
    vocabulary_closure, minted_lookup, failure_classes, phase_health, age_provenance, curation_predicates, study_candidates, aliased_values, first_samples, largest_changes, short_form_audit, study_reads, agreement_deltas,
    manifest_check, own_distribution_share,
)}
ORACLES = {
    "vocabulary_closure": f"""with h as (select {_CAT} col, {_L('term')} k, min(mesh_id) hit_id from vocab where {_CAT} is not null and {_L('term')} <> '' group by 1, 2 having count(distinct mesh_id) = 1),
r as (select col, output_id, coalesce(nullif(trim(output_name, ' '), ''), trim(input_label, ' ')) "name" from resolutions where regexp_matches(output_id, '^(OOV|ART)'))
select r.col, "name", output_id minted_id, hit_id, count(*) n_rows from r join h on r.col = h.col and {_L('"name"')} = h.k where "name" <> '' and not contains("name", ';') and {_L('"name"')} <> 'not specified' group by 1, 2, 3, 4""",
    "minted_lookup": f"""with m as (select * from resolutions where regexp_matches(output_id, '^OOV')), a as (select col, {_L('output_name')} k, min(output_id) own from m where {_L('output_name')} <> '' group by 1, 2), b as (select col, {_L('input_label')} k, min(output_id) other from m where {_L('input_label')} <> '' group by 1, 2),
p as (select col, {_L('input_label')} k, count(*) n_rows from resolutions where coalesce(trim(output_id, ' '), '') = '' and {_L('input_label')} <> '' group by 1, 2)
select p.col, p.k label, coalesce(own, other, '') minted_id, case when own is not null then 'name' when other is not null then 'synonym' else 'none' end found_by, n_rows from p left join a on p.col = a.col and p.k = a.k left join b on p.col = b.col and p.k = b.k""",
    "failure_classes": "select col, case when regexp_matches(coalesce(trim(output_id, ' '), ''), '^(OOV|ART)') then 'minted' when coalesce(trim(output_id, ' '), '') <> '' then 'resolved' when source = 'llm-oov' then 'unmatched' else 'FAILED' end \"class\", count(*) n_rows, count(distinct input_label) labels from resolutions group by 1, 2",
    "phase_health": " union all ".join(f"select field, '{c}' phase, count(*) n, count(*) filter (where {c} is null) errors, count(*) filter (where {c} is null) <= count(*) * 0.25 healthy from gsm_phase_results group by 1" for c in PHASES),
    "age_provenance": rf"""with s as (select gsm, unnest(regexp_split_to_array(coalesce(characteristics, ''), '[;\t\n]')) s from gsm_context where gsm is not null), k as (select gsm, trim(split_part(s, ':', 1), ' ') k from s where contains(s, ':')), q as (select * from k where k <> '' and length(k) < 60),
c as (select gsm, bool_or(regexp_matches(k, '(?i)(^|[^a-z])age([^a-z]|$)|^age')) donor, bool_or(regexp_matches(k, '(?i)gestation|postnatal|embryo|\bpnd\b|\bdpc\b|\bdpf\b|develop\w*\s*stage|dev\s*stage|fetus|larval|post[- ]?conception')) growth from q group by 1),
a as (select gsm from gsm_phase_results where field = 'Age' and coalesce(lower(trim(regexp_replace(trim(p1b_value, ' '), '(?i)^\s*age\s*:\s*', ''), ' ')), '') not in ({_IN(MISSING_FINAL)}))
select case when donor then 'donor age field' when growth then 'developmental field' else 'no age field' end "class", count(*) n from a left join c using (gsm) group by 1""",
    "curation_predicates": r"""with r as (select *, trim(coalesce(nullif(output_name, ''), input_label), ' ') l from resolutions), s as (select *, coalesce(l <> '' and (regexp_matches(l, '[0-9]') or not regexp_matches(l, '[\s\v]')), false) shaped from r)
select col, count(*) n, count(*) filter (where shaped) shaped, count(*) filter (where shaped and starts_with(output_id, 'CVCL')) cell_identities, count(*) filter (where output_name <> '' and output_name <> 'Not Specified') with_target from s group by 1""",
    "study_candidates": "with u as (select gse, field, trim(p2_value, ' ') canon, count(*) n, max(updated_at) l from gsm_phase_results where gse is not null and field is not null and trim(p2_value, ' ') <> '' group by 1, 2, 3), r as (select *, row_number() over (partition by gse, field order by n desc, l desc nulls last, canon) p from u) select gse, field, string_agg(canon, ' | ' order by p) candidates from r where p <= 10 group by 1, 2",
    "aliased_values": "select distinct gsm, trim(translate(coalesce(nullif(title, ''), nullif(source_name, ''), nullif(description, ''), ''), chr(9), ' '), ' ') \"value\", coalesce(nullif(trim(split_part(gse, ',', 1), ' '), ''), '__nogse_' || gsm) study from gsm_context where gsm is not null",
    "first_samples": "select distinct gsm from gsm_context where gsm is not null order by gsm limit 100",
    "largest_changes": "with c as (select col, input_label, count(*) n_rows, first(coalesce(trim(output_id, ' '), '') order by created_at, res_id) \"before\", first(coalesce(trim(output_id, ' '), '') order by created_at desc, res_id desc) \"after\" from resolutions where input_label is not null group by 1, 2) select * from c where \"before\" <> \"after\" order by n_rows desc, col, input_label limit 15",
    "short_form_audit": r"""with a as (select col, samples, trim(acronym, ' ') a from acronym_all where acronym is not null), s as (select *, length(a) between 2 and 6 and regexp_matches(a, '^[A-Za-z0-9/+\-.]+$') and length(regexp_replace(a, '[^A-Z]', '', 'g')) >= 2 x from a)
select col, count(*) n, count(*) filter (where x) short, cast(sum(case when x then coalesce(samples, 0) else 0 end) as bigint) samples from s group by 1""",
    "study_reads": "with a as (select gse, count(distinct gsm) samples from gsm_context where gse is not null and gsm is not null group by 1), b as (select gse, count(distinct gsm) with_results from gsm_phase_results where gse is not null and gsm is not null group by 1), c as (select gse, count(distinct field) aggregates from gse_field_aggregate where gse is not null and field is not null group by 1) select gse, coalesce(samples, 0) samples, coalesce(with_results, 0) with_results, coalesce(aggregates, 0) aggregates from a full join b using (gse) full join c using (gse)",
    "agreement_deltas": f"""with r as (select field, case when {_L('p1_value')} = {_L('p2_value')} then 1.0 else 0.0 end b, case when {_L('p1b_value')} = {_L('p2_value')} then 1.0 else 0.0 end a from gsm_phase_results where lower(trim(coalesce(p2_value, ''), ' ')) not in ({_IN(NS_FOLD)}))
select field, count(*) n, round(avg(b), 6) "before", round(avg(a), 6) "after", round(avg(a) - avg(b), 6) delta from r group by 1""",
    "manifest_check": "select count(*) n_rows, count(gsm) ids, cast(sum(length(concat_ws('', title, source_name, characteristics))) as bigint) chars, true same from gsm_context",
    "own_distribution_share": f"""with r as (select distinct gse, gsm, field, {_L('p1b_value')} v from gsm_phase_results where gse is not null and field is not null and gsm is not null and lower(trim(coalesce(p1b_value, ''), ' ')) not in ({_IN(NS_FOLD)})),
s as (select field, count(*) over (partition by gse, field, v) own, count(*) over (partition by gse, field) a from r)
select field, case when own = a then 'all' when own = 1 then 'alone' when own * 2 >= a then 'half' else 'few' end shared_by, count(*) samples from s group by 1, 2""",
}
