"""Normalization tiers, cross-field rules, screens and tree walks over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.guards import age_years
from sievework.functions.labels import augmented_tokens, blocking_key, fold_key
from sievework.functions.missing import NS, is_missing
from sievework.functions.text import plain_space, strip
from sievework.operators.cascade import consolidate_greedy, context_policy, first_tier, lexical_pick, reconcile_sex, reroute
from sievework.operators.dictionary import first_in_order
from sievework.operators.vectors import components, similar_pairs
from sievework.plans.vocabulary import _tree, field_of
from sievework.problems.p1_hierarchy import links_and_nodes
from sievework.runtime import broadcast_if_small
from sievework.sources.tables import table


def resolution_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels through exact name, fold key, blocking key and cell-line tiers: labels by field and tier."""
    v = table(spark, sf_dir, "vocab").select(field_of(F.col("category")).alias("col"), "term", F.col("mesh_id").alias("ref_id")).filter("col is not null and term is not null")
    lines = table(spark, sf_dir, "cell_lines").filter("name is not null").select(F.lit("Tissue").alias("col"), F.col("name").alias("term"), F.col("cvcl").alias("ref_id"))
    labels = table(spark, sf_dir, "resolutions").filter("input_label is not null").select("col", F.col("input_label").alias("label")).distinct()
    fold = lambda c: fold_key(plain_space(c))
    out, keys = labels, {"exact": lambda c: F.lower(plain_space(c)), "fold": fold, "block": blocking_key, "line": fold}
    tiers = []
    for name, f in keys.items():
        out = out.withColumn(f"k_{name}", f(F.col("label")))
        src = lines if name == "line" else v
        tiers.append((name, src.groupBy("col", f(F.col("term")).alias(f"k_{name}")).agg(F.min("ref_id").alias("ref_id"), F.count_distinct("ref_id").alias("n")).filter(f"n = 1 and k_{name} <> ''").drop("n")))
    left, parts = out, []
    for name, t in tiers:
        got = first_tier(left, ["col", f"k_{name}"], [(name, t)])
        parts.append(got.filter("ref_id is not null").select("col", "label", "ref_id", "tier"))
        left = got.filter("ref_id is null").drop("ref_id", "tier")
    rest = left.select("col", "label", F.lit(None).cast("string").alias("ref_id"), F.lit("unresolved").alias("tier"))
    for p in parts:
        rest = rest.unionByName(p)
    return rest.groupBy("col", "tier").agg(F.count(F.lit(1)).alias("labels"), F.count_distinct("ref_id").alias("concepts"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample with its latest p1b value of each field."""
    rows = first_in_order(table(spark, sf_dir, "gsm_phase_results").filter("gsm is not null"), ["gsm", "field"], [F.desc_nulls_last("updated_at"), F.desc("pr_id")])
    return rows.groupBy("gsm").pivot("field", ["Sex", "Age", "Tissue", "Condition", "Treatment"]).agg(F.max(F.trim("p1b_value"))).fillna(NS)


def field_reroute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by what rerouting changed. A name is misplaced if it means a concept or line of another field only."""
    v = table(spark, sf_dir, "vocab").select(F.lower(F.trim("term")).alias("k"), field_of(F.col("category")).alias("f"))
    disease = v.groupBy("k").agg(F.max(F.col("f") == "Condition").alias("c"), F.max(F.col("f") == "Tissue").alias("t")).filter("c and not t").select("k", F.col("k").alias("disease_in_tissue"))
    line = table(spark, sf_dir, "cell_lines").filter("name is not null").select(F.lower(F.trim("name")).alias("k")).distinct()
    w = _wide(spark, sf_dir).select("gsm", F.col("Tissue").alias("tissue"), F.col("Condition").alias("condition"), F.col("Treatment").alias("treatment"))
    w = w.withColumns({"tissue0": F.col("tissue"), "condition0": F.col("condition"), "treatment0": F.col("treatment")})
    w = w.join(disease, F.lower("tissue") == F.col("k"), "left").drop("k")
    for c in ("condition", "treatment"):
        w = w.join(line.select(F.col("k"), F.col("k").alias(f"line_in_{c}")), F.lower(c) == F.col("k"), "left").drop("k")
    out = reroute(w)
    return out.groupBy(*[(~F.col(c).eqNullSafe(F.col(f"{c}0"))).alias(f"{c}_changed") for c in ("tissue", "condition", "treatment")]).agg(F.count(F.lit(1)).alias("samples"))


def context_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-phase values as the context policy lets them stand, by field and whose value it is."""
    ctx = table(spark, sf_dir, "gsm_context").filter("gsm is not null").groupBy("gsm").agg(F.min(F.concat_ws(" ", "title", "source_name", "characteristics")).alias("record"))
    rows = table(spark, sf_dir, "gsm_phase_results").filter("field in ('Tissue', 'Condition', 'Treatment')").join(ctx, "gsm")
    first, answer = F.coalesce("p1_value", F.lit(NS)), F.col("p1b_value")
    final = F.lit(None).cast("string")
    for f in ("Tissue", "Condition", "Treatment"):
        final = F.when(F.col("field") == f, context_policy(f, first, answer, F.col("record"))).otherwise(final)
    rows = rows.select("field", first.alias("first"), answer.alias("answer"), final.alias("final"))
    whose = F.when(F.col("final").eqNullSafe(F.col("answer")), "answer").when(F.col("final").eqNullSafe(F.col("first")), "first").otherwise("recovered")
    return rows.groupBy("field", whose.alias("whose")).agg(F.count(F.lit(1)).alias("n"))


def sex_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sexes before and after the cell line's donor overrules a contradiction."""
    lines = table(spark, sf_dir, "cell_lines").filter("donor_sex in ('Male', 'Female') and name is not null").groupBy(fold_key(F.col("name")).alias("k")).agg(F.min("donor_sex").alias("donor"), F.count_distinct("donor_sex").alias("n")).filter("n = 1").drop("n")
    w = _wide(spark, sf_dir).select(F.initcap("Sex").alias("sex"), fold_key(F.col("Tissue")).alias("k")).join(lines, "k", "left")
    no = F.lit(False)
    return w.groupBy("sex", reconcile_sex(F.col("sex"), no, no, F.coalesce("donor", F.lit(""))).alias("after")).agg(F.count(F.lit(1)).alias("samples"))


def age_screen(spark: SparkSession, sf_dir: str, under: float = 18.0) -> DataFrame:
    """Samples with a known age by condition branch (first letter of the name's category): comparable, and those under age."""
    cat = table(spark, sf_dir, "vocab").filter("category in ('C', 'F')").groupBy(F.lower(F.trim("term")).alias("k")).agg(F.min("category").alias("category"))
    w = _wide(spark, sf_dir).select(age_years(F.col("Age")).alias("years"), F.lower("Condition").alias("k")).filter("years is not null").join(cat, "k")
    return w.groupBy("category").agg(F.count(F.lit(1)).alias("comparable"), F.count_if(F.col("years") < under).alias("young"))


def branch_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of two sibling branches, those in both left out, and those of a third branch taken off (set differences over tree prefixes)."""
    t = _tree(spark, sf_dir)
    under = lambda p: t.filter((F.col("at") == p) | F.col("at").startswith(p + ".")).select("id").distinct()
    a, b, off = under("A02"), under("A06"), under("C11")
    a, b = a.subtract(off), b.subtract(off)
    both = a.intersect(b)
    return a.subtract(both).withColumn("branch", F.lit("A02")).unionByName(b.subtract(both).withColumn("branch", F.lit("A06")))


def tree_walk(spark: SparkSession, sf_dir: str, depth: int = 3) -> DataFrame:
    """Concepts up to three links below those of the first-level tree numbers, with the least number of links."""
    links, _ = links_and_nodes(spark, sf_dir)
    links = links.filter("parent is not null and child is not null and parent <> child").distinct()
    seen = _tree(spark, sf_dir).filter("at not like '%.%'").select(F.col("id").alias("node"), F.lit(0).alias("depth")).distinct()
    front = seen
    for k in range(1, depth + 1):
        front = front.join(links, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), F.lit(k).alias("depth")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(front)
    return seen


def corpus_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by field, missing or with one or several values, as columns."""
    n = F.size(F.split(F.trim("p1b_value"), r"\s*;\s*"))
    kind = F.when(is_missing(F.col("p1b_value"), "context"), "missing").when(n > 1, "several").otherwise("single")
    return table(spark, sf_dir, "gsm_phase_results").select("field", kind.alias("kind")).groupBy("field").pivot("kind", ["missing", "single", "several"]).agg(F.count(F.lit(1))).fillna(0)


def judged_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged values with a matched id by field: how often it is among the assigned ones, in values and instances."""
    rows = table(spark, sf_dir, "t5_shard1_judge").filter("matched_id is not null and assigned_id is not null and field is not null").select("item", "field", "instances", F.upper(strip("matched_id")).alias("m"), F.upper("assigned_id").alias("a")).distinct()
    ok = F.col("a").contains(F.col("m"))
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("same"), F.sum(F.when(ok, F.coalesce("instances", F.lit(0))).otherwise(0)).alias("same_instances"))


def lexical_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks among all vocabulary terms that share a token with a label; the score is the share of the label's tokens."""
    tokens = lambda c: augmented_tokens(F.col(c))
    v = table(spark, sf_dir, "vocab").select(F.col("term").alias("name"), F.col("mesh_id").alias("ref_id"), F.explode(tokens("term")).alias("tok")).distinct()
    labels = table(spark, sf_dir, "resolutions").filter("input_label is not null").select(F.lower("input_label").alias("label")).distinct().withColumn("n", F.size(tokens("label")))
    pairs = labels.select("label", "n", F.explode(tokens("label")).alias("tok")).join(broadcast_if_small(v), "tok").groupBy("label", "n", "ref_id", "name").agg(F.count(F.lit(1)).alias("c"))
    return lexical_pick(pairs.select("label", "ref_id", "name", (F.col("c") / F.col("n")).alias("score")))


def consolidate_vectors(spark: SparkSession, sf_dir: str, threshold: float = 0.35) -> DataFrame:
    """Vectors joined by a cosine of at least ``threshold``, transitively, are a component; greedy concepts within each, by number of values."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("label"), (F.col("vec_id") % 7).alias("n"), F.col("embedding").alias("vec"))
    nodes = e.withColumnRenamed("label", "node")
    e = e.join(components(nodes, similar_pairs(nodes, threshold=threshold)).withColumnRenamed("node", "label"), "label")
    return consolidate_greedy(e, threshold=threshold).groupBy("component", "concept").agg(F.count(F.lit(1)).alias("n_values"))


_TN = r"regexp_replace(regexp_replace(upper(regexp_replace(tree_number, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '\.$', ''), '[\s\p{Z}]+$', '')"
_ID = r"upper(regexp_replace(X, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"
_T = f"(select distinct num, id from (select {_TN} num, {_ID.replace('X', 'mesh_id')} id from mesh_tree) where num <> '' and id <> '')"
_L = rf"(select {_ID.replace('X', 'parent_id')} p, {_ID.replace('X', 'child_id')} c from mesh_parent union select a.id, b.id from {_T} a join {_T} b on regexp_replace(b.num, '\.[^.]*$', '') = a.num and contains(b.num, '.'))"
_W = "(select gsm, " + ", ".join(f"coalesce(max(trim(p1b_value, ' ')) filter (where field = '{f}'), 'Not Specified') {f.lower()}" for f in ("Sex", "Age", "Tissue", "Condition", "Treatment")) + " from (select * from gsm_phase_results where gsm is not null qualify row_number() over (partition by gsm, field order by updated_at desc nulls last, pr_id desc) = 1) group by 1)"
QUERIES = {f.__name__: f for f in (resolution_cascade, field_reroute, context_stage, sex_reconciled, age_screen, branch_sets, tree_walk, corpus_composition, judged_precision, lexical_picks, consolidate_vectors)}
ORACLES = {
    "field_reroute": f"""with v as (select lower(trim(term, ' ')) k, category from vocab), d as (select k from v group by 1 having bool_or(category in ('C', 'F')) and not bool_or(category = 'A')), l as (select distinct lower(trim(name, ' ')) k from cell_lines where name is not null),
w as (select *, lower(tissue) in (select k from d) dt, lower(condition) in (select k from l) lc, lower(treatment) in (select k from l) lt from {_W}),
s as (select *, case when dt then 'Not Specified' else tissue end t1, case when dt and condition in ('', 'Not Specified') then lower(tissue) else condition end c1 from w),
u as (select *, case when lc and t1 in ('', 'Not Specified') then lower(condition) else t1 end t2, case when lc then 'Not Specified' else c1 end c2 from s),
z as (select *, case when lt and t2 in ('', 'Not Specified') then lower(treatment) else t2 end t3, case when lt then 'Not Specified' else treatment end x3 from u)
select t3 <> tissue tissue_changed, c2 <> condition condition_changed, x3 <> treatment treatment_changed, count(*) samples from z group by 1, 2, 3""",
    "branch_sets": f"with a as (select id from {_T} where num = 'A02' or num like 'A02.%' except select id from {_T} where num = 'C11' or num like 'C11.%'), b as (select id from {_T} where num = 'A06' or num like 'A06.%' except select id from {_T} where num = 'C11' or num like 'C11.%') select id, 'A02' branch from a where id not in (select id from b) union all select id, 'A06' from b where id not in (select id from a)",
    "tree_walk": f"with recursive w as (select distinct id node, 0 depth from {_T} where not contains(num, '.') union select l.c, depth + 1 from w join {_L} l on l.p = w.node where depth < 3 and l.p <> l.c and l.p <> '' and l.c <> '') select node, min(depth) depth from w group by 1",
    "corpus_composition": r"""with k as (select field, case when lower(trim(coalesce(p1b_value, ''), ' ')) in ('', 'not specified', 'n/a', 'none', 'unknown', 'na', 'not available', 'not applicable', 'unclear', 'unspecified', 'missing', 'undetermined', 'insufficient', 'insufficient information', 'no information', 'no data') then 'missing' when contains(p1b_value, ';') then 'several' else 'single' end kind from gsm_phase_results)
select field, count(*) filter (where kind = 'missing') missing, count(*) filter (where kind = 'single') single, count(*) filter (where kind = 'several') several from k group by 1""",
    "judged_precision": f"select field, count(*) n, count(*) filter (where contains(a, m)) same, cast(sum(case when contains(a, m) then coalesce(instances, 0) else 0 end) as bigint) same_instances from (select distinct item, field, instances, {_ID.replace('X', 'matched_id')} m, upper(assigned_id) a from t5_shard1_judge where matched_id is not null and assigned_id is not null and field is not null) group by 1",
    "age_screen": f"""with c as (select lower(trim(term, ' ')) k, min(category) category from vocab where category in ('C', 'F') group by 1),
y as (select lower(condition) k, split_part(age, ':', 1) u, try_cast(regexp_extract(age, '^[a-z]+:\\s*(\\d+(\\.\\d+)?)$', 1) as double) n from {_W})
select category, count(*) comparable, count(*) filter (where n * case u when 'years' then 1.0 when 'months' then 1 / 12.0 when 'weeks' then 7 / 365.25 else 1 / 365.25 end < 18) young from y join c using (k) where n is not null and u in ('years', 'months', 'weeks', 'days') group by 1""",
    "sex_reconciled": r"""with l as (select regexp_replace(lower(trim(name, ' ')), '[\s\-_.]+', '', 'g') k, min(donor_sex) donor from cell_lines where donor_sex in ('Male', 'Female') and name is not null group by 1 having count(distinct donor_sex) = 1),
w as (select array_to_string(list_transform(string_split(lower(sex), ' '), lambda s: upper(left(s, 1)) || substr(s, 2)), ' ') sex, regexp_replace(lower(trim(tissue, ' ')), '[\s\-_.]+', '', 'g') k from WIDE)
select sex, case when sex in ('Male', 'Female') and donor is not null then donor else sex end as after, count(*) samples from w left join l using (k) group by 1, 2""".replace("WIDE", _W),
}
