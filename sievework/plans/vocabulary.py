"""Vocabulary plans: exact names, ambiguity, tree descendants, cell lines, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.labels import augmented_query, augmented_tokens, blocking_key, distinctive_words, fold_key, id_group
from sievework.functions.text import blank_to_null, plain_space, strip
from sievework.operators.packed import IDENTIFIERS, split_packed
from sievework.operators.vectors import components, top_k
from sievework.runtime import broadcast_if_small
from sievework.sources.tables import table


def field_of(category: Column) -> Column:
    return F.when(category == "A", "Tissue").when(category.isin("C", "F"), "Condition").when(category.isin("D", "E"), "Treatment")


def exact_vocabulary_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose lower-case text is one concept's name in the field's categories, with the concept."""
    v = table(spark, sf_dir, "vocab").select(field_of(F.col("category")).alias("col"), F.lower(F.trim("term")).alias("k"), "mesh_id").filter("col is not null")
    v = v.groupBy("col", "k").agg(F.min("mesh_id").alias("mesh_id"), F.count_distinct("mesh_id").alias("n")).filter("n = 1").drop("n")
    labels = table(spark, sf_dir, "resolutions").filter("input_label is not null").groupBy("col", F.lower(F.trim("input_label")).alias("k")).agg(F.count(F.lit(1)).alias("uses"))
    return labels.join(v, ["col", "k"])


def ambiguous_surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of vocabulary and cell lines that mean several things, with how many."""
    v = table(spark, sf_dir, "vocab").select(F.lower(F.trim("term")).alias("form"), F.col("mesh_id").alias("id")).union(table(spark, sf_dir, "cell_lines").select(F.lower(F.trim("name")), "cvcl"))
    return v.filter("form is not null and id is not null").groupBy("form").agg(F.count_distinct("id").alias("meanings"), F.min("id").alias("first_id")).filter("meanings > 1")


def unambiguous_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms an index may hold: those of one concept, with the preferred name by kind of entry."""
    order = F.when(F.col("kind") == "descriptor", 0).when(F.col("kind") == "entry", 1).when(F.col("kind") == "scr", 2).otherwise(3)
    v = table(spark, sf_dir, "vocab").filter("term_norm is not null and mesh_id is not null")
    return v.groupBy("term_norm").agg(F.count_distinct("mesh_id").alias("n"), F.min("mesh_id").alias("mesh_id"), F.min(F.struct(order.alias("o"), "kind"))["kind"].alias("kind")).filter("n = 1").drop("n")


def concept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of each concept in one row."""
    return table(spark, sf_dir, "vocab").filter("term is not null").groupBy("mesh_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " | ").alias("names"), F.count_distinct("term").alias("n"))


def descriptor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text for an index entry: the preferred name and up to five other names."""
    v = table(spark, sf_dir, "vocab").filter("mesh_id is not null and preferred is not null")
    per = v.groupBy("mesh_id").agg(F.min("preferred").alias("name"), F.array_sort(F.collect_set(F.when(F.col("term") != F.col("preferred"), F.col("term")))).alias("others"))
    return per.select("mesh_id", F.concat_ws(" | ", "name", blank_to_null(F.array_join(F.slice("others", 1, 5), "; "))).alias("text"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = blank_to_null(strip(F.regexp_replace(F.upper(strip("tree_number")), r"\.$", "")))
    return table(spark, sf_dir, "mesh_tree").select(number.alias("at"), blank_to_null(F.upper(strip("mesh_id"))).alias("id")).filter("at is not null and id is not null").distinct()


def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts below each second-level tree number. Every number is exploded into its own prefixes, which makes the prefix test an equality."""
    t = _tree(spark, sf_dir)
    parts = F.split("at", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    below = t.select("id", F.explode(prefixes).alias("top")).filter(F.size(F.split("top", r"\.")) == 2)
    return below.groupBy("top").agg(F.count_distinct("id").alias("concepts"))


def tree_shallowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of each concept by its shallowest tree number, ties by number."""
    t = _tree(spark, sf_dir).withColumn("depth", F.size(F.split("at", r"\.")))
    best = t.groupBy("id").agg(F.min(F.struct("depth", "at")).alias("b"))
    return best.select("id", F.substring("b.at", 1, 1).alias("category"), F.col("b.depth").cast("long").alias("depth"))


def branch_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved answers by field: how many lie in the field's branches of the tree, how many outside."""
    cats = _tree(spark, sf_dir).select("id", field_of(F.substring("at", 1, 1)).alias("f")).distinct()
    rows = table(spark, sf_dir, "resolutions").select("res_id", "col", F.upper(strip("output_id")).alias("id"))
    hit = rows.join(cats, "id").groupBy("res_id", "col").agg(F.max(F.col("f") == F.col("col")).alias("ok"))
    return hit.groupBy("col").agg(F.count(F.lit(1)).alias("with_tree"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("outside"))


def orphan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept ids used in resolutions that the vocabulary doesn't have (anti join, so nulls don't matter)."""
    used = table(spark, sf_dir, "resolutions").select(F.upper(strip("output_id")).alias("id")).filter(F.col("id").rlike(r"^[CD]\d+$")).groupBy("id").agg(F.count(F.lit(1)).alias("uses"))
    return used.join(table(spark, sf_dir, "vocab").select(F.upper("mesh_id").alias("id")).distinct(), "id", "left_anti")


def label_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose name isn't the preferred name of their id."""
    pref = table(spark, sf_dir, "vocab").groupBy("mesh_id").agg(F.min("preferred").alias("preferred"))
    rows = table(spark, sf_dir, "resolutions").filter("output_name is not null").select("res_id", "output_name", F.trim("output_id").alias("mesh_id"))
    return rows.join(pref, "mesh_id").filter(F.lower("output_name") != F.lower("preferred")).select("res_id", "mesh_id", "output_name", "preferred")


def cell_line_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tissue values that name exactly one human cell line, with it and its donor's sex."""
    lines = table(spark, sf_dir, "cell_lines").filter("name is not null and cvcl is not null").filter(F.exists(F.split(F.coalesce("organism", F.lit("")), ";"), lambda o: F.trim(o).startswith("Homo sapiens")))
    lines = lines.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.count_distinct("cvcl").alias("n"), F.min("cvcl").alias("cvcl"), F.min(F.coalesce("donor_sex", F.lit(""))).alias("donor_sex")).filter("n = 1").drop("n")
    values = table(spark, sf_dir, "gsm_phase_results").filter("field = 'Tissue' and p1b_value is not null").groupBy(F.lower(F.trim("p1b_value")).alias("k")).agg(F.count(F.lit(1)).alias("uses"))
    return values.join(lines, "k")


def cell_line_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by species of the cell lines (species lists exploded)."""
    rows = table(spark, sf_dir, "cell_lines").select("name", F.explode(F.split("organism", ";")).alias("o"))
    return rows.groupBy(F.trim("o").alias("organism")).agg(F.count_distinct("name").alias("names"))


def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids of resolutions by field and vocabulary group, and over all fields."""
    rows = table(spark, sf_dir, "resolutions").select("col", F.upper(strip("output_id")).alias("id")).filter("id <> ''")
    return rows.rollup("col", id_group(F.col("id")).alias("grp")).agg(F.count_distinct("id").alias("concepts")).filter("col is null or grp is not null").select(F.coalesce("col", F.lit("Total")).alias("col"), F.coalesce("grp", F.lit("all")).alias("grp"), "concepts")


def vocabulary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct acronym targets by field that the vocabulary, the cell lines, both or neither have."""
    a = table(spark, sf_dir, "acronym_all").filter("target is not null").select("col", F.lower("target").alias("k")).distinct()
    v = table(spark, sf_dir, "vocab").select(F.lower("term").alias("k")).distinct().withColumn("v", F.lit(True))
    c = table(spark, sf_dir, "cell_lines").select(F.lower("name").alias("k")).distinct().withColumn("c", F.lit(True))
    kind = F.when(F.col("v") & F.col("c"), "both").when(F.col("v"), "vocabulary").when(F.col("c"), "cell_lines").otherwise("neither")
    return a.join(v, "k", "left").join(c, "k", "left").groupBy("col", kind.alias("covered")).agg(F.count(F.lit(1)).alias("targets"))


def acronym_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms with several meanings, the meanings and the share of the commonest."""
    rows = table(spark, sf_dir, "acronym_all").filter("id is not null").groupBy("col", F.upper(F.trim("acronym")).alias("acronym"), "id").agg(F.sum(F.coalesce("samples", F.lit(0))).alias("n"))
    per = rows.groupBy("col", "acronym").agg(F.count(F.lit(1)).alias("senses"), F.sum("n").alias("total"), F.max("n").alias("most")).filter("senses > 1 and total > 0")
    return per.select("col", "acronym", "senses", "total", F.round(F.col("most") / F.col("total"), 6).alias("share"))


def acronym_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms of at least 100 samples with their commonest target."""
    rows = table(spark, sf_dir, "acronym_all").groupBy("col", F.upper(F.trim("acronym")).alias("acronym"), F.coalesce("id", F.lit("")).alias("id")).agg(F.sum(F.coalesce("samples", F.lit(0))).alias("n"))
    return rows.groupBy("col", "acronym").agg(F.sum("n").alias("samples"), F.min(F.struct((-F.col("n")).alias("n"), "id"))["id"].alias("id")).filter("samples >= 100")


def unanimous_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms pooled over the sheet: one vote per resolved row, a conflict if they disagree."""
    rows = table(spark, sf_dir, "acronym_all").filter("lower(trim(resolved)) = 'yes' and id is not null")
    return rows.groupBy("col", F.upper(F.trim("acronym")).alias("acronym")).agg(F.count(F.lit(1)).alias("votes"), F.when(F.count_distinct("id") == 1, F.min("id")).otherwise("conflict").alias("verdict"))


def augmented_label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten queries and distinctive words of vocabulary terms."""
    t = table(spark, sf_dir, "vocab").filter("term is not null").select("term").distinct()
    return t.select("term", F.coalesce(augmented_query(F.col("term")), F.lit("")).alias("query"), F.array_join(F.array_sort(augmented_tokens(F.col("term"))), " ").alias("tokens"), F.array_join(F.array_sort(distinctive_words(F.col("term"), ["compound", "tissue"])), " ").alias("words"))


def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label the vocabulary term that covers most of its tokens, among all terms that share any; ties by term, then id."""
    toks = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)))
    v = table(spark, sf_dir, "vocab").select("term", "mesh_id", toks(F.col("term")).alias("vt")).distinct()
    vt = v.select("term", "mesh_id", F.size("vt").alias("nv"), F.explode("vt").alias("tok"))
    labels = table(spark, sf_dir, "resolutions").select(F.lower("input_label").alias("label")).distinct().select("label", toks(F.col("label")).alias("lt"))
    pairs = labels.select("label", F.size("lt").alias("nl"), F.explode("lt").alias("tok")).join(broadcast_if_small(vt), "tok")
    # a term of several concepts is one pair for each of them
    shared = pairs.groupBy("label", "term", "mesh_id", "nl", "nv").agg(F.count(F.lit(1)).alias("c"))
    scored = shared.select("label", "term", "mesh_id", F.round(F.col("c") / (F.col("nl") + F.col("nv") - F.col("c")), 6).alias("score"))
    best = scored.groupBy("label").agg(F.min(F.struct((-F.col("score")).alias("s"), "term", "mesh_id")).alias("b"))
    return best.select("label", F.col("b.term").alias("term"), F.col("b.mesh_id").alias("mesh_id"), (-F.col("b.s")).alias("score"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every hundredth vector."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    got = top_k(q, e.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vec")), k=6)
    return got.filter("query_id <> ref_id and rank <= 6").select("query_id", "ref_id", "score")


def vector_topk_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of the same label of every hundredth vector, itself included."""
    e = table(spark, sf_dir, "embeddings").withColumn("category", F.col("label"))
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "category")
    return top_k(q, e.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vec"), "category"), k=5, category=True)


def consolidate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending labels grouped into concepts: labels of a field joined by an equal blocking key or an equal fold key, transitively."""
    rows = table(spark, sf_dir, "resolutions").filter("input_label is not null").select(F.concat_ws("|", "col", "input_label").alias("node"), "col", blocking_key(F.col("input_label")).alias("b"), fold_key(plain_space("input_label")).alias("f")).distinct()
    # a star to each key's first label, not all pairs
    star = lambda k: rows.filter(F.col(k) != "").select("node", "col", F.col(k).alias("k")).join(rows.groupBy("col", F.col(k).alias("k")).agg(F.min("node").alias("hub")), ["col", "k"]).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return components(rows, star("b").union(star("f"))).groupBy("component").agg(F.count(F.lit(1)).alias("labels"))


def packed_judge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of judged values by vocabulary group, packed fields split."""
    rows = split_packed(table(spark, sf_dir, "t5_shard1_judge"), "assigned_id", ["field"], IDENTIFIERS)
    return rows.groupBy("field", id_group(F.col("val")).alias("grp")).agg(F.count(F.lit(1)).alias("ids"))


_F = "case when {0} = 'A' then 'Tissue' when {0} in ('C', 'F') then 'Condition' when {0} in ('D', 'E') then 'Treatment' end"
_S = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_AT = _S.format("regexp_replace(upper(" + _S.format("tree_number") + r"), '\.$', '')")
_T = f"(select distinct num, id from (select nullif({_AT}, '') num, nullif(upper({_S.format('mesh_id')}), '') id from mesh_tree) where num is not null and id is not null)"
_TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z]{{3,}}'))"
_COS = "round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / greatest(sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[]))) * sqrt(list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[]))), 1e-12), 6)"
QUERIES = {f.__name__: f for f in (
    exact_vocabulary_hit, ambiguous_surface_forms, unambiguous_index, concept_names, descriptor_text, tree_descendants, tree_shallowest, branch_validity, orphan_ids, label_drift, cell_line_match, cell_line_species, resource_summary,
    vocabulary_coverage, acronym_senses, acronym_population, unanimous_definitions, augmented_label_queries, lexical_rerank, vector_topk, vector_topk_masked, consolidate_components, packed_judge_ids,
)}
ORACLES = {
    "exact_vocabulary_hit": f"""with v as (select {_F.format("category")} col, lower(trim(term, ' ')) k, min(mesh_id) mesh_id from vocab group by 1, 2 having count(distinct mesh_id) = 1)
select r.col, r.k, uses, mesh_id from (select col, lower(trim(input_label, ' ')) k, count(*) uses from resolutions where input_label is not null group by 1, 2) r join v on r.col = v.col and r.k = v.k""",
    "ambiguous_surface_forms": "select form, count(distinct id) meanings, min(id) first_id from (select lower(trim(term, ' ')) form, mesh_id id from vocab union all select lower(trim(name, ' ')), cvcl from cell_lines) where form is not null and id is not null group by 1 having count(distinct id) > 1",
    "unambiguous_index": "select term_norm, min(mesh_id) mesh_id, first(kind order by case kind when 'descriptor' then 0 when 'entry' then 1 when 'scr' then 2 else 3 end, kind) kind from vocab where term_norm is not null and mesh_id is not null group by 1 having count(distinct mesh_id) = 1",
    "concept_names": "select mesh_id, string_agg(term, ' | ' order by term) names, count(*) n from (select distinct mesh_id, term from vocab where term is not null) group by 1",
    "descriptor_text": "with p as (select mesh_id, min(preferred) name from vocab where mesh_id is not null and preferred is not null group by 1), o as (select distinct mesh_id, term from vocab where mesh_id is not null and preferred is not null and term <> preferred), q as (select mesh_id, string_agg(term, '; ' order by term) t from (select * from o qualify row_number() over (partition by mesh_id order by term) <= 5) group by 1) select mesh_id, concat_ws(' | ', name, t) as text from p left join q using (mesh_id)",
    "tree_descendants": f"select split_part(num, '.', 1) || '.' || split_part(num, '.', 2) top, count(distinct id) concepts from {_T} where contains(num, '.') group by 1",
    "tree_shallowest": f"select id, left(first(num order by len(string_split(num, '.')), num), 1) category, cast(min(len(string_split(num, '.'))) as bigint) depth from {_T} group by 1",
    "branch_validity": f"select col, count(*) with_tree, count(*) filter (where not coalesce(ok, false)) outside from (select res_id, col, bool_or(f = col) ok from (select res_id, col, upper({_S.format('output_id')}) id from resolutions) join (select distinct id, {_F.format('left(num, 1)')} f from {_T}) using (id) group by 1, 2) group by 1",
    "orphan_ids": rf"select id, count(*) uses from (select upper({_S.format('output_id')}) id from resolutions) where regexp_matches(id, '^[CD]\d+$') and id not in (select upper(mesh_id) from vocab where mesh_id is not null) group by 1",
    "label_drift": "select res_id, mesh_id, output_name, preferred from (select res_id, output_name, trim(output_id, ' ') mesh_id from resolutions where output_name is not null) join (select mesh_id, min(preferred) preferred from vocab group by 1) using (mesh_id) where lower(output_name) <> lower(preferred)",
    "cell_line_match": "with l as (select lower(trim(name, ' ')) k, min(cvcl) cvcl, min(coalesce(donor_sex, '')) donor_sex from cell_lines where name is not null and cvcl is not null and len(list_filter(string_split(coalesce(organism, ''), ';'), lambda o: starts_with(trim(o, ' '), 'Homo sapiens'))) > 0 group by 1 having count(distinct cvcl) = 1) select k, uses, cvcl, donor_sex from (select lower(trim(p1b_value, ' ')) k, count(*) uses from gsm_phase_results where field = 'Tissue' and p1b_value is not null group by 1) join l using (k)",
    "cell_line_species": "select trim(o, ' ') organism, count(distinct name) names from (select name, unnest(string_split(organism, ';')) o from cell_lines) group by 1",
    "resource_summary": rf"""with r as (select col, upper({_S.format('output_id')}) id from resolutions), g as (select col, id, case when regexp_matches(id, '^D\d+$') then 'mesh' when regexp_matches(id, '^C\d+$') then 'scr' when regexp_matches(id, '^CVCL_') then 'cellosaurus' when regexp_matches(id, '^(OOV|ART)') then 'oov' else 'other' end grp from r where id <> '')
select col, grp, count(distinct id) concepts from g group by 1, 2 union all select 'Total', 'all', count(distinct id) from g""",
    "vocabulary_coverage": "with a as (select distinct col, lower(target) k from acronym_all where target is not null) select col, case when v and c then 'both' when v then 'vocabulary' when c then 'cell_lines' else 'neither' end covered, count(*) targets from (select col, k in (select lower(term) from vocab where term is not null) v, k in (select lower(name) from cell_lines where name is not null) c from a) group by 1, 2",
    "acronym_senses": "select col, acronym, count(*) senses, cast(sum(n) as bigint) total, round(max(n) / sum(n), 6) share from (select col, upper(trim(acronym, ' ')) acronym, id, sum(coalesce(samples, 0)) n from acronym_all where id is not null group by 1, 2, 3) group by 1, 2 having count(*) > 1 and sum(n) > 0",
    "acronym_population": "select col, acronym, cast(sum(n) as bigint) samples, first(id order by n desc, id) id from (select col, upper(trim(acronym, ' ')) acronym, coalesce(id, '') id, sum(coalesce(samples, 0)) n from acronym_all group by 1, 2, 3) group by 1, 2 having sum(n) >= 100",
    "unanimous_definitions": "select col, upper(trim(acronym, ' ')) acronym, count(*) votes, case when count(distinct id) = 1 then min(id) else 'conflict' end verdict from acronym_all where lower(trim(resolved, ' ')) = 'yes' and id is not null group by 1, 2",
    "lexical_rerank": f"""with v as (select distinct term, mesh_id, {_TOK.format("term")} vt from vocab), l as (select distinct lower(input_label) label, {_TOK.format("input_label")} lt from resolutions),
a as (select term, mesh_id, len(vt) nv, unnest(vt) tok from v), b as (select label, len(lt) nl, unnest(lt) tok from l), p as (select label, term, mesh_id, nl, nv, count(*) c from b join a using (tok) group by all),
s as (select label, term, mesh_id, round(c / (nl + nv - c), 6) s from p) select label, first(term order by s desc, term, mesh_id) term, first(mesh_id order by s desc, term, mesh_id) mesh_id, max(s) score from s group by 1""",
    "vector_topk": f"select query_id, ref_id, score from (select a.vec_id query_id, b.vec_id ref_id, {_COS} score from embeddings a, embeddings b where a.vec_id % 100 = 0 qualify row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) <= 6) where query_id <> ref_id",
    "vector_topk_masked": f'select a.vec_id query_id, b.vec_id ref_id, {_COS} score, row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) "rank" from embeddings a join embeddings b on a.label = b.label where a.vec_id % 100 = 0 qualify row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) <= 5',
}
