"""The value dictionary over resolutions and the phase results: counts, staging, minting, folding, application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions.labels import GREEK, blocking_key, canonicalize, fold_key, id_type, identifier_shaped, is_junk, mint_id, short_form, short_form_alnum, spans, surface_shape
from sievework.functions.missing import is_missing
from sievework.functions.text import plain_space
from sievework.operators.dictionary import apply_dictionary, build_dictionary, first_in_order, fold_canon, mint, short_form_slots, stage, value_spans
from sievework.sources.tables import table

FIELDS = ["Tissue", "Condition", "Treatment"]


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the three fields' p1c-or-p1b-or-p1 values: (gse, gsm, pr_id, col, pos, raw)."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter(F.col("field").isin(FIELDS)).select("gse", "gsm", "pr_id", F.col("field").alias("col"), F.posexplode(spans(F.col("p1b_value"))).alias("pos", "raw"))
    return rows


def value_dictionary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_dictionary(_values(spark, sf_dir))


def value_dictionary_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instance counts of part names by type over all line items (the wide fact joined to a small dimension)."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("col"), F.col("p_name").alias("raw"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return items.join(part, "p_partkey").groupBy("col", "raw").agg(F.sum("n").alias("n"))


def label_dictionary_unsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cells as values, with counts and the number of studies."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter(~is_missing(F.col("p1_value"), "extract"))
    return rows.groupBy("field", F.trim("p1_value").alias("raw")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gse").alias("studies"))


def shortform_slots_by_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short forms of the acronym sheet by field with the number of rows and the first target by id."""
    rows = table(spark, sf_dir, "acronym_all").select("col", F.trim("acronym").alias("raw"), F.coalesce("id", F.lit("")).alias("gse"), "target")
    return short_form_slots(rows, "target", "target").withColumn("text", F.coalesce("text", F.lit("")))


def corpus_load_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (field, value): instances, first study by row number, number of studies, up to six smallest distinct samples."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter(~is_missing(F.col("p1_value"), "extract"))
    rows = rows.select("field", F.trim("p1_value").alias("raw"), "gse", "gsm", "pr_id")
    w = Window.partitionBy("field", "raw").orderBy("gsm")
    some = rows.groupBy("field", "raw", "gsm").agg(F.lit(1)).withColumn("rn", F.row_number().over(w)).filter("rn <= 6").groupBy("field", "raw").agg(F.concat_ws(",", F.array_sort(F.collect_list("gsm"))).alias("samples"))
    return rows.groupBy("field", "raw").agg(F.count(F.lit(1)).alias("n"), F.min_by("gse", "pr_id").alias("first_gse"), F.count_distinct("gse").alias("studies")).join(some, ["field", "raw"])


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(col, canon, ref_id): canonical vocabulary names that mean one concept of the field's categories and no cell line."""
    v = table(spark, sf_dir, "vocab")
    col = F.when(F.col("category") == "A", "Tissue").when(F.col("category").isin("C", "F"), "Condition").when(F.col("category").isin("D", "E"), "Treatment")
    keys = v.select(col.alias("col"), canonicalize(F.col("term")).alias("canon"), "mesh_id").filter("canon <> '' and col is not null")
    lines = table(spark, sf_dir, "cell_lines").select(canonicalize(F.col("name")).alias("canon")).distinct()
    return keys.groupBy("col", "canon").agg(F.min("mesh_id").alias("ref_id"), F.count_distinct("mesh_id").alias("n")).filter("n = 1").drop("n").join(lines, "canon", "left_anti")


def deterministic_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(value_dictionary_counts(spark, sf_dir), _exact(spark, sf_dir)).select("col", "raw", "n", "canon", "stage", "ref_id")


def minted_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mint(stage(value_dictionary_counts(spark, sf_dir), _exact(spark, sf_dir))).select("col", "raw", "n", "stage", "ref_id")


def stage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deterministic_staging(spark, sf_dir).groupBy("col", "stage").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("instances"))
    return d.withColumn("share", F.round(F.col("instances") / F.sum("instances").over(Window.partitionBy("col")), 6))


def dictionary_apply_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances per (col, ref_id) after the dictionary is joined back to every span."""
    values = _values(spark, sf_dir)
    return apply_dictionary(values, minted_dictionary(spark, sf_dir)).groupBy("col", "ref_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gsm").alias("samples"))


def mint_oov_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id minted for each label, whatever its characters."""
    rows = table(spark, sf_dir, "resolutions").filter("input_label is not null")
    return rows.select("col", F.col("input_label").alias("raw")).distinct().withColumn("ref_id", mint_id(F.col("col"), plain_space("raw")))


def casefold_oov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minted rows of resolutions folded: per key the id and the label met most."""
    rows = table(spark, sf_dir, "resolutions").filter(F.col("output_id").rlike("^(OOV|ART)") & F.col("output_name").isNotNull()).select("col", F.col("output_id").alias("ref_id"), F.col("output_name").alias("label"))
    return fold_canon(rows)


def casefold_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts before and after folding by field, with a total."""
    rows = table(spark, sf_dir, "resolutions").filter(F.col("output_id").rlike("^(OOV|ART)") & F.col("output_name").isNotNull()).select("col", "output_id", fold_key(F.col("output_name")).alias("k"))
    return rows.rollup("col").agg(F.count_distinct("output_id").alias("before"), F.count_distinct("k").alias("after")).withColumn("col", F.coalesce("col", F.lit("Total")))


def oov_consolidation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values, concepts, values folded into another's concept, and concepts of several values, by field with a total."""
    per = table(spark, sf_dir, "resolutions").filter(F.col("output_id").rlike("^OOV")).groupBy("col", "output_id").agg(F.count_distinct("input_label").alias("v"))
    out = per.rollup("col").agg(F.sum("v").alias("n_values"), F.count(F.lit(1)).alias("concepts"), F.sum(F.col("v") - 1).alias("folded"), F.count_if(F.col("v") > 1).alias("multi"))
    return out.withColumn("col", F.coalesce("col", F.lit("Total")))


def blocking_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "vocab").filter("term is not null").select(blocking_key(F.col("term")).alias("k"), "term", "mesh_id")
    return rows.groupBy("k").agg(F.count_distinct("term").alias("terms"), F.count_distinct("mesh_id").alias("concepts")).filter("terms > 1")


def label_collapse_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values against distinct concepts by field; a value without an id counts as itself."""
    rows = table(spark, sf_dir, "resolutions").filter("input_label is not null")
    ref = F.coalesce(F.nullif(F.trim("output_id"), F.lit("")), F.concat(F.lit("~"), "input_label"))
    return rows.groupBy("col").agg(F.count_distinct("input_label").alias("raw"), F.count_distinct(ref).alias("concepts"))


def resolution_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest answer of each (col, label), the larger row number among those of a day."""
    rows = table(spark, sf_dir, "resolutions").filter("input_label is not null").select("col", "input_label", "output_id", "created_at", "res_id")
    return first_in_order(rows, ["col", "input_label"], [F.desc("created_at"), F.desc("res_id")]).select("col", "input_label", "res_id", F.coalesce("output_id", F.lit("")).alias("output_id"))


def dominant_value_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label with several ids the id met most and its share of the label's rows."""
    rows = table(spark, sf_dir, "resolutions").filter(F.trim("output_id") != "").groupBy("col", F.trim(F.lower("input_label")).alias("label"), F.upper(F.trim("output_id")).alias("ref_id")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("col", "label")
    rows = rows.withColumns({"total": F.sum("n").over(w), "ids": F.count(F.lit(1)).over(w), "rn": F.row_number().over(w.orderBy(F.desc("n"), "ref_id"))})
    return rows.filter("ids > 1 and rn = 1 and label is not null").select("col", "label", "ref_id", "ids", "total", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def value_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface classes of acronyms and part names with shape flags counted."""
    v = table(spark, sf_dir, "acronym_all").select(F.trim("acronym").alias("v")).union(table(spark, sf_dir, "cell_lines").select("name")).filter("v is not null and v <> ''")
    c = F.col("v")
    return v.groupBy(surface_shape(c).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.count_if(short_form(c)).alias("capitals"), F.count_if(short_form_alnum(c)).alias("alnum"), F.count_if(identifier_shaped(c)).alias("identifiers"))


def junk_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct p1b values that inform nobody, with counts."""
    rows = table(spark, sf_dir, "gsm_phase_results").filter("p1b_value is not null").groupBy(F.col("p1b_value").alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return rows.filter(is_junk(F.col("raw")))


def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of each label, whatever its characters."""
    rows = table(spark, sf_dir, "resolutions").filter("input_label is not null").select(F.col("input_label").alias("raw")).distinct()
    return rows.withColumn("canon", canonicalize(plain_space("raw")))


def id_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of resolutions and judged values by field and kind of id."""
    a = table(spark, sf_dir, "resolutions").select(F.col("col").alias("field"), "output_id")
    b = table(spark, sf_dir, "t5_shard1_judge").select("field", "assigned_id")
    return a.union(b).filter("field is not null").groupBy("field", id_type(F.col("output_id")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def identical_input_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of labels with one canonical form, and how many of them got several ids, by field; a label without a canonical form is alike to none."""
    return _consistency(table(spark, sf_dir, "resolutions").withColumn("canon", canonicalize(plain_space("input_label"))).filter("canon <> ''"))


def _consistency(rows: DataFrame) -> DataFrame:
    rows = rows.filter(F.trim("output_id") != "").select("col", "canon", "input_label", F.upper(F.trim("output_id")).alias("ref_id"))
    per = rows.groupBy("col", "canon").agg(F.count_distinct("input_label").alias("forms"), F.count_distinct("ref_id").alias("ids")).filter("forms > 1")
    return per.groupBy("col").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("ids") > 1).alias("disagree"))


_FILLER = "'tissue','tissues','sample','samples','specimen','specimens','derived','from','obtained','isolated','purified','sorted','primary','fresh','frozen','ffpe','biopsy','biopsies','total','whole','human','mouse','rat','patient','patients','donor','donors','subject','subjects','adult','na','unknown'"


#: White space that RE2's class doesn't hold, and surrounding white space of any kind.
_WIDE = r"[\t\n\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ROUND = rf"^[ \t\n\v\f\r\x1c-\x1f\x{{85}}\p{{Z}}]+|[ \t\n\v\f\r\x1c-\x1f\x{{85}}\p{{Z}}]+$"


def plain_sql(x: str) -> str:
    """Without surrounding white space, inner white space other than blanks as tabs."""
    return f"regexp_replace(regexp_replace({x}, '{_ROUND}', '', 'g'), '{_WIDE}', chr(9), 'g')"


def canon_sql(x: str, whole: bool = False) -> str:
    """The canonical form in SQL; whole: of text of any characters."""
    s = f"lower(trim(coalesce({plain_sql(x) if whole else x}, '')))"
    for g, a in GREEK.items() if whole else ():
        s = f"replace({s}, '{g}', '{a}')"
    for p in (r"\b(gsm|gse|srs|srr|srx|prjna)\d+\b", r"\bn\s*=\s*\d+\b", r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", r"\b(rep(licate)?|donor|subject|patient|sample)[ _-]?\d+\b", r"[^a-z0-9%+\- ]+", r"\s+", r"\bcell\s+lines?\b"):
        s = f"regexp_replace({s}, '{p}', ' ', 'g')"
    w = f"list_filter(string_split({s}, ' '), lambda w: w <> '')"
    kept = f"list_filter({w}, lambda w: w not in ({_FILLER}))"
    return f"array_to_string(case when len({kept}) > 0 then {kept} else {w} end, ' ')"


_SPANS = "select pr_id, gse, gsm, field col, raw from (select *, unnest(list_filter(list_transform(string_split(p1b_value, ';'), lambda s: trim(s, ' ')), lambda s: s <> '' and s <> 'Not Specified')) raw from gsm_phase_results where field in ('Tissue', 'Condition', 'Treatment'))"
_DICT = f"select col, raw, count(*) n from ({_SPANS}) group by 1, 2"
_JUNK = "'', '-', '--', 'na', 'n a', 'nan', 'none', 'null', 'unknown', 'unk', 'tbd', 'not applicable', 'not specified', 'not available', 'not determined', 'missing', 'blank', 'other', 'others', 'misc', 'undetermined', '?', '.'"
_IDENT = r"regexp_matches(trim(X), '^(\d+[-/]\d+|[A-Za-z]+-?\d+|\d{3,})$')"


def junk_sql(canon: str, raw: str) -> str:
    return rf"({canon} in ({_JUNK}) or regexp_matches({canon}, '^[\d\s.,;:/+-]+$') and not {_IDENT.replace('X', raw)} or length({canon}) = 1 or length({raw}) > 300 and len(string_split({canon}, ' ')) > 40)"


_SHORT = r"regexp_matches(regexp_replace(trim(raw), '^([A-Z]+)s$', '\1'), '^[A-Z]{2,6}$')"
_STAGED = rf"""
with d as (select *, {canon_sql("raw")} canon from ({_DICT})),
v as (select case when category = 'A' then 'Tissue' when category in ('C', 'F') then 'Condition' when category in ('D', 'E') then 'Treatment' end col, {canon_sql("term")} canon, mesh_id from vocab),
e as (select col, canon, min(mesh_id) ref_id from v where canon <> '' and col is not null and canon not in (select {canon_sql("name")} from cell_lines) group by 1, 2 having count(distinct mesh_id) = 1),
s as (select d.col, raw, n, d.canon, case when {junk_sql("d.canon", "raw")} then 'junk' when {_SHORT} then 'pending-short' when ref_id is not null then 'exact' else 'pending' end stage, ref_id from d left join e on d.col = e.col and d.canon = e.canon)
select col, raw, n, canon, stage, case when stage = 'exact' then ref_id end ref_id from s"""
MINT_SQL = r"'OOV-' || case COL when 'Tissue' then 'T' when 'Condition' then 'C' when 'Treatment' then 'X' end || '-' || upper(substr(sha1(COL || chr(0) || lower(regexp_replace(trim(RAW, ' '), '\s+', ' ', 'g'))), 1, 10))"
_MINTED = f"select col, raw, n, case when stage = 'pending' then 'minted' else stage end stage, case when stage = 'pending' then {MINT_SQL.replace('COL', 'col').replace('RAW', 'raw')} else ref_id end ref_id from ({_STAGED})"
_NOT_EXTRACT = "lower(trim(coalesce(p1_value, ''), ' ')) not in ('', 'not specified', 'none', 'null', 'n/a', 'na')"
_OOV = "regexp_matches(output_id, '^(OOV|ART)') and output_name is not null"
_FOLD = r"regexp_replace(lower(trim(output_name, ' ')), '[\s\-_.]+', '', 'g')"

QUERIES = {f.__name__: f for f in (
    value_dictionary_counts, value_dictionary_by_part, label_dictionary_unsplit, shortform_slots_by_study, corpus_load_first_seen, deterministic_staging, minted_dictionary, stage_shares, dictionary_apply_back, mint_oov_ids,
    casefold_oov, casefold_effect, oov_consolidation_stats, blocking_key_groups, label_collapse_ratio, resolution_latest, dominant_value_share, value_shapes, junk_values, canonical_values, id_types, identical_input_consistency,
)}
ORACLES = {
    "value_dictionary_counts": _DICT,
    "value_dictionary_by_part": "select p_type col, p_name raw, count(*) n from lineitem join part on l_partkey = p_partkey group by 1, 2",
    "label_dictionary_unsplit": f"select field, trim(p1_value, ' ') raw, count(*) n, count(distinct gse) studies from gsm_phase_results where {_NOT_EXTRACT} group by 1, 2",
    "shortform_slots_by_study": rf"select col, raw, gse, count(*) n, coalesce(min(target), '') as text from (select col, trim(acronym, ' ') raw, coalesce(id, '') gse, target from acronym_all) where {_SHORT} group by 1, 2, 3",
    "corpus_load_first_seen": f"""with r as (select field, trim(p1_value, ' ') raw, gse, gsm, pr_id from gsm_phase_results where {_NOT_EXTRACT}),
s as (select field, raw, string_agg(gsm, ',' order by gsm) samples from (select field, raw, gsm from (select distinct field, raw, gsm from r) qualify row_number() over (partition by field, raw order by gsm) <= 6) group by 1, 2)
select r.field, r.raw, count(*) n, arg_min(gse, pr_id) first_gse, count(distinct gse) studies, any_value(samples) samples from r join s on r.field = s.field and r.raw = s.raw group by 1, 2""",
    "deterministic_staging": _STAGED,
    "minted_dictionary": _MINTED,
    "stage_shares": f"select col, stage, count(*) n_values, cast(sum(n) as bigint) instances, round(sum(n) / sum(sum(n)) over (partition by col), 6) share from ({_STAGED}) group by 1, 2",
    "dictionary_apply_back": f"select v.col, ref_id, count(*) n, count(distinct gsm) samples from ({_SPANS}) v left join ({_MINTED}) d on v.col = d.col and v.raw = d.raw group by 1, 2",
    "mint_oov_ids": f"select distinct col, input_label raw, {MINT_SQL.replace('COL', 'col').replace('RAW', plain_sql('input_label'))} ref_id from resolutions where input_label is not null",
    "casefold_oov": f"""with r as (select col, {_FOLD} k, output_id ref_id, output_name label from resolutions where {_OOV}),
i as (select col, k, ref_id from r group by 1, 2, 3 qualify row_number() over (partition by col, k order by count(*) desc, ref_id) = 1),
l as (select col, k, label from r group by 1, 2, 3 qualify row_number() over (partition by col, k order by count(*) desc, label) = 1)
select col, k, ref_id, label from i join l using (col, k)""",
    "casefold_effect": f"select coalesce(col, 'Total') col, count(distinct output_id) as before, count(distinct {_FOLD}) as after from resolutions where {_OOV} group by rollup (col)",
    "oov_consolidation_stats": "select coalesce(col, 'Total') col, cast(sum(v) as bigint) n_values, count(*) concepts, cast(sum(v - 1) as bigint) folded, count(*) filter (where v > 1) multi from (select col, output_id, count(distinct input_label) v from resolutions where output_id like 'OOV%' group by 1, 2) group by rollup (col)",
    "blocking_key_groups": r"select k, count(distinct term) terms, count(distinct mesh_id) concepts from (select array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')), ' ') k, term, mesh_id from vocab where regexp_matches(term, '^[ -~]+$')) group by 1 having count(distinct term) > 1",
    "label_collapse_ratio": "select col, count(distinct input_label) raw, count(distinct coalesce(nullif(trim(output_id, ' '), ''), '~' || input_label)) concepts from resolutions where input_label is not null group by 1",
    "resolution_latest": "select col, input_label, res_id, coalesce(output_id, '') output_id from resolutions where input_label is not null qualify row_number() over (partition by col, input_label order by created_at desc, res_id desc) = 1",
    "dominant_value_share": """with r as (select col, trim(lower(input_label), ' ') label, upper(trim(output_id, ' ')) ref_id, count(*) n from resolutions where trim(output_id, ' ') <> '' group by 1, 2, 3),
w as (select *, sum(n) over (partition by col, label) total, count(*) over (partition by col, label) ids, row_number() over (partition by col, label order by n desc, ref_id) rn from r)
select col, label, ref_id, ids, cast(total as bigint) total, round(n / total, 6) share from w where ids > 1 and rn = 1 and label is not null""",
    "value_shapes": rf"""with v as (select trim(acronym, ' ') v from acronym_all union all select name from cell_lines), w as (select v, trim(v, ' ') t from v where v is not null and v <> '')
select case when regexp_matches(v, '[^\x00-\x7f]') then 'non_ascii' when contains(v, '_') then 'underscore' when regexp_matches(v, '^[\s\v\x1c-\x1f]|[\s\v\x1c-\x1f]$|  ') then 'odd_blanks' when upper(v) <> lower(v) and v = upper(v) then 'all_capitals' when upper(v) <> lower(v) and v = lower(v) then 'all_lower_case' else 'plain' end shape, count(*) n, count(*) filter (where {_SHORT.replace("raw", "v")}) capitals,
 count(*) filter (where regexp_matches(t, '^[A-Za-z][A-Za-z0-9]{{1,4}}$') and regexp_matches(t, '[A-Z0-9]')) alnum, count(*) filter (where {_IDENT.replace("X", "t")}) identifiers from w group by 1""",
    "junk_values": f"select raw, n from (select p1b_value raw, count(*) n, {canon_sql('p1b_value')} canon from gsm_phase_results where p1b_value is not null group by 1) where {junk_sql('canon', 'raw')}",
    "canonical_values": f"select distinct input_label raw, {canon_sql('input_label', whole=True)} canon from resolutions where input_label is not null",
    "id_types": r"""with r as (select col field, output_id i from resolutions union all select field, assigned_id from t5_shard1_judge),
x as (select field, list_filter(list_transform(string_split(regexp_replace(coalesce(i, ''), ',', ';', 'g'), ';'), lambda s: trim(s, ' ')), lambda s: s <> '') p from r where field is not null)
select field, case when len(list_filter(p, lambda s: regexp_matches(s, '^[DC]\d'))) > 0 then 'mesh' when len(list_filter(p, lambda s: s like 'CVCL\_%' escape '\')) > 0 then 'cellosaurus' when len(list_filter(p, lambda s: regexp_matches(s, '^(OOV|ART)'))) > 0 then 'oov' else 'uncovered' end kind, count(*) n from x group by 1, 2""",
    "identical_input_consistency": f"select col, count(*) groups, count(*) filter (where ids > 1) disagree from (select col, {canon_sql('input_label', whole=True)} canon, count(distinct input_label) forms, count(distinct upper(trim(output_id, ' '))) ids from resolutions where trim(output_id, ' ') <> '' group by 1, 2) where forms > 1 and canon <> '' group by 1",
}
