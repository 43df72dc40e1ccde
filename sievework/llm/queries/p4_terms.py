"""Problem 4: frequency of every value of p1_value, value_dist and acronym."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import blank_to_null, strip
from sievework.llm.termcounts import TermCounts, mark_terms
from sievework.runtime import cut, ensure_checkpoint_dir
from sievework.sources.tables import table


def _term(col: str) -> Column:
    return blank_to_null(strip(F.lower(col)))


def _of_values(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("p1_value").alias("src"), _term("p1_value").alias("term"), F.col("gsm").alias("record"), F.lit(1).cast("long").alias("occ"))


def _of_dists(rows: DataFrame) -> DataFrame:
    rows = rows.select("gse", F.explode(F.from_json("value_dist", "map<string,bigint>")).alias("value", "n"))
    return rows.select(F.lit("value_dist").alias("src"), _term("value").alias("term"), F.col("gse").alias("record"), F.coalesce("n", F.lit(0)).alias("occ"))


def _of_acronyms(rows: DataFrame) -> DataFrame:
    """Every row is a record of its own; its number is drawn once and kept."""
    rows = cut(rows.select(_term("acronym").alias("term"), "samples", F.monotonically_increasing_id().cast("string").alias("record")))
    return rows.select(F.lit("acronym").alias("src"), "term", "record", F.coalesce("samples", F.lit(0)).alias("occ"))


def _late(rows: DataFrame, share: float = 0.9) -> Column:
    """Whether a row came after the first ``share`` of its table, by updated_at; how a table is parted into load and late rows doesn't change what comes out."""
    day = rows.agg(F.percentile_approx(F.col("updated_at").cast("timestamp"), share)).first()[0]
    return F.coalesce(F.col("updated_at").cast("timestamp") > F.lit(day), F.lit(False))


def _marked(store: TermCounts) -> DataFrame:
    """The store's terms with their marks, kept apart from the store, which is removed."""
    out = cut(mark_terms(store.terms(), store.totals()).select("src", "term", "occ", "records", "total", "mark"))
    store.remove()
    return out


def _store(spark: SparkSession) -> TermCounts:
    return TermCounts(spark, f"{ensure_checkpoint_dir(spark)}/termcounts-{uuid.uuid4().hex}")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, term, occ, records, total, mark) of every term over all rows: a first load, into which the late rows are merged."""
    values, dists = table(spark, sf_dir, "gsm_phase_results"), table(spark, sf_dir, "gse_field_aggregate")
    late_v, late_d, store = _late(values), _late(dists), _store(spark)
    store.update(_of_values(values.filter(~late_v)).union(_of_dists(dists.filter(~late_d))).union(_of_acronyms(table(spark, sf_dir, "acronym_all"))).withColumn("sign", F.lit(1)))
    store.update(_of_values(values.filter(late_v)).union(_of_dists(dists.filter(late_d))).withColumn("sign", F.lit(1)))
    return _marked(store)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_counts(spark, sf_dir).filter("mark is not null").select("src", "term", "mark")


def p4_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`p4_counts` of p1_value and value_dist, but of the state that holds now: of each (gsm, field) and each (gse,
    field) only the latest row. The state before the late rows is loaded; then each late row that replaces one takes the old
    one's term away (-1) and adds its own (+1), and one whose value is gone takes it away only."""
    store, load, change = _store(spark), [], []
    for name, keys, key, of in (("gsm_phase_results", ["gsm", "field"], "pr_id", _of_values), ("gse_field_aggregate", ["gse", "field"], "agg_id", _of_dists)):
        rows = table(spark, sf_dir, name)
        late = _late(rows)
        order = F.struct(F.col("updated_at").isNotNull(), "updated_at", F.col(key))
        whole = F.struct("gse", *(["gsm", "p1_value"] if of is _of_values else ["value_dist"]))
        last = rows.groupBy(*keys).agg(F.max_by(whole, F.when(~late, order)).alias("old"), F.max_by(whole, order).alias("new"), F.max(late).alias("touched"))
        last = cut(last)
        load.append(of(last.filter("old is not null").select("old.*")).withColumn("sign", F.lit(1)))
        for side, sign in (("old", -1), ("new", 1)):
            change.append(of(last.filter(f"touched and {side} is not null").select(f"{side}.*")).withColumn("sign", F.lit(sign)))
    store.update(load[0].union(load[1]))
    store.update(change[0].union(change[1]).union(change[2]).union(change[3]))
    return _marked(store)


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts, "p4_current": p4_current}

_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def _sql_term(x: str) -> str:
    return f"nullif(regexp_replace(lower({x}), '^{_SPACE}+|{_SPACE}+$', '', 'g'), '')"


def _sql_counts(values: str, dists: str, acronyms: bool) -> str:
    return f"""
with p as (
  select 'p1_value' src, {_sql_term("p1_value")} term, gsm record, 1 occ from {values}
  union all
  select 'value_dist', {_sql_term("k")}, gse, coalesce(try_cast(json_extract_string(value_dist, '$."' || k || '"') as bigint), 0)
  from (select gse, value_dist, unnest(json_keys(value_dist)) k from {dists} where try_cast(value_dist as json) is not null and left(ltrim(value_dist), 1) = '{{')
  {f"union all select 'acronym', {_sql_term('acronym')}, cast(row_number() over () as varchar), coalesce(samples, 0) from acronym_all" if acronyms else ""}
), q as (select * from p where term is not null and record is not null),
t as (select src, term, cast(sum(occ) as bigint) occ, count(distinct record) records from q group by 1, 2),
n as (select src, count(distinct record) total from q group by 1)
select src, term, occ, records, total, case when occ <= 2 then 'rare' when records * 100 > total then 'common' end mark from t join n using (src)
"""


_COUNTS = _sql_counts("gsm_phase_results", "gse_field_aggregate", True)
_LAST = "(select * from {0} qualify row_number() over (partition by {1}, field order by updated_at desc nulls last, {2} desc) = 1)"
ORACLES = {
    "p4_counts": _COUNTS,
    "p4_found": f"select src, term, mark from ({_COUNTS}) where mark is not null",
    "p4_current": _sql_counts(_LAST.format("gsm_phase_results", "gsm", "pr_id"), _LAST.format("gse_field_aggregate", "gse", "agg_id"), False),
}
