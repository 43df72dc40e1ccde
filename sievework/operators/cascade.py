"""Normalization tiers and cross-field rules over label cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.guards import CONTROL_MARK, DISEASE_PHRASE, bare_control, recover_disease, treatment_grounded
from sievework.functions.labels import augmented_tokens
from sievework.functions.missing import NS, is_missing

# Words of a treatment that say nothing of the agent; what an answer that repeats its instructions holds.
TREATMENT_STOP = [
    "the", "and", "for", "with", "from", "cells", "cell", "control", "controls", "ctrl", "vehicle", "untreated", "mock", "none", "not", "specified", "day", "days", "hour", "hours", "week", "weeks", "dose", "treatment", "treated",
    "group", "sample", "nm", "um", "mm", "mg", "ml", "ug", "ng", "gy", "stimulation", "exposure", "time", "normal", "normally",
]
ECHO_MARK = r"(?i)sibling samples in this gse|from phase\s*1|phase\s*1 value|output exactly|cohort[-\s]?grouping|class[-\s]?1 intervention|experiment context"
CODE = r"^[A-Za-z]{1,6}[-\s]?\d{1,5}[A-Za-z0-9]*$"


def first_tier(df: DataFrame, key: list[str], tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """``df`` with ref_id and tier of the first table (key..., ref_id; one row per key) that knows the key. Each further tier is joined for the rows left over only."""
    left, done = df, []
    for name, table in tiers:
        joined = left.join(table.select(*key, "ref_id"), key, "left")
        done.append(joined.filter("ref_id is not null").withColumn("tier", F.lit(name)))
        left = joined.filter("ref_id is null").drop("ref_id")
    out = left.withColumns({"ref_id": F.lit(None).cast("string"), "tier": F.lit("unresolved")})
    for part in done:
        out = out.unionByName(part)
    return out


def reroute(df: DataFrame) -> DataFrame:
    """Values in the wrong field moved to the right one if that is empty.

    df: per sample tissue, condition, treatment (value or the sentinel) and disease_in_tissue, line_in_condition,
    line_in_treatment (the right name, null where the value is in its place). A disease leaves Tissue for an empty
    Condition; a cell line leaves Condition, then Treatment, for an empty Tissue (or one a disease has just left).
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(NS)).isin(NS, "")
    moved = F.col("disease_in_tissue").isNotNull()
    df = df.withColumn("t1", F.when(moved, NS).otherwise(F.col("tissue"))).withColumn("c1", F.when(moved & empty("condition"), F.col("disease_in_tissue")).otherwise(F.col("condition")))
    for col, line in (("c1", "line_in_condition"), ("treatment", "line_in_treatment")):
        out = F.col(line).isNotNull()
        df = df.withColumn("t1", F.when(out & empty("t1"), F.col(line)).otherwise(F.col("t1"))).withColumn(col, F.when(out, NS).otherwise(F.col(col)))
    return df.withColumns({"tissue": F.col("t1"), "condition": F.col("c1")}).drop("t1", "c1", "disease_in_tissue", "line_in_condition", "line_in_treatment")


def context_policy(field: str, first: Column, answer: Column, record: Column) -> Column:
    """What the context stage may make of its ``answer`` for a field, given the first stage's value and the sample's own text."""
    none = is_missing(answer, "context")
    disease = recover_disease(record)
    if field == "Treatment":
        return F.when(record.rlike(CONTROL_MARK) | F.coalesce(answer.rlike(ECHO_MARK), F.lit(False)) | none, first).when(~treatment_grounded(answer, record, TREATMENT_STOP), first).otherwise(answer)
    if field != "Condition":
        return F.when(F.coalesce(answer.rlike(ECHO_MARK), F.lit(False)) | none, first).otherwise(answer)
    code = lambda c: F.coalesce(c.rlike(CODE) & ~c.rlike(DISEASE_PHRASE), F.lit(False))
    kept = F.when((code(first) | bare_control(first)) & disease.isNotNull(), disease).otherwise(first)
    told = ~is_missing(first, "context") & ~bare_control(first)
    return (
        F.when(F.coalesce(answer.rlike(ECHO_MARK), F.lit(False)), first)
        .when(none, kept)
        .when(code(answer) & disease.isNotNull(), disease)
        .when(bare_control(answer) & told, first)
        .when(bare_control(answer) & disease.isNotNull(), disease)
        .otherwise(answer)
    )


def reconcile_sex(sex: Column, female: Column, male: Column, donor: Column) -> Column:
    """A definite sex that the tissue's anatomy (female / male flags) or else the cell line's donor contradicts is replaced by theirs."""
    known = sex.isin("Male", "Female")
    return F.when(known & female & ~male, "Female").when(known & male & ~female, "Male").when(known & donor.isin("Male", "Female"), donor).otherwise(sex)


def lexical_pick(candidates: DataFrame) -> DataFrame:
    """(label, ref_id, name): the candidate that best covers a label by tokens, then by score. candidates: label, ref_id, name, score.

    A label with one candidate takes it. Otherwise the order is: name fully covered, half, partly, not at all; a first one
    without a common token needs a score of 0.95; a first one of a single covered token needs 0.45; the rest stay open.
    """
    a, b = augmented_tokens(F.col("label")), augmented_tokens(F.col("name"))
    common = F.size(F.array_intersect(a, b))
    cover = common / F.greatest(F.size(b), F.lit(1))
    band = F.when(common == 0, 0).when(cover >= 1, 3).when(cover >= 0.5, 2).otherwise(1)
    rated = candidates.select("label", "ref_id", "name", "score", band.alias("band"), F.size(b).alias("words"))
    best = rated.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("band")).alias("b"), (-F.col("score")).alias("s"), "ref_id", "name", "words")).alias("t"))
    ok = (F.col("n") == 1) | ((F.col("t.b") == 0) & (-F.col("t.s") >= 0.95)) | ((F.col("t.b") == -3) & (F.col("t.words") == 1) & (-F.col("t.s") >= 0.45))
    return best.filter(ok).select("label", F.col("t.ref_id").alias("ref_id"), F.col("t.name").alias("name"))


def consolidate_greedy(values: DataFrame, *, threshold: float, most: int = 8) -> DataFrame:
    """(component, label, concept): within each component, values by falling count join the most similar concept so far, or found their own.

    values: component, label, n, vec. Sequential by definition, so components run as groups; a component is bounded by the
    similarity that made it. The nearest of at most ``most`` concepts at ``threshold`` or above is taken; equal lower-case
    labels always join.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "label"], ascending=[False, True], kind="stable")
        names, index, rows, out = [], {}, [], []
        for label, vec in zip(pdf["label"], pdf["vec"]):
            at = index.get(label.strip().lower())
            if at is None and names:
                sims = np.asarray(rows) @ np.asarray(vec, np.float64)
                near = sorted((-s, names[i], i) for i, s in enumerate(sims) if s >= threshold)[:most]
                at = near[0][2] if near else None
            if at is None:
                at = len(names)
                names.append(label)
                rows.append(np.asarray(vec, np.float64))
                index[label.strip().lower()] = at
            out.append(names[at])
        return pd.DataFrame({"component": pdf["component"].to_numpy(), "label": pdf["label"].to_numpy(), "concept": out})

    kind = values.schema["component"].dataType.simpleString()
    return values.groupBy("component").applyInPandas(run, f"component {kind}, label string, concept string")

