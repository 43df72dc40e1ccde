"""Documented examples of the column functions."""

import subprocess
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sievework.functions import acronyms, guards, labels, missing


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "f,value,want",
    [
        (labels.strip_dose, "paclitaxel 10 nM 24 h", "paclitaxel"),
        (labels.strip_dose, "metformin 100mg/kg", "metformin"),
        (labels.strip_dose, "cisplatin", None),
        (labels.extract_dose, "paclitaxel 10 nM 24 h", "10 nM; 24 h"),
        (labels.extract_dose, "IL-12 (10 ng) + butyrate (0.5 mM)", "10 ng; 0.5 mM"),
        (labels.extract_dose, "cisplatin", ""),
        (labels.augmented_query, "pulmonary tissue", "lung"),
        (labels.augmented_query, "renal tissue", "kidney"),
        (labels.augmented_query, "lung", None),
        (labels.canonicalize, "Primary TNF-α cells (n=3), GSM123 rep 2", "tnf-alpha cells"),
        (labels.canonicalize, "Human Tissue", "human tissue"),
        (labels.canonicalize, "HeLa cell line", "hela"),
        (labels.blocking_key, "Vehicle control", "control vehicle"),
        (labels.fold_key, "Wild-type_2.0", "wildtype20"),
        (labels.spans, "Renal cell carcinoma; tumor;; Not Specified", ["Renal cell carcinoma", "tumor"]),
        (labels.treatment_spans, "a + b; c", ["a", "b", "c"]),
        (labels.char_keys, "Sex: F; age : 3 | sex: M", ["age", "sex"]),
        (labels.id_type, "CVCL_1, D02", "mesh"),
        (labels.id_group, "C012", "scr"),
        (labels.strip_label_prefix, "Answer: Tissue - x", "Tissue - x"),
        (labels.strip_label_prefix, "Label: Tissue: lung", "lung"),
        (labels.strip_artifacts, "lung [[ ## completed ]]", "lung"),
        (labels.safe_name, " a/b:c ", "a_b_c"),
        (labels.line_safe, "a\r\n\tb ", "a b"),
        (missing.normalize_ns, '"n/a"', "Not Specified"),
        (missing.normalize_ns, "'lung'", "lung"),
        (guards.fast_sex, "gender: F; age: 30", "female"),
        (guards.fast_sex, "sex (1=m): 1", None),
        (guards.fast_sex, "sex: M; gender: F", None),
        (guards.fast_sex, "sex: n/a\tgender: male.", "male"),
        (guards.fast_age, "age: 34", "years: 34"),
        (guards.fast_age, "age (weeks): 8", "weeks: 8"),
        (guards.fast_age, "age: 5 mo", "months: 5"),
        (guards.fast_age, "age group: 3", None),
        (guards.fast_age, "age: 130", None),
        (guards.age_class, "24hours", "non_age"),
        (guards.age_class, "adult", "descriptor"),
        (guards.age_class, "130", "implausible"),
        (guards.age_class, "age (mos): 2.8", "chronological"),
        (guards.age_class, "unknown", "not_specified"),
        (guards.recover_disease, "biopsy of human breast cancer", "human breast cancer"),
        (guards.control_condition, " Healthy controls", "Healthy Control"),
        (guards.generic_tissue, "Tumor", "Not Specified"),
    ],
)
def test_examples(spark, f, value, want):
    assert one(spark, f, value) == want


@pytest.mark.parametrize(
    "f,yes,no",
    [
        (labels.short_form, ["AD", "PBMCs"], ["MCF7", "tumor", "A", "ABCDEFG"]),
        (labels.short_form_alnum, ["AD", "MCF7", "PBMCs"], ["tumor", "A;B", "7AB"]),
        (labels.acronym_shaped, ["CLL", "mRNA"], ["Lung", "A", "7A"]),
        (labels.identifier_shaped, ["12-34", "HCT116", "123"], ["12", "a b1"]),
        (labels.is_junk, ["", "n/a", "--", "12", "x"], ["HCT116", "lung", "123"]),
        (guards.pure_qualifier, ["stage III", "grade 2", "pT3a tumor"], ["p53", "CD4", "lung", "stage"]),
        (guards.denied, ["diabetes: No", "x = 0"], ["diabetes: yes", "no"]),
        (guards.bare_control, ["healthy control", "WT"], ["normal lung cancer", ""]),
        (guards.sex_grounded, ["Sex: M", "two women", "patient: F"], ["female_like", "lung"]),
    ],
)
def test_predicates(spark, f, yes, no):
    assert [one(spark, f, v) for v in yes] == [True] * len(yes) and [bool(one(spark, f, v)) for v in no] == [False] * len(no)


@pytest.mark.parametrize(
    "value,want",
    [("female, control, 47y", "Female"), ("Sex: M", "Male"), ("male/female", "Mixed"), ("2", "Not Specified"), ("pooled", "Mixed"), (None, "Not Specified"), ("gender:", "Not Specified")],
)
def test_sex(spark, value, want):
    assert one(spark, guards.normalize_sex, value).value == want


@pytest.mark.parametrize(
    "value,want",
    [
        ("years: 45", ("45 years", "45", "years", "", "", "")),
        ("weeks: 8-10", ("8-10 weeks", "", "weeks", "8", "10", "")),
        ("adult", ("adult", "", "", "", "", "adult")),
        ("age: >= 18 years", (">= 18 years", "", "years", "18", "", "")),
        ("Not Specified", ("Not Specified", "", "", "", "", "")),
    ],
)
def test_age_parts(spark, value, want):
    assert tuple(one(spark, guards.age_parts, value)) == want


def test_verbatim(spark):
    assert one(spark, guards.verbatim, "5 mg/kg; lung carcinoma; tumor biopsy", "dose: 5mg/kg\nbiopsy of a tumor in the lung") == "5 mg/kg; tumor biopsy"
    assert one(spark, guards.verbatim, "kidney", "lung") == "Not Specified"


def test_dedup_cell(spark):
    got = one(spark, guards.dedup_cell, "A; B; A", "D1; D2; D1")
    assert (got.labels, got.ids) == ("A; B", "D1; D2")
    got = one(spark, guards.dedup_cell, "A; B", "D1")
    assert (got.labels, got.ids) == ("A; B", "D1")


def test_supported(spark):
    df = spark.createDataFrame([("sPTD", ["Preterm Delivery", "x"]), ("NSC", ["Lung"])], "a string, f array<string>")
    assert [r.x for r in df.select(guards.supports_acronym(F.col("a"), F.col("f")).alias("x")).collect()] == [True, False]


def test_marked_output(spark):
    text = "pre [[ ## tissue ## ]] lung [[ ## completed ## ]]"
    assert one(spark, lambda c: labels.marked_output(c, "tissue"), text) == "lung"
    assert one(spark, lambda c: labels.marked_output(c, "sex"), text) == "pre" and one(spark, lambda c: labels.marked_output(c, "sex"), " plain ") == "plain"


def test_mint(spark):
    assert one(spark, labels.mint_id, "Tissue", "abc") == one(spark, labels.mint_id, "Tissue", " ABC") == "OOV-T-0DA82BE8EE"


@pytest.mark.parametrize(
    "short,text,want",
    [
        ("CLL", "patients with chronic lymphocytic leukemia (CLL) and", "chronic lymphocytic leukemia"),
        ("CLL", "CLL (chronic lymphocytic leukemia) samples", "chronic lymphocytic leukemia"),
        ("MI", "after myocardial infarction (MI; clinical symptoms)", "myocardial infarction"),
        ("AD", "samples of AD (n=12)", None),
        ("lung", "the lung (lung)", None),
        ("AD", None, None),
    ],
)
def test_definitions(short, text, want):
    assert acronyms.find_definition(short, text) == want


def test_harvest_and_summary(spark):
    assert acronyms.harvest_definitions("chronic lymphocytic leukemia (CLL); AD (Alzheimer disease)") == [("CLL", "chronic lymphocytic leukemia"), ("AD", "Alzheimer disease")]
    cases = [
        (("T", "One. Two is here.", None), "Title: T. One. Two is here."),
        ((None, "A.", "des"), "A. Design: des"),
        (("x" * 600, None, None), "Title: " + "x" * 504 + "…"),
        (("T", "First fits. " + "y" * 600 + ". Third is short.", ""), "Title: T. First fits."),
        (("T", "S.", "d" * 900), "Title: T. S. Design: " + "d" * 489),
        ((None, None, None), ""),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "a string, b string, c string")
    assert [r.s for r in df.select(acronyms.study_summary(*map(F.col, "abc")).alias("s")).collect()] == [want for _, want in cases]


def test_definitions_travel_without_the_package(tmp_path):
    text = "chronic lymphocytic leukemia (CLL)"
    for f, args, want in [(acronyms.harvest_definitions, (text,), [("CLL", text[:-6])]), (acronyms.find_definition, ("CLL", text), text[:-6])]:
        run = "import sys; from pyspark import cloudpickle; f, args = cloudpickle.load(sys.stdin.buffer); print(f(*args), 'sievework' in sys.modules)"
        there = subprocess.run([sys.executable, "-I", "-c", run], input=cloudpickle.dumps((f, args)), capture_output=True, cwd=tmp_path)
        assert there.stdout.decode().strip() == f"{want} False", there.stderr.decode()


def test_definitions_of_frames(spark):
    rows = [(2**53 + 1, "chronic lymphocytic leukemia (CLL)"), (None, "AD (Alzheimer disease)"), (2**63 - 1, "myocardial infarction (MI) or MI (not one)"), (1, None), (2, "none (n=1)"), (3, "")]
    want = {(2**53 + 1, "CLL", "chronic lymphocytic leukemia"), (None, "AD", "Alzheimer disease"), (2**63 - 1, "MI", "myocardial infarction")}
    for parts in (1, len(rows)):  # all in one batch, and batches that define nothing
        df = spark.createDataFrame(rows, "id long, t string").repartition(parts)
        got = acronyms.definitions(df, "t", ["id"])
        assert got.columns == ["id", "short", "expansion"] and {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert acronyms.definitions(spark.createDataFrame([(1, "none (n=1)")], "id long, t string"), "t", ["id"]).count() == 0


def test_definitions_in_long_texts():
    began = time.time()
    assert acronyms.harvest_definitions("chronic lymphocytic leukemia (CLL) and other words " * 10_000) == [("CLL", "chronic lymphocytic leukemia")]
    assert acronyms.harvest_definitions("x " + "ab" * 500_000 + " (abc def)") == []
    assert acronyms.harvest_definitions("a" * 5_000 + " (AAAAAAAAAB)") == []
    assert time.time() - began < 10
