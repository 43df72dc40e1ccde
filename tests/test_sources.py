import json

import pytest
from pyspark.sql import functions as F

from sievework.sources import catalogue, sinks, vocabularies
from sievework.streaming import increments

XML = """<Set><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Lung</String></DescriptorName>
<TreeNumberList><TreeNumber>A04.411</TreeNumber><TreeNumber>C1.2.3</TreeNumber></TreeNumberList>
<ConceptList><Concept><TermList><Term><String>Lung</String></Term><Term><String>Pulmonary Tissue</String></Term></TermList></Concept></ConceptList></DescriptorRecord>
<DescriptorRecord><DescriptorUI>D2</DescriptorUI><DescriptorName><String>Chest Organs</String></DescriptorName><TreeNumberList><TreeNumber>A04</TreeNumber></TreeNumberList></DescriptorRecord></Set>"""
LINES = "ID   HeLa\nAC   CVCL_0030\nSY   He La; HELA\nOX   NCBI_TaxID=9606; ! Homo sapiens (Human)\nSX   Female\n//\nID   X9\nAC   CVCL_9\nOX   NCBI_TaxID=1; ! Mus musculus (Mouse)\nOX   NCBI_TaxID=2; ! Rattus (Rat)\n//\n"


def test_descriptor_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    d = vocabularies.read_descriptors(spark, str(tmp_path / "d.xml"))
    vocab = {(r.term, r.mesh_id, r.kind, r.category) for r in vocabularies.flat_vocabulary(d).collect()}
    assert vocab == {("Lung", "D1", "descriptor", "A"), ("Pulmonary Tissue", "D1", "entry", "A"), ("Chest Organs", "D2", "descriptor", "A")}
    tree, parent = vocabularies.tree_tables(d)
    assert tree.count() == 3 and [tuple(r) for r in parent.collect()] == [("D2", "D1")]
    with pytest.raises(ValueError, match="at least"):
        vocabularies.flat_vocabulary(d, at_least=10)


def test_cell_lines(spark, tmp_path):
    (tmp_path / "c.txt").write_text(LINES)
    got = {tuple(r) for r in vocabularies.read_cell_lines(spark, str(tmp_path / "c.txt")).collect()}
    assert {(n, "CVCL_0030", "HeLa", "Homo sapiens (Human)", "Female") for n in ("HeLa", "He La", "HELA")} <= got
    assert ("X9", "CVCL_9", "X9", "Mus musculus (Mouse);Rattus (Rat)", None) in got


def test_catalogue(spark, tmp_path):
    df = spark.createDataFrame([("GSM1", "GPL1", "t", "z")], "gsm string, gpl string, title string, other string")
    assert catalogue.scan_samples(df, ["other"]).columns == ["gsm", "gpl", "title", "other"]
    with pytest.raises(ValueError, match="nope"):
        catalogue.scan_samples(df, ["nope"])
    studies = spark.createDataFrame([("GSE1", "t", "s", "d")], "gse string, title string, summary string, design string")
    assert catalogue.scan_studies(studies).first().gse_design == "d"
    (tmp_path / "list.csv").write_text("﻿gsm1,x\nGSM22\nother\n")
    assert sorted(r.id for r in catalogue.read_manifest(spark, str(tmp_path / "list.csv"), "GSM").collect()) == ["GSM1", "GSM22"]
    many = spark.createDataFrame([("GSM1", "GPL1"), ("GSM2", "GPL2"), ("GSM3", "GPL3")], "gsm string, gpl string")
    gpl = spark.createDataFrame([("GPL1", "RNA-seq", "Homo"), ("GPL2", "array", "Homo")], "gpl string, technology string, organism string")
    both = catalogue.select_samples(many, platforms=many.filter("gpl = 'GPL1'"), accessions=many.filter("gsm = 'GSM2'"), gpl=gpl, technology="rna")
    assert [r.gsm for r in both.collect()] == ["GSM1"]


def test_shards_and_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"gsm": "1", "x": "a"}]))
    (tmp_path / "b.json").write_text(json.dumps({"samples": [{"gsm": "2", "x": None}, {"gsm": "3"}]}))
    (tmp_path / "c.partial.json").write_text(json.dumps([{"gsm": "9"}]))
    got = catalogue.read_shards(spark, str(tmp_path), "gsm: string, x: string")
    assert sorted(r.gsm for r in got.collect()) == ["1", "2", "3"]
    soft = spark.createDataFrame([("!Series_title = A\n!Series_summary = one\n!Series_summary = two\n",)], "t string").select(catalogue.soft_fields(F.col("t")).alias("s")).first().s
    assert (soft.title, soft.summary, soft.design) == ("A", "one two", "")
    assert catalogue.populated_stage(spark.createDataFrame([(None, "x")], "phase1b string, phase1 string"), ["phase1b", "phase1"]) == "phase1"


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("g1", "GPL 1/x", "a\nb", "age: unknown")], "gsm string, gpl string, Tissue string, Age string")
    b = spark.createDataFrame([("g2", None, "n/a", "age: 3")], a.schema)
    sinks.export_csv(a.unionByName(b), str(tmp_path / "x"))
    back = spark.read.option("header", True).csv(str(tmp_path / "x"))
    assert {(r.gsm, r.Tissue, r.platform) for r in back.collect()} == {("g1", "a b", "GPL_1_x"), ("g2", "n/a", "none")}
    whole, manifest = sinks.assemble([a, b], "gsm", ["Tissue", "Age"])
    assert whole.count() == 2 and tuple(manifest.first()) == (2, 1, 1)
    with pytest.raises(Exception, match="repeated gsm"):
        sinks.assemble([a, a], "gsm", ["Tissue"])[1].collect()
    with pytest.raises(ValueError, match="columns"):
        sinks.assemble([a, b.drop("Age")], "gsm", [])
    path = str(tmp_path / "stage")
    for k, v in ((1, "old"), (2, "new")):
        sinks.append_stage(spark.createDataFrame([("g1", v, k)], "gsm string, v string, seq int"), path)
    done = sinks.read_stage(spark, path, ["gsm"], "seq")
    assert [r.v for r in done.collect()] == ["new"] and [r.gsm for r in sinks.unfinished(whole, done, ["gsm"]).collect()] == ["g2"]
    told = sinks.decide(whole, spark.createDataFrame([("g1", "yes")], "gsm string, answer string"), ["gsm"], F.lit("abstain"))
    assert {r.gsm: r.answer for r in told.collect()} == {"g1": "yes", "g2": "abstain"}


def test_stream_of_new_samples(spark, tmp_path):
    schema = "gse string, gsm string, field string, value string"
    src, rows, counts = (str(tmp_path / x) for x in ("src", "rows", "counts"))

    def arrive(*r):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(src)
        increments.start(spark, src, schema, rows, counts, str(tmp_path / "ck")).awaitTermination()

    arrive(("s", "1", "Sex", "male"), ("s", "2", "Sex", "n/a"), ("s", "2", "Sex", "n/a"))
    arrive(("s", "1", "Sex", "female"), ("s", "3", "Sex", None), ("t", "9", "Sex", "male"))
    got = {(r.gse, r.field): (r.n_total, r.n_ns) for r in increments.latest_counts(spark, counts).collect()}
    assert got == {("s", "Sex"): (3, 2), ("t", "Sex"): (1, 0)}


def test_windows_of_events(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert increments.windowed_events(events).agg(F.sum("n")).first()[0] == events.count()
