from pyspark.sql import functions as F

from sievework.llm.dedup import content, duplicates


def canon(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.c for r in df.select("i", content(F.col("v")).alias("c")).orderBy("i").collect()]


def test_content(spark):
    got = canon(spark, ["CD4+ T cell; Lung", "lung|cd4+ t-cell", "lung; lung; cd4+tcell", "3.5 %", "35", "a-b", "ab", "Vor3+/-", "Vor3-/-", "Ünder (x)", "?!", None, "a\nb", "x."])
    assert got[0] == got[1] != got[2] and got[3] == "3.5%" and got[4] == "35" and got[5] == got[6]
    assert got[7] == "vor3+" and got[8] == "vor3-" and got[9] == "ünderx" and got[10] == "" and got[11] is None and got[12] == "a|b" and got[13] == "x"


def pairs(df, **kw):
    records, copies = duplicates(df, id_col="id", exact=["g"], text="t", **kw)
    return {(r.first_id, r.n_copies) for r in records.collect()}, {(r.first_id, r.copy_id) for r in copies.collect()}


def test_copies_with_hot_values_nulls_repeats_and_clashing_names(spark):
    rows = [(i, "g", "Hot Value" if i % 2 else "hot-value", "x") for i in range(60)]
    rows += [(100, "h", "hot value", None), (101, None, "a;b", None), (102, None, "B | a", None), (103, "g", None, None), (104, "g", None, None), (105, "g", "", None), (106, "g", "z" * 40_000, None), (107, "g", "Z" * 40_000, None)]
    df = spark.createDataFrame(rows, "id long, g string, t string, value string")
    for hot in (1000, 2):
        records, copies = pairs(df, hot=hot)
        assert copies == {(0, i) for i in range(1, 60)} | {(101, 102), (103, 104), (106, 107)}
        assert records == {(0, 60), (100, 1), (101, 2), (103, 2), (105, 1), (106, 2)}


def test_empty(spark):
    assert pairs(spark.createDataFrame([], "id long, g string, t string")) == (set(), set())
