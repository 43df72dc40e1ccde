from sievework.operators.imputation import fill_from_similar, k_prototypes


def test_centres_part_two_groups(spark):
    df = spark.createDataFrame([(float(i % 3), "a") for i in range(30)] + [(100.0 + i % 3, "b") for i in range(30)], "x double, c string")
    p = k_prototypes(df, ["x"], ["c"], k=2)
    assert sorted(round(c["n0"]) for c in p.centres) == [1, 101] and len({c["c0"] for c in p.centres}) == 2


def test_clusters_fill_and_the_group_stands_by(spark):
    """In one study two kinds of samples have two values: the cluster knows which, the group alone doesn't."""
    rows = [(i, "g", f"s{i}", "liver" if i % 2 else "lung", "x" if i % 2 else "y") for i in range(20)] + [(100, "g", "t0", None, "x"), (101, "g", "t1", None, "y"), (102, "g", "t2", None, None)]
    df = spark.createDataFrame(rows, "id int, g string, s string, v string, kind string")
    got = {r.id: (r.value, r.method, r.samples, r.agree, r.group_samples) for r in fill_from_similar(df, id_col="id", target="v", group=["g"], sample="s", categorical=["kind"], k=2).collect()}
    assert got[100] == ("liver", "cluster_mode", 10, 10, 20) and got[101] == ("lung", "cluster_mode", 10, 10, 20) and 102 in got


def test_median_of_similar_rows_where_the_group_has_none(spark):
    df = spark.createDataFrame([(1, "g", 5, 1.0), (2, "g", 5, 1.0), (3, "h", None, 1.0)], "id int, g string, n int, x double")
    assert [(r.id, r.value, r.method) for r in fill_from_similar(df, id_col="id", target="n", group=["g"], numeric=["x"], median=True).collect()] == [(3, 5.0, "similar_median")]


def test_mode_with_parent_fallback_and_flags(spark):
    rows = [(1, "g", "s1", "a", "u"), (2, "g", "s2", "a", "u"), (3, "g", "s3", "a", "v"), (4, "g", "s3", "a", "v"), (5, "g", "s4", None, "u"), (6, "h", "s5", "b", "u"), (7, "h", "s6", None, "u"), (8, None, "s7", None, "u")]
    df = spark.createDataFrame(rows, "id int, g string, s string, weight string, cluster string")
    got = {r.id: (r.value, r.method) for r in fill_from_similar(df, id_col="id", target="weight", group=["g"], sample="s", categorical=["cluster"], k=2).collect()}
    assert got == {5: ("a", "cluster_mode"), 7: ("b", "cluster_mode")}  # a null group fills nothing


def test_share_is_exact_and_ties_go_to_the_smaller(spark):
    rows = [(i, "g", "b" if i < 4 else "a") for i in range(5)] + [(9, "g", None), (20, "t", "y"), (21, "t", "x"), (22, "t", None)]
    df = spark.createDataFrame(rows, "id int, g string, v string")
    assert {r.id: (r.value, r.samples, r.agree, r.group_agree) for r in fill_from_similar(df, id_col="id", target="v", group=["g"]).collect() if r.id == 9} == {9: ("b", 5, 4, 4)}
    assert {r.id: r.value for r in fill_from_similar(df, id_col="id", target="v", group=["g"]).collect()} == {9: "b", 22: "x"}


def test_median(spark):
    df = spark.createDataFrame([(1, "g", 1), (2, "g", 3), (3, "g", 100), (4, "g", None)], "id int, g string, n int")
    assert [(r.id, r.value, r.method) for r in fill_from_similar(df, id_col="id", target="n", group=["g"], median=True).collect()] == [(4, 3.0, "cluster_median")]


def test_empty(spark):
    df = spark.createDataFrame([], "id int, g string, v string")
    assert fill_from_similar(df, id_col="id", target="v", group=["g"], categorical=["v"]).count() == 0
