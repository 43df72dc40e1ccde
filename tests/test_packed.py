import pytest

from sievework.operators.packed import CHARACTERISTICS, IDENTIFIERS, Grammar, split_packed


@pytest.mark.parametrize(
    "text,want",
    [
        ("age: 9; Stage: pT2, N0; x", [(1, "age: 9"), (2, "Stage: pT2, N0"), (3, "x")]),
        ('a: "he said ""ready""; then cut";\tb //c', [(1, 'a: he said "ready"; then cut'), (2, "b"), (3, "c")]),
        ('note: biopsy with 3" needle; a', [(1, 'note: biopsy with 3" needle'), (2, "a")]),
        ("; a;; b;", [(2, "a"), (4, "b")]),
        ("g : patient's own|age:'left; outer'", [(1, "g : patient's own"), (2, "age:left; outer")]),
        ("a\r\nb", [(1, "a"), (2, "b")]),
        ("batch: 4/12 / z", [(1, "batch: 4/12"), (2, "z")]),
        ('"age: see; step" // x', [(1, "age: see; step"), (2, "x")]),
        ("", []),
    ],
)
def test_characteristics(text, want):
    assert [(p, v) for p, v, _ in Grammar(CHARACTERISTICS).items(text)] == want


@pytest.mark.parametrize(
    "text,want",
    [
        ('["D1", "O2"]', [(1, "D1"), (2, "O2")]),
        ("['D1', 'O2']", [(1, "D1"), (2, "O2")]),
        ('"A\nB"', [(1, "A"), (2, "B")]),
        ('"D7";;"O1";"X"', [(1, "D7"), (3, "O1"), (4, "X")]),
        ("A + B|C; D/E & F", [(1, "A"), (2, "B"), (3, "C"), (4, "D"), (5, "E"), (6, "F")]),
        (" A B ", [(1, "A"), (2, "B")]),
        ("A |", [(1, "A")]),
    ],
)
def test_identifiers(text, want):
    assert [(p, v) for p, v, _ in Grammar(IDENTIFIERS).items(text)] == want


def test_unclosed_quote_is_flagged():
    assert list(Grammar(CHARACTERISTICS).items('a; "b; c')) == [(1, "a", None), (2, '"b', "unclosed_quote"), (3, "c", None)]


def test_frame_with_nulls_long_fields_repeats_and_clashing_names(spark):
    long = ";".join(f"k{i}: v" for i in range(20_000))
    rows = [(1, "a;b", "x"), (1, "a;b", "x"), (2, None, None), (3, "  ", "y"), (4, long, "z")]
    df = spark.createDataFrame(rows, "packed int, text string, k0 string")
    got = split_packed(df, "text", ["packed", "k0"], CHARACTERISTICS)
    assert got.columns == ["packed", "k0", "n_values", "pos", "val", "error"]
    out = got.collect()
    assert len(out) == 4 + 20_000 and sorted((r.packed, r.pos, r.val) for r in out if r.packed == 1) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert split_packed(df.limit(0), "text", ["packed"], CHARACTERISTICS).count() == 0


def test_a_megabyte_of_blanks_or_brackets_is_read_in_one_pass():
    import time

    began = time.time()
    n = 1_000_000
    assert [v for _, v, _ in Grammar(CHARACTERISTICS).items("a: b" + " " * n + "c")] == ["a: b" + " " * n + "c"]
    assert [v for _, v, _ in Grammar(CHARACTERISTICS).items("a: b" + " " * n + "; c")] == ["a: b", "c"]
    assert [v for _, v, _ in Grammar(IDENTIFIERS).items("[" * n + "X1, X2" + "]" * n)] == ["X1", "X2"]
    assert [v for _, v, _ in Grammar(IDENTIFIERS).items("X1" + " " * n + "X2")] == ["X1", "X2"]
    assert time.time() - began < 4
