import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm.linking import Dictionary, Wording, allowed, deletions, learn_wording, link_labels, readings, weighted_distance

REFERENCE = [
    ("Muscle, Midapalk", "Tissue", "A1", 3),
    ("Midapalk Muscle", "Tissue", "A1", 3),
    ("Midapalk tissue", "Tissue", "A1", 3),
    ("Surchoitis, Type 2", "Condition", "C2", 1),
    ("Surchoitis, Type 3", "Condition", "C3", 9),
    ("Yaeplaerleuamab", "Treatment", "D1", 0),
    ("YAB", "Treatment", "D1", 0),
    ("Raenio Hydrochloride", "Treatment", "D2", 0),
    ("ZR-2833", "Tissue", "L1", 0),
    ("ZR-2834", "Tissue", "L2", 0),
    ("Quanpe Disorder", "Condition", "C4", 0),
]


WORDING = Wording(frozenset("frozen human left patients treated with mg kg h cells cell sample line low dose".split()), {"dis": ("disease", "disorder")})


@pytest.mark.parametrize(
    "label,group,want",
    [
        ("midapalk muscle", "Tissue", "A1"),
        ("MUSCLE_MIDAPALK", "Tissue", "A1"),
        ("[frozen midapálk\tmuscles ]", "Tissue", "A1"),
        ("CD33+ human midapalkmuscle (left)", "Tissue", "A1"),
        ("midaplak mucsle", "Tissue", "A1"),
        ("surchoitis type 3 patients", "Condition", "C3"),
        ("surchoitsi, type 2?", "Condition", "C2"),
        ("Y.A.B.s", "Treatment", "D1"),
        ("treated with raenio hydrochloride (5 mg/kg) 24 h", "Treatment", "D2"),
        ("zr2833 P8", "Tissue", "L1"),
        ("ZR 2834 cells", "Tissue", "L2"),
        ("quanpe dis.", "Condition", "C4"),
        ("midapalk muscle", "Condition", None),
        ("surchoitis type 4", "Condition", None),
        ("ZR-2835", "Tissue", None),
        ("sample 26", "Tissue", None),
        ("YAC", "Treatment", None),
        ("", "Tissue", None),
        (None, "Tissue", None),
    ],
)
def test_labels(label, group, want):
    hit = Dictionary(REFERENCE, 3, WORDING).best(label, group)
    assert (hit and hit[2]) == want


def test_distance():
    assert weighted_distance("abcd", "abdc", 3) == 0.8 and weighted_distance("abcd", "abccd", 3) == 0.8 and weighted_distance("abcd", "abxd", 3) == 1
    assert weighted_distance("xbcd", "abcd", 3) == 1.5 and weighted_distance("abcd", "wxyz", 2) == float("inf")


def test_close_strings_share_a_deletion():
    assert deletions("midapalkmuscle", 2) & deletions("midaplakmuscle", 2) and deletions("xidapalkmuscle", 1) & deletions("midapalkmuscle", 1)


WORDS = st.text("abcd", min_size=6, max_size=18)


@settings(max_examples=300, deadline=None)
@given(WORDS, st.lists(st.tuples(st.sampled_from("drsi"), st.integers(0, 17), st.sampled_from("abcd")), max_size=4))
def test_every_pair_within_the_distance_is_found(word, edits):
    """Deleting, replacing, swapping and inserting letters: whatever is near enough comes out of the index."""
    other = word
    for kind, at, c in edits:
        at = min(at, len(other) - 1)
        other = {"d": other[:at] + other[at + 1 :], "r": other[:at] + c + other[at + 1 :], "s": other[:at] + other[at : at + 2][::-1] + other[at + 2 :], "i": other[:at] + c + other[at:]}[kind] or c
    index = Dictionary([(word, "g", "id", 0)])
    most = min(allowed(word, 3), allowed(other, 3))
    near = weighted_distance(other, word, most) != float("inf")
    assert not near or index.best(other, "g") is not None


def test_four_swaps_are_more_than_three_edits():
    assert weighted_distance("abcdefghijklmnop", "badcfehgijklmnop", 3) == float("inf")


def test_wording_is_learned_from_resolved_labels(spark):
    names = [(f"{x}lumo Disease", "C", f"d{x}", 0) for x in "abcdefghijkl"] + [(f"{x}nero Disorder", "C", f"e{x}", 0) for x in "abcdefghijkl"]
    ref = spark.createDataFrame(names, "name string, grp string, ref_id string, weight long")
    rows = [(f"severe {x}lumo disease", "C", f"D{x}") for x in "abcd"] + [(f"{x}lumo dz", "C", f"d{x}") for x in "efg"] + [(f"severe {x}nero dz", "C", f"e{x}") for x in "abc"]
    rows += [("odd alumo disease", "C", "da"), (None, "C", "da"), ("x", None, "da"), ("alumo disease", "C", None)]
    got = learn_wording(spark.createDataFrame(rows, "label string, grp string, ref_id string"), ref)
    assert got.words == {"severe"} and got.short == {"dz": ("disease", "disorder")}
    assert ["hlumo", "disease"] in readings("SEVERE hlumo-dz", got) and ["hlumo", "disorder"] in readings("SEVERE hlumo-dz", got)
    df = spark.createDataFrame([(1, "severe hlumo dz", "C"), (2, "severehnero disorder", "C")], "id int, label string, grp string")
    assert {r.id: r.ref_id for r in link_labels(df, ref, label="label", group="grp", keep=["id"], wording=got).collect()} == {1: "dh", 2: "eh"}
    assert learn_wording(spark.createDataFrame([], "label string, grp string, ref_id string"), ref) == Wording()


@pytest.mark.parametrize("max_entries", [1000, 3])
def test_frame_in_one_block_and_in_several(spark, max_entries):
    ref = spark.createDataFrame([*REFERENCE, (None, "Tissue", "X", 1), ("x", None, "X", 1)], "name string, grp string, ref_id string, weight long")
    rows = [(1, "midaplak mucsle", "Tissue", "a"), (1, "midaplak mucsle", "Tissue", "a"), (2, None, "Tissue", "b"), (3, "surchoitis type 3", "Condition", None), (4, "y" * 50_000, "Tissue", None), (5, "yab", None, None)]
    df = spark.createDataFrame(rows, "label int, text string, grp string, ref_id string")
    got = link_labels(df, ref, label="text", group="grp", keep=["label"], max_entries=max_entries).collect()
    assert sorted((r.label, r.ref_id) for r in got) == [(1, "A1"), (1, "A1"), (2, "unmatched"), (3, "C3"), (4, "unmatched"), (5, "unmatched")]
    assert link_labels(df.limit(0), ref, label="text", group="grp", keep=["label"]).count() == 0


def test_empty_reference(spark):
    ref = spark.createDataFrame([], "name string, grp string, ref_id string, weight long")
    df = spark.createDataFrame([(1, "a", "Tissue")], "id int, text string, grp string")
    assert [r.ref_id for r in link_labels(df, ref, label="text", group="grp", keep=["id"]).collect()] == ["unmatched"]
