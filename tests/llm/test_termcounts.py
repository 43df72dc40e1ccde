import random
from collections import defaultdict

from sievework.llm.termcounts import TermCounts, mark_terms

SCHEMA = "src string, term string, record string, occ long, sign int"


def brute(rows):
    cells = defaultdict(lambda: [0, 0])
    for src, term, rec, occ, sign in rows:
        if None not in (src, term, rec):
            cells[src, term, rec][0] += (occ or 0) * sign
            cells[src, term, rec][1] += sign
    terms, records = defaultdict(lambda: [0, 0]), set()
    for (src, term, rec), (occ, n) in cells.items():
        terms[src, term][0] += occ
        if n > 0:
            terms[src, term][1] += 1
            records.add((src, rec))
    return {k: tuple(v) for k, v in terms.items() if v[1] > 0}, records


def state(store):
    return {(r.src, r.term): (r.occ, r.records) for r in store.terms().collect()}, {r.src: r.total for r in store.totals().collect()}


def test_increments_equal_a_full_count(spark, tmp_path):
    rnd = random.Random(4)
    store, seen = TermCounts(spark, str(tmp_path / "s"), buckets=4), []
    for batch in range(3):
        add = [("a", f"t{rnd.randrange(8)}", f"r{rnd.randrange(6)}", rnd.choice([1, 2, None]), 1) for _ in range(25)] + [("b", None, "r", 1, 1), (None, "t", "r", 1, 1), ("a", "t", None, 1, 1)]
        gone = [(*r[:4], -1) for r in rnd.sample(seen, 15)] if batch else []
        store.update(spark.createDataFrame(add + gone, SCHEMA))
        seen = [r for r in seen if (*r[:4], -1) not in gone] + [r for r in add if None not in r[:3]]
        all_rows = (all_rows if batch else []) + add + gone
        terms, records = brute(all_rows)
        got, totals = state(store)
        assert got == terms and totals.get("a") == len({r for s, r in records if s == "a"})


def test_deleting_everything_leaves_nothing_and_empty_changes_nothing(spark, tmp_path):
    store = TermCounts(spark, str(tmp_path / "s"), buckets=2)
    rows = [("a", "t", "r", 2, 1), ("a", "t", "r", 2, 1), ("a", "u", "q", 1, 1)]
    store.update(spark.createDataFrame([], SCHEMA))
    assert state(store) == ({}, {})
    store.update(spark.createDataFrame(rows, SCHEMA))
    store.update(spark.createDataFrame([], SCHEMA))
    assert state(store) == ({("a", "t"): (4, 1), ("a", "u"): (1, 1)}, {"a": 2})
    store.update(spark.createDataFrame([(*r[:4], -1) for r in rows], SCHEMA))
    assert state(store) == ({}, {})


def test_marks(spark):
    terms = spark.createDataFrame([("a", "x", 2, 2), ("a", "y", 9, 2), ("a", "z", 9, 1)], "src string, term string, occ long, records long")
    got = mark_terms(terms, spark.createDataFrame([("a", 100)], "src string, total long")).collect()
    assert {r.term: r["mark"] for r in got} == {"x": "rare", "y": "common", "z": None}
