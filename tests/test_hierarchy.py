import random

import pytest

from sievework.operators.hierarchy import contract


def brute(links):
    links = {(a, b) for a, b in links if a is not None and b is not None}
    below = {}
    for a, b in links:
        below.setdefault(a, set()).add(b)
    nodes = {x for e in links for x in e}
    ways = {}
    for r in nodes:
        d, front = {r: 0}, [r]
        while front:
            nxt = [y for x in front for y in below.get(x, ()) if y not in d]
            for y in nxt:
                d[y] = min(d.get(y, 1 << 30), d[next(x for x in front if y in below.get(x, ()))] + 1)
            front = list(dict.fromkeys(nxt))
        ways.update({(n, r): k for n, k in d.items()})
    cyclic = {a for a in nodes if any((a, y) in ways for y in below.get(a, ()))}
    roots = nodes - {b for _, b in links}
    return ways, cyclic, roots


def some_links(seed, n=40):
    rnd = random.Random(seed)
    out = {(f"n{rnd.randint(max(0, i - 3), i - 1)}", f"n{i}") for i in range(1, n) if rnd.random() < 0.9}
    return sorted(out | {(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(6)})


@pytest.mark.parametrize("seed", [3, 4])
def test_against_breadth_first_search(spark, seed):
    links = some_links(seed)
    ways, cyclic, roots = brute(links)
    df = spark.createDataFrame(links, "parent string, child string")
    h = contract(df)
    assert {(r.node, r.source): r.depth for r in h.labels.collect()} == {k: v for k, v in ways.items() if k[1] in roots}
    assert {r.node for r in h.cyclic.collect()} == cyclic


def test_descendants_and_paths(spark):
    links = some_links(5)
    ways, _, roots = brute(links)
    df = spark.createDataFrame(links, "parent string, child string")
    got = contract(df, mode="descendants").labels.collect()
    assert {(r.node, r.source): r.depth for r in got} == ways and len(got) == len(ways)
    for r in contract(df, mode="paths").labels.collect():
        assert r.path[0] == r.source and r.path[-1] == r.node and len(r.path) == r.depth + 1
        assert all(e in links for e in zip(r.path, r.path[1:]))


def test_long_chain_takes_few_rounds(spark):
    n = 120
    df = spark.createDataFrame([(f"c{i:04}", f"c{i + 1:04}") for i in range(n)], "parent string, child string")
    h = contract(df)
    assert {r.node: r.depth for r in h.labels.collect()} == {f"c{i:04}": i for i in range(n + 1)}
    assert h.rounds < 40


def test_nulls_repeats_lone_nodes_and_clashing_columns(spark):
    rows = [("a", "b", 1, "x"), ("a", "b", 2, "y"), (None, "c", 3, "z"), ("d", None, 4, None), (None, None, 5, "q"), ("e", "e", 6, "s")]
    df = spark.createDataFrame(rows, "parent string, child string, node int, path string")
    h = contract(df, spark.createDataFrame([("lone",), (None,)], "node string"))
    assert {(r.node, r.source, r.depth) for r in h.labels.collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "c", 0), ("d", "d", 0), ("lone", "lone", 0)}
    assert [r.node for r in h.cyclic.collect()] == ["e"]


def test_empty(spark):
    h = contract(spark.createDataFrame([], "parent string, child string"))
    assert h.labels.count() == 0 and h.cyclic.count() == 0


def test_core_that_resists_contraction(spark):
    """Every node has two parents and two children at least, and one root hangs above."""
    ring = [f"r{i}" for i in range(6)]
    links = [(a, b) for a in ring for b in ring if a != b] + [("top", "r0"), ("top", "r3"), ("r5", "leaf")]
    ways, cyclic, _ = brute(links)
    df = spark.createDataFrame(links, "parent string, child string")
    h = contract(df)
    assert {(r.node, r.source): r.depth for r in h.labels.collect()} == {k: v for k, v in ways.items() if k[1] == "top"}
    assert {r.node for r in h.cyclic.collect()} == cyclic == set(ring)
    got = contract(df, mode="descendants").labels.collect()
    assert {(r.node, r.source): r.depth for r in got} == ways and len(got) == len(ways)


def test_parent_with_very_many_children_is_spread(spark, monkeypatch):
    import sievework.operators.hierarchy as hierarchy
    from sievework.operators import skew

    monkeypatch.setattr(hierarchy, "hubs", lambda *a: skew.hubs(*a, least=20))
    links = [("hub", f"c{i:03}") for i in range(150)] + [(f"c{i:03}", f"d{i:03}") for i in range(0, 150, 3)] + [(f"d{i:03}", "sink") for i in range(0, 150, 3)]
    ways, cyclic, roots = brute(links)
    h = contract(spark.createDataFrame(links, "parent string, child string"))
    assert {(r.node, r.source): r.depth for r in h.labels.collect()} == {k: v for k, v in ways.items() if k[1] in roots}
    assert h.cyclic.count() == 0
