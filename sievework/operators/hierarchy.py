"""Hierarchies from parent-child links by tree contraction.

Nodes are numbered in the order of their ids. Rounds alternate two contractions on the links that are left, and record
what they take away:

* chain compression: a node with exactly one parent and one child is spliced out, its two links becoming one longer link.
  Of neighbouring chain nodes only local minima of a per-round hash go, so no two adjacent ones are spliced in one round;
* raking: a node without children leaves, with all its incoming links.

Rounds go on until no link is left or neither contraction finds anything, however few or many links there are. A loop that
shrinks to one node shows as a self-link, which is noted and taken away. Where rounds stop short, loops with several ways
in are left; nodes with a single parent or a single child are then spliced out, which never adds links, and rounds go on.
Only a core in which every node has two parents and two children resists that; it is solved by rounds of shortest ways and
of colouring.

The records are then replayed backwards: every node gets its roots and distances from the parents that it was recorded
with, which were there longer than the node itself; a spliced node lies on a loop if a parent and a child of it share one.

Defined results: links with a null end are no links, but the other end still is a node; repeated links count once; a node
with several parents gets a row for each root; nodes that no root reaches get no label; nodes of loops are listed in
``cyclic``. Empty input gives empty tables. Ids of any type come back as strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.skew import hubs, salted_join
from sievework.runtime import count_by, cut, release, setting

#: Kinds of rows of a round: links left, links of raked nodes, links into and out of spliced nodes, self-links.
EDGE, RAKED, INTO, OUT, LOOP = 0, 1, 2, 3, 4


@dataclass
class Hierarchy:
    """``labels``: (node, source, depth[, path]), one row for each root (or ancestor) that reaches the node, with the
    links of the shortest way; ``cyclic``: (node), the nodes that can be reached from themselves; ``rounds``: contractions done."""

    labels: DataFrame
    cyclic: DataFrame
    rounds: int


@dataclass
class _Work:
    """mode, and the nodes with so many children, or parents, that their rows are spread over several tasks (node -> parts)."""

    mode: str
    children: dict
    parents: dict

    @property
    def mid(self) -> list[str]:
        """With paths a link has the nodes spliced out of it; they are part of the paths that come out."""
        return ["mid"] if self.mode == "paths" else []


def contract(links: DataFrame, nodes: DataFrame | None = None, *, parent: str = "parent", child: str = "child", node: str = "node", mode: str = "roots") -> Hierarchy:
    """Roots, depths and loops of the graph of ``links`` (columns ``parent``, ``child``) and ``nodes``.

    mode ``roots``: labels are (node, source = root, depth). ``paths``: also ``path``, the ids from the root to the node on
    the shortest way (the first in string order among equals). ``descendants``: source runs over all ancestors of the node
    and the node itself, so grouping by source gives all its descendants.
    """
    if mode not in ("roots", "paths", "descendants"):
        raise ValueError(f"unknown mode {mode!r}")
    raw = links.select(F.col(parent).cast("string").alias("p"), F.col(child).cast("string").alias("c"))
    names, edges, loops, work = _numbered(raw, nodes, node, mode)
    # adaptive planning starts a thread of its own for each shuffle, which stays for a minute: over the rounds that is hundreds in
    # the driver. Hot keys are salted here, so the rounds do without it.
    with setting(links.sparkSession, "spark.sql.adaptive.enabled", "false"):
        labels, marks, rounds = _contracted(names, edges, loops, work)
    out = _named(labels, names, work)
    cyclic = marks.select(F.col("node").alias("id")).distinct().join(names.select("id", F.col("name").alias("node")), "id").select("node")
    return Hierarchy(out, cyclic, rounds)


def _contracted(names: DataFrame, edges: DataFrame, loops: DataFrame, work: _Work) -> tuple[DataFrame, DataFrame, int]:
    """Labels and loop marks by number, and the number of rounds, all materialized."""
    records, core = [], False
    n = {EDGE: edges.count()}
    while n.get(EDGE):
        step = _round(edges, len(records), work)
        n = count_by(step, "kind")
        if set(n) <= {EDGE}:
            step = cut(_eliminate(edges, len(records), work))
            n = count_by(step, "kind")
            if set(n) <= {EDGE}:
                core = True
                break
        if n.get(LOOP):
            loops = loops.union(step.filter(F.col("kind") == LOOP).select(F.col("p").alias("node")))
        records.append((step, bool(n.get(INTO))))
        edges = step.filter(F.col("kind") == EDGE).drop("kind")
        if len(records) % 4 == 0:
            release(names.sparkSession)
    loops = cut(loops.distinct())
    path = [F.array("node").alias("path")] if work.mode == "paths" else []
    own = (names if work.mode == "descendants" else names.filter("root")).select(F.col("id").alias("node"), F.col("id").alias("src"), F.lit(0).alias("d"))
    labels = own.select("*", *path)
    marks = loops.select("node", F.col("node").alias("src"))
    if core:
        labels, marks = _core_labels(cut(labels), edges, work), cut(marks.union(_components(edges)))
    if work.mode == "descendants":  # a node's pair with itself is added at the end
        labels = labels.filter("node <> src")
    labels, marks = _replay(labels, marks, records, work)
    if work.mode == "descendants":
        labels = labels.filter("node <> src").union(own)
    return labels, marks, len(records)


def _numbered(raw: DataFrame, nodes: DataFrame | None, node: str, mode: str) -> tuple:
    """The nodes (name, id, root), the links between different ones (p, c, w) by number, the self-linked ones, and what rounds need to know."""
    raw = cut(raw.distinct())
    whole = F.col("p").isNotNull() & F.col("c").isNotNull()
    one = lambda ok: F.when(ok, 1).otherwise(0)
    ends = raw.select(F.col("p").alias("name"), one(whole).alias("below"), F.lit(0).alias("above")).union(raw.select("c", F.lit(0), one(whole)))
    if nodes is not None:
        ends = ends.union(nodes.select(F.col(node).cast("string"), F.lit(0), F.lit(0)))
    names = ends.filter("name is not null").groupBy("name").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    # sorted, so that numbers compare as the ids do
    names = cut(names.orderBy("name").select("name", F.monotonically_increasing_id().alias("id"), "below", "above", (F.col("above") == 0).alias("root")))
    total = raw.count()
    many = [hubs(names, "name", c, total) for c in ("below", "above")]
    ids = names.select("name", "id")
    edges = salted_join(raw.filter(whole), ids.select(F.col("name").alias("p"), F.col("id").alias("pi")), "p", many[0], ["c"])
    edges = salted_join(edges, ids.select(F.col("name").alias("c"), F.col("id").alias("ci")), "c", many[1], ["pi"])
    edges = cut(edges.select(F.col("pi").alias("p"), F.col("ci").alias("c"), F.lit(1).alias("w")))
    loops = edges.filter("p = c").select(F.col("p").alias("node"))
    work = _Work(mode, *[hubs(names, "id", c, total) for c in ("below", "above")])
    empty = [F.expr("cast(array() as array<long>)").alias("mid")] if work.mid else []
    return names, edges.filter("p <> c").select("p", "c", "w", *empty), loops, work


def _arm(work: _Work, w: str = "w", mid: str = "mid") -> list[Column]:
    return [F.col(w), *[F.col(mid) for _ in work.mid]]


def _round(edges: DataFrame, k: int, work: _Work) -> DataFrame:
    """One splicing and raking, materialized: a table (kind, p, c, w) of the links left, the self-links made and what was taken away."""
    mid = bool(work.mid)
    null = lambda t: F.lit(None).cast(t)
    arrays = lambda a, b: [a.alias("mid_in"), b.alias("mid_out")] if mid else []
    no = null("array<long>")
    ends = edges.select(F.col("c").alias("v"), F.lit(1).alias("n_in"), F.lit(0).alias("n_out"), F.col("p").alias("u"), null("long").alias("x"), F.col("w").alias("w_in"), null("int").alias("w_out"), *arrays(F.col("mid") if mid else no, no))
    ends = ends.union(edges.select("p", F.lit(0), F.lit(1), null("long"), "c", null("int"), "w", *arrays(no, F.col("mid") if mid else no)))
    # of a chain node, which has one link each way, the least is the one
    nodes = ends.groupBy("v").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), *[F.min(c).alias(c) for c in ("u", "x", "w_in", "w_out")], *([F.min(c).alias(c) for c in ("mid_in", "mid_out")] if mid else []))
    nodes = nodes.filter("n_out = 0 or (n_in = 1 and n_out = 1)").persist()
    chain = nodes.filter("n_out = 1").drop("n_in", "n_out")
    rank = lambda v: F.xxhash64(F.col(v), F.lit(k % 2))  # two hashes in turn: compiled plans serve again
    rivals = chain.select(F.explode(F.array("u", "x")).alias("v"), rank("v").alias("rival"))
    of_chain = [c for c in chain.columns if c != "v"]
    met = chain.withColumn("rival", null("long")).unionByName(rivals, allowMissingColumns=True).groupBy("v").agg(*[F.min(c).alias(c) for c in of_chain], F.min("rival").alias("rival"))
    gone = met.filter(F.col("u").isNotNull() & (F.col("rival").isNull() | (rank("v") < F.col("rival")))).drop("rival").persist()
    link = lambda p, c, w, gone, m=None: F.struct(F.col(p).alias("p"), F.col(c).alias("c"), w.alias("w"), F.lit(gone).alias("gone"), *([m.alias("mid")] if mid else []))
    joined = F.concat("mid_in", F.array("v"), "mid_out") if mid else None
    change = gone.select(F.inline(F.array(link("u", "x", F.col("w_in") + F.col("w_out"), 0, joined), link("u", "v", null("int"), 1, no), link("v", "x", null("int"), 1, no))))
    # the links of a spliced node exist once, so a removal row takes its pair away as a whole
    left = edges.withColumn("gone", F.lit(0)).unionByName(change).groupBy("p", "c").agg(F.min("w").alias("w"), F.max("gone").alias("gone"), *([F.min(F.when(F.col("gone") == 0, F.struct("w", "mid")))["mid"].alias("mid")] if mid else []))
    leaves = nodes.filter("n_out = 0").select(F.col("v").alias("c"), F.lit(RAKED).alias("leaf"))
    left = salted_join(left.filter("gone = 0"), leaves, "c", work.parents, ["p"], "left")
    left = left.select(F.when(F.col("p") == F.col("c"), LOOP).otherwise(F.coalesce("leaf", F.lit(EDGE))).alias("kind"), "p", "c", *_arm(work))
    record = lambda kind, p, c, side: F.struct(F.lit(kind).alias("kind"), F.col(p).alias("p"), F.col(c).alias("c"), F.col(f"w_{side}").alias("w"), *([F.col(f"mid_{side}").alias("mid")] if mid else []))
    done = cut(left.union(gone.select(F.inline(F.array(record(INTO, "u", "v", "in"), record(OUT, "v", "x", "out"))))))
    nodes.unpersist()
    gone.unpersist()
    return done


def _eliminate(edges: DataFrame, k: int, work: _Work) -> DataFrame:
    """Where rounds find nothing: nodes with one parent or one child are spliced out, no two adjacent ones. Each has at most
    as many links as before afterwards, so links get fewer."""
    ends = edges.select(F.col("c").alias("v"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("p", F.lit(0), F.lit(1)))
    able = ends.groupBy("v").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).filter("least(i, o) = 1").select("v")
    rank = lambda v: F.xxhash64(F.col(v), F.lit(k % 2))
    both = edges.join(able.select(F.col("v").alias("p")), "p").join(able.select(F.col("v").alias("c")), "c")
    rivals = both.select(F.col("p").alias("v"), rank("c").alias("rival")).union(both.select("c", rank("p"))).groupBy("v").agg(F.min("rival").alias("rival"))
    gone = cut(able.join(rivals, "v", "left").filter(F.col("rival").isNull() | (rank("v") < F.col("rival"))).select("v"))
    into = cut(salted_join(edges, gone.withColumnRenamed("v", "c"), "c", work.parents, ["p"]).select(F.lit(INTO).alias("kind"), "p", "c", *_arm(work)))
    out = cut(salted_join(edges, gone.withColumnRenamed("v", "p"), "p", work.children, ["c"]).select(F.lit(OUT).alias("kind"), "p", "c", *_arm(work)))
    a = into.select(F.col("p").alias("u"), F.col("c").alias("v"), F.col("w").alias("w_in"), *[F.col("mid").alias("mid_in") for _ in work.mid])
    b = out.select(F.col("p").alias("v"), F.col("c").alias("x"), F.col("w").alias("w_out"), *[F.col("mid").alias("mid_out") for _ in work.mid])
    longer = a.join(b, "v").select(F.col("u").alias("p"), F.col("x").alias("c"), (F.col("w_in") + F.col("w_out")).alias("w"), *[F.concat("mid_in", F.array("v"), "mid_out").alias("mid") for _ in work.mid])
    kept = edges.join(gone.withColumnRenamed("v", "p"), "p", "left_anti").join(gone.withColumnRenamed("v", "c"), "c", "left_anti").select("p", "c", *_arm(work))
    left = kept.union(longer).groupBy("p", "c").agg(F.min("w").alias("w"), *[F.min(F.struct("w", "mid"))["mid"].alias("mid") for _ in work.mid])
    return left.select(F.when(F.col("p") == F.col("c"), LOOP).otherwise(EDGE).alias("kind"), "p", "c", *_arm(work)).union(into).union(out)


def _reach(labels: DataFrame, links: DataFrame, work: _Work) -> DataFrame:
    """Labels of the links' children, by one step from labelled parents; the shortest way each."""
    at = salted_join(links, labels.withColumnRenamed("node", "p"), "p", work.children, ["c"])
    hops = at.select(F.col("c").alias("node"), "src", (F.col("d") + F.col("w")).alias("d"), *[F.concat("path", "mid", F.array("c")).alias("path") for _ in work.mid])
    return hops.groupBy("node", "src").agg(*_best(work))


def _best(work: _Work) -> list[Column]:
    return [F.min("d").alias("d")] + [F.min(F.struct("d", "path"))["path"].alias("path") for _ in work.mid]


def _core_labels(labels: DataFrame, edges: DataFrame, work: _Work) -> DataFrame:
    """Labels within the core, which has no leaf to start from: shortest ways from the labelled nodes, by rounds of improved labels."""
    key, front = ["node", "src"], labels
    while True:
        new = _reach(front, edges, work)
        old = labels.select(*key, F.col("d").alias("d0"), *[F.col("path").alias("path0") for _ in work.mid])
        better = F.col("d0").isNull() | (F.col("d") < F.col("d0"))
        if work.mid:
            better = better | ((F.col("d") == F.col("d0")) & (F.col("path") < F.col("path0")))
        front = cut(new.join(old, key, "left").filter(better).select(*labels.columns))
        if front.isEmpty():
            return labels
        labels = cut(labels.union(front).groupBy(*key).agg(*_best(work)))


def _components(edges: DataFrame) -> DataFrame:
    """(node, src): the core's nodes that lie on loops, each with its component's name, by forward colouring and backward collection."""
    edges = edges.select("p", "c")
    found = None
    while True:
        before = edges.count()
        while before:  # what hangs above loops is no part of them
            edges = cut(edges.join(edges.select(F.col("c").alias("p")).distinct(), "p", "left_semi"))
            edges = cut(edges.join(edges.select(F.col("p").alias("c")).distinct(), "c", "left_semi"))
            after = edges.count()
            if after == before:
                break
            before = after
        if not before:
            return found if found is not None else edges.select(F.col("p").alias("node"), F.col("c").alias("src"))
        colour = cut(edges.select(F.col("p").alias("node")).distinct().withColumn("colour", F.col("node")))
        front = colour
        while not front.isEmpty():
            sent = edges.join(front.withColumnRenamed("node", "p"), "p").groupBy(F.col("c").alias("node")).agg(F.max("colour").alias("sent"))
            front = cut(sent.join(colour, "node").filter("sent > colour").select("node", F.col("sent").alias("colour")))
            colour = cut(colour.union(front).groupBy("node").agg(F.max("colour").alias("colour")))
        inside = colour.filter("node = colour")
        front = inside
        while not front.isEmpty():
            back = edges.join(front.withColumnRenamed("node", "c"), "c").select(F.col("p").alias("node"), "colour").distinct()
            front = cut(back.join(colour, ["node", "colour"]).join(inside, "node", "left_anti"))
            inside = cut(inside.union(front))
        several = inside.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("colour")
        part = cut(inside.join(several, "colour").select("node", F.col("colour").alias("src")))
        found = part if found is None else found.union(part)
        gone = inside.select("node")
        edges = cut(edges.join(gone.withColumnRenamed("node", "p"), "p", "left_anti").join(gone.withColumnRenamed("node", "c"), "c", "left_anti"))


def _replay(labels: DataFrame, marks: DataFrame, records: list[tuple[DataFrame, bool]], work: _Work) -> tuple[DataFrame, DataFrame]:
    """Undo the contractions, last first: labels (node, src, d) and marks (node, src = a name of its loops), which in between
    are labels of depth -1. Only the nodes that a round took away get new rows."""
    any_marks = not marks.isEmpty()
    no_path = [F.lit(None).cast("array<long>").alias("path") for _ in work.mid]
    state = cut(labels.union(marks.select("node", "src", F.lit(-1).alias("d"), *no_path)))
    kind, most = F.col("kind"), int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for i, (step, spliced) in enumerate(reversed(records)):
        if i % 4 == 0:
            release(labels.sparkSession)
        at = state.filter("d >= 0")
        if work.mode == "descendants":
            new = _undone_pairs(at, step, spliced, work)
        else:
            new = _reach(at, step.filter(kind.isin(RAKED, INTO)).drop("kind"), work).select(*labels.columns)
        if spliced and any_marks:
            on = state.filter("d < 0").select("node", "src")
            above = salted_join(step.filter(kind == INTO).select("p", "c"), on.withColumnRenamed("node", "p"), "p", work.children, ["c"]).select(F.col("c").alias("node"), "src")
            below = salted_join(step.filter(kind == OUT).select("p", "c"), on.withColumnRenamed("node", "c"), "c", work.parents, ["p"]).select(F.col("p").alias("node"), "src")
            new = new.union(above.join(below, ["node", "src"], "left_semi").distinct().select("node", "src", F.lit(-1).alias("d"), *no_path))
        state = cut(state.union(new).coalesce(most))
    return state.filter("d >= 0"), state.filter("d < 0").select("node", "src")


def _undone_pairs(at: DataFrame, step: DataFrame, spliced: bool, work: _Work) -> DataFrame:
    """The pairs (node, src = ancestor) that a round's nodes add: raked ones hang below their parents and those' ancestors,
    spliced ones stand above their children and what these reach, and below their parents and what reaches these."""
    kind = F.col("kind")

    def below(pairs: DataFrame, links: DataFrame) -> DataFrame:
        return _reach(pairs.union(links.select(F.col("p").alias("node"), F.col("p").alias("src"), F.lit(0).alias("d")).distinct()), links, work)

    raked = below(at, step.filter(kind == RAKED).drop("kind"))
    if not spliced:
        return raked
    raked = cut(raked)
    at = at.union(raked)
    out = step.filter(kind == OUT).select("p", F.col("c").alias("src"), "w")
    over = at.join(out, "src").select("node", F.col("p").alias("src"), (F.col("d") + F.col("w")).alias("d")).union(out.select("src", "p", "w"))
    over = cut(over.groupBy("node", "src").agg(F.min("d").alias("d")))
    under = below(at.union(over), step.filter(kind == INTO).drop("kind"))
    return raked.union(over).union(under)


def _named(labels: DataFrame, names: DataFrame, work: _Work) -> DataFrame:
    """The labels with ids in place of numbers. A source may hold most of the rows."""
    sizes = cut(labels.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    ids = names.select("id", "name")
    sources = sizes.select(F.col("id").alias("src")).join(ids.select(F.col("id").alias("src"), F.col("name").alias("source")), "src")
    out = salted_join(labels, sources, "src", hubs(sizes, "id", "n", total), ["node"])
    out = out.join(ids.select(F.col("id").alias("node"), F.col("name").alias("to")), "node")
    if not work.mid:
        return out.select(F.col("to").alias("node"), "source", F.col("d").alias("depth"))
    steps = out.select("node", "src", "to", "source", "d", F.posexplode("path").alias("at", "id")).join(ids, "id")
    path = F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: s["name"])
    steps = steps.groupBy("node", "src").agg(F.first("to").alias("to"), F.first("source").alias("source"), F.first("d").alias("d"), path.alias("path"))
    return steps.select(F.col("to").alias("node"), "source", F.col("d").alias("depth"), "path")
