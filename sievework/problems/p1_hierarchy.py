"""Problem 1: concept hierarchies of mesh_parent and mesh_tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import blank_to_null, strip
from sievework.operators.hierarchy import Hierarchy, contract
from sievework.sources.tables import table


def _id(col: str) -> Column:
    return blank_to_null(F.upper(strip(col)))


def links_and_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links (parent, child) of both tables, and all ids (node). A concept at tree number a.b.c hangs under those at a.b."""
    given = table(spark, sf_dir, "mesh_parent").select(_id("parent_id").alias("parent"), _id("child_id").alias("child"))
    number = blank_to_null(strip(F.regexp_replace(F.upper(strip("tree_number")), r"\.$", "")))
    held = table(spark, sf_dir, "mesh_tree").select(number.alias("at"), _id("mesh_id").alias("node")).filter("node is not null").distinct()
    below = held.filter("at like '%.%'").select(F.regexp_extract("at", r"^(.*)\.[^.]*$", 1).alias("at"), F.col("node").alias("child"))
    placed = below.join(held.filter("at is not null").withColumnRenamed("node", "parent"), "at").select("parent", "child")
    return given.union(placed), held.select("node")


def hierarchy(spark: SparkSession, sf_dir: str, mode: str = "roots") -> Hierarchy:
    links, nodes = links_and_nodes(spark, sf_dir)
    return contract(links, nodes, mode=mode)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy(spark, sf_dir)
    rows = h.labels.select(F.col("node").alias("node_id"), F.col("source").alias("root_id"), F.col("depth").cast("long").alias("depth"))
    return rows.union(h.cyclic.select("node", "node", F.lit(-1).cast("long")))


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each concept and each of its roots the shortest path, ids joined by ``>``."""
    h = hierarchy(spark, sf_dir, "paths")
    return h.labels.select(F.col("node").alias("node_id"), F.col("source").alias("root_id"), F.col("depth").cast("long").alias("depth"), F.concat_ws(">", "path").alias("path"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, descendant_id, depth): every concept with every concept below it, itself left out."""
    h = hierarchy(spark, sf_dir, "descendants")
    return h.labels.filter("source <> node").select(F.col("source").alias("node_id"), F.col("node").alias("descendant_id"), F.col("depth").cast("long").alias("depth"))


QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants}

_SPACE = r"[\s\p{Z}\v\x1c-\x1f\x{85}]"
_SQL_ID = rf"nullif(upper(regexp_replace(X, '^{_SPACE}+|{_SPACE}+$', '', 'g')), '')"
_SQL_LINKS = rf"""n as (select regexp_replace(regexp_replace(upper(regexp_replace(tree_number, '^{_SPACE}+|{_SPACE}+$', '', 'g')), '\.$', ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') num, {_SQL_ID.replace("X", "mesh_id")} id from mesh_tree),
t as (select distinct num, id from n where id is not null), g as (select {_SQL_ID.replace("X", "parent_id")} p, {_SQL_ID.replace("X", "child_id")} c from mesh_parent),
l as (select p, c from g where p is not null and c is not null union select a.id, b.id from t a join t b on a.num <> '' and contains(b.num, '.') and regexp_replace(b.num, '\.[^.]*$', '') = a.num),
v as (select p node from g where p is not null union select c from g where c is not null union select id from t)"""
# the shortest way from a root has fewer links than there are nodes; who can be reached from itself shows in the closure
ORACLES = {
    "p1_found": f"""with recursive {_SQL_LINKS}, m as (select count(*) n from v),
w as (select node, node root, 0 d from v where node not in (select c from l) union select l.c, w.root, w.d + 1 from w join l on l.p = w.node where w.d < (select n from m)),
closure as (select p, c from l union select k.p, l.c from closure k join l on k.c = l.p)
select node node_id, root root_id, cast(min(d) as bigint) depth from w group by 1, 2 union all select p, p, -1 from closure where p = c""",
}
