"""Filling of missing values from similar rows: k-prototypes clusters, then the rows' own group.

Rows are clustered on their observed numeric and categorical features (squared scaled difference, plus gamma for each
category that differs; a missing feature neither brings rows together nor parts them). Categories are compared by their
64-bit hashes, so texts of any length are features. A missing value is filled from the rows of the same group in the same
cluster (their mode, or their median), else from the whole group, else, for medians, from the whole cluster, and the method
is told. Prototypes are few, so they travel as literals and the assignment stays an expression without a shuffle.

Defined results: a null group key fills nothing; a group without observed values fills nothing by modes; ties go to the value
of more samples, then the smaller one; repeated rows of one sample count once; with no rows at all the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.skew import hot_join
from sievework.runtime import cut, release


@dataclass
class Prototypes:
    """The centres of the clusters; a cluster's number is its place. numeric: the scale of each numeric feature."""

    numeric: dict[str, float]
    gamma: float
    centres: list[dict] = field(default_factory=list)

    def assign(self, feature: dict[str, Column]) -> Column:
        """(d, i): the distance and number of a row's nearest centre, the first among equals, by its features."""
        if not self.centres:
            return F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("i"))

        # the centres are one literal, so the compiled plan of a round serves for all rounds
        centres = F.array(*[F.struct(*[F.lit(c[n]).cast("double" if n in self.numeric else "long").alias(n) for n in feature]) for c in self.centres])

        def distance(c: Column) -> Column:
            parts = [F.coalesce(F.pow((x - c[n]) / F.lit(self.numeric[n]), F.lit(2.0)), F.lit(0.0)) if n in self.numeric else F.when(x.isNull() | c[n].isNull() | (x == c[n]), 0.0).otherwise(self.gamma) for n, x in feature.items()]
            return sum(parts, F.lit(0.0))

        return F.array_min(F.transform(centres, lambda c, i: F.struct(distance(c).alias("d"), i.alias("i"))))


def _features(numeric: list[str], categorical: list[str]) -> dict[str, Column]:
    out = {f"n{i}": F.col(c).cast("double") for i, c in enumerate(numeric)}
    return out | {f"c{i}": F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c).cast("string"))) for i, c in enumerate(categorical)}


def k_prototypes(df: DataFrame, numeric: list[str], categorical: list[str], *, k: int = 12, gamma: float = 1.0, tolerance: float = 0.03) -> Prototypes:
    """Centres of ``df``'s rows. The start is the ``k`` most frequent combinations of features; rounds move the centres to the
    weighted mean and modes of their rows until that makes the rows' distances less than ``tolerance`` smaller. Only the
    centres (``k`` rows) come to the driver."""
    feature = _features(numeric, categorical)
    points = cut(df.select(*[f.alias(n) for n, f in feature.items()]).groupBy(*feature).agg(F.count(F.lit(1)).alias("weight")))
    nums, cats = [n for n in feature if n[0] == "n"], [n for n in feature if n[0] == "c"]
    scales = points.agg(*[F.stddev_pop(n).alias(n) for n in nums]).first() if nums else {}
    out = Prototypes({n: (scales[n] or 1.0) for n in nums}, gamma)
    out.centres = [{n: r[n] for n in feature} for r in points.orderBy(F.desc("weight"), *feature).limit(k).collect()]
    # one row for each feature and one for the distance: a category is counted by value, a number summed
    cell = lambda at, value, x: F.struct(F.lit(at).alias("at"), value.cast("long").alias("value"), x.cast("double").alias("x"))
    none = F.lit(None)
    cell = F.array(*[cell(n, none, F.col(n)) for n in nums], *[cell(n, F.col(n), F.lit(0)) for n in cats], cell("d", none, F.col("near.d")))
    cost = float("inf")
    while out.centres:
        near = points.select(out.assign({n: F.col(n) for n in feature}).alias("near"), "weight", *feature)
        cells = near.select(F.col("near.i").alias("cluster"), "weight", F.inline(cell))
        sums = cells.filter("x is not null and (value is not null or at not like 'c%')").groupBy("cluster", "at", "value").agg(F.sum("weight").alias("n"), F.sum(F.col("x") * F.col("weight")).alias("x"))
        best = {(r["cluster"], r["at"]): r["b"] for r in sums.groupBy("cluster", "at").agg(F.min(F.struct((-F.col("n")).alias("n"), "value", "x")).alias("b")).collect()}
        now = sum(b["x"] for (_, at), b in best.items() if at == "d")
        if now >= cost * (1 - tolerance):
            break
        cost, held = now, {c for c, _ in best}
        middle = lambda i, n: None if (i, n) not in best else best[i, n]["x"] / -best[i, n]["n"] if n in nums else best[i, n]["value"]
        out.centres = [{n: middle(i, n) for n in feature} if i in held else c for i, c in enumerate(out.centres)]
    return out


def fill_from_similar(df: DataFrame, *, id_col: str, target: str, group: list[str], sample: str | None = None, numeric: list[str] = (), categorical: list[str] = (), median: bool = False, k: int = 12) -> DataFrame:
    """(id_col, value, method, samples, agree, group_value, group_samples, group_agree) of every row whose ``target`` is null and that could be filled.

    ``group``: the columns in which a donor must agree (the parent level). ``sample``: what counts as one vote (the row by
    default). value comes from the row's cluster within its group (method ``cluster_mode`` / ``cluster_median``), by fallback
    from its group (``group_mode`` / ``group_median``) or, for medians, from its cluster over all groups (``similar_median``);
    samples have a value there, and agree of them have this one (null for medians). The group's own are told beside it.
    """
    numeric, categorical = list(numeric), list(categorical)
    centres = k_prototypes(df, numeric, categorical, k=k)
    release(df.sparkSession)
    names = [f"g{i}" for i in range(len(group))]
    rows = df.select(F.col(id_col).alias("rid"), F.col(target).alias("value"), (F.col(sample) if sample else F.col(id_col)).alias("sample"), centres.assign(_features(numeric, categorical))["i"].alias("cluster"), *[F.col(c).alias(g) for c, g in zip(group, names)])
    rows = cut(rows.filter(" and ".join(f"{g} is not null" for g in names)))
    missing = rows.filter("value is null").select("rid", "cluster", *names)
    keys = [*names, "cluster"]
    if median:
        level = lambda by: _medians(rows, by)
    else:
        votes = cut(rows.filter("value is not null").select(*keys, "value", "sample").distinct())
        level = lambda by: _modes(votes, by)
    need = cut(missing.groupBy(*keys).agg(F.count(F.lit(1)).alias("need")))
    total = need.agg(F.sum("need")).first()[0] or 0
    fill = F.struct("value", "samples", "agree")
    near = cut(level(keys).join(need, keys).select(*keys, fill.alias("c"), "need"))
    parent = cut(level(names).join(need.groupBy(*names).agg(F.sum("need").alias("need")), names).select(*names, fill.alias("p"), "need"))
    got = hot_join(hot_join(missing, near, keys, "need", total, how="left"), parent, names, "need", total, how="left")
    what = "median" if median else "mode"
    pick, method = F.coalesce("c", "p"), F.when(F.col("c").isNotNull(), f"cluster_{what}").otherwise(f"group_{what}")
    if median:  # k rows
        got = got.join(F.broadcast(level(["cluster"]).select("cluster", fill.alias("s"))), "cluster", "left")
        pick, method = F.coalesce("c", "p", "s"), F.when(F.coalesce("c", "p").isNull(), "similar_median").otherwise(method)
    out = got.select("rid", pick.alias("x"), method.alias("method"), "p").filter("x is not null")
    return out.select(F.col("rid").alias(id_col), "x.value", "method", "x.samples", "x.agree", *[F.col(f"p.{c}").alias(f"group_{c}") for c in ("value", "samples", "agree")])


def _modes(votes: DataFrame, keys: list[str]) -> DataFrame:
    """The value that most samples agree on. Samples are made distinct before they are counted, so a large group is spread over its samples."""
    each = votes.select(*keys, "value", "sample").distinct().groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    top = each.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("top"))
    size = votes.select(*keys, "sample").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    return top.join(size, keys).select(*keys, F.col("top.value").alias("value"), "samples", (-F.col("top.n")).alias("agree"))


def _medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Exact medians over value counts (few distinct values stand for many rows)."""
    each = rows.filter("value is not null").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*keys).agg(F.expr("percentile(cast(value as double), 0.5, n)").alias("value"), F.sum("n").alias("samples")).withColumn("agree", F.lit(None).cast("long"))
