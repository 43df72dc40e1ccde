"""Evaluation measures as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prf(tp: Column, fp: Column, fn: Column, tn: Column | None = None) -> list[Column]:
    """precision, recall, f1 and (with tn) accuracy to four places; null where nothing was counted."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    out = [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1")]
    return out + ([F.round(F.try_divide(tp + tn, tp + fp + fn + tn), 4).alias("accuracy")] if tn is not None else [])


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k in n, clamped to 0..1; null for n = 0."""
    p = F.try_divide(k, n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    mid = (p + F.try_divide(F.lit(z * z), 2 * n)) / d
    half = z * F.sqrt(F.greatest(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n), F.lit(0.0))) / d
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def cluster_bootstrap(per: DataFrame, *, draws: int, seed: int = 42) -> DataFrame:
    """(draw, rate): ``draws`` resamples of clusters. per: (cluster, ok, n). Each cluster's number of appearances in a draw is
    Poisson-distributed by a hash of cluster, draw and seed, so draws need no central index and any cluster's copies are
    worked out where it is; per draw only the two sums travel."""
    u = (F.pmod(F.xxhash64("cluster", "draw", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    # inverse of the Poisson(1) distribution: bounds of 0, 1, 2, ... appearances
    bounds = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]
    times = sum(F.when(u > b, 1).otherwise(0) for b in bounds)
    rows = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("times", times).filter("times > 0")
    return rows.groupBy("draw").agg((F.sum(F.col("ok") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("rate"))
