import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm.packing import best_fit, pack


def placed(df, **kw):
    bins, items = defaultdict(int), defaultdict(list)
    for r in pack(df, id_col="id", size_col="n", capacity=100, **kw).collect():
        bins[r.container_id] += r["size"]
        items[r.id].append((r.part, r.start, r["size"]))
    return bins, items


def test_best_fit_never_overfills_and_leaves_no_two_that_fit():
    rnd = random.Random(2)
    where, fills = best_fit(np.array([rnd.randint(1, 60) for _ in range(500)]), 100)
    assert len(where) == 500 and max(fills) <= 100
    low = sorted(fills)
    assert low[0] + low[1] > 100


def test_all_tokens_placed_once_and_merged_across_partitions(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([1, 5, 20, 37, 55, 99, 100, 101, 250])) for i in range(600)]
    bins, items = placed(spark.createDataFrame(rows, "id long, n long").repartition(16), fan_in=4)
    assert max(bins.values()) <= 100 and sum(bins.values()) == sum(n for _, n in rows)
    for i, n in rows:
        parts = sorted(items[i])
        assert sum(s for _, _, s in parts) == n and [p for p, _, _ in parts] == list(range(len(parts))) and [a for _, a, _ in parts] == [100 * p for p, _, _ in parts]
        assert len(parts) == -(-n // 100)
    assert len(bins) <= 1.03 * sum(n for _, n in rows) / 100 + 1


def test_no_pair_fits_anyhow(spark):
    bins, _ = placed(spark.createDataFrame([(i, 60) for i in range(50)], "id long, n long").repartition(8))
    assert sorted(bins.values()) == [60] * 50


def test_nulls_zeros_repeats_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 7), (2, 0, 7), (3, 40, 7), (3, 40, 7)], "id long, n long, bin long")
    bins, items = placed(df)
    assert sorted(bins.values()) in ([80], [40, 40]) and set(items) == {3}
    assert pack(df.limit(0), id_col="id", size_col="n", capacity=100).count() == 0


def test_negative_sizes_fail(spark):
    with pytest.raises(Exception, match="negative"):
        pack(spark.createDataFrame([(1, -1)], "id long, n long"), id_col="id", size_col="n", capacity=10).count()


def test_a_million_containers_of_one_fill(spark):
    """No two fit together, so nothing goes up the tree but what a half empty container could need."""
    df = spark.range(1_000_000).select("id", F.lit(60).cast("long").alias("n"))
    out = pack(df.union(spark.createDataFrame([(-1, 30), (-2, 35)], "id long, n long")), id_col="id", size_col="n", capacity=100, chunk=100_000)
    fills = out.groupBy("container_id").agg(F.sum("size").alias("f")).groupBy("f").count().collect()
    assert {r.f: r["count"] for r in fills} == {60: 999_998, 90: 1, 95: 1}


def test_half_empty_containers_of_all_leaves_meet(spark):
    rows = [(i, 90) for i in range(40)] + [(100 + i, 12) for i in range(8)]
    bins, _ = placed(spark.createDataFrame(rows, "id long, n long").repartition(8, "id"), fan_in=2, chunk=3)
    small = [f for f in bins.values() if f < 90]
    assert sum(bins.values()) == 40 * 90 + 8 * 12 and len(small) == 1 or sum(f <= 50 for f in bins.values()) <= 1
