"""Vector retrieval and grouping by similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.runtime import cut


def top_k(queries: DataFrame, index: DataFrame, *, k: int, category: bool = False, block_rows: int = 20_000) -> DataFrame:
    """(query_id, ref_id, score, rank): the ``k`` nearest distinct refs of each query by cosine, ties by id.

    queries: (query_id, vec[, category]); index: (ref_id, vec[, category]). ``category``: only refs of the query's own.
    Both sides are cut into blocks of about ``block_rows`` vectors; each pair of blocks is one task on an executor, which multiplies
    two matrices and keeps k refs for each query, and the partial results are merged by rank. Nothing goes through the driver.
    """
    cat = ["category"] if category else []
    size = lambda df: max(1, -(-df.count() // block_rows))
    n_q, n_x = size(queries), size(index)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "vec", *cat, block("query_id", n_q).alias("qb"), each(n_x).alias("xb"))
    right = index.select("ref_id", "vec", *cat, block("ref_id", n_x).alias("xb"), each(n_q).alias("qb"))

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        kinds = q["category"].unique() if category else [None]
        x = x.sort_values("ref_id", kind="stable")
        for kind in kinds:
            qs, xs = (q[q["category"] == kind], x[x["category"] == kind]) if category else (q, x)
            if not len(qs) or not len(xs):
                continue
            mat = np.array(xs["vec"].tolist(), np.float64)
            norm = np.linalg.norm(mat, axis=1)
            ids, first = np.unique(xs["ref_id"].to_numpy(), return_index=True)
            for at in range(0, len(qs), 1000):
                part = qs.iloc[at : at + 1000]
                m = np.array(part["vec"].tolist(), np.float64)
                s = np.round((m @ mat.T) / np.maximum(np.outer(np.linalg.norm(m, axis=1), norm), 1e-12), 6)
                s = np.maximum.reduceat(s, first, axis=1)  # a ref's best vector
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                for i, qid in enumerate(part["query_id"]):
                    near = np.flatnonzero(s[i] >= least[i])
                    near = near[np.argsort(-s[i, near], kind="stable")][:k]  # refs stand in the order of their ids
                    out += [(qid, ids[j], s[i, j]) for j in near]
        return pd.DataFrame(out, columns=["query_id", "ref_id", "score"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    out = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInPandas(search, f"query_id {kind(queries, 'query_id')}, ref_id {kind(index, 'ref_id')}, score double")
    best = out.groupBy("query_id", "ref_id").agg(F.max("score").alias("score"))
    ranked = best.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ref_id"))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("i", "t")).select("query_id", F.col("t.ref_id").alias("ref_id"), (-F.col("t.s")).alias("score"), (F.col("i") + 1).alias("rank"))


def similar_pairs(vectors: DataFrame, *, threshold: float, block_rows: int = 200_000) -> DataFrame:
    """(a, b): all pairs of nodes a < b whose cosine is at least ``threshold``. vectors: (node, vec), one row per node.

    Complete: the vectors go around in blocks of at most ``block_rows``, each broadcast and multiplied with every batch.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-vectors.count() // block_rows))
    kind = vectors.schema["node"].dataType.simpleString()
    out = None
    for b in range(blocks):
        pdf = vectors.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == b).select("node", "vec").toPandas()
        ids, mat = pdf["node"].to_numpy(), np.array(pdf["vec"].tolist(), np.float64).reshape(len(pdf), -1)
        bc = spark.sparkContext.broadcast((ids, mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-12)))

        def pairs(batches, bc=bc):
            ids, mat = bc.value
            for q in batches:
                if not len(ids) or not len(q):
                    continue
                m = np.array(q["vec"].tolist(), np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                own = q["node"].to_numpy()
                # few rows at a time, so that the similarities of a large block stay small
                step = max(1, 4_000_000 // len(ids))
                for at in range(0, len(m), step):
                    i, j = np.nonzero(m[at : at + step] @ mat.T >= threshold)
                    a, b = own[at + i], ids[j]
                    yield pd.DataFrame({"a": a[a < b], "b": b[a < b]})

        part = vectors.select("node", "vec").mapInPandas(pairs, f"a {kind}, b {kind}")
        out = part if out is None else out.union(part)
    return out


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component; edges (a, b) in one direction are enough.

    All nodes of one label take the least label that any of them has as a neighbour, and then that label's own new label
    (pointer jumping), so settled regions merge as a whole. It ends when no label moves. Each round is checkpointed.
    """
    from sievework.runtime import cut

    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    state = cut(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hook = state.join(near, "node", "left").groupBy("component").agg(F.min(F.least("component", F.coalesce("near", "component"))).alias("low"))
        low = cut(state.join(hook, "component"))
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("far"))
        new = cut(low.join(jump, "low").select("node", F.least("low", "far").alias("component"), (F.least("low", "far") < F.col("component")).alias("moved")))
        state = new.drop("moved")
        if new.filter("moved").isEmpty():
            return state
