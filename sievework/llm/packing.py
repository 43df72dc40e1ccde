"""Items into containers of fixed capacity by hierarchical residual packing.

Each partition packs its own items by best fit, the largest first. Containers filled to ``nearly_full`` are done. The
others go up a tree as items: groups of ``fan_in`` partitions pack them together again by best fit, until one group is
left. No item is moved more than its container's name.

What has to go up is bounded without loss. After a packing no two containers of a group fit together, so at most one of
them is half empty; and two containers can only be merged if one of them is. So there are at most as many mergers as half
empty containers in all, say ``h`` (one for each leaf at most), and the ``2 h`` roomiest containers of each group, themselves
included, serve them as well as all would, whatever their fills; the rest stay as they are. A task above the leaves holds
``2 * fan_in * h`` names.

Defined results: an item above the capacity is split into full containers and a rest, which is packed like an item; null
and zero sizes take no container and give no row; negative sizes raise an error; items of one id in several rows are
packed each for itself; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.runtime import broadcast_if_small, cut


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """(container of each size, fill of each container), largest first, each into the fullest container that has room."""
    where, fills = np.empty(len(sizes), np.int64), []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: there is a container with room r
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            fills[bin_] += size
        else:
            bin_ = len(fills)
            fills.append(size)
            room = capacity
        left = room - size
        if left:
            by_room.setdefault(left, []).append(bin_)
            rooms |= 1 << left
        where[i] = bin_
    return where, fills


def pack(df: DataFrame, *, id_col: str, size_col: str, capacity: int, nearly_full: float = 0.995, fan_in: int = 8, chunk: int = 1_000_000) -> DataFrame:
    """(id_col, part, start, size, container_id) of every part of every item. part counts from 0, start is the part's place in its item.

    chunk: a partition of more items is packed in leaves of so many, which the tree brings together like those of partitions.
    """
    enough = int(np.ceil(capacity * nearly_full))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("item"), F.col(size_col).cast("long").alias("size")).filter("size <> 0")

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partition, made, held, count = TaskContext.get().partitionId(), 0, [], 0
        for pdf in batches:
            held.append(pdf)
            count += len(pdf)
            if count >= chunk:
                out, n = _pack_leaf(pd.concat(held), capacity, (partition << 33) + made)
                made, held, count = made + n, [], 0
                yield out
        if held:
            yield _pack_leaf(pd.concat(held), capacity, (partition << 33) + made)[0]

    placed = cut(rows.mapInPandas(leaf, f"item {kind}, part long, start long, size long, bin long, fill long, grp long"))
    opened = cut(placed.filter(F.col("fill") < enough).select("bin", "fill", "grp").distinct())
    moves = []
    leaves = placed.agg(F.max("grp")).first()[0]
    carry = 2 * opened.filter(F.col("fill") * 2 <= capacity).count()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "bin"], kind="stable")
        where, fills = best_fit(pdf["fill"].to_numpy(), capacity)
        # a merged container keeps the name of its fullest part
        order = np.argsort(-pdf["fill"].to_numpy(), kind="stable")
        names = np.full(len(fills), -1, np.int64)
        for i in order:
            if names[where[i]] < 0:
                names[where[i]] = pdf["bin"].iat[i]
        out = pd.DataFrame({"bin": pdf["bin"].to_numpy(), "into": names[where], "fill": np.array(fills, np.int64)[where]})
        out["grp"] = int(pdf["grp"].iat[0])
        out["up"] = (out["bin"] == out["into"]) & (out["fill"] < enough)
        return out[out["up"] | (out["bin"] != out["into"])]

    groups = (leaves or 0) + 1
    while carry:
        groups = -(-groups // fan_in)
        roomiest = Window.partitionBy("grp").orderBy("fill", "bin")
        opened = opened.withColumn("place", F.row_number().over(roomiest)).filter(F.col("place") <= carry).drop("place")
        step = cut(opened.withColumn("grp", F.floor(F.col("grp") / fan_in)).groupBy("grp").applyInPandas(merge, "bin long, into long, fill long, grp long, up boolean"))
        moves.append(step.filter("bin <> into").select("bin", "into"))
        opened = step.filter("up").select("bin", "fill", "grp")
        if groups == 1:
            break
    out = placed
    for step in moves:
        out = out.join(broadcast_if_small(step), "bin", "left").withColumn("bin", F.coalesce("into", "bin")).drop("into")
    return out.select(F.col("item").alias(id_col), "part", "start", "size", F.col("bin").alias("container_id"))


def _pack_leaf(pdf: pd.DataFrame, capacity: int, base: int) -> tuple[pd.DataFrame, int]:
    """The leaf's parts with their containers, numbered from ``base``; how many containers there are."""
    size = pdf["size"].to_numpy()
    if (size < 0).any():
        raise ValueError("sizes must not be negative")
    parts = -(-size // capacity)
    item = np.repeat(np.arange(len(pdf)), parts)
    part = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
    sizes = np.minimum(size[item] - part * capacity, capacity)
    where, fills = best_fit(sizes, capacity)
    fill = np.array(fills, np.int64)
    return pd.DataFrame({"item": pdf["item"].to_numpy()[item], "part": part, "start": part * capacity, "size": sizes, "bin": base + where, "fill": fill[where], "grp": base >> 33}), len(fills)
