"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_join(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int, *, how: str = "inner", hot: int = 1000) -> DataFrame:
    """``left`` with ``right``, which has one row per key and in ``n`` the key's rows in ``left``.

    Keys with more than ``total / hot`` rows, of which there are fewer than ``hot``, are joined by a broadcast of that
    proven size, the rest by shuffle, so no task gets more than about ``total / hot`` rows of one key. ``n`` is dropped.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    limit = max(total // hot, 1)
    many, few = right.filter(F.col(n) > limit), right.filter(F.col(n) <= limit)
    keys = F.broadcast(many.select(*on))
    return left.join(F.broadcast(many.drop(n)), on).unionByName(left.join(keys, on, "left_anti").join(few.drop(n), on, how))


def hubs(counts: DataFrame, key: str, n: str, total: int, *, hot: int = 1000, least: int = 20_000) -> dict:
    """Key -> number of parts for the keys of ``counts`` (one row per key, ``n`` its rows) with more than ``total / hot``
    rows, of which there are fewer than ``hot``; keys of up to ``least`` rows fit one task anyway."""
    limit = max(total // hot, least)
    return {r[0]: -(-r[1] // limit) for r in counts.filter(F.col(n) > limit).select(key, n).collect()}


def salted_join(left: DataFrame, right: DataFrame, on: str, parts: dict, spread: list[str], how: str = "inner") -> DataFrame:
    """``left`` with ``right``, where the rows of ``left`` with a key of ``parts`` are spread by a hash of the columns ``spread``
    over that many parts, and the rows of ``right`` repeated for each part. Without hot keys it is a plain join."""
    if not parts:
        return left.join(right, on, how)
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(parts.items())])
    n = F.coalesce(F.element_at(table, F.col(on)), F.lit(1))
    left = left.withColumn("salt_", F.pmod(F.xxhash64(*spread), n))
    right = right.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    return left.join(right, [on, "salt_"], how).drop("salt_")
